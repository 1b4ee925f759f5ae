"""Spec grammars of training, validation and inference sources, and prompt-format files."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lmprep.functions.templates import DEFAULT_PROMPTS


#: Scheme and host of an address with a path, whose colons separate nothing: ``s3a://bucket``, ``hdfs://host:8020``, ``file:``.
_PLACE = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)")
_LINES_SUFFIX = (".jsonl", ".jsonl.gz", ".jsonl.bz2", ".jsonl.zst")


@dataclass(frozen=True)
class SourceSpec:
    """A named dataset with optional language subset and split; or a JSON file."""

    name: str
    subset: str | None = None
    split: str = "train"
    is_file: bool = False


def _fields(item: str) -> list[str]:
    """The parts of a spec between its colons; the first one may be an address."""
    place = _PLACE.match(item)
    start = place.end() if place else 0
    first, *others = item[start:].split(":")
    return [item[:start] + first, *others]


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def is_data_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is JSON: a file that is not named as Parquet, or a folder that holds ``*.json`` or ``*.jsonl`` files."""
    if path.rstrip("/").endswith(".parquet") or len(_fields(path)) > 1 or not path_exists(spark, path):
        return False
    system, target = _file_system(spark, path)
    if not system.getFileStatus(target).isDirectory():
        return True
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, "*.json*")
    return len(system.globStatus(inside)) > 0


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether a JSON path holds lines of records: by its suffix or, for a folder, by files that are named as lines or as Spark
    names the lines it writes."""
    if path.endswith(_LINES_SUFFIX):
        return True
    system, target = _file_system(spark, path)
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, "{part-*.json*,*.jsonl*}")
    return system.getFileStatus(target).isDirectory() and len(system.globStatus(inside)) > 0


def parse_source_spec(
    spec: str, split: str = "train", many: bool = False, exists: Callable[[str], bool] = lambda _: False
) -> list[SourceSpec]:
    """Training grammar: an existing JSON file, else ``name:subset``, else ``name``.

    ``many`` allows a comma list (raw-text training), where a file is not looked for.
    """
    if not spec:
        raise ValueError("No datasets found")
    if not many and exists(spec):
        return [SourceSpec(spec, split=split, is_file=True)]
    found = []
    for item in spec.split(",") if many else [spec]:
        parts = _fields(item)
        if len(parts) > 2:
            raise ValueError(f"expected name or name:subset, got {item!r}")
        found.append(SourceSpec(parts[0], parts[1] if len(parts) == 2 else None, split))
    return found


def parse_prompt_spec(spec: str | None, exists: Callable[[str], bool] = lambda _: False) -> SourceSpec:
    """Inference grammar: an existing file, ``name:split``, or ``name:subset:split``."""
    if spec is None:
        raise ValueError("No prompt file provided.")
    if exists(spec):
        return SourceSpec(spec, is_file=True)
    parts = _fields(spec)
    if len(parts) == 2:
        return SourceSpec(parts[0], None, parts[1])
    if len(parts) == 3:
        return SourceSpec(*parts)
    if len(parts) == 1:
        raise ValueError(f"{spec!r} names no split; use name:split")
    raise ValueError(f"Invalid prompt file format: {spec}")


def check_unique_names(names: Iterable[str]) -> None:
    repeated = [name for name, n in Counter(names).items() if n > 1]
    if repeated:
        raise ValueError(f"Duplicate dataset name: {repeated[0]}")


def parse_validation_spec(spec: str) -> list[tuple[str | None, str]]:
    """``name:path,name:path`` to named sets; without a comma one unnamed set."""
    if "," not in spec:
        return [(None, spec)]
    items = spec.split(",")
    if any(":" not in item or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", item) for item in items):
        raise ValueError("several validation sets need the form name:path")
    named = [tuple(item.split(":", 1)) for item in items]
    check_unique_names(name for name, _ in named)
    return named


def load_prompt_format(spark: SparkSession | None = None, path: str | None = None) -> dict[str, str]:
    """The two default templates, or those of a JSON object file (read through Spark, so from any file system)."""
    if path is None:
        return dict(DEFAULT_PROMPTS)
    whole = spark.read.text(path, wholetext=True).first()[0]
    prompts = json.loads(whole)
    missing = {"prompt_input", "prompt_no_input"} - set(prompts)
    if missing:
        raise ValueError(f"prompt format lacks {sorted(missing)}")
    return prompts
