"""Readers. All are lazy and leave pruning and pushdown to the scan."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lmprep.cluster import ensure_checkpoint_dir
from lmprep.sources.json_arrays import json_array_lines
from lmprep.sources.specs import (
    SourceSpec,
    is_data_file,
    is_json_lines,
    parse_prompt_spec,
    parse_source_spec,
    parse_validation_spec,
    path_exists,
)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """UTF-8 JSON files that hold an array of records each.

    The arrays are cut into records in parallel and written once, as compressed lines, to the checkpoint folder; the reader then works on
    those lines. A file that holds anything else, such as a second array or lines of records, raises ``ValueError``.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    try:
        json_array_lines(spark, path).write.option("compression", "gzip").text(folder)
    except PySparkException as e:
        if "not one JSON array" not in str(e):
            raise
        raise ValueError(f"{path} holds a file that is not one JSON array of records; use read_json_lines for lines of records") from e
    return read_json_lines(spark, folder, schema)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """UTF-8 files of one JSON record a line, as ``write_predictions_json`` makes them. Large files are split over tasks."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def open_table(spark: SparkSession, name: str) -> DataFrame:
    """A Parquet path, or a table or view of the session."""
    if "/" in name and path_exists(spark, name):
        return spark.read.parquet(name)
    return spark.table(name)


def filter_subset(df: DataFrame, lang: str | None = None, split: str | None = None) -> DataFrame:
    """Rows of a language and split; both conditions reach the scan, or prune partitions when laid out so."""
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def read_dataset(spark: SparkSession, name: str, subset: str | None = None, split: str = "train") -> DataFrame:
    """One split of a named dataset. A table without a ``split`` column is all ``train``."""
    df = open_table(spark, name)
    if "split" not in df.columns:
        if split != "train":
            raise ValueError(f"{name} has no split column, so no split {split!r}")
        return filter_subset(df, subset)
    return filter_subset(df, subset, split)


def read_spec(spark: SparkSession, spec: SourceSpec, schema: T.StructType | None = None) -> DataFrame:
    if spec.is_file and is_json_lines(spark, spec.name):
        return read_json_lines(spark, spec.name, schema)
    if spec.is_file:
        return read_json_records(spark, spec.name, schema)
    return read_dataset(spark, spec.name, spec.subset, spec.split)


def read_source(spark: SparkSession, spec: str, split: str = "train", schema: T.StructType | None = None) -> DataFrame:
    """One training source by spec."""
    (parsed,) = parse_source_spec(spec, split, exists=lambda p: is_data_file(spark, p))
    return read_spec(spark, parsed, schema)


def read_prompts(spark: SparkSession, spec: str | None, schema: T.StructType | None = None) -> DataFrame:
    parsed = parse_prompt_spec(spec, exists=lambda p: is_data_file(spark, p))
    return read_spec(spark, parsed, schema)


#: Order key of a corpus that has none of its own.
SOURCE_KEY = "source_key"


def with_source_key(df: DataFrame, name: str = SOURCE_KEY) -> DataFrame:
    """Add the place of each row in its Parquet files, (file, row), which sorts as the files lie.

    It does not depend on how the files are split over tasks, nor on filters. ``df`` must read Parquet files directly; other
    sources do not number their rows and raise ``ValueError``.
    """
    if name in df.columns:
        raise ValueError(f"the source has a column {name} already")
    try:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return df.select("*", place.alias(name))
    except AnalysisException as e:
        raise ValueError("only rows of Parquet files have a place; give an order key") from e


def read_in_order(spark: SparkSession, path: str, name: str = "place") -> DataFrame:
    """Rows of a Parquet folder that Spark wrote, numbered from 0 in ``name`` in the order in which they were written.

    A sorted result is written in sorted order: part files by number, rows by their place in the file. Only these two numbers
    are ranked, by the row counts of the parts; nothing is sorted.
    """
    rows = spark.read.parquet(path)
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    file = F.col("_metadata.file_path")
    # a struct of their own, so that no name of theirs can clash
    keyed = rows.select(F.struct("*").alias("_data"), file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    number = F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    order = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = keyed.groupBy("_file").agg(F.count("*").alias("_n"))
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    placed = keyed.join(F.broadcast(starts) if _few_files(rows) else starts, "_file")
    return placed.select("_data.*", (F.col("_start") + F.col("_row")).alias(name))


def _few_files(df: DataFrame, limit: int = 100_000) -> bool:
    return len(df.inputFiles()) <= limit


def scan_raw_text(
    spark: SparkSession, specs: str, split: str = "train", order_key: str | None = "doc_id", text: str = "text"
) -> dict[str, DataFrame]:
    """One lazy two-column scan per corpus of a comma list.

    With ``order_key`` None corpora need only a text; their rows are keyed by their place in the files, as ``source_key``.
    """
    found = {}
    for i, spec in enumerate(parse_source_spec(specs, split, many=True)):
        name = spec.name.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
        label = f"{name}:{spec.subset}" if spec.subset else name
        label = label if label not in found else f"{label}#{i}"
        rows = read_spec(spark, spec)
        found[label] = rows.select(order_key, text) if order_key else with_source_key(rows).select(SOURCE_KEY, text)
    return found


def read_pretokenized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_validation_sets(spark: SparkSession, spec: str, schema: T.StructType | None = None) -> dict[str | None, DataFrame]:
    return {
        name: read_source(spark, path, split="validation", schema=schema)
        for name, path in parse_validation_spec(spec)
    }


def union_validation_sets(sets: dict[str | None, DataFrame]) -> DataFrame:
    """All named sets in one relation with ``eval_name``."""
    tagged = [df.withColumn("eval_name", F.lit(name).cast("string")) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def project_text(df: DataFrame, field: str = "text") -> DataFrame:
    return df.select(F.col(field).alias("prompts"))


def dataset_info(data: DataFrame | dict[str, DataFrame], name: str | Column = "eval_name") -> DataFrame:
    """Example count per named dataset, or of a single one."""
    if isinstance(data, dict):
        data = union_validation_sets({k: v.select() for k, v in data.items()})
        name = "eval_name"
    elif isinstance(name, str) and name not in data.columns:
        data = data.withColumn(name, F.lit("all"))
    return data.groupBy(name).agg(F.count("*").alias("n_examples"))
