"""Evaluation tasks as rows, and the documents each of them scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lmprep.functions.templates import (
    DECONTAMINATION_QUERY,
    LANGUAGE_NAMES,
    READING_PROMPT,
    TOPIC_PROMPT,
    language_name,
)
from lmprep.sources.readers import read_dataset

TASK_FIELDS = (
    "task", "group", "dataset_path", "dataset_name", "test_split", "fewshot_split", "sampler",
    "output_type", "should_decontaminate", "decontamination_query", "prompt_template", "target_template", "metrics",
)

# Settings that all tasks of a family share.
FAMILY_BASES: dict[str, dict[str, object]] = {
    "reading": {
        "group": "belebele", "output_type": "multiple_choice", "should_decontaminate": True, "sampler": "first_n",
        "test_split": "test", "fewshot_split": "test", "prompt_template": READING_PROMPT,
        "decontamination_query": DECONTAMINATION_QUERY["reading"],
        "target_template": "{{correct_answer_num}}", "metrics": "acc,acc_norm",
    },
    "topic": {
        "group": "sib200", "output_type": "multiple_choice", "should_decontaminate": True,
        "test_split": "test", "fewshot_split": "validation", "prompt_template": TOPIC_PROMPT,
        "decontamination_query": DECONTAMINATION_QUERY["topic"],
        "target_template": "{{category}}", "metrics": "acc,acc_norm",
    },
    "translation": {
        "group": "flores", "output_type": "generate_until", "should_decontaminate": True, "sampler": "first_n",
        "test_split": "devtest", "metrics": "chrf,bleu",
    },
}


def _slot(code: Column) -> Column:
    return F.concat(F.lit("{{sentence_"), code, F.lit("}}"))


def _with_base(own: DataFrame, base: Mapping[str, object]) -> DataFrame:
    """Inherit the base's fields as literals; a field the task has itself wins."""
    shown = []
    for name in TASK_FIELDS:
        inherited = F.lit(base.get(name))
        value = F.coalesce(F.col(name), inherited) if name in own.columns else inherited
        shown.append(value.cast("boolean" if name == "should_decontaminate" else "string").alias(name))
    return own.select(*shown)


def build_eval_tasks(
    pairs: DataFrame, base: Mapping[str, object] | None = None, names: Mapping[str, str] = LANGUAGE_NAMES,
    prefix: str | None = None,
) -> DataFrame:
    """One translation task per (src, tgt) row."""
    base = {**FAMILY_BASES["translation"], **(base or {})}
    prefix = prefix or str(base["group"])
    src, tgt = F.col("src"), F.col("tgt")
    shown = F.coalesce(language_name(src, names), src), F.coalesce(language_name(tgt, names), tgt)
    own = pairs.select(
        F.concat(F.lit(prefix + "_"), src, F.lit("-"), tgt).alias("task"),
        F.concat(src, F.lit("-"), tgt).alias("dataset_name"),
        F.concat(_slot(src), F.lit("\t"), _slot(tgt)).alias("decontamination_query"),
        F.concat(shown[0], F.lit(": "), _slot(src), F.lit("\n"), shown[1], F.lit(":")).alias("prompt_template"),
        _slot(tgt).alias("target_template"),
    )
    return _with_base(own, base)


def build_language_tasks(
    languages: DataFrame, family: str, base: Mapping[str, object] | None = None, lang: str = "lang",
    prefix: str | None = None,
) -> DataFrame:
    """One ``reading`` or ``topic`` task per language row."""
    base = {**FAMILY_BASES[family], **(base or {})}
    prefix = prefix or str(base["group"])
    own = languages.select(
        F.concat(F.lit(prefix + "_"), F.col(lang)).alias("task"), F.col(lang).alias("dataset_name")
    )
    return _with_base(own, base)


def read_eval_docs(spark: SparkSession, task: Mapping[str, str], columns: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Test documents and few-shot pool of a task: two pruned scans of its dataset."""
    test = read_dataset(spark, task["dataset_path"], task.get("dataset_name"), task["test_split"])
    pool = read_dataset(
        spark, task["dataset_path"], task.get("dataset_name"), task.get("fewshot_split") or task["test_split"]
    )
    return (test.select(*columns), pool.select(*columns)) if columns else (test, pool)
