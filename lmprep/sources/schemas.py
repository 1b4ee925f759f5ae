"""Declared schemas of the dataset kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXT = T.StringType()
_IDS = T.ArrayType(T.IntegerType())
_MESSAGE = T.StructType().add("turn", T.LongType()).add("role", _TEXT).add("content", _TEXT)

CHAT = T.StructType().add("messages", T.ArrayType(_MESSAGE))
ALPACA = T.StructType().add("instruction", _TEXT).add("input", _TEXT).add("output", _TEXT)
RAW = T.StructType().add("text", _TEXT)
PRETOKENIZED = T.StructType().add("input_ids", _IDS).add("labels", _IDS).add("attention_mask", _IDS)
QA = T.StructType().add("id", _TEXT).add("instruction", _TEXT).add("input", _TEXT)
PREDICTIONS = T.StructType().add("input", _TEXT).add("raw_output", _TEXT).add("output", _TEXT)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail when the plan is built, not at the first row, if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
