"""Consecutive batches and batch-wise padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmprep.functions.arrays import IGNORE, pad_left, pad_right, round_up
from lmprep.operators.indexing import index_keys


def batch_keys(
    keys: DataFrame, batch_size: int, order_key: Sequence[str], drop_last: bool = False
) -> DataFrame:
    """Assign ``batch_id`` and ``batch_pos`` to a narrow frame."""
    indexed = index_keys(keys, order_key, name="_row")
    if drop_last:
        whole = (indexed.count() // batch_size) * batch_size
        indexed = indexed.where(F.col("_row") < whole)
    row = F.col("_row")
    return indexed.select(
        *keys.columns,
        F.floor(row / batch_size).cast("long").alias("batch_id"),
        (row % batch_size).cast("int").alias("batch_pos"),
    )


def _order(order_key: str | Sequence[str]) -> list[str]:
    return [order_key] if isinstance(order_key, str) else list(order_key)


def make_batches(
    df: DataFrame, batch_size: int, order_key: str | Sequence[str], drop_last: bool = False
) -> DataFrame:
    order = _order(order_key)
    return df.join(batch_keys(df.select(*order), batch_size, order, drop_last), order)


def _widened(df: DataFrame, ids: str, multiple: int) -> DataFrame:
    """Add the target length; a window over one batch is bounded by the batch size."""
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    return df.withColumn("_width", round_up(longest, multiple))


def pad_batch_longest(
    df: DataFrame,
    pad_id: int,
    multiple: int = 8,
    ids: str = "input_ids",
    labels: str | None = "labels",
    mask: str | None = "attention_mask",
) -> DataFrame:
    """Right-pad every row of a batch to the longest, rounded up to ``multiple``."""
    wide = _widened(df, ids, multiple)
    width, padded = F.col("_width"), {}
    padded[ids] = pad_right(F.col(ids), width, pad_id)
    if labels:
        padded[labels] = pad_right(F.col(labels), width, IGNORE)
    if mask:
        padded[mask] = pad_right(F.col(mask), width, 0)
    return wide.withColumns(padded).drop("_width")


def pad_batch_left(df: DataFrame, pad_id: int = 0, ids: str = "input_ids") -> DataFrame:
    """Left-pad every row of a batch to the longest, as generation needs it. Adds the mask."""
    wide = _widened(df, ids, 1)
    real = F.array_repeat(F.lit(1), F.size(ids))
    return wide.withColumns(
        {"attention_mask": pad_left(real, F.col("_width"), 0), ids: pad_left(F.col(ids), F.col("_width"), pad_id)}
    ).drop("_width")
