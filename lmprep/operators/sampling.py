"""Order, limits and repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.functions.text import seeded_order


def global_shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Seeded order of all rows: a range sort on a hash, so partitions stay even."""
    return df.orderBy(seeded_order(seed, F.col(key)), key)


def keep_order(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def head(df: DataFrame, n: int, order_key: str) -> DataFrame:
    """First ``n`` rows by key.

    The last kept key comes from a scan of the key column alone; the rows are then read through a filter on it,
    which the scan can use to skip row groups, so texts past the head are not read.
    """
    keys = df.select(order_key).orderBy(order_key).limit(n)
    last = keys.agg(F.max(order_key)).scalar()
    key = F.col(order_key)
    return df.where(key.isNull() | (key <= last)).orderBy(order_key).limit(n)


def repeat_epochs(df: DataFrame, n: int) -> DataFrame:
    """Every row once per ``epoch``, without a join."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
