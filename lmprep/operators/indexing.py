"""A dense row index without a single-task window.

Keys are range-sorted, so no task holds more than its share even when one group is a third of
the rows. Only the keys are written to the checkpoint; each row then adds the offset of its
(partition, group) run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmprep.cluster import broadcast_within, reliable, shuffle_partitions

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _tag_runs(keys: DataFrame, within: list[str], order_by: list[str]) -> DataFrame:
    """Keys in order, written, with their partition and place in it. A repeated or null key raises ``ValueError``.

    Dealt by range, equal keys lie in one partition, which is all that a window over a key asks; it sorts them
    there, and repeats are numbered without another shuffle.
    """
    columns = [*within, *order_by]
    ordered = keys.repartitionByRange(*columns)
    repeat = F.row_number().over(Window.partitionBy(*columns).orderBy(*columns)) > 1
    null = reduce(or_, (F.col(c).isNull() for c in order_by))
    tagged = reliable(ordered.withColumn("_bad", repeat | null).withColumn("_at", F.monotonically_increasing_id()))
    bad = tagged.where("_bad").select(*columns).head()
    if bad is not None:
        # rows are joined back by key: a repeated one would double rows and a null one lose them
        raise ValueError(f"order keys must be unique and not null, found {bad.asDict()}")
    return tagged.select(
        "*",
        F.shiftright("_at", _PARTITION_BITS).cast("int").alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1)).alias("_pos"),
    ).drop("_at", "_bad")


def index_keys(
    keys: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), name: str = "row_index"
) -> DataFrame:
    """Add a dense 0-based ``name`` to a narrow frame, restarting in every ``within`` group.

    ``order_by`` must be unique inside a group and not null; a key that is not raises ``ValueError``.
    """
    if "_part" in keys.columns or "_pos" in keys.columns:
        raise ValueError("columns _part and _pos are reserved")
    within = list(within)
    tagged = _tag_runs(keys, within, list(order_by))
    runs = tagged.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "_part",
        *(F.col(c).alias(f"_g_{c}") for c in within),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    ).withColumnRenamed("_part", "_run_part")
    if not within:
        # one row per partition, so the bound is the partition count itself
        offsets = broadcast_within(offsets, shuffle_partitions(keys.sparkSession))
    same = F.col("_part") == F.col("_run_part")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return tagged.join(offsets, same).select(
        *(F.col(c) for c in keys.columns), (F.col("_pos") + F.col("_shift")).alias(name)
    )


def with_row_index(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), name: str = "row_index"
) -> DataFrame:
    """Add the index to full rows: the keys are indexed alone, then joined back."""
    order_by, within = list(order_by), list(within)
    names = [*within, *order_by]
    if len(df.columns) == len(names):
        return index_keys(df, order_by, within, name)
    return join_index(df, index_keys(df.select(*names), order_by, within, name), order_by, within)


def join_index(df: DataFrame, indexed: DataFrame, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows with their index; a null group is a group like any other."""
    added = [c for c in indexed.columns if c not in {*order_by, *within}]
    renamed = indexed.withColumnsRenamed({c: f"_k_{c}" for c in (*order_by, *within)})
    same = [F.col(c) == F.col(f"_k_{c}") for c in order_by] + [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in within]
    return df.join(renamed, same).select(*(F.col(f"`{c}`") for c in df.columns), *added)
