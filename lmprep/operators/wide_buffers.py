"""Buffers of very many documents each, in joins and windows over blocks.

Each document knows where the next buffer would start if one started at it: at the first document whose distance in characters is at
least the limit. These links are found for all documents at once by sorting positions and targets together, in bins of about equal size.
The links are then doubled: joined with themselves they lead two, four, eight buffers on, and after as many rounds as the number of
buffers has binary digits, the starts reached from the first document are known. No row holds more than a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmprep.cluster import reliable

#: Documents of a bin of positions, about.
BIN_ROWS = 65_536


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over this and all earlier rows of the shard: inside the block, and block sums before it."""
    df = df.withColumn("_value", value.cast("long"))
    inside = Window.partitionBy("shard", "_block").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("shard", "_block").agg(F.sum("_value").alias("_sum"))
    shifts = sums.select("shard", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    summed = df.withColumn("_inside", F.sum("_value").over(inside)).join(shifts, ["shard", "_block"])
    return summed.withColumn(name, F.col("_inside") + F.col("_shift")).drop("_value", "_inside", "_shift")


def _onward(placed: DataFrame, limit: int, width: int) -> DataFrame:
    """(shard, at, to): for each document the first one at least ``limit`` characters on, where there is one."""
    starts = placed.groupBy("shard", F.col("_before").alias("pos")).agg(F.min("_idx").alias("first"))
    targets = placed.select("shard", (F.col("_before") + limit).alias("pos"), F.col("_idx").alias("at"))
    events = starts.select("shard", "pos", "first", F.lit(None).cast("long").alias("at")).unionByName(
        targets.select("shard", "pos", F.lit(None).cast("long").alias("first"), "at")
    )
    events = events.withColumn("bin", F.floor(F.col("pos") / width))
    # from the end of a bin to its beginning, documents ahead of the targets that they meet
    back = Window.partitionBy("shard", "bin").orderBy(F.desc("pos"), F.col("at").asc_nulls_first())
    inside = F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("inside")
    bins = events.groupBy("shard", "bin").agg(F.min("first").alias("lowest"))
    later = Window.partitionBy("shard").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    after = bins.select("shard", "bin", F.last("lowest", ignorenulls=True).over(later).alias("after"))
    met = events.select("shard", "bin", "at", inside).where("at IS NOT NULL").join(after, ["shard", "bin"])
    return met.select("shard", "at", F.coalesce("inside", "after").alias("to")).where("to IS NOT NULL")


def _reached(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """(shard, at) of all documents that links lead to from ``firsts``, themselves included."""
    reached = firsts
    while not links.isEmpty():
        more = reached.join(links, ["shard", "at"]).select("shard", F.col("to").alias("at"))
        reached = reliable(reached.unionByName(more).distinct())
        onward = links.select("shard", F.col("at").alias("to"), F.col("to").alias("on"))
        links = reliable(links.join(onward, ["shard", "to"]).select("shard", "at", F.col("on").alias("to")))
    return reached


def assign_wide(indexed: DataFrame, limit: int, mean_chars: float, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Add ``buffer_id`` and ``_ahead`` to rows with ``shard``, ``_idx``, ``_block``, ``n_chars`` and ``n_tokens``."""
    width = max(1, int(mean_chars * bin_rows))
    summed = _running(indexed.select("shard", "_idx", "_block", "n_chars"), F.col("n_chars"), "_upto")
    placed = reliable(summed.select("shard", "_idx", (F.col("_upto") - F.col("n_chars")).alias("_before")))
    links = reliable(_onward(placed, limit, width))
    firsts = placed.where("_idx = 0").select("shard", F.col("_idx").alias("at"))
    starts = _reached(links, firsts).where("at > 0").select("shard", F.col("at").alias("_idx"), F.lit(1).alias("_start"))
    marked = indexed.join(starts, ["shard", "_idx"], "left")
    numbered = _running(marked, F.coalesce("_start", F.lit(0)), "buffer_id").drop("_start")
    inside = Window.partitionBy("shard", "_block", "buffer_id").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("_ahead", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
