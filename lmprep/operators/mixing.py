"""Weighted mixing of sources with a reproducible schedule."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lmprep.cluster import broadcast_within, shuffle_partitions
from lmprep.functions.text import hex_bounds, seeded_hex
from lmprep.operators.indexing import index_keys

_MAX_BLOCKS = 8192
_MIN_BLOCK_STEPS = 4096
_RUN_STEPS = 1024
_COPIES_PER_KEY = 64
_CASE_SOURCES = 32  # more than this and the branches outgrow one compiled method


def mix_probabilities(spec: str | Sequence[float] | None, n: int) -> list[float]:
    """Comma list or sequence of weights; uniform when none is given."""
    if spec is None or spec == "":
        return [1 / n] * n
    probs = [float(p) for p in (spec.split(",") if isinstance(spec, str) else spec)]
    if len(probs) != n:
        raise ValueError(f"{len(probs)} probabilities for {n} sources")
    if any(p < 0 for p in probs) or not math.isclose(sum(probs), 1.0, abs_tol=1e-6):
        raise ValueError("probabilities must not be negative and must sum to 1")
    return probs


def combine_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Many corpora into one relation with a ``source`` tag."""
    if not sources:
        raise ValueError("No datasets found")
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _pick(hexes: Column, bounds: Sequence[str]) -> Column:
    """Number of the source whose share of [0, 1) holds the draw."""
    if len(bounds) > _CASE_SOURCES:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= hexes))
    chosen = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        chosen = F.when(hexes < bounds[i], F.lit(i)).otherwise(chosen)
    return chosen


def _schedule(spark: SparkSession, n_steps: int, bounds: Sequence[str], seed: int) -> DataFrame:
    """(step, source_no, draw) for ``n_steps`` draws.

    Steps live in blocks that are made on the executors from a shuffled handful of block numbers; ranks
    are local to (block, source) and shifted by the draws of earlier blocks. Nothing but those
    per-block counts is ever gathered by source.
    """
    block_steps = max(_MIN_BLOCK_STEPS, math.ceil(n_steps / _MAX_BLOCKS))
    blocks = math.ceil(n_steps / block_steps)
    tasks = min(blocks, shuffle_partitions(spark))

    def draw(step: Column) -> Column:
        return F.struct(step.alias("step"), seeded_hex(seed, step).alias("hex"))

    first = F.col("block") * F.lit(block_steps)
    end = F.least(first + F.lit(block_steps), F.lit(n_steps).cast("long"))
    runs = F.explode(F.sequence(first, end - 1, F.lit(_RUN_STEPS).cast("long"))).alias("_run")
    run_end = F.least(F.col("_run") + F.lit(_RUN_STEPS), end) - 1
    drawn = (
        spark.range(0, blocks, 1, 1)
        .withColumnRenamed("id", "block")
        .repartition(tasks, "block")
        .select("block", runs)
        .select("block", F.explode(F.transform(F.sequence(F.col("_run"), run_end), draw)).alias("_d"))
        .select("block", "_d.step", _pick(F.col("_d.hex"), bounds).alias("source_no"))
    )
    before = Window.partitionBy("source_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("block", "source_no").agg(F.count("*").alias("_n"))
    shifts = counts.select(
        "block", "source_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    local = F.row_number().over(Window.partitionBy("block", "source_no").orderBy("step")) - 1
    return (
        drawn.withColumn("_local", local)
        .join(broadcast_within(shifts, blocks * len(bounds)), ["block", "source_no"])
        .select("step", "source_no", (F.col("_local") + F.col("_shift")).alias("draw"))
    )


def _exhausted_at(schedule: DataFrame, rows: Sequence[int]) -> dict[int, int]:
    """Step at which each source has given its last row for the first time (one row per source)."""
    last = F.element_at(F.array(*(F.lit(n - 1) for n in rows)), F.col("source_no") + 1)
    hits = schedule.where(F.col("draw") == last).select("source_no", "step").collect()
    return {r["source_no"]: r["step"] for r in hits}


def plan_mixture(
    spark: SparkSession, rows: Sequence[int], probs: Sequence[float], seed: int, stop: str
) -> tuple[DataFrame, int]:
    """Schedule and number of steps for sources of the given sizes."""
    if stop not in ("all_exhausted", "first_exhausted"):
        raise ValueError(f"unknown stopping strategy: {stop}")
    every = stop == "all_exhausted"
    if any(n == 0 for n in rows):
        raise ValueError("a source is empty")
    if every and any(p == 0 for p in probs):
        raise ValueError("a source with probability 0 is never exhausted")
    need = [(n + 6 * math.sqrt(n) + 20) / p for n, p in zip(rows, probs) if p > 0]
    n_steps = math.ceil(max(need) if every else min(need))
    bounds = hex_bounds(probs)
    while True:
        schedule = _schedule(spark, n_steps, bounds, seed)
        done = _exhausted_at(schedule, rows)
        if len(done) == len(rows) or (done and not every):
            last = max(done.values()) if every else min(done.values())
            return schedule.where(F.col("step") <= last), last + 1
        n_steps *= 2


def mix_sources(
    sources: Mapping[str, DataFrame],
    order_key: str,
    probs: str | Sequence[float] | None = None,
    seed: int = 42,
    stop: str = "all_exhausted",
) -> DataFrame:
    """Draw one source per ``step`` by weight and take its next row; a source that runs out starts again.

    Stops once every source ran out (``all_exhausted``) or once the first one did. Rows are matched
    to draws on their index alone; the payload is shuffled once, by key. A row that
    is drawn very often is copied per 64 draws, so a tiny source is no hot join key.
    """
    names = list(sources)
    combined = combine_sources(sources)
    if len(names) == 1:
        mix_probabilities(probs, 1)
        return index_rows(combined, order_key)
    weights = mix_probabilities(probs, len(names))
    number = F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i)))
    indexed = index_keys(combined.select("source", order_key), [order_key], ["source"], "_idx")
    sizes = {r["source"]: r["n"] for r in combined.groupBy("source").agg(F.count("*").alias("n")).collect()}
    rows = [sizes.get(name, 0) for name in names]
    schedule, n_steps = plan_mixture(combined.sparkSession, rows, weights, seed, stop)

    size = F.element_at(F.array(*map(F.lit, rows)), F.col("source_no") + 1).cast("long")
    draws = schedule.select(
        "step",
        "source_no",
        (F.col("draw") % size).alias("_idx"),
        F.floor(F.col("draw") / size / _COPIES_PER_KEY).cast("int").alias("_copy"),
    )
    keyed = indexed.select(number[F.col("source")].alias("source_no"), order_key, "_idx")
    payload = combined.withColumn("source_no", number[F.col("source")])
    if n_steps <= _COPIES_PER_KEY * min(rows):  # no row can be drawn often
        picked = draws.drop("_copy").join(keyed, ["source_no", "_idx"]).drop("_idx")
        return picked.join(payload, ["source_no", order_key]).drop("source_no")

    drawn = {r["source_no"]: r["n"] for r in draws.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
    copies = [math.ceil(drawn.get(i, 0) / n / _COPIES_PER_KEY) for i, n in enumerate(rows)]

    def copied(df: DataFrame) -> DataFrame:
        last = F.element_at(F.array(*map(F.lit, copies)), F.col("source_no") + 1)
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))

    picked = draws.join(copied(keyed), ["source_no", "_idx", "_copy"]).drop("_idx")
    return picked.join(copied(payload), ["source_no", order_key, "_copy"]).drop("source_no", "_copy")


def index_rows(df: DataFrame, order_key: str) -> DataFrame:
    """A single source: its own order is the schedule."""
    return df.join(index_keys(df.select(order_key), [order_key], name="step"), [order_key])


def mixture_report(
    mixed: DataFrame, asked: Mapping[str, float], n_tokens: Column, source: str = "source"
) -> DataFrame:
    """Asked and realized share, rows and tokens per source."""
    shares = F.create_map(*(F.lit(x) for item in asked.items() for x in item))
    per_source = mixed.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.sum(n_tokens.cast("long")).alias("n_tokens")
    )
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # one row per source
    return per_source.select(
        source,
        F.try_element_at(shares, F.col(source)).cast("double").alias("asked_share"),
        "n_rows",
        "n_tokens",
        (F.col("n_rows") / total).alias("realized_share"),
    )
