"""Few-shot examples in front of evaluation prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.functions.text import seeded_order


def add_fewshot(
    docs: DataFrame,
    pool: DataFrame,
    n: int,
    key: str,
    order_key: str | None = None,
    prompt: str = "prompt",
    target: str = "target",
    sampler: str = "first_n",
    seed: int = 42,
    separator: str = "\n\n",
    delimiter: str = " ",
    pool_is_test: bool = True,
) -> DataFrame:
    """Prefix each prompt with ``n`` solved examples.

    ``first_n`` takes the head of the pool, ``seeded`` the head of a seeded order of it. Only
    ``n + 1`` rows leave the pool; they reach the documents as one scalar array, without a join.
    ``pool_is_test`` says that pool and documents are one split: the row with the document's own key is left out. In
    another split an equal key is another document, so all show the same examples.
    """
    if n == 0:
        return docs.withColumn("fewshot_prompt", F.col(prompt))
    order = F.col(order_key or key)
    if sampler == "seeded":
        order = seeded_order(seed, order)
    elif sampler != "first_n":
        raise ValueError(f"unknown sampler: {sampler}")
    shown = F.concat(F.col(prompt), F.lit(delimiter), F.col(target).cast("string"))
    chosen = pool.select(order.alias("at"), F.col(key).alias("key"), shown.alias("shown")).orderBy("at").limit(n + 1)
    packed = chosen.agg(F.array_sort(F.collect_list(F.struct("at", "key", "shown"))).alias("examples"))
    own = F.col(key)
    placed = docs.withColumn("_examples", packed.scalar())
    others = F.slice(F.filter("_examples", lambda e: ~e["key"].eqNullSafe(own) if pool_is_test else F.lit(True)), 1, n)
    parts = F.concat(F.transform(others, lambda e: e["shown"]), F.array(F.col(prompt)))
    return placed.withColumn("fewshot_prompt", F.array_join(parts, separator)).drop("_examples")
