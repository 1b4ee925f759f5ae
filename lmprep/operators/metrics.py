"""Scores: accuracy over choices, corpus BLEU and corpus chrF.

Corpus scores only ever add up sums per group, so map-side partial aggregation carries a hot group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.cluster import spread_small
from lmprep.functions.text import PY_WHITESPACE


def _picked(scores: DataFrame, value: Column, keys: Sequence[str]) -> DataFrame:
    """Best choice per item; the lowest index wins a tie."""
    best = F.max(F.struct(value.alias("v"), (-F.col("choice_idx")).alias("i")))
    return scores.groupBy(*keys).agg(
        (-best["i"]).alias("picked"), F.max("gold").alias("gold")
    ).withColumn("correct", (F.col("picked") == F.col("gold")).cast("double"))


def accuracy(scores: DataFrame, task: str = "task", item: str = "item_id") -> DataFrame:
    picked = _picked(scores, F.col("loglik"), [task, item])
    return picked.groupBy(task).agg(F.avg("correct").alias("acc"))


def accuracy_norm(scores: DataFrame, task: str = "task", item: str = "item_id") -> DataFrame:
    """Log-likelihood per character of the choice."""
    picked = _picked(scores, F.col("loglik") / F.length("choice"), [task, item])
    return picked.groupBy(task).agg(F.avg("correct").alias("acc_norm"))


def group_scores(task_scores: DataFrame, group: str = "group", task: str = "task", value: str = "value") -> DataFrame:
    """Task rows plus one row per group: the unweighted mean of its tasks."""
    per_group = task_scores.groupBy(group).agg(F.avg(value).alias(value)).withColumn(task, F.lit(None).cast("string"))
    return task_scores.select(group, task, value).unionByName(per_group.select(group, task, value))


# ---- n-gram overlap --------------------------------------------------------------------------


def tokenize_13a(text: Column) -> Column:
    """The published 13a tokenization."""
    # Replacement rules of the 13a tokenizer, in order.
    rules = [
        ("<skipped>", ""),
        ("-\n", ""),
        ("\n", " "),
        ("&quot;", '"'),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ]
    padded = text
    for i, (pattern, replacement) in enumerate(rules):
        if i == 7:
            padded = F.concat(F.lit(" "), padded, F.lit(" "))
        padded = F.regexp_replace(padded, pattern, replacement)
    return F.filter(F.split(padded, f"[{PY_WHITESPACE}]+"), lambda w: w != "")


def _overlap(orders: int):
    """Per row: clipped matches, prediction n-grams and target n-grams of every order, one after another.

    A unit is a character of a string or a word of an array. Counting inside the row keeps the texts where they
    are: only ``3 * orders`` sums per row go on to the aggregation.
    """

    def grams(units, n: int) -> Counter:
        if isinstance(units, str):
            return Counter(units[i : i + n] for i in range(len(units) - n + 1))
        return Counter(zip(*(units[i:] for i in range(n))))

    def sums(prediction, target) -> list[int]:
        out = []
        for n in range(1, orders + 1):
            p, t = grams(prediction, n), grams(target, n)
            # characters: a row without target n-grams of an order does not count for its precision either
            made = p.total() if t or not isinstance(prediction, str) else 0
            out += [sum(min(k, t[g]) for g, k in p.items() if g in t), made, t.total()]
        return out

    @F.pandas_udf("array<long>")
    def overlap(prediction: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([sums(p, t) for p, t in zip(prediction, target)], dtype=object)

    return overlap


def _order_sums(df: DataFrame, prediction: Column, target: Column, orders: int, group: Sequence[str]) -> DataFrame:
    """One row per group with the sums of every order as columns."""
    small = spread_small(df.select(*group, prediction.alias("_p"), target.alias("_t")))
    counted = small.select(*group, _overlap(orders)("_p", "_t").alias("_o"))
    names = [f"{name}_{order}" for order in range(1, orders + 1) for name in ("matches", "n_pred", "n_target")]
    return counted.groupBy(*group).agg(
        *(F.coalesce(F.sum(F.get("_o", F.lit(i))), F.lit(0)).cast("double").alias(n) for i, n in enumerate(names))
    )


def corpus_chrf(
    df: DataFrame, group: Sequence[str] = (), prediction: str = "prediction", target: str = "target",
    orders: int = 6, beta: float = 2.0,
) -> DataFrame:
    """Character n-gram F score of whole groups."""
    group = list(group)

    def bare(column: str) -> Column:
        return F.translate(F.coalesce(column, F.lit("")), PY_WHITESPACE, "")

    sums = _order_sums(df, bare(prediction), bare(target), orders, group)
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for order in range(1, orders + 1):
        m, p, t = (F.col(f"{x}_{order}") for x in ("matches", "n_pred", "n_target"))
        both = (p > 0) & (t > 0)
        precision += F.when(both, F.try_divide(m, p)).otherwise(0.0)
        recall += F.when(both, F.try_divide(m, t)).otherwise(0.0)
        used += both.cast("int")
    scored = sums.select(*group, precision.alias("_ps"), recall.alias("_rs"), used.alias("_u"))
    p, r = F.try_divide("_ps", "_u"), F.try_divide("_rs", "_u")
    weight = beta**2
    score = F.try_divide((1 + weight) * p * r, weight * p + r) * 100
    return scored.select(*group, F.coalesce(score, F.lit(0.0)).alias("chrf"))


def corpus_bleu(
    df: DataFrame, group: Sequence[str] = (), prediction: str = "prediction", target: str = "target", orders: int = 4
) -> DataFrame:
    """BLEU of whole groups: 13a words, brevity penalty, exponential smoothing of empty orders."""
    group = list(group)

    def words(column: str) -> Column:
        return tokenize_13a(F.coalesce(column, F.lit("")))

    sums = _order_sums(df, words(prediction), words(target), orders, group)
    logs, misses = F.lit(0.0), F.lit(0)
    matched, complete = F.lit(0.0), F.lit(True)
    for order in range(1, orders + 1):
        m, n = F.col(f"matches_{order}"), F.col(f"n_pred_{order}")
        misses += F.when((m == 0) & (n > 0), 1).otherwise(0)
        smoothed = F.try_divide(F.lit(1.0), F.pow(F.lit(2.0), misses) * n)
        logs += F.when(m > 0, F.ln(F.try_divide(m, n))).otherwise(F.ln(smoothed))
        matched += m
        complete &= n > 0
    c, r = F.col("n_pred_1"), F.col("n_target_1")
    penalty = F.when(c > r, 1.0).otherwise(F.exp(1 - F.try_divide(r, c)))
    score = F.when(complete & (matched > 0), 100 * penalty * F.exp(logs / orders)).otherwise(0.0)
    return sums.select(*group, F.coalesce(score, F.lit(0.0)).alias("bleu"))
