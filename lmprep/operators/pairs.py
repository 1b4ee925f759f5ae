"""Language pairs and parallel sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.operators.indexing import with_row_index


def language_pairs(languages: DataFrame, src: str = "src_langs", tgt: str = "tgt_langs") -> DataFrame:
    """All (src, tgt) with src != tgt, from one row that holds both code lists."""
    return (
        languages.select(F.explode(src).alias("src"), F.col(tgt))
        .select("src", F.explode(tgt).alias("tgt"))
        .where(F.col("src") != F.col("tgt"))
    )


def languages_of(df: DataFrame, column: str = "lang") -> DataFrame:
    """The one-row code lists of a table. The set of codes is made by partial aggregates."""
    codes = F.sort_array(F.collect_set(column))
    return df.agg(codes.alias("src_langs")).withColumn("tgt_langs", F.col("src_langs"))


def add_reverse(pairs: DataFrame) -> DataFrame:
    """Append every pair swapped; a pair that is listed both ways already is kept as it is."""
    return pairs.unionByName(pairs.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))


def pair_sentences(
    a: DataFrame, b: DataFrame, on: str | Sequence[str], text: str = "text", names: tuple[str, str] = ("src", "tgt")
) -> DataFrame:
    """Source and target sentence of the same item."""
    on = [on] if isinstance(on, str) else list(on)
    left = a.select(*on, F.col(text).alias(f"sentence_{names[0]}"))
    right = b.select(*on, F.col(text).alias(f"sentence_{names[1]}"))
    return left.join(right, on)


def numbered_by_language(df: DataFrame, lang: str = "lang", order_key: str = "doc_id") -> DataFrame:
    """Item number inside each language, for corpora that are parallel by position."""
    return with_row_index(df, [order_key], [lang], "item")
