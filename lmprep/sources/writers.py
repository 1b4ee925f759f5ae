"""Sinks for predictions and prepared datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.sources.schemas import require


def write_predictions_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record ``{input, raw_output, output}`` per line (and the id where there is one)."""
    require(df, "input", "raw_output", "output")
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_predictions_text(df: DataFrame, path: str, order_key: str, mode: str = "errorifexists") -> None:
    """One prediction per line; part files follow each other in input order."""
    require(df, "output", order_key)
    df.orderBy(order_key).select(F.coalesce("output", F.lit("")).alias("output")).write.mode(mode).text(path)


def materialize(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Run the transformation once, store it as Parquet, and continue from the stored rows."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)
