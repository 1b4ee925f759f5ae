"""Checks on conversations: fail the query, or set the bad rows aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.functions.chat import valid_role
from lmprep.functions.text import has_line_break


def bad_roles(messages: str = "messages") -> Column:
    return F.exists(F.col(messages), lambda m: ~valid_role(m["role"]))


def is_empty(messages: str = "messages") -> Column:
    return F.coalesce(F.size(messages) <= 0, F.lit(True))


def _apply(df: DataFrame, bad: Column, mode: str, message: str) -> DataFrame:
    bad = F.coalesce(bad, F.lit(True))
    if mode == "strict":
        return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
    if mode == "flag":
        return df.withColumn("invalid", bad)
    if mode == "keep":
        return df.where(~bad)
    if mode == "quarantine":
        return df.where(bad)
    raise ValueError(f"unknown mode: {mode}")


def validate_roles(df: DataFrame, mode: str = "strict", messages: str = "messages") -> DataFrame:
    """``strict`` fails on a role outside the three; ``flag`` marks, ``keep`` and ``quarantine`` split."""
    return _apply(df, bad_roles(messages), mode, "Invalid role")


def validate_nonempty(df: DataFrame, mode: str = "strict", messages: str = "messages") -> DataFrame:
    return _apply(df, is_empty(messages), mode, "messages field is empty.")


def validate_turns(
    turns: DataFrame, keys: Sequence[str], role: str = "role", mode: str = "flag"
) -> DataFrame:
    """Role check on turn rows: one flag per conversation from map-side partial aggregates,
    so a hot conversation is never gathered to be checked."""
    bad = turns.groupBy(*keys).agg(F.max(~valid_role(F.col(role))).alias("invalid"))
    if mode == "flag":
        return bad
    if mode in ("keep", "quarantine"):
        return bad.where(F.col("invalid") == F.lit(mode == "quarantine")).drop("invalid")
    raise ValueError(f"unknown mode: {mode}")


def flag_multiline(df: DataFrame, column: str = "raw_output") -> DataFrame:
    return df.withColumn("multiline", has_line_break(F.col(column)))
