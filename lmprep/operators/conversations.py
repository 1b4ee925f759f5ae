"""Turn rows to conversation records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmprep.functions.chat import valid_role

#: Groups over which the turns of a conversation are dealt when the first are looked for.
SALTS = 32


def messages_from_turns(
    turns: DataFrame,
    keys: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    max_len: int | None = None,
    check_roles: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """One row per conversation with ``messages`` in turn order.

    With ``max_len`` only the first ``max_len`` turns are gathered. Every message renders to at
    least one token, so a training row cut at ``max_len`` tokens is the same either way. The first turns are found in two steps:
    among the turns of a conversation that share a salt, which deals a hot conversation over ``salts`` groups, and then among
    what these have left, ``salts * max_len`` turns at most.

    With ``check_roles`` a turn of no known role raises, also one behind the cut: roles are checked before turns are dropped.
    """
    keys = list(keys)
    if check_roles:
        known = F.when(valid_role(F.col(role)), F.col(role))
        turns = turns.withColumn(role, known.otherwise(F.raise_error(F.lit("Invalid role")).cast("string")))
    if max_len is not None:
        turns = turns.withColumn("_salt", F.pmod(F.xxhash64(turn), F.lit(salts)))
        for group in ([*keys, "_salt"], keys):
            rank = F.row_number().over(Window.partitionBy(*group).orderBy(turn))
            turns = turns.withColumn("_rank", rank).where(F.col("_rank") <= max_len).drop("_rank")
    message = F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")
    )
    return turns.groupBy(*keys).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def instructions_from_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """User turn and the assistant turn right after it as ``instruction`` / ``output``; the system
    text is the ``input``. Joins on (conversation, turn), so no conversation is one group."""
    k, t, r, c = (F.col(x) for x in (key, turn, role, content))
    asked = turns.where(r == "user").select(key, turn, c.alias("instruction"))
    answered = turns.where(r == "assistant").select(key, (t - 1).alias(turn), c.alias("output"))
    system = turns.where((r == "system") & (t == 0)).select(key, c.alias("input"))
    return (
        asked.join(answered, [key, turn])
        .join(system, [key], "left")
        .select(
            F.concat_ws("-", k, t).alias("id"), key, turn, "instruction",
            F.coalesce("input", F.lit("")).alias("input"), "output",
        )
    )
