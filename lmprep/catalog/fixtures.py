"""Inputs that queries derive from the tables, and the same derivations in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lmprep.cluster import ensure_checkpoint_dir, spread_small
from lmprep.functions.templates import DEFAULT_PROMPTS, TOPICS
from lmprep.functions.text import PY_WHITESPACE
from lmprep.functions.tokenizers import CodepointTokenizer
from lmprep.operators.conversations import instructions_from_turns, messages_from_turns

TOK = CodepointTokenizer()
SEED = 42
LANGS = ("de", "en", "es", "fr")
LANG_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
MIX = "0.32,0.32,0.18,0.18"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that costs far more than the scan."""
    return spread_small(table(spark, sf_dir, name).select(*columns))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def conversations(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    return messages_from_turns(table(spark, sf_dir, "conversations"), max_len=max_len, check_roles=max_len is not None)


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions_from_turns(table(spark, sf_dir, "conversations"))


def split_view(spark: SparkSession, sf_dir: str) -> str:
    """Documents as a view with a ``split``: a tenth each for validation and test."""
    name = "corpus_with_split"
    last = F.pmod("doc_id", F.lit(10))
    split = F.when(last == 0, "validation").when(last == 1, "test").otherwise("train")
    table(spark, sf_dir, "documents").withColumn("split", split).createOrReplaceTempView(name)
    return name


def topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, TOPICS))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(" "), "text", F.lit("\n")).alias("sentence"),
        F.element_at(labels, (F.col("doc_id") % len(TOPICS) + 1).cast("int")).alias("category"),
    )


def reading_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.col("text").alias("flores_passage"),
        F.concat(F.lit("\t"), F.reverse("text"), F.lit(" ")).alias("question"),
        *(F.get(words, F.lit(i)).alias(f"mc_answer{i + 1}") for i in range(4)),
        (F.col("item_id") % 4 + 1).cast("string").alias("correct_answer_num"),
    )


def choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four choices per document; every tenth document is a tie."""
    from lmprep.functions.text import seeded_uniform

    idx = F.col("choice_idx")
    loglik = F.when(F.col("doc_id") % 10 == 0, F.lit(-1.0)).otherwise(-seeded_uniform(SEED, F.col("doc_id"), idx))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice_idx"))
        .select(
            F.concat(F.lit("reading_"), "lang").alias("task"),
            F.col("doc_id").alias("item_id"),
            "choice_idx",
            F.get(F.split("text", " "), idx).alias("choice"),
            loglik.alias("loglik"),
            (F.col("doc_id") % 4).cast("int").alias("gold"),
        )
        .where(F.length("choice") > 0)
    )


def translation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant turn and the one two turns later as prediction and target."""
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    later = said.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("target"))
    return (
        said.select("conv_id", "turn", F.col("text").alias("prediction"))
        .join(later, ["conv_id", "turn"])
        .withColumn("grp", (F.col("conv_id") % 3).cast("string"))
    )


#: Checkers compare strings; a benchmark measures the operators alone and sets this to False.
JOIN_ARRAYS = True


def joined(ids: Column | str) -> Column:
    """Token array as one string, so that any checker can compare it."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(ids.cast("array<string>"), " ") if JOIN_ARRAYS else ids


# ---- SQL ---------------------------------------------------------------------------------------

WS = "'" + PY_WHITESPACE + "'"
BREAKS = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sql_ids(expr: str, bos: bool = True) -> str:
    ids = (
        f"list_transform(regexp_extract_all({expr}, '(?s)</s>|<s>|.'), "
        "lambda c: CASE c WHEN '</s>' THEN 2 WHEN '<s>' THEN 1 ELSE unicode(c) + 3 END)"
    )
    return f"([1] || {ids})" if bos else ids


def sql_joined(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def sql_repeat(value: int, n: str) -> str:
    return f"list_transform(range(0, greatest({n}, 0)::BIGINT), lambda z: {value})"


SQL_MESSAGE = (
    f"'<|' || role || '|>' || chr(10) || {sql_strip('text')} || "
    "CASE WHEN role = 'assistant' THEN '</s>' ELSE '' END || chr(10)"
)

SQL_CHAT = f"SELECT conv_id, string_agg({SQL_MESSAGE}, '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id"

SQL_INSTRUCTIONS = """
SELECT u.conv_id || '-' || u.turn AS id, u.conv_id, u.turn, u.text AS instruction, coalesce(s.text, '') AS input,
       a.text AS output
FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = 0 AND s.role = 'system'
WHERE u.role = 'user'
"""


def _sql_filled(template: str) -> str:
    expr = quoted(template)
    for name in ("instruction", "input"):
        expr = expr.replace("{" + name + "}", f"' || {name} || '")
    return expr


SQL_PROMPT = (
    f"CASE WHEN input = '' THEN {_sql_filled(DEFAULT_PROMPTS['prompt_no_input'])} "
    f"ELSE {_sql_filled(DEFAULT_PROMPTS['prompt_input'])} END"
)

SQL_SPLIT = (
    "SELECT *, CASE doc_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents"
)

SQL_TOPIC_DOCS = (
    f"SELECT doc_id, ' ' || text || chr(10) AS sentence, [{', '.join(map(quoted, TOPICS))}][doc_id % 7 + 1] AS category "
    "FROM documents"
)

SQL_READING_DOCS = (
    "SELECT item_id, text AS flores_passage, chr(9) || reverse(text) || ' ' AS question, "
    + ", ".join(f"string_split(text, ' ')[{i}] AS mc_answer{i}" for i in range(1, 5))
    + ", (item_id % 4 + 1)::VARCHAR AS correct_answer_num FROM benchmark"
)

SQL_UNIFORM = "('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"

SQL_SCORES = f"""
SELECT 'reading_' || lang AS task, doc_id AS item_id, choice_idx, string_split(text, ' ')[choice_idx + 1] AS choice,
       CASE WHEN doc_id % 10 = 0 THEN -1.0::DOUBLE
            ELSE -(CAST({SQL_UNIFORM.format(key=f"'{SEED}:' || doc_id || ':' || choice_idx")} AS DOUBLE)) END AS loglik,
       doc_id % 4 AS gold
FROM documents, unnest([0, 1, 2, 3]) AS c(choice_idx)
WHERE length(string_split(text, ' ')[choice_idx + 1]) > 0
"""

SQL_TRANSLATION = """
SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS target, (a.conv_id % 3)::VARCHAR AS grp
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2
WHERE a.role = 'assistant' AND b.role = 'assistant'
"""
