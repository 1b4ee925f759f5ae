"""Aggregates, joins, streaming and inference (sections F to K)."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from lmprep.catalog import fixtures as fx
from lmprep.catalog.registry import query
from lmprep.catalog.text_queries import SQL_PARALLEL, SQL_TOPIC_PROMPT, parallel
from lmprep.catalog.token_queries import LIMIT, NUM_SEQUENCES, SEQ_LEN, _sql_packed, generations
from lmprep.functions.chat import chat_generation_prompt
from lmprep.functions.templates import render_topic_prompt
from lmprep.operators import batching, decontaminate, fewshot, inference, metrics, packing, pairs
from lmprep.plans.evaltasks import build_eval_tasks, build_language_tasks
from lmprep.plans.prompts import run_inference
from lmprep.sources import readers
from lmprep.streaming.packing import stream_pack
from lmprep.streaming.prompts import read_arriving, stream_prompts

# ---- F -----------------------------------------------------------------------------------------


@query("f1_dataset_info", f"SELECT 'set_' || split AS eval_name, count(*) AS n_examples FROM ({fx.SQL_SPLIT}) GROUP BY split")
def f1(spark, sf):
    view = fx.split_view(spark, sf)
    sets = {f"set_{s}": readers.read_dataset(spark, view, split=s) for s in ("train", "validation", "test")}
    return readers.dataset_info(sets)


@query(
    "f2_chars_per_token",
    "SELECT sum(length(text))::BIGINT AS n_chars, sum(length(text) + 1)::BIGINT AS n_tokens, "
    "sum(length(text))::DOUBLE / sum(length(text) + 1) AS chars_per_token "
    "FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 500)",
)
def f2(spark, sf):
    return packing.chars_per_token(fx.table(spark, sf, "documents"), fx.TOK)


def _sql_accuracy(value: str, name: str) -> str:
    return f"""
SELECT task, avg((picked = gold)::INTEGER)::DOUBLE AS {name} FROM (
  SELECT task, item_id, any_value(gold) AS gold,
         arg_max(choice_idx, ({value}, -choice_idx)) AS picked
  FROM ({fx.SQL_SCORES}) GROUP BY task, item_id) GROUP BY task
"""


@query("f3_accuracy", _sql_accuracy("loglik", "acc"))
def f3(spark, sf):
    return metrics.accuracy(fx.choice_scores(spark, sf))


@query("f4_accuracy_norm", _sql_accuracy("loglik / length(choice)", "acc_norm"))
def f4(spark, sf):
    return metrics.accuracy_norm(fx.choice_scores(spark, sf))


_SQL_CHRF = f"""
WITH r AS (SELECT grp, conv_id * 1000 + turn AS id, translate(prediction, {fx.WS}, '') AS p, translate(target, {fx.WS}, '') AS t
           FROM ({fx.SQL_TRANSLATION})),
o AS (SELECT grp, id, k, p, t FROM r, unnest([1, 2, 3, 4, 5, 6]) AS u(k)),
g AS (SELECT grp, id, k, substr(p, i::BIGINT, k) AS gram, 1 AS np, 0 AS nt
      FROM (SELECT *, unnest(range(1, length(p) - k + 2)) AS i FROM o)
      UNION ALL
      SELECT grp, id, k, substr(t, i::BIGINT, k), 0, 1 FROM (SELECT *, unnest(range(1, length(t) - k + 2)) AS i FROM o)),
c AS (SELECT grp, id, k, gram, sum(np) AS np, sum(nt) AS nt FROM g GROUP BY ALL),
e AS (SELECT grp, id, k, sum(least(np, nt)) AS m, sum(np) AS p, sum(nt) AS t FROM c GROUP BY grp, id, k HAVING sum(nt) > 0),
s AS (SELECT grp, k, sum(m)::DOUBLE AS m, sum(p)::DOUBLE AS p, sum(t)::DOUBLE AS t FROM e GROUP BY grp, k),
a AS (SELECT grp, avg(m / p) AS pr, avg(m / t) AS re FROM s WHERE p > 0 AND t > 0 GROUP BY grp)
SELECT grp, round(100 * 5 * pr * re / (4 * pr + re), 6) AS chrf FROM a
"""


@query("f5_corpus_chrf", _SQL_CHRF)
def f5(spark, sf):
    scored = metrics.corpus_chrf(fx.translation_scores(spark, sf), ["grp"])
    return scored.withColumn("chrf", F.round("chrf", 6))


def _sql_13a(column: str) -> str:
    expr = column
    rules = [
        ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ]
    for i, (pattern, replacement) in enumerate(rules):
        if i == 7:
            expr = f"' ' || {expr} || ' '"
        expr = f"regexp_replace({expr}, {fx.quoted(pattern)}, {fx.quoted(replacement)}, 'g')"
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


_SQL_BLEU = f"""
WITH r AS (SELECT grp, conv_id * 1000 + turn AS id, {_sql_13a('prediction')} AS p, {_sql_13a('target')} AS t
           FROM ({fx.SQL_TRANSLATION})),
o AS (SELECT grp, id, k, p, t FROM r, unnest([1, 2, 3, 4]) AS u(k)),
g AS (SELECT grp, id, k, array_to_string(p[i:i + k - 1], ' ') AS gram, 1 AS np, 0 AS nt
      FROM (SELECT *, unnest(range(1, len(p) - k + 2)) AS i FROM o)
      UNION ALL
      SELECT grp, id, k, array_to_string(t[i:i + k - 1], ' '), 0, 1
      FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS i FROM o)),
c AS (SELECT grp, id, k, gram, sum(np) AS np, sum(nt) AS nt FROM g GROUP BY ALL),
e AS (SELECT grp, id, k, sum(least(np, nt)) AS m, sum(np) AS p, sum(nt) AS t FROM c GROUP BY grp, id, k HAVING sum(nt) > 0),
s AS (SELECT grp, k, sum(m)::DOUBLE AS m, sum(p)::DOUBLE AS p, sum(t)::DOUBLE AS t FROM e GROUP BY grp, k),
z AS (SELECT *, sum((m = 0)::INTEGER) OVER (PARTITION BY grp ORDER BY k) AS misses FROM s),
l AS (SELECT grp, avg(ln(CASE WHEN m > 0 THEN m / p ELSE 1 / (pow(2, misses) * p) END)) AS logs, count(*) AS orders,
             sum(m) AS matched, max(CASE WHEN k = 1 THEN p END) AS c, max(CASE WHEN k = 1 THEN t END) AS r
      FROM z WHERE p > 0 GROUP BY grp)
SELECT grp, round(CASE WHEN orders < 4 OR matched = 0 THEN 0
                  ELSE 100 * CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * exp(logs) END, 6) AS bleu FROM l
"""


@query("f6_corpus_bleu", _SQL_BLEU)
def f6(spark, sf):
    scored = metrics.corpus_bleu(fx.translation_scores(spark, sf), ["grp"])
    return scored.withColumn("bleu", F.round("bleu", 6))


@query(
    "f7_group_scores",
    f"""
WITH t AS (SELECT 'reading' AS "group", task, acc AS value FROM ({_sql_accuracy("loglik", "acc")}))
SELECT "group", task, round(value, 9) AS value FROM t
UNION ALL SELECT "group", NULL, round(avg(value), 9) FROM t GROUP BY "group"
""",
)
def f7(spark, sf):
    per_task = metrics.accuracy(fx.choice_scores(spark, sf)).select(
        F.lit("reading").alias("group"), "task", F.col("acc").alias("value")
    )
    return metrics.group_scores(per_task).withColumn("value", F.round("value", 9))


# ---- G, H --------------------------------------------------------------------------------------

_SQL_LANGS = "SELECT DISTINCT lang FROM documents"
_SQL_PAIRS = f"SELECT a.lang AS src, b.lang AS tgt FROM ({_SQL_LANGS}) a, ({_SQL_LANGS}) b WHERE a.lang <> b.lang"


@query("g1_language_pairs", _SQL_PAIRS)
def g1(spark, sf):
    return pairs.language_pairs(pairs.languages_of(fx.table(spark, sf, "documents")))


_SQL_NAME = "CASE {x} WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END"


_SQL_SLOT = "'{{{{sentence_' || {x} || '}}}}'"
_SRC, _TGT = _SQL_SLOT.format(x="src"), _SQL_SLOT.format(x="tgt")


@query(
    "g2_build_eval_tasks",
    f"""
SELECT 'flores_' || src || '-' || tgt AS task, 'flores' AS "group", NULL::VARCHAR AS dataset_path,
  src || '-' || tgt AS dataset_name, 'devtest' AS test_split, NULL::VARCHAR AS fewshot_split, 'first_n' AS sampler,
  'generate_until' AS output_type, true AS should_decontaminate,
  {_SRC} || chr(9) || {_TGT} AS decontamination_query,
  {_SQL_NAME.format(x='src')} || ': ' || {_SRC} || chr(10) || {_SQL_NAME.format(x='tgt')} || ':' AS prompt_template,
  {_TGT} AS target_template, 'chrf,bleu' AS metrics
FROM ({_SQL_PAIRS})
""",
)
def g2(spark, sf):
    return build_eval_tasks(g1(spark, sf), names=fx.LANG_NAMES)


@query(
    "g2_build_language_tasks",
    f"""
SELECT 'sib200_' || lang AS task, lang AS dataset_name, 'sib200' AS "group", 'validation' AS fewshot_split
FROM ({_SQL_LANGS})
""",
)
def g2_languages(spark, sf):
    langs = fx.table(spark, sf, "documents").select("lang").distinct()
    return build_language_tasks(langs, "topic").select("task", "dataset_name", "group", "fewshot_split")


@query(
    "g3_add_fewshot",
    f"""
WITH d AS (SELECT doc_id, {SQL_TOPIC_PROMPT} AS prompt, category AS target FROM ({fx.SQL_TOPIC_DOCS})),
f AS (SELECT * FROM d ORDER BY doc_id LIMIT 4),
x AS (SELECT d.doc_id, f.prompt || ' ' || f.target AS example, f.doc_id AS example_id,
             row_number() OVER (PARTITION BY d.doc_id ORDER BY f.doc_id) AS place
      FROM d JOIN f ON d.doc_id <> f.doc_id),
e AS (SELECT doc_id, string_agg(example, chr(10) || chr(10) ORDER BY example_id) AS examples FROM x WHERE place <= 3 GROUP BY doc_id)
SELECT doc_id, examples || chr(10) || chr(10) || prompt AS fewshot_prompt FROM d JOIN e USING (doc_id)
""",
)
def g3(spark, sf):
    docs = fx.topic_docs(spark, sf)
    prompted = docs.select("doc_id", render_topic_prompt(docs).alias("prompt"), F.col("category").alias("target"))
    return fewshot.add_fewshot(prompted, prompted, 3, "doc_id").select("doc_id", "fewshot_prompt")


@query(
    "g4_attach_predictions",
    """
WITH b AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, i // 8 AS batch_id, (i % 8)::INTEGER AS batch_pos, text AS prompts, right(text, 50) AS raw_output FROM b
""",
)
def g4(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompts"))
    batches = batching.make_batches(docs, 8, "doc_id")
    outputs = inference.generate(batches, last_words).select("batch_id", "batch_pos", "raw_output")
    return inference.attach_predictions(batches, outputs)


_SQL_WORDS = (
    "list_filter(string_split(translate(lower(text), "
    f"chr(9) || chr(10) || chr(13) || chr(12) || {fx.quoted(string.punctuation)}, '    '), ' '), lambda w: w <> '')"
)


def _sql_grams(key: str, relation: str) -> str:
    return (
        f"SELECT {key}, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i "
        f"FROM (SELECT {key}, {_SQL_WORDS} AS w FROM {relation}))"
    )


_SQL_HITS = (
    f"SELECT DISTINCT doc_id FROM ({_sql_grams('doc_id', 'documents')}) "
    f"WHERE gram IN (SELECT gram FROM ({_sql_grams('item_id', 'benchmark')}))"
)


def _train_and_queries(spark, sf):
    return (
        fx.table(spark, sf, "documents").select("doc_id", "text"),
        fx.table(spark, sf, "benchmark").select(F.col("text").alias("query")),
    )


@query("g6_decontaminate", f"SELECT doc_id, text FROM documents WHERE doc_id NOT IN ({_SQL_HITS})")
def g6(spark, sf):
    return decontaminate.decontaminate(*_train_and_queries(spark, sf))


@query("g6_flag_contaminated", f"SELECT doc_id, doc_id IN ({_SQL_HITS}) AS contaminated FROM documents")
def g6_flag(spark, sf):
    flagged = decontaminate.decontaminate(*_train_and_queries(spark, sf), mode="flag")
    return flagged.select("doc_id", "contaminated")


@query("g6_past_the_bound", f"SELECT doc_id, text FROM documents WHERE doc_id NOT IN ({_SQL_HITS})")
def g6_past(spark, sf):
    """With no room for a broadcast: the filter and the shuffle of hashes."""
    return decontaminate.decontaminate(*_train_and_queries(spark, sf), limit=0)


SHORT = 5


_SQL_SENTENCES = "(SELECT item_id, unnest(regexp_split_to_array(text, '[.?!]')) AS text FROM benchmark)"


@query(
    "g6_short_queries",
    f"""WITH q AS (
      SELECT DISTINCT array_to_string(w, ' ') AS phrase FROM (SELECT {_SQL_WORDS} AS w FROM {_SQL_SENTENCES})
      WHERE len(w) BETWEEN {SHORT} AND 12
    ), d AS (SELECT doc_id, ' ' || array_to_string({_SQL_WORDS}, ' ') || ' ' AS line FROM documents)
    SELECT doc_id FROM d JOIN q ON contains(line, ' ' || phrase || ' ')
    UNION
    SELECT doc_id FROM ({_sql_grams('doc_id', 'documents')}) WHERE gram IN (SELECT gram FROM ({_sql_grams('item_id', _SQL_SENTENCES)}))""",
)
def g6_short(spark, sf):
    """Sentences of the benchmark as queries, most of them too short for an n-gram."""
    train, items = _train_and_queries(spark, sf)
    sentences = items.select(F.explode(F.split("query", "[.?!]")).alias("query"))
    return decontaminate.contaminated_keys(train, sentences, min_words=SHORT)


@query("g7_pair_sentences", SQL_PARALLEL)
def g7(spark, sf):
    return parallel(spark, sf)


@query("h1_add_reverse", f"WITH p AS ({_SQL_PAIRS}), o AS (SELECT * FROM p WHERE src < tgt) SELECT src, tgt FROM o UNION ALL SELECT tgt, src FROM o")
def h1(spark, sf):
    return pairs.add_reverse(g1(spark, sf).where("src < tgt"))


# ---- J -----------------------------------------------------------------------------------------


def _drained(spark, stream, label):
    """Run a stream over what is there now, and read its output."""
    out = fx.scratch(spark, label)
    run = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "j1_stream_prompts",
    f"SELECT doc_id, {fx.SQL_PROMPT} AS prompts FROM (SELECT doc_id, text AS instruction, '' AS input FROM documents)",
)
def j1(spark, sf):
    path = f"{sf}/documents.parquet"
    arriving = stream_prompts(
        spark, f"{sf}/documents*.parquet", spark.read.parquet(path).schema, "alpaca", keep=("doc_id",),
        prepare=lambda df: df.withColumnRenamed("text", "instruction"),
    )
    return _drained(spark, arriving, "stream-prompts")


@query(
    "j2_stream_pack",
    f"{_sql_packed(LIMIT, shards=8)} SELECT shard, buffer_id, chunk_id, {fx.sql_joined('ids')} AS input_ids FROM c",
)
def j2(spark, sf):
    path = f"{sf}/documents.parquet"
    arriving = read_arriving(spark, f"{sf}/documents*.parquet", spark.read.parquet(path).schema)
    chunks = stream_pack(arriving, fx.TOK, SEQ_LEN, NUM_SEQUENCES, chars_per_token=1.0, shards=8)
    return _drained(spark, chunks, "stream-pack").withColumn("input_ids", fx.joined("input_ids"))


# ---- K -----------------------------------------------------------------------------------------


def last_words(prompts: list[str], **options) -> list[str]:
    """Deterministic stand-in for a model: the end of each prompt."""
    return [p[-50:] for p in prompts]


@query(
    "k1_tokenizer",
    "SELECT doc_id, (length(text) + 1)::INTEGER AS n_ids, (length(text) + 1)::INTEGER AS n_counted, text AS decoded FROM documents",
)
def k1(spark, sf):
    ids = fx.spread(spark, sf, "documents", "doc_id", "text").select("doc_id", "text", fx.TOK.encode(F.col("text")).alias("ids"))
    return ids.select(
        "doc_id", F.size("ids").alias("n_ids"), fx.TOK.count(F.col("text")).alias("n_counted"),
        fx.TOK.decode(F.col("ids")).alias("decoded"),
    )


_SQL_CLEAN = fx.sql_strip(
    f"array_to_string(list_transform(regexp_split_to_array(raw_output, {fx.BREAKS}), lambda s: {fx.sql_strip('s')}), ' ')"
)


@query(
    "k2_generate",
    f"SELECT conv_id, input, raw_output, {_SQL_CLEAN} AS output FROM (SELECT conv_id, chat || '<|assistant|>' || chr(10) AS input, "
    f"right(chat || '<|assistant|>' || chr(10), 50) AS raw_output FROM ({fx.SQL_CHAT}))",
)
def k2(spark, sf):
    prompts = fx.conversations(spark, sf).select(
        "conv_id", chat_generation_prompt(F.col("messages")).alias("prompts")
    )
    return run_inference(prompts, last_words, batch_size=8, max_new_tokens=50)


@query(
    "k4_postprocess",
    f"SELECT id, instruction AS input, output AS raw_output, {_SQL_CLEAN.replace('raw_output', 'output')} AS output FROM ({fx.SQL_INSTRUCTIONS})",
)
def k4(spark, sf):
    return inference.postprocess(generations(spark, sf), fx.TOK).select("id", "input", "raw_output", "output")
