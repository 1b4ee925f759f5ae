"""Sources, projections, checks, rendering (sections A, B, C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lmprep.catalog import fixtures as fx
from lmprep.catalog.registry import query
from lmprep.functions import chat, templates, text
from lmprep.operators import inference, validation
from lmprep.plans.datasets import DatasetOptions, build_dataset
from lmprep.plans.evaltasks import read_eval_docs
from lmprep.plans.prompts import build_prompts
from lmprep.sources import readers, writers
from lmprep.sources.schemas import PREDICTIONS

MAX_LEN = 512

# ---- A -----------------------------------------------------------------------------------------


@query("a2_read_dataset", f"SELECT doc_id, lang, split, n_chars FROM ({fx.SQL_SPLIT}) WHERE lang = 'en' AND split = 'train'")
def a2(spark, sf):
    return readers.read_dataset(spark, fx.split_view(spark, sf), "en", "train").select("doc_id", "lang", "split", "n_chars")


@query("a4_read_prompts", f"SELECT doc_id, text FROM ({fx.SQL_SPLIT}) WHERE lang = 'de' AND split = 'test'")
def a4(spark, sf):
    return readers.read_prompts(spark, f"{fx.split_view(spark, sf)}:de:test").select("doc_id", "text")


@query("a5_scan_raw_text", "SELECT 'documents:' || lang AS corpus, doc_id, text FROM documents WHERE lang IN ('de', 'fr')")
def a5(spark, sf):
    path = f"{sf}/documents.parquet"
    scans = readers.scan_raw_text(spark, f"{path}:de,{path}:fr")
    first, second = (df.withColumn("corpus", F.lit(name)) for name, df in scans.items())
    return first.unionByName(second)


@query("a6_read_pretokenized", f"SELECT doc_id, {fx.sql_joined(fx.sql_ids('text'))} AS input_ids FROM documents")
def a6(spark, sf):
    path = fx.scratch(spark, "pretokenized")
    docs = fx.spread(spark, sf, "documents", "doc_id", "text")
    writers.materialize(docs.select("doc_id", fx.TOK.encode(F.col("text")).alias("input_ids")), path)
    return readers.read_pretokenized(spark, path).withColumn("input_ids", fx.joined("input_ids"))


@query(
    "a8_read_eval_docs",
    f"SELECT CASE split WHEN 'test' THEN 'test' ELSE 'pool' END AS part, doc_id, text FROM ({fx.SQL_SPLIT}) "
    "WHERE lang = 'en' AND split IN ('test', 'validation')",
)
def a8(spark, sf):
    task = {
        "dataset_path": fx.split_view(spark, sf), "dataset_name": "en",
        "test_split": "test", "fewshot_split": "validation",
    }
    test, pool = read_eval_docs(spark, task, ["doc_id", "text"])
    return test.withColumn("part", F.lit("test")).unionByName(pool.withColumn("part", F.lit("pool")))


#: What a cut at braces must not be misled by.
_AWKWARD = '}"],{\\" [{'


@query(
    "a1_read_json_records",
    f"SELECT doc_id, text, text || '{_AWKWARD}' AS awkward, doc_id + 1 AS following FROM documents",
)
def a1(spark, sf):
    """All documents as JSON arrays, a file for each remainder of the key, read again."""
    path = fx.scratch(spark, "arrays")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(8)).alias("file"))
    order = Window.partitionBy("file").orderBy("doc_id")
    ends = F.lag("doc_id").over(order).isNull(), F.lead("doc_id").over(order).isNull()
    # the rows are moved with one text; what is made of it comes behind
    placed = docs.select("file", "doc_id", "text", ends[0].alias("first"), ends[1].alias("last")).select(
        "file", "first", "last", "doc_id", "text", F.concat("text", F.lit(_AWKWARD)).alias("awkward"),
        F.array("doc_id", F.col("doc_id") + 1).alias("numbers"),
    )
    record = F.to_json(F.struct("doc_id", "text", "awkward", "numbers"))
    opening, closing = F.when(F.col("first"), "[").otherwise(","), F.when(F.col("last"), "]").otherwise("")
    placed.select("file", F.concat(opening, record, closing)).write.partitionBy("file").text(path)
    found = readers.read_json_records(spark, f"{path}/*", "doc_id long, text string, awkward string, numbers array<long>")
    return found.select("doc_id", "text", "awkward", F.col("numbers")[1].alias("following"))


@query(
    "a9_write_predictions_json",
    f"SELECT text AS input, text AS raw_output, {fx.sql_strip(f'''array_to_string(list_transform(regexp_split_to_array(text, {fx.BREAKS}), lambda s: {fx.sql_strip('s')}), ' ')''')} AS output FROM documents",
)
def a9(spark, sf):
    path = fx.scratch(spark, "predictions-json")
    docs = fx.table(spark, sf, "documents").select(F.col("text").alias("prompts"), F.col("text").alias("raw_output"))
    writers.write_predictions_json(inference.prediction_record(docs), path)
    return spark.read.schema(PREDICTIONS).json(path)


@query(
    "a10_write_predictions_text",
    f"SELECT {fx.sql_strip(f'''array_to_string(list_transform(regexp_split_to_array(text, {fx.BREAKS}), lambda s: {fx.sql_strip('s')}), ' ')''')} AS value FROM conversations WHERE role = 'assistant'",
)
def a10(spark, sf):
    path = fx.scratch(spark, "predictions-text")
    said = fx.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    answers = said.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), text.normalize_prediction(F.col("text")).alias("output")
    )
    writers.write_predictions_text(answers, path, "at")
    return spark.read.text(path)


@query("a11_materialize", f"SELECT conv_id, {fx.sql_strip('chat')} AS text FROM ({fx.SQL_CHAT})")
def a11(spark, sf):
    rendered = fx.conversations(spark, sf).select("conv_id", chat.chat_training_text(F.col("messages")).alias("text"))
    return writers.materialize(rendered, fx.scratch(spark, "materialized"))


@query(
    "a12_read_validation_sets",
    f"SELECT 'dev_' || lang AS eval_name, doc_id, text FROM ({fx.SQL_SPLIT}) "
    "WHERE split = 'validation' AND lang IN ('de', 'fr')",
)
def a12(spark, sf):
    view = fx.split_view(spark, sf)
    sets = readers.read_validation_sets(spark, f"dev_de:{view}:de,dev_fr:{view}:fr")
    return readers.union_validation_sets(sets).select("eval_name", "doc_id", "text")


# ---- B -----------------------------------------------------------------------------------------


@query("b1_project_text", "SELECT text AS prompts FROM documents")
def b1(spark, sf):
    return readers.project_text(fx.table(spark, sf, "documents"))


@query("b2_filter_subset", f"SELECT doc_id, text FROM ({fx.SQL_SPLIT}) WHERE lang = 'es' AND split = 'validation'")
def b2(spark, sf):
    docs = spark.table(fx.split_view(spark, sf))
    return readers.filter_subset(docs, "es", "validation").select("doc_id", "text")


@query("b3_has_input", f"SELECT id, input <> '' AS has_input FROM ({fx.SQL_INSTRUCTIONS})")
def b3(spark, sf):
    df = fx.instructions(spark, sf)
    return df.select("id", templates.has_input(df).alias("has_input"))


@query(
    "b4_validate_roles",
    "SELECT conv_id, max((conv_id * 31 + turn) % 17 = 0) AS invalid FROM conversations GROUP BY conv_id",
)
def b4(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    planted = F.when((F.col("conv_id") * 31 + F.col("turn")) % 17 == 0, "moderator").otherwise(F.col("role"))
    return validation.validate_turns(turns.withColumn("role", planted), ["conv_id"])


@query(
    "b5_validate_nonempty",
    "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0",
)
def b5(spark, sf):
    system = F.filter("messages", lambda m: m["role"] == "system")
    df = fx.conversations(spark, sf).select("conv_id", system.alias("messages"))
    return validation.validate_nonempty(df, "quarantine").select("conv_id")


_SQL_EXAMPLES = f"""
WITH r AS (SELECT id, {fx.SQL_PROMPT} AS prompt, output FROM ({fx.SQL_INSTRUCTIONS})),
t AS (SELECT id, {fx.sql_ids('prompt || output')}[1:{MAX_LEN}] AS ids0,
             least(length(prompt) + 1, {MAX_LEN}) AS n FROM r),
e AS (SELECT id, n, CASE WHEN len(ids0) < {MAX_LEN} THEN ids0 || [2] ELSE ids0 END AS ids FROM t)
"""
SQL_INSTRUCTION_TRIPLE = f"""{_SQL_EXAMPLES}
SELECT id, {fx.sql_joined(f"ids || {fx.sql_repeat(0, f'{MAX_LEN} - len(ids)')}")} AS input_ids,
  {fx.sql_joined(f"{fx.sql_repeat(-100, 'n')} || ids[n + 1:] || {fx.sql_repeat(-100, f'{MAX_LEN} - len(ids)')}")} AS labels,
  {fx.sql_joined(f"{fx.sql_repeat(1, 'len(ids)')} || {fx.sql_repeat(0, f'{MAX_LEN} - len(ids)')}")} AS attention_mask
FROM e
"""


@query("b6_build_dataset", SQL_INSTRUCTION_TRIPLE)
def b6(spark, sf):
    fx.instructions(spark, sf).createOrReplaceTempView("instruction_records")
    built = build_dataset(spark, "alpaca", "instruction_records", fx.TOK, DatasetOptions(max_seq_length=MAX_LEN))
    return built.select(
        "id", fx.joined("input_ids").alias("input_ids"), fx.joined("labels").alias("labels"),
        fx.joined(F.col("attention_mask").cast("array<int>")).alias("attention_mask"),
    )


@query("b7_build_prompts", f"SELECT conv_id, chat || '<|assistant|>' || chr(10) AS prompts FROM ({fx.SQL_CHAT})")
def b7(spark, sf):
    return build_prompts(spark, fx.conversations(spark, sf), "chat", keep=("conv_id",))


@query("b8_flag_multiline", "SELECT conv_id, turn, contains(text, chr(10)) AS multiline FROM conversations WHERE role = 'assistant'")
def b8(spark, sf):
    said = fx.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return validation.flag_multiline(said, "text").select("conv_id", "turn", "multiline")


@query("b9_keep_id", f"SELECT {fx.SQL_PROMPT} AS prompts, id AS ids FROM ({fx.SQL_INSTRUCTIONS})")
def b9(spark, sf):
    return build_prompts(spark, fx.instructions(spark, sf), "alpaca", task="estqa")


# ---- C -----------------------------------------------------------------------------------------

_PADDED = "chr(9) || chr(160) || text || chr(12288) || chr(10)"


@query("c1_py_strip", f"SELECT doc_id, {fx.sql_strip(_PADDED)} AS stripped FROM documents")
def c1(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit("　\n"))
    return fx.table(spark, sf, "documents").select("doc_id", text.py_strip(padded).alias("stripped"))


@query("c2_render_chat", f"SELECT conv_id, chat FROM ({fx.SQL_CHAT})")
def c2(spark, sf):
    return fx.conversations(spark, sf).select("conv_id", chat.render_chat(F.col("messages")).alias("chat"))


@query("c3_chat_training_text", f"SELECT conv_id, {fx.sql_strip('chat')} AS training_text FROM ({fx.SQL_CHAT})")
def c3(spark, sf):
    return fx.conversations(spark, sf).select(
        "conv_id", chat.chat_training_text(F.col("messages")).alias("training_text")
    )


@query("c4_chat_generation_prompt", f"SELECT conv_id, chat || '<|assistant|>' || chr(10) AS prompt FROM ({fx.SQL_CHAT})")
def c4(spark, sf):
    return fx.conversations(spark, sf).select(
        "conv_id", chat.chat_generation_prompt(F.col("messages")).alias("prompt")
    )


@query(
    "c5_apply_chat_template",
    "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) "
    "|| '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id",
)
def c5(spark, sf):
    shown = chat.apply_chat_template(F.col("messages"), chat.CHAT_TEMPLATES["chatml"])
    return fx.conversations(spark, sf).select("conv_id", shown.alias("prompt"))


@query("c6_instruction_prompt", f"SELECT id, {fx.SQL_PROMPT} AS prompt FROM ({fx.SQL_INSTRUCTIONS})")
def c6(spark, sf):
    df = fx.instructions(spark, sf)
    return df.select("id", templates.instruction_prompt(df).alias("prompt"))


@query("c7_instruction_example", f"SELECT id, {fx.SQL_PROMPT} || output AS example FROM ({fx.SQL_INSTRUCTIONS})")
def c7(spark, sf):
    df = fx.instructions(spark, sf)
    return df.select("id", templates.instruction_example(df).alias("example"))


@query(
    "c8_render_template",
    "SELECT doc_id, '[' || lang || '] {' || source || '} 100% ' || text || chr(10) AS rendered FROM documents",
)
def c8(spark, sf):
    df = fx.table(spark, sf, "documents")
    return df.select("doc_id", templates.render_template("[{lang}] {{{source}}} 100% {text}\n", df).alias("rendered"))


_SQL_NORMAL = fx.sql_strip(
    f"array_to_string(list_transform(regexp_split_to_array(text, {fx.BREAKS}), lambda s: {fx.sql_strip('s')}), ' ')"
)


@query("c9_normalize_prediction", f"SELECT doc_id, {_SQL_NORMAL} AS normalized FROM documents")
def c9(spark, sf):
    return fx.spread(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", text.normalize_prediction(F.col("text")).alias("normalized")
    )


@query(
    "c10_chat_prefixes",
    f"""
WITH m AS (SELECT conv_id, turn, role, {fx.SQL_MESSAGE} AS piece FROM conversations),
p AS (SELECT conv_id, row_number() OVER w AS length, string_agg(piece, '') OVER w AS text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS upcoming
      FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, length::INTEGER AS length, text,
       text || CASE WHEN upcoming = 'assistant' THEN '<|assistant|>' || chr(10) ELSE '' END AS text_to_answer FROM p
""",
)
def c10(spark, sf):
    prefixes = F.explode(chat.chat_prefixes(F.col("messages"))).alias("p")
    return fx.conversations(spark, sf).select("conv_id", prefixes).select("conv_id", "p.*")


@query(
    "c11_render_mc_prompt",
    f"SELECT item_id, 'P: ' || flores_passage || chr(10) || 'Q: ' || {fx.sql_strip('question')} || chr(10) || "
    "'A: ' || mc_answer1 || chr(10) || 'B: ' || mc_answer2 || chr(10) || 'C: ' || mc_answer3 || chr(10) || "
    f"'D: ' || mc_answer4 || chr(10) || 'Answer：' AS prompt FROM ({fx.SQL_READING_DOCS})",
)
def c11(spark, sf):
    df = fx.reading_docs(spark, sf)
    return df.select("item_id", templates.render_mc_prompt(df).alias("prompt"))


SQL_TOPIC_PROMPT = (
    "'Topic Classification: science/technology, travel, politics, sports, health, entertainment, geography.' "
    f"|| chr(10) || chr(10) || 'The label of [' || {fx.sql_strip('sentence')} || '] is'"
)


@query("c12_render_topic_prompt", f"SELECT doc_id, {SQL_TOPIC_PROMPT} AS prompt FROM ({fx.SQL_TOPIC_DOCS})")
def c12(spark, sf):
    df = fx.topic_docs(spark, sf)
    return df.select("doc_id", templates.render_topic_prompt(df).alias("prompt"))


SQL_PARALLEL = """
WITH n AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS item FROM documents)
SELECT a.item, a.text AS sentence_en, b.text AS sentence_de
FROM n a JOIN n b ON a.item = b.item AND a.lang = 'en' AND b.lang = 'de'
"""


def parallel(spark, sf):
    from lmprep.operators.pairs import numbered_by_language, pair_sentences

    numbered = numbered_by_language(fx.table(spark, sf, "documents").where(F.col("lang").isin("en", "de")))
    en, de = (numbered.where(F.col("lang") == x) for x in ("en", "de"))
    return pair_sentences(en, de, "item", names=("en", "de"))


@query(
    "c13_render_translation_prompt",
    f"SELECT item, 'English: ' || sentence_en || chr(10) || 'German:' AS prompt FROM ({SQL_PARALLEL})",
)
def c13(spark, sf):
    df = parallel(spark, sf)
    return df.select("item", templates.render_translation_prompt(df, "en", "de", fx.LANG_NAMES).alias("prompt"))


@query(
    "c14_language_name",
    "SELECT doc_id, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' "
    "WHEN 'fr' THEN 'French' END AS language FROM documents",
)
def c14(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", templates.language_name(F.col("lang"), fx.LANG_NAMES).alias("language")
    )


@query("c15_target_index", f"SELECT item_id, (correct_answer_num::INTEGER - 1) AS target FROM ({fx.SQL_READING_DOCS})")
def c15(spark, sf):
    return fx.reading_docs(spark, sf).select(
        "item_id", templates.target_index(F.col("correct_answer_num"), templates.READING_GOLD).alias("target")
    )


@query(
    "c16_decontamination_query",
    f"SELECT item, sentence_en || chr(9) || sentence_de AS query FROM ({SQL_PARALLEL})",
)
def c16(spark, sf):
    df = parallel(spark, sf)
    return df.select("item", templates.decontamination_query(df, "translation", "en", "de").alias("query"))
