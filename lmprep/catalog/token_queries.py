"""Tokens, labels, padding, packing, order and mixing (sections D and E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lmprep.catalog import fixtures as fx
from lmprep.catalog.registry import query
from lmprep.catalog.text_queries import MAX_LEN, SQL_INSTRUCTION_TRIPLE
from lmprep.cluster import ensure_checkpoint_dir, shuffle_partitions
from lmprep.functions import arrays
from lmprep.functions.templates import instruction_prompt
from lmprep.functions.text import hex_bounds
from lmprep.operators import batching, labels, mixing, packing, sampling
from lmprep.plans.datasets import DatasetOptions, build_dataset
from lmprep.sources import readers

SEQ_LEN = 2048
NUM_SEQUENCES = 16
BATCH = 8

# ---- D -----------------------------------------------------------------------------------------


@query("d1_tokenize", f"SELECT doc_id, {fx.sql_joined(fx.sql_ids('text'))} AS input_ids FROM documents")
def d1(spark, sf):
    docs = fx.spread(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", fx.joined(fx.TOK.encode(F.col("text"))).alias("input_ids"))


@query("d2_token_count", "SELECT doc_id, (length(text) + 1)::INTEGER AS n_tokens FROM documents")
def d2(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fx.TOK.count(F.col("text")).alias("n_tokens"))


#: Tokens of a training conversation.
CHAT_LEN = 2048

SQL_CHAT_LABELS = f"""
WITH t AS (
  SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
         {fx.sql_ids("'<|' || role || '|>' || chr(10)", bos=False)} AS head,
         {fx.sql_ids(f"{fx.sql_strip('text')} || CASE WHEN role = 'assistant' THEN '</s>' ELSE '' END || chr(10)", bos=False)} AS body
  FROM conversations),
s AS (
  SELECT conv_id, [1] || flatten(list(head || body ORDER BY turn)) AS ids,
         [CASE WHEN arg_min(role, turn) = 'assistant' THEN 1 ELSE -100 END] || flatten(list(
           CASE WHEN role <> 'assistant' OR before <> 'assistant'
                THEN {fx.sql_repeat(-100, 'len(head)')} ELSE head END ||
           CASE WHEN role <> 'assistant' THEN {fx.sql_repeat(-100, 'len(body)')} ELSE body END ORDER BY turn)) AS labels
  FROM t GROUP BY conv_id),
n AS (SELECT conv_id, least(len({fx.sql_ids(fx.sql_strip('chat'))}), {CHAT_LEN}) AS n FROM ({fx.SQL_CHAT})),
x AS (SELECT conv_id, ids[1:n] AS ids, labels[1:n] AS labels, n FROM s JOIN n USING (conv_id))
"""


def chat_examples(spark, sf, batch_size=None):
    convs = fx.conversations(spark, sf, max_len=CHAT_LEN)
    if batch_size:
        convs = batching.make_batches(convs, batch_size, "conv_id")
    return labels.mask_chat_labels(convs, fx.TOK, CHAT_LEN).drop("messages")


def shown(df, *keep):
    return df.select(*keep, *(fx.joined(F.col(c).cast("array<int>")).alias(c) for c in ("input_ids", "labels", "attention_mask")))


@query(
    "d3_mask_chat_labels",
    f"{SQL_CHAT_LABELS} SELECT conv_id, {fx.sql_joined('ids')} AS input_ids, {fx.sql_joined('labels')} AS labels, "
    f"{fx.sql_joined(fx.sql_repeat(1, 'n'))} AS attention_mask FROM x",
)
def d3(spark, sf):
    return shown(chat_examples(spark, sf), "conv_id")


@query("d4_mask_instruction_labels", SQL_INSTRUCTION_TRIPLE)
def d4(spark, sf):
    df = fx.instructions(spark, sf)
    return shown(labels.mask_instruction_labels(df.withColumn("prompt", instruction_prompt(df)), fx.TOK, MAX_LEN), "id")


_SQL_CUT = f"SELECT doc_id, {fx.sql_ids('text')}[1:{MAX_LEN}] AS ids FROM documents"


def cut_docs(spark, sf):
    return fx.spread(spark, sf, "documents", "doc_id", "text").select("doc_id", fx.TOK.encode(F.col("text"), MAX_LEN).alias("ids"))


@query(
    "d5_append_eos",
    f"SELECT doc_id, {fx.sql_joined(f'CASE WHEN len(ids) < {MAX_LEN} THEN ids || [2] ELSE ids END')} AS ids FROM ({_SQL_CUT})",
)
def d5(spark, sf):
    return cut_docs(spark, sf).select(
        "doc_id", fx.joined(arrays.append_eos(F.col("ids"), fx.TOK.eos_id, MAX_LEN)).alias("ids")
    )


@query(
    "d6_attention_mask",
    f"SELECT doc_id, {fx.sql_joined(fx.sql_repeat(1, 'len(ids)'))} AS chat_mask, "
    f"{fx.sql_joined(f'''{fx.sql_repeat(1, 'len(ids)')} || {fx.sql_repeat(0, f'{MAX_LEN} - len(ids)')}''')} AS padded_mask "
    f"FROM ({_SQL_CUT})",
)
def d6(spark, sf):
    padded = arrays.padded_mask(F.size("ids"), MAX_LEN, F.lit(1), F.lit(0))
    return cut_docs(spark, sf).select(
        "doc_id", fx.joined(arrays.ones(F.col("ids"))).alias("chat_mask"), fx.joined(padded).alias("padded_mask")
    )


@query(
    "d7_pad_to_max",
    f"SELECT doc_id, {fx.sql_joined(f'''ids || {fx.sql_repeat(0, f'{MAX_LEN} - len(ids)')}''')} AS ids FROM ({_SQL_CUT})",
)
def d7(spark, sf):
    return cut_docs(spark, sf).select(
        "doc_id", fx.joined(arrays.pad_right(F.col("ids"), MAX_LEN, fx.TOK.pad_id)).alias("ids")
    )


@query(
    "d8_pad_batch_longest",
    f"""{SQL_CHAT_LABELS},
b AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // {BATCH} AS batch_id FROM x),
w AS (SELECT *, (ceil(max(n) OVER (PARTITION BY batch_id) / 8.0) * 8)::BIGINT AS width FROM b)
SELECT conv_id, batch_id, {fx.sql_joined(f"ids || {fx.sql_repeat(0, 'width - n')}")} AS input_ids,
  {fx.sql_joined(f"labels || {fx.sql_repeat(-100, 'width - n')}")} AS labels,
  {fx.sql_joined(f"{fx.sql_repeat(1, 'n')} || {fx.sql_repeat(0, 'width - n')}")} AS attention_mask FROM w
""",
)
def d8(spark, sf):
    padded = batching.pad_batch_longest(chat_examples(spark, sf, BATCH), fx.TOK.pad_id)
    return shown(padded, "conv_id", "batch_id")


@query(
    "d9_pad_batch_left",
    f"""
WITH p AS (SELECT conv_id, {fx.sql_ids("chat || '<|assistant|>' || chr(10)")} AS ids,
                  (row_number() OVER (ORDER BY conv_id) - 1) // {BATCH} AS batch_id FROM ({fx.SQL_CHAT})),
w AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM p)
SELECT conv_id, batch_id, {fx.sql_joined(f"{fx.sql_repeat(0, 'width - n')} || ids")} AS input_ids,
  {fx.sql_joined(f"{fx.sql_repeat(0, 'width - n')} || {fx.sql_repeat(1, 'n')}")} AS attention_mask FROM w
""",
)
def d9(spark, sf):
    from lmprep.functions.chat import chat_generation_prompt

    prompts = batching.make_batches(fx.conversations(spark, sf), BATCH, "conv_id").select(
        "conv_id", "batch_id", fx.TOK.encode(chat_generation_prompt(F.col("messages"))).alias("input_ids")
    )
    padded = batching.pad_batch_left(prompts, 0)
    return padded.select(
        "conv_id", "batch_id", fx.joined("input_ids").alias("input_ids"), fx.joined("attention_mask").alias("attention_mask")
    )


def generations(spark, sf):
    """Prompt ids followed by answer ids, as a model returns them."""
    df = fx.instructions(spark, sf)
    return df.select(
        "id",
        F.col("instruction").alias("prompts"),
        F.concat(
            fx.TOK.encode(F.col("instruction")), fx.TOK.encode(F.col("output"), specials=False), F.array(F.lit(2))
        ).alias("generated"),
        fx.TOK.count(F.col("instruction")).alias("prompt_len"),
    )


@query(
    "d10_strip_prompt_tokens",
    f"SELECT id, {fx.sql_joined(fx.sql_ids('output', bos=False) + ' || [2]')} AS ids FROM ({fx.SQL_INSTRUCTIONS})",
)
def d10(spark, sf):
    kept = arrays.strip_prompt_tokens(F.col("generated"), F.col("prompt_len"))
    return generations(spark, sf).select("id", fx.joined(kept).alias("ids"))


@query("d11_decode", "SELECT doc_id, text FROM documents")
def d11(spark, sf):
    ids = fx.spread(spark, sf, "documents", "doc_id", "text").select("doc_id", fx.TOK.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", fx.TOK.decode(F.col("ids")).alias("text"))


def _sql_packed(
    limit: float | str, shards: int = 1, greedy: bool = True, documents: str = "documents", before: str = ""
) -> str:
    """Buffers by a recursive walk over the documents, or one buffer per shard; ``before`` are tables that it needs."""
    shard = "0" if shards == 1 else f"('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {shards}"
    walk = f"""
w AS (
  SELECT shard, i, n_chars AS filled, 0::BIGINT AS buffer_id FROM d WHERE i = 0
  UNION ALL
  SELECT d.shard, d.i, CASE WHEN w.filled >= {limit} THEN d.n_chars ELSE w.filled + d.n_chars END,
         w.buffer_id + CASE WHEN w.filled >= {limit} THEN 1 ELSE 0 END
  FROM w JOIN d ON d.shard = w.shard AND d.i = w.i + 1)"""
    if not greedy:
        walk = "w AS (SELECT shard, i, 0::BIGINT AS buffer_id FROM d)"
    return f"""
WITH RECURSIVE {before} d AS (
  SELECT doc_id, ({shard})::INTEGER AS shard, length(text) AS n_chars,
         row_number() OVER (PARTITION BY {shard} ORDER BY doc_id) - 1 AS i FROM {documents}),
{walk},
b AS (
  SELECT shard, buffer_id, flatten(list({fx.sql_ids('text')} || [2] ORDER BY d.i)) AS ids
  FROM w JOIN d USING (shard, i) JOIN {documents} t USING (doc_id) GROUP BY shard, buffer_id),
c AS (
  SELECT shard, buffer_id, chunk_id, ids[chunk_id * {SEQ_LEN} + 1 : (chunk_id + 1) * {SEQ_LEN}] AS ids
  FROM (SELECT *, unnest(range(0, len(ids) // {SEQ_LEN})) AS chunk_id FROM b))
"""


LIMIT = float(SEQ_LEN * NUM_SEQUENCES)
_SQL_CHUNKS = f"SELECT shard, buffer_id, chunk_id, {fx.sql_joined('ids')} AS input_ids"


def packed(spark, sf, **options):
    docs = fx.table(spark, sf, "documents")
    chunks = packing.pack_sequences(
        docs, fx.TOK, SEQ_LEN, **{"num_sequences": NUM_SEQUENCES, "chars_per_token": 1.0, **options}
    )
    return chunks.drop("labels").withColumn("input_ids", fx.joined("input_ids"))


@query("d12_pack_sequences", f"{_sql_packed(LIMIT)} {_SQL_CHUNKS} FROM c")
def d12(spark, sf):
    return packed(spark, sf)


@query("d12_pack_sharded", f"{_sql_packed(LIMIT, shards=3)} {_SQL_CHUNKS} FROM c")
def d12_sharded(spark, sf):
    return packed(spark, sf, shards=3)


@query("d12_pack_one_buffer", f"{_sql_packed(LIMIT, shards=3, greedy=False)} {_SQL_CHUNKS} FROM c")
def d12_one(spark, sf):
    return packed(spark, sf, shards=3, num_sequences=2**40, block_rows=64)


@query(
    "d12_pack_source_order",
    f"{_sql_packed(LIMIT, documents='(SELECT row_number() OVER () - 1 AS doc_id, text FROM documents)')} {_SQL_CHUNKS} FROM c",
)
def d12_source_order(spark, sf):
    """A corpus of which only the text is read, in the order of its files."""
    (docs,) = readers.scan_raw_text(spark, f"{sf}/documents.parquet", order_key=None).values()
    chunks = packing.pack_sequences(
        docs, fx.TOK, SEQ_LEN, num_sequences=NUM_SEQUENCES, chars_per_token=1.0, order_key=readers.SOURCE_KEY
    )
    return chunks.drop("labels").withColumn("input_ids", fx.joined("input_ids"))


_SQL_SOME_NULL = "(SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE text END AS text FROM documents)"


@query(
    "b10_null_text_quarantine",
    f"SELECT 'rejected' AS kind, doc_id, NULL::BIGINT AS n FROM {_SQL_SOME_NULL} WHERE text IS NULL "
    f"UNION ALL SELECT 'packed', NULL, count(text) FROM {_SQL_SOME_NULL} "
    f"UNION ALL SELECT 'documents', NULL, count(*) FROM {_SQL_SOME_NULL} "
    f"UNION ALL SELECT 'null texts', NULL, count_if(text IS NULL)::BIGINT FROM {_SQL_SOME_NULL}",
)
def b10(spark, sf):
    """French texts taken away: what is packed, what is set aside, and the counts of the pass."""
    text = F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("text"))
    docs = fx.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    done = packing.pack_documents(docs, fx.TOK, SEQ_LEN, num_sequences=NUM_SEQUENCES, chars_per_token=1.0)
    none = F.lit(None).cast("long")
    kind = lambda name: F.lit(name).alias("kind")
    out = done.rejected.select(kind("rejected"), "doc_id", none.alias("n"))
    out = out.unionByName(done.buffers.agg(F.sum("n_documents").alias("n")).select(kind("packed"), none.alias("doc_id"), "n"))
    for name, n in (("documents", done.counts["documents"]), ("null texts", done.counts["null_texts"])):
        out = out.unionByName(spark.range(1).select(kind(name), none.alias("doc_id"), F.lit(n).cast("long").alias("n")))
    return out


@query("d12_pack_wide_buffers", f"{_sql_packed(20 * LIMIT, shards=3)} {_SQL_CHUNKS} FROM c")
def d12_wide(spark, sf):
    """Links between documents, doubled, as for buffers of any number of documents."""
    return packed(spark, sf, shards=3, num_sequences=20 * NUM_SEQUENCES, block_rows=64, widest=0)


@query(
    "d12_pack_report",
    f"{_sql_packed(LIMIT)}, e AS (SELECT w.buffer_id, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars "
    f"FROM w JOIN d USING (shard, i) GROUP BY w.buffer_id) "
    f"SELECT buffer_id, n_documents, n_chars, len(ids) AS n_tokens, len(ids) // {SEQ_LEN} AS n_chunks, "
    f"len(ids) % {SEQ_LEN} AS n_dropped_tokens FROM b JOIN e USING (buffer_id)",
)
def d12_report(spark, sf):
    docs = fx.table(spark, sf, "documents")
    done = packing.pack_documents(docs, fx.TOK, SEQ_LEN, num_sequences=NUM_SEQUENCES, chars_per_token=1.0)
    return done.buffers.drop("shard")


@query(
    "d14_chunk_shuffle",
    f"{_sql_packed(LIMIT)} {_SQL_CHUNKS}, (row_number() OVER (PARTITION BY shard, buffer_id "
    f"ORDER BY md5('{fx.SEED}:' || chunk_id), chunk_id) - 1)::INTEGER AS chunk_pos FROM c",
)
def d14(spark, sf):
    return packed(spark, sf, shuffle_seed=fx.SEED)


# ---- E -----------------------------------------------------------------------------------------


def _sql_mixed(stop: str) -> str:
    probs = [float(p) for p in fx.MIX.split(",")]
    bounds = hex_bounds(probs)
    number = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(fx.LANGS)) + " END"
    name = "CASE s " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(fx.LANGS)) + " END"
    picks = "CASE " + " ".join(f"WHEN h < '{b}' THEN {i}" for i, b in enumerate(bounds[:-1])) + f" ELSE {len(bounds) - 1} END"
    smallest = min(probs)
    return f"""
WITH src AS (
  SELECT doc_id, text, {number} AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n FROM documents),
steps AS (SELECT unnest(range(0, (SELECT (max(n) / {smallest} * 2 + 1000)::BIGINT FROM src))) AS step),
hashed AS (SELECT step, substr(md5('{fx.SEED}:' || step), 1, 8) AS h FROM steps),
drawn AS (SELECT step, {picks} AS s FROM hashed),
ranked AS (SELECT step, s, row_number() OVER (PARTITION BY s ORDER BY step) - 1 AS k FROM drawn),
sizes AS (SELECT DISTINCT s, n FROM src),
last AS (SELECT {stop}(step) AS stop FROM ranked JOIN sizes USING (s) WHERE k = n - 1),
mixed AS (
  SELECT step, {name} AS source, doc_id, text FROM ranked JOIN sizes USING (s)
  JOIN src USING (s) CROSS JOIN last WHERE src.idx = k % sizes.n AND step <= stop)
"""


def sources(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return {lang: docs.where(F.col("lang") == lang).drop("lang") for lang in fx.LANGS}


@query("e1_mix_sources", f"{_sql_mixed('max')} SELECT * FROM mixed")
def e1(spark, sf):
    return mixing.mix_sources(sources(spark, sf), "doc_id", fx.MIX, fx.SEED)


@query("e2_mix_first_exhausted", f"{_sql_mixed('min')} SELECT * FROM mixed")
def e2(spark, sf):
    return mixing.mix_sources(sources(spark, sf), "doc_id", fx.MIX, fx.SEED, stop="first_exhausted")


def written_places(ordered):
    """The operator's rows, numbered by where they come to lie when written: the operator alone makes this order."""
    path = f"{ensure_checkpoint_dir(ordered.sparkSession)}/ordered-{uuid.uuid4().hex}"
    ordered.write.parquet(path)
    return readers.read_in_order(ordered.sparkSession, path)


@query(
    "e4_global_shuffle",
    f"SELECT doc_id, text, row_number() OVER (ORDER BY md5('{fx.SEED}:' || doc_id), doc_id) - 1 AS place FROM documents",
)
def e4(spark, sf):
    return written_places(sampling.global_shuffle(fx.table(spark, sf, "documents").select("doc_id", "text"), fx.SEED, "doc_id"))


@query("e5_keep_order", "SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def e5(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    scattered = docs.repartition(shuffle_partitions(spark), F.xxhash64("doc_id"))  # so that the order is the operator's work
    return written_places(sampling.keep_order(scattered, "doc_id"))


@query("e6_head", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 500")
def e6(spark, sf):
    return sampling.head(fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 500, "doc_id")


_SQL_BATCHES = """
SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS batch_id,
       ((row_number() OVER (ORDER BY doc_id) - 1) % 128)::INTEGER AS batch_pos FROM documents
"""


@query("e7_make_batches", _SQL_BATCHES)
def e7(spark, sf):
    return batching.make_batches(fx.table(spark, sf, "documents").select("doc_id", "text"), 128, "doc_id")


@query(
    "e7_make_batches_drop_last",
    f"SELECT * FROM ({_SQL_BATCHES}) WHERE batch_id < (SELECT count(*) // 128 FROM documents)",
)
def e7_drop(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return batching.make_batches(docs, 128, "doc_id", drop_last=True)


@query("e9_repeat_epochs", "SELECT conv_id, turn, text, e::INTEGER AS epoch FROM conversations, unnest([0, 1]) AS t(e)")
def e9(spark, sf):
    return sampling.repeat_epochs(fx.table(spark, sf, "conversations").select("conv_id", "turn", "text"), 2)


_SQL_MIX_TABLES = f"""{_sql_mixed('max').strip().removeprefix('WITH')},
docs AS MATERIALIZED (SELECT step AS doc_id, text FROM mixed),
lim AS MATERIALIZED (
  SELECT {SEQ_LEN * NUM_SEQUENCES} * (sum(length(text))::DOUBLE / sum(length(text) + 1)) AS v FROM docs WHERE doc_id < 500),
"""


@query(
    "b6_build_raw_text",
    f"{_sql_packed('(SELECT v FROM lim)', documents='docs', before=_SQL_MIX_TABLES)} {_SQL_CHUNKS}, "
    f"{fx.sql_joined('ids')} AS labels, (row_number() OVER (PARTITION BY shard, buffer_id "
    f"ORDER BY md5('{fx.SEED}:' || chunk_id), chunk_id) - 1)::INTEGER AS chunk_pos FROM c",
)
def b6_raw(spark, sf):
    """The main path: corpora mixed by weight, characters per token estimated from the first steps, packed, chunks shuffled."""
    spec = ",".join(f"{sf}/documents.parquet:{lang}" for lang in fx.LANGS)
    options = DatasetOptions(
        max_seq_length=SEQ_LEN, num_sequences=NUM_SEQUENCES, interleave_probs=fx.MIX, seed=fx.SEED
    )
    chunks = build_dataset(spark, "culturax", spec, fx.TOK, options)
    return chunks.withColumn("input_ids", fx.joined("input_ids")).withColumn("labels", fx.joined("labels"))


@query(
    "h2_combine_sources", "SELECT lang AS source, doc_id, text FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')"
)
def h2(spark, sf):
    return mixing.combine_sources(sources(spark, sf))


@query(
    "f9_mixture_report",
    f"""{_sql_mixed('max')}
SELECT source, CASE source WHEN 'de' THEN 0.32::DOUBLE WHEN 'en' THEN 0.32::DOUBLE ELSE 0.18::DOUBLE END AS asked_share,
       count(*) AS n_rows, sum(length(text) + 1)::BIGINT AS n_tokens,
       count(*)::DOUBLE / sum(count(*)) OVER () AS realized_share
FROM mixed GROUP BY source
""",
)
def f9(spark, sf):
    asked = dict(zip(fx.LANGS, mixing.mix_probabilities(fx.MIX, len(fx.LANGS))))
    return mixing.mixture_report(e1(spark, sf), asked, fx.TOK.count(F.col("text")))
