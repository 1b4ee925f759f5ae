"""Packing documents into sequences of one fixed length.

A buffer takes documents in order until its characters reach a limit, so each buffer start depends
on the one before. The chain is followed in parallel: every block of consecutive documents is
summed up as a function from "characters already in the open buffer" to the same number at its end.
That function is a short table, since only documents inside the first buffer length of a block
can be its first start. Tables compose, ``FAN_IN`` blocks at a time, up a tree; the known
start (an empty buffer) then goes back down. Only key, characters and token counts take part. Buffers too wide for
such tables are found by doubling links (``wide_buffers``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmprep.cluster import broadcast_within, reliable
from lmprep.functions.text import hash_shard, seeded_order
from lmprep.functions.tokenizers import Tokenizer, concat_id
from lmprep.operators.indexing import index_keys
from lmprep.operators.sampling import head
from lmprep.operators.wide_buffers import assign_wide

BLOCK_ROWS = 262_144
FAN_IN = 512
#: Chunks that are put together in one place.
GROUP = 64
#: Documents of a buffer, on average, up to which tables of steps are used.
WIDEST = 1 << 16
#: Documents that may take one text before it is copied, and how many texts are copied at most.
COPIED, MOST_COPIED = 64, 100_000


def chars_per_token(df: DataFrame, tok: Tokenizer, n: int = 500, order_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters over tokens of the first ``n`` rows, as a ratio of sums (one row)."""
    first = head(df.select(order_key, text), n, order_key)
    sums = first.agg(
        F.sum(F.length(text)).cast("long").alias("n_chars"),
        F.sum(tok.count(F.col(text))).cast("long").alias("n_tokens"),
    )
    ratio = F.when(F.col("n_tokens") > 0, F.col("n_chars") / F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("no rows to estimate from")).cast("double")
    )
    return sums.withColumn("chars_per_token", ratio)


@dataclass(frozen=True)
class Steps:
    """What a run of documents does to an open buffer that holds ``c`` characters.

    Its first new buffer starts at the first entry whose ``before`` (characters of the run ahead of it)
    is at least ``limit - c``. From there the run always ends with ``left`` characters in
    the open buffer after ``opened`` more starts. Without such an entry the run just adds ``total``.
    """

    before: np.ndarray
    left: np.ndarray
    opened: np.ndarray
    total: int

    def apply(self, c: int, limit: float) -> tuple[int, int]:
        at = int(np.searchsorted(self.before, limit - c, side="left"))
        if at == len(self.before):
            return c + self.total, 0
        return int(self.left[at]), int(self.opened[at]) + 1


def steps_of_documents(n_chars: np.ndarray, limit: float) -> Steps:
    """Follow the chain of starts for all possible first starts at once."""
    n = len(n_chars)
    before = np.cumsum(n_chars, dtype=np.int64) - n_chars
    total = int(n_chars.sum())
    follow = np.append(np.searchsorted(before, before + limit, side="left"), n)
    first = np.arange(min(n, int(np.searchsorted(before, limit, side="left")) + 1))
    at, opened = first.copy(), np.zeros(len(first), dtype=np.int64)
    while (more := follow[at] < n).any():
        at = np.where(more, follow[at], at)
        opened += more
    return _bounded(Steps(before[first], total - before[at], opened, total), limit)


def _bounded(s: Steps, limit: float) -> Steps:
    """Entries past the first one at or above ``limit`` are never reached; equal ones are one."""
    keep = np.searchsorted(s.before, limit, side="left") + 1
    before, first = np.unique(s.before[:keep], return_index=True)
    return Steps(before, s.left[first], s.opened[first], s.total)


def then(a: Steps, b: Steps, limit: float) -> Steps:
    """``a`` followed by ``b``."""
    at = np.searchsorted(b.before, limit - a.left, side="left")
    starts = at < len(b.before)  # a buffer opens inside ``b``
    at = np.where(starts, at, 0)
    if len(b.before):
        left = np.where(starts, b.left[at], a.left + b.total)
        opened = a.opened + np.where(starts, b.opened[at] + 1, 0)
    else:
        left, opened = a.left + b.total, a.opened
    return _bounded(
        Steps(
            np.concatenate([a.before, b.before + a.total]),
            np.concatenate([left, b.left]),
            np.concatenate([opened, b.opened]),
            a.total + b.total,
        ),
        limit,
    )


_STEPS = "shard int, level int, node long, starts_before array<long>, left array<long>, opened array<long>, total long"
_ENTRY = "shard int, node long, carried long, buffer_no long"


def _to_row(shard: int, level: int, node: int, s: Steps) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "shard": [shard], "level": [level], "node": [node], "starts_before": [s.before],
            "left": [s.left], "opened": [s.opened], "total": [s.total],
        }
    )


def _from_row(row) -> Steps:
    return Steps(np.asarray(row.starts_before), np.asarray(row.left), np.asarray(row.opened), int(row.total))


def _block_steps(meta: DataFrame, limit: float) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chars = pdf.sort_values("_idx")["n_chars"].to_numpy(dtype=np.int64)
        return _to_row(key[0], 0, key[1], steps_of_documents(chars, limit))

    return meta.select("shard", "_block", "_idx", "n_chars").groupBy("shard", "_block").applyInPandas(run, _STEPS)


def _merge_steps(level: DataFrame, limit: float, fan_in: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = None
        for row in pdf.sort_values("node").itertuples():
            merged = _from_row(row) if merged is None else then(merged, _from_row(row), limit)
        return _to_row(key[0], int(pdf["level"].iloc[0]) + 1, key[1], merged)

    parent = F.floor(F.col("node") / fan_in).cast("long").alias("_parent")
    return level.groupBy("shard", parent).applyInPandas(run, _STEPS)


def _entries(level: DataFrame, parents: DataFrame | None, limit: float, fan_in: int) -> DataFrame:
    """State in which each node of a level is entered, from the state of its parent."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        carried, buffer_no = int(pdf["carried"].iloc[0]), int(pdf["buffer_no"].iloc[0])
        out = []
        for row in pdf.itertuples():
            out.append((key[0], row.node, carried, buffer_no))
            carried, opened = _from_row(row).apply(carried, limit)
            buffer_no += opened
        return pd.DataFrame(out, columns=["shard", "node", "carried", "buffer_no"])

    level = level.withColumn("_parent", F.floor(F.col("node") / fan_in).cast("long"))
    if parents is None:
        entered = level.withColumn("carried", F.lit(0)).withColumn("buffer_no", F.lit(0))
    else:
        entered = level.join(parents.withColumnRenamed("node", "_parent"), ["shard", "_parent"])
    return entered.groupBy("shard", "_parent").applyInPandas(run, _ENTRY)


def _block_entries(meta: DataFrame, n_blocks: int, limit: float, fan_in: int) -> DataFrame:
    levels = [reliable(_block_steps(meta, limit))]
    width = n_blocks
    while width > fan_in:
        levels.append(reliable(_merge_steps(levels[-1], limit, fan_in)))
        width = math.ceil(width / fan_in)
    entries = None
    for level in reversed(levels):
        entries = _entries(level, entries, limit, fan_in)
    return entries


def assign_buffers(
    meta: DataFrame,
    limit: float,
    order_key: str,
    shards: int = 1,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
    widest: int = WIDEST,
) -> DataFrame:
    """Add ``buffer_id`` to ``(shard, order_key, n_chars, n_tokens)`` rows by the greedy rule.

    Also adds ``_block`` and ``_ahead``, the tokens of earlier documents of the same buffer and block.
    ``meta`` is read more than once, so it should be a written table. Where a buffer takes more than ``widest`` documents on average, tables of
    steps would be as long, and links between documents are doubled instead.
    """
    sums = meta.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")).first()
    indexed = index_keys(meta, [order_key], ["shard"], "_idx").withColumn(
        "_block", F.floor(F.col("_idx") / block_rows).cast("long")
    )
    if sums["n"] > block_rows and sums["n"] * limit > widest * sums["chars"]:
        return assign_wide(indexed, math.ceil(limit), sums["chars"] / sums["n"]).select(*meta.columns, "_block", "buffer_id", "_ahead")
    n_blocks = 1 if sums["n"] <= block_rows else indexed.agg(F.max("_block")).first()[0] + 1
    if n_blocks > 1:
        entries = _block_entries(indexed, n_blocks, limit, fan_in).withColumnRenamed("node", "_block")
        placed = indexed.join(broadcast_within(entries, n_blocks * shards), ["shard", "_block"])
    else:
        placed = indexed.withColumn("carried", F.lit(0).cast("long")).withColumn("buffer_no", F.lit(0).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        chars = pdf["n_chars"].to_numpy(dtype=np.int64)
        before = np.cumsum(chars) - chars
        starts = np.zeros(len(pdf), dtype=np.int64)
        at = int(np.searchsorted(before, limit - int(pdf["carried"].iloc[0]), side="left"))
        while at < len(pdf):
            starts[at] = 1
            at = int(np.searchsorted(before, before[at] + limit, side="left"))
        pdf["buffer_id"] = int(pdf["buffer_no"].iloc[0]) + np.cumsum(starts)
        pdf["_ahead"] = pdf.groupby("buffer_id")["n_tokens"].cumsum() - pdf["n_tokens"]
        return pdf[out_columns]

    out_columns = [*meta.columns, "_block", "buffer_id", "_ahead"]
    given = (f"`{f.name}` {f.dataType.simpleString()}" for f in meta.schema)
    schema = ", ".join([*given, "_block long", "buffer_id long", "_ahead long"])
    return placed.groupBy("shard", "_block").applyInPandas(run, schema)


@dataclass(frozen=True)
class Packed:
    """Result of packing: the chunks, one summary row per buffer, the keys of documents without a text, and counts.

    ``counts`` has ``documents`` and ``null_texts``, taken in the pass that makes the plan.
    """

    chunks: DataFrame
    buffers: DataFrame
    rejected: DataFrame
    counts: dict[str, int]
    #: ``chunks`` with the column ``_group`` by which they are placed.
    grouped: DataFrame


def _place(assigned: DataFrame, seq_len: int) -> DataFrame:
    """Token offset inside the buffer: offset inside the block plus what earlier blocks put into the buffer.

    Only per-(buffer, block) sums are ordered, so a buffer of any number of documents is no hot task.
    """
    parts = assigned.groupBy("shard", "buffer_id", "_block").agg(F.sum("n_tokens").alias("_n"))
    buffer = Window.partitionBy("shard", "buffer_id")
    earlier = buffer.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "shard",
        "buffer_id",
        "_block",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
        F.floor(F.sum("_n").over(buffer) / seq_len).cast("long").alias("_n_chunks"),
    )
    placed = assigned.join(shifts, ["shard", "buffer_id", "_block"])
    return placed.withColumn("_offset", F.col("_ahead") + F.col("_shift")).drop("_block", "_ahead", "_shift")


def _often_taken(assigned: DataFrame, text_key: list[str], n_documents: int) -> DataFrame | None:
    """Texts that more than ``COPIED`` documents take, with the copies they need; None where there is none. They fit a broadcast."""
    most = max(COPIED, math.ceil(n_documents / MOST_COPIED))
    taken = assigned.groupBy(*text_key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    often = reliable(taken.select(*text_key, F.ceil(F.col("_n") / most).cast("int").alias("_copies")))
    return None if often.isEmpty() else often


def _copied(docs: DataFrame, placed: DataFrame, text_key: list[str], often: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Texts and the documents that take them, with the key by which they meet: no task joins a text with all of very many documents."""
    if often is None:
        return docs, placed, text_key
    copies = F.coalesce("_copies", F.lit(1))
    spread = F.pmod(F.xxhash64("shard", "buffer_id", "_offset"), copies).cast("int")
    placed = placed.join(F.broadcast(often), text_key, "left").withColumn("_copy", spread)
    docs = docs.join(F.broadcast(often), text_key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return docs.drop("_copies"), placed.drop("_copies"), [*text_key, "_copy"]


def _cut(docs: DataFrame, ids: Column, placed: DataFrame, text_key: list[str], seq_len: int, as_text: bool = True) -> DataFrame:
    """One row per chunk, with its ``_group``: ``GROUP`` consecutive chunks, which are put together in one place.

    A document is sent to each group it has a part in as text, a fourth of its ids, and its tokens are made there. One of more chunks than
    a group has, or any that comes as ids, is cut into chunks before, so that nothing is sent more than twice. The
    merge hint keeps the texts out of a broadcast when they look small.
    """
    spans = placed.select(
        *text_key,
        "shard",
        "buffer_id",
        "_offset",
        F.floor(F.col("_offset") / seq_len).cast("long").alias("_from"),
        F.least(
            F.floor((F.col("_offset") + F.col("n_tokens") - 1) / seq_len).cast("long"), F.col("_n_chunks") - 1
        ).alias("_to"),
    ).where(F.col("_from") <= F.col("_to"))

    start = F.col("chunk_id") * seq_len
    skipped = F.greatest(start - F.col("_offset"), F.lit(0))
    taken = F.slice("_ids", (skipped + 1).cast("int"), (start + seq_len - F.col("_offset") - skipped).cast("int"))
    part = F.struct((F.col("_offset") + skipped).alias("at"), taken.alias("ids"))
    place = ["shard", "buffer_id", "_group"]

    def pieces(rows: DataFrame) -> DataFrame:
        """Chunks from ``_from`` to ``_to`` of documents whose tokens start at ``_offset``."""
        made = rows.select(*place, "_offset", "_from", "_to", ids.alias("_ids"))
        return made.select(*place, "_offset", "_ids", F.explode(F.sequence("_from", "_to")).alias("chunk_id"))

    def of(chunk: str) -> Column:
        return F.floor(F.col(chunk) / GROUP).cast("long")

    given = docs.join(spans.hint("merge"), text_key).withColumn("_group", F.lit(None).cast("long"))
    long = F.col("_to") - F.col("_from") >= GROUP if as_text else F.lit(True)
    cut = pieces(given.where(long)).select("shard", "buffer_id", of("chunk_id").alias("_group"), "chunk_id", part.alias("_part"))
    if as_text:
        sent = given.where(~long).withColumn("_group", F.explode(F.sequence(of("_from"), of("_to"))))
        sent = sent.select(
            *place, "_offset", "_text",
            F.greatest("_from", F.col("_group") * GROUP).alias("_from"), F.least("_to", F.col("_group") * GROUP + GROUP - 1).alias("_to"),
        )
        both = sent.unionByName(cut, allowMissingColumns=True).repartition(*place)
        cut_here = F.col("_part").isNull()
        # tokens first, in a step of their own: beside the generator they would be made for each chunk
        made = both.select(
            *place, "_offset", "_part", F.when(cut_here, ids).alias("_ids"),
            F.when(cut_here, F.sequence("_from", "_to")).otherwise(F.array("chunk_id")).alias("_numbers"),
        )
        here = made.select(*place, "_offset", "_part", "_ids", F.explode("_numbers").alias("chunk_id"))
        parts = here.select(*place, "chunk_id", F.coalesce("_part", part).alias("_part"))
    else:
        parts = cut.repartition(*place)
    whole = parts.groupBy(*place, "chunk_id").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return whole.select(
        *place, "chunk_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("input_ids")
    )


def pack_documents(
    df: DataFrame,
    tok: Tokenizer,
    seq_len: int = 1024,
    num_sequences: int = 1024,
    chars_per_token: float = 3.6,
    order_key: str = "doc_id",
    text: str = "text",
    formatting: Callable[[DataFrame], Column] | None = None,
    shards: int = 1,
    default_concat_id: int = 0,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
    widest: int = WIDEST,
    null_text: str = "quarantine",
    texts: DataFrame | None = None,
    text_key: Sequence[str] = (),
) -> Packed:
    """Pack documents in key order; with ``shards`` each shard is a pass of its own.

    A document whose text is null is not packed: its key is among the ``rejected``, or ``null_text="raise"`` makes it an error.

    With ``texts``, documents hold only the ``text_key`` of their text there, which any number of them may take: each text moves
    once to meet its documents, and nothing is written before that but keys and lengths. A key that is not among them is a null text.

    ``formatting`` maps the frame with the texts to the text column to pack. Tokens are made once per document, after
    the plan is fixed for the built-in tokenizer and before it for a model tokenizer.
    """
    held = df if texts is None else texts
    by = [order_key] if texts is None else list(text_key)
    source = formatting(held) if formatting else F.col(text)
    if null_text not in ("quarantine", "raise"):
        raise ValueError(f"unknown mode for null texts: {null_text}")
    docs = held.select(*by, source.alias("_text"))
    end = F.array(F.lit(concat_id(tok, default_concat_id)))
    ids = F.concat(tok.encode(F.col("_text")), end)
    if tok.prefix_stable:
        counted = docs.select(
            *by, F.length("_text").cast("long").alias("n_chars"),
            (tok.count(F.col("_text")) + 1).cast("long").alias("n_tokens"),
        )
    else:
        # a model runs once: its ids are kept in the checkpoint folder and read by both passes
        docs = reliable(docs.select(*by, F.length("_text").cast("long").alias("n_chars"), ids.alias("_ids")))
        ids = F.col("_ids")
        counted = docs.select(*by, "n_chars", F.size("_ids").cast("long").alias("n_tokens"))
    if texts is not None:
        counted = df.select(order_key, *by).join(counted, by, "left")
    # written first: range sorting samples its input, which must not be a second pass over the texts
    known = reliable(counted.withColumn("shard", hash_shard(F.col(order_key), shards)))
    null = F.col("n_chars").isNull()
    counts = known.agg(F.count("*").alias("documents"), F.count_if(null).alias("null_texts")).first().asDict()
    if counts["null_texts"] and null_text == "raise":
        raise ValueError(f"{counts['null_texts']} of {counts['documents']} documents have no text")
    meta = known.where(~null)
    limit = seq_len * chars_per_token * num_sequences
    assigned = reliable(assign_buffers(meta, limit, order_key, shards, block_rows, fan_in, widest))
    placed = _place(assigned, seq_len)
    buffers = placed.groupBy("shard", "buffer_id").agg(
        F.count("*").alias("n_documents"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("_n_chunks").alias("n_chunks"),
        (F.sum("n_tokens") - F.max("_n_chunks") * seq_len).alias("n_dropped_tokens"),
    )
    often = None if texts is None else _often_taken(assigned, by, counts["documents"])
    docs, taking, met = _copied(docs, placed, by, often)
    grouped = _cut(docs, ids, taking, met, seq_len, as_text=tok.prefix_stable)
    return Packed(grouped.drop("_group"), buffers, known.where(null).select(order_key), counts, grouped)


def pack_sequences(
    df: DataFrame,
    tok: Tokenizer,
    seq_len: int = 1024,
    shuffle_seed: int | None = None,
    **options,
) -> DataFrame:
    """``(shard, buffer_id, chunk_id, input_ids, labels)``; with a seed also ``chunk_pos``, the
    shuffled place of a chunk inside its buffer."""
    packed = pack_documents(df, tok, seq_len, **options)
    chunks = packed.chunks
    if shuffle_seed is not None:
        chunks = chunk_shuffle(packed.grouped, packed.buffers, shuffle_seed)
    return chunks.withColumn("labels", F.col("input_ids"))


def chunk_shuffle(chunks: DataFrame, buffers: DataFrame, seed: int) -> DataFrame:
    """Seeded order of the chunks inside each buffer.

    Ranks are made from (buffer, chunk number) alone and joined by group of chunks, the key the chunks are already
    partitioned by.
    """
    numbers = buffers.where(F.col("n_chunks") > 0).select(
        "shard", "buffer_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk_id")
    )
    rank = F.row_number().over(
        Window.partitionBy("shard", "buffer_id").orderBy(seeded_order(seed, F.col("chunk_id")), "chunk_id")
    )
    place = ["shard", "buffer_id", "_group"]
    ranked = numbers.withColumn("_pos", rank - 1).withColumn("_group", F.floor(F.col("chunk_id") / GROUP).cast("long"))
    ranks = ranked.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "_pos"))).alias("_ranks"))
    joined = chunks.join(ranks, place)
    return joined.withColumn("chunk_pos", F.element_at("_ranks", F.col("chunk_id"))).drop("_ranks", "_group")
