"""Similarity join of documents by word shingles, with adaptive multi-match prefixes.

Every distinct shingle set is a node; documents with equal sets share one. The join goes from cheap facts about all documents to
costly ones about few:

1. One pass hashes all texts. Of each set, the shingles whose hash lies below a fixed limit are compared across the corpus; a set in
   which more than a quarter of all shingles occurs nowhere else cannot be linked and is done.
2. The sets left over are written once, and their shingles counted exactly among them; a shingle of one set only cannot be shared.
   With ``n`` shingles, two linked sets share at least ``need = ceil(0.75 n)``; a set with fewer shared shingles is done too.
3. Shingles are put in one order, rare ones first. Linked sets share ``k`` shingles among the first ``n - need + k`` of each, for any
   ``k`` up to ``need``. A longer prefix costs more index rows but asks for more shared shingles; each set takes the ``k`` with the least
   estimated cost. A pair has to meet the demand that follows from both prefixes and sizes before it is verified on whole sets.

Components come first, and no family of near copies is expanded into rows of pairs for them: each set is verified against the one partner with which it
shares most of its prefix; then, round by round as long as that links enough, sets outside a common shingle's largest component against the most
similar of ``LEADERS`` of its members. The exact rest joins prefix shingles across components, leaving out pairs inside one. A parity bitmap of
each set bounds the difference of a pair from below within that join. Every link is thus either verified or inside a component, and each
set's links are all counted inside its component: blocks of its sets meet as matrices, of which only counts for each set come back.

Shingles are 64-bit hashes, nodes 128 bits of sums of hashes; equal hashes are taken as equal shingles and sets. Step 1 compares about
``40 + log2(buckets)`` bits, which can only keep a set that could go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.cluster import input_bytes, shuffle_partitions
from lmprep.llm.arrow import chunks, text_buffer
from lmprep.llm.components import connected_components, more_links
from lmprep.llm.store import written
from lmprep.llm.words import mix, shingle_sets

WIDTH = 5
PERCENT = 75
#: Share of all hashes that the first pass compares. A quarter decides nothing, all would move every shingle.
COMPARED = 0.4
_LIMIT = int(COMPARED * 2**64)
#: Documents and compared shingles of a chunk, and bytes of input for each bucket of shingles.
CHUNK_DOCS, CHUNK_SHINGLES, BUCKET_BYTES = 8192, 1 << 19, 8 << 20
#: Most bits of the filter of nodes that are left; with more nodes than an eighth, a join does the rest.
FILTER_BITS = 1 << 24
#: Index rows that one verification is worth.
VERIFY_COST = 20.0
#: Members tried in a round of merging, sets that make a shingle common enough for it, and the share of tried pairs that must
#: turn out to be links for another round. They only decide how much is left to the exact rest.
LEADERS, CROWD, USEFUL = 3, 32, 0.1
#: Sets and shingles, on average, of a block in which links are counted; larger components are several blocks. Shingles multiplied at once,
#: and the work of a shingle in the product, relative to listing its pairs.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS, DENSE = 512, 1 << 20, 2048, 16
#: 64-bit words of a bitmap.
MAP_WORDS = 8
_FP_BITS, _LOCAL_BITS = 40, 24
_UNKNOWN = 1 << 60
_SEVERAL = (1 << _LOCAL_BITS) - 1


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for part in chunks(texts):
        yield from shingle_sets(*text_buffer(part), WIDTH)


def _node(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that is not empty."""
    n = np.uint64(len(found))
    ends = np.array([np.add.reduce(mix(found, 3)) ^ n, np.add.reduce(mix(found, 5)) + n], np.uint64)
    high, low = mix(ends, 4).astype(np.int64).tolist()
    return high, low


# --- 1. which sets can be linked at all

_SCAN = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())),
    ("n", pa.list_(pa.int32())), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())),
])


def _scan(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds. With ``bucket`` -1, a chunk of documents: ids, each one's place ``at`` in the chunk's list of distinct sets (-1: no
    shingles), and that list as n, high and low. Otherwise the keys of a chunk's compared shingles in one bucket.

    A key is a part of the shingle and the place of its set, or ``_SEVERAL`` if sets of the chunk share it: a shingle of any number of
    documents is one key per chunk.
    """
    width = _LIMIT // buckets + 1
    shift = max(0, (width - 1).bit_length() - _FP_BITS)

    def keys(sets: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        flat = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
        low = flat < np.uint64(_LIMIT)
        flat, at = flat[low], at[low]
        order = np.argsort(flat)
        flat, at = flat[order], at[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
        at = np.where(np.diff(np.r_[first, len(flat)]) > 1, np.uint64(_SEVERAL), at[first])
        flat = flat[first]
        bucket = flat // np.uint64(width)
        packed = ((flat - bucket * np.uint64(width)) >> np.uint64(shift)) << np.uint64(_LOCAL_BITS) | at
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
            yield int(bucket[a]), packed[a:b].tobytes()

    def rows(chunk: int, ids: list, at: list, nodes: dict, sets: list[np.ndarray]) -> pa.RecordBatch:
        out = [{
            "chunk": chunk, "bucket": -1, "ids": ids, "at": at, "n": [len(s) for s in sets], "high": [h for h, _ in nodes], "low": [x for _, x in nodes],
        }]
        if sets:
            out += [{"chunk": chunk, "bucket": b, "keys": k} for b, k in keys(sets)]
        return pa.RecordBatch.from_pylist(out, schema=_SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, at, nodes, sets, size = [], [], {}, [], 0
        for batch in batches:
            for i, found in zip(batch.column("doc_id").to_pylist(), _sets(batch.column("text"))):
                ids.append(i)
                if not len(found):
                    at.append(-1)
                    continue
                node = _node(found)
                if node not in nodes:
                    nodes[node] = len(nodes)
                    sets.append(found)
                    size += int(COMPARED * len(found))
                at.append(nodes[node])
                if size >= CHUNK_SHINGLES:
                    yield rows(chunk, ids, at, nodes, sets)
                    chunk, ids, at, nodes, sets, size = chunk + 1, [], [], {}, [], 0
            if len(ids) >= CHUNK_DOCS:
                yield rows(chunk, ids, at, nodes, sets)
                chunk, ids, at, nodes, sets, size = chunk + 1, [], [], {}, [], 0
        if ids:
            yield rows(chunk, ids, at, nodes, sets)

    return docs.mapInArrow(
        run, "chunk long, bucket int, keys binary, ids array<long>, at array<int>, n array<int>, high array<long>, low array<long>"
    )


def _alone(frame: pd.DataFrame) -> pd.DataFrame:
    """(chunk, found): for one bucket and each chunk the places of sets with shingles that no other set has, a place for each."""
    keys = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
    chunk = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    part = flat >> np.uint64(_LOCAL_BITS)
    order = np.argsort(part)
    part = part[order]
    same = part[1:] == part[:-1]
    single = ~(np.r_[False, same] | np.r_[same, False])
    at = (flat & np.uint64(_SEVERAL)).astype(np.int32)
    kept = order[single & (at[order] != _SEVERAL)]
    kept.sort()
    cuts = np.searchsorted(chunk[kept], np.arange(len(keys) + 1))
    found = [at[kept[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pd.DataFrame({"chunk": frame["chunk"], "found": found})


def _left_over(frame: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The sets of one chunk that may share enough."""
    if frame.empty:
        return pd.DataFrame({"high": [], "low": [], "n": []}).astype("int64")
    row = frame.iloc[0]
    n = np.asarray(row["n"], np.int64)
    alone = np.bincount(np.frombuffer(b"".join(counts["found"]), np.int32), minlength=len(n))[: len(n)]
    left = (n - alone) * 100 >= PERCENT * n
    return pd.DataFrame({"high": np.asarray(row["high"], np.int64)[left], "low": np.asarray(row["low"], np.int64)[left], "n": n[left]})


def _linkable(scan: DataFrame) -> DataFrame:
    """(high, low, n) of the sets that may share enough, once for each chunk."""
    alone = scan.where("bucket >= 0").select("bucket", "chunk", "keys").groupBy("bucket").applyInPandas(_alone, "chunk long, found binary")
    lists = scan.where("bucket = -1").select("chunk", "n", "high", "low")
    return lists.groupBy("chunk").cogroup(alone.groupBy("chunk")).applyInPandas(_left_over, "high long, low long, n long")


def _left_sets(docs: DataFrame, left: DataFrame) -> DataFrame:
    """(node, high, low, n, tokens) of the sets in ``left`` and of few others, each once; nodes are numbers of their own."""
    count = left.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * count - 1).bit_length()))
    words = left.select(F.col("high").bitwiseAND(F.lit(bits - 1)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")
    )
    flags = np.zeros(bits // 64, np.int64)
    found = words.toArrow()  # FILTER_BITS / 64 rows at most, whatever the input
    flags[found["word"].to_numpy()] = found["bits"].to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(np.unpackbits(flags.view(np.uint8), bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shipped.value, set()
        for batch in batches:
            nodes, sets, size = [], [], 0
            for tokens in _sets(batch.column("text")):
                node = _node(tokens) if len(tokens) else None
                if node is None or not known[node[0] & (bits - 1)] or node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sets.append(tokens.astype(np.int64))
                size += len(tokens)
                if size > 200_000:
                    yield rows(nodes, sets)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield rows(nodes, sets)

    def rows(nodes: list[tuple[int, int]], sets: list[np.ndarray]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets))
        ends = [pa.array([node[i] for node in nodes], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*ends, lists], names=["high", "low", "tokens"])

    sets = docs.select("text").mapInArrow(run, "high long, low long, tokens array<long>")
    if 8 * count > bits:
        sets = sets.join(left.select("high", "low").distinct(), ["high", "low"], "left_semi")
    once = sets.dropDuplicates(["high", "low"])
    return written(once.select(F.monotonically_increasing_id().alias("node"), "high", "low", F.size("tokens").alias("n"), "tokens"), "sets")


# --- 2. shared shingles, rare first


def _reduced(sets: DataFrame) -> DataFrame:
    """(node, n, tokens, often): of each set that has enough of them the shingles that others have too, rare ones first."""
    rows = sets.select("node", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    own = rows.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("own"))
    both = sets.select("node", "n").join(own, "node").where(F.size("own") * 100 >= F.col("n") * PERCENT)
    return both.select("node", "n", F.col("own.token").alias("tokens"), F.col("own.f").alias("often"))


# --- 3. prefixes


def demand(often: np.ndarray, base: int, need: int) -> int:
    """The number of matches ``k`` with the least estimated cost; ``often`` are frequencies, rising, of which a prefix has the first ``base - 1 + k``.

    Index rows are the sum of the prefix's frequencies. A candidate with ``k`` matches is in ``k`` of the lists, so there are at
    most sum / k of them, and at most as many as in all lists but the ``k - 1`` longest.
    """
    most = max(1, min(need, len(often) - base + 1))
    k = np.arange(1, most + 1)
    sums = np.concatenate([[0.0], np.cumsum(often.astype(float))])
    ends = np.minimum(base - 1 + k, len(often))
    rows = sums[ends]
    shorter = sums[np.maximum(ends - (k - 1), 0)]  # all lists but the k - 1 longest
    return int(k[np.argmin(rows + VERIFY_COST * np.minimum(rows / k, shorter))])


_ENTRY = {"token": pa.int64(), "node": pa.int64(), "n": pa.int32(), "place": pa.int32(), "k": pa.int32(), "rest": pa.int32(), "alone": pa.int32()}


def _prefixes(reduced: DataFrame) -> DataFrame:
    """Index rows: each prefix shingle of each set, its place in the set's order, the set's ``k``, the number of shingles (of the
    need) behind the prefix, and that of shingles which no other set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            lists = (batch.column(c) for c in ("node", "n", "tokens", "often"))
            for node, n, tokens, often in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(lists))):
                tokens, often = tokens.values.to_numpy(), often.values.to_numpy()
                alone = n - len(tokens)
                need = -(-PERCENT * n // 100)
                k = demand(often, n - need + 1 - alone, need)
                size = n - need + k - alone
                parts.append((tokens[:size], node, n, np.arange(alone, alone + size), k, need - k, alone))
                if sum(len(p[0]) for p in parts) > 100_000:
                    yield _entries(parts)
                    parts = []
            if parts:
                yield _entries(parts)

    return reduced.mapInArrow(run, "token long, node long, n int, place int, k int, rest int, alone int")


def _entries(parts: list[tuple]) -> pa.RecordBatch:
    sizes = [len(p[0]) for p in parts]
    columns = [p if np.ndim(p[0]) else np.repeat(p, sizes) for p in zip(*parts)]
    arrays = [np.concatenate(c) if isinstance(c, tuple) else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, _ENTRY.values())], names=list(_ENTRY))


def _maps(reduced: DataFrame) -> DataFrame:
    """(node, x0..): a bitmap of each set's shared shingles, a bit flipped by each.

    Two bitmaps differ in no more bits than their sets in shingles.
    """
    names = [f"x{i}" for i in range(MAP_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ends = np.asarray(lists.offsets)
            place = mix(lists.flatten().to_numpy().view(np.uint64), 7) % np.uint64(64 * MAP_WORDS)
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            flips = np.bincount(row * (64 * MAP_WORDS) + place.astype(np.int64), minlength=len(lists) * 64 * MAP_WORDS) & 1
            words = np.packbits(flips.astype(np.uint8).reshape(-1, 64 * MAP_WORDS), axis=1).view(np.int64)
            columns = [batch.column("node"), *(pa.array(words[:, i]) for i in range(MAP_WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", *names])

    return reduced.select("node", "tokens").mapInArrow(run, "node long, " + ", ".join(f"{x} long" for x in names))


def _near_sizes(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _alpha(n_a: Column, n_b: Column) -> Column:
    """Shingles that two similar sets share at least."""
    return F.ceil((n_a + n_b) * PERCENT / (100 + PERCENT))


# --- 4. candidates and links


def _first_partners(shared: DataFrame) -> DataFrame:
    """For each node the least node with which it shares most prefix shingles, of those that lead a shingle's rows.

    The set with the fewest shingles of its own leads: of near copies of one text the one changed least, and most like the others.
    """
    leads = shared.groupBy("token").agg(F.min(F.struct("alone", "node", "n", "rest")).alias("lead"))
    return _best_partners(shared.join(leads, "token").where(F.col("node") != F.col("lead.node")))


def _crowd_partners(shared: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """For each node outside a common shingle's largest component the most similar of some members of that component."""
    rows = _in_parts(shared, roots)
    draw = lambda i: F.xxhash64("node", F.lit(turn * LEADERS + i))
    draws = [
        F.min(F.struct(F.col("alone") + F.pmod(draw(i), F.lit(4 * i + 1)), draw(i), "node", "n", "rest")).alias(f"lead{i}")
        for i in range(LEADERS)
    ]
    parts = rows.groupBy("token", "part").agg(F.count("*").alias("c"), *draws)
    leads = F.array_distinct(F.array(*(F.struct(*(F.col(f"lead{i}.{c}").alias(c) for c in ("node", "n", "rest"))) for i in range(LEADERS))))
    tops = parts.groupBy("token").agg(
        F.max(F.struct("c", "part", leads.alias("leads"))).alias("top"), F.sum("c").alias("all"), F.count("*").alias("parts")
    )
    tops = tops.where((F.col("parts") > 1) & (F.col("all") >= CROWD)).select("token", "top")
    outside = rows.join(tops, "token").where(F.col("part") != F.col("top.part"))
    return _best_partners(outside.select("node", "n", "rest", F.explode("top.leads").alias("lead")))


def _in_parts(shared: DataFrame, roots: DataFrame) -> DataFrame:
    part = F.coalesce("root", "node").alias("part")
    return shared.join(roots, "node", "left").select("token", "node", "n", "place", "k", "rest", "alone", part)


def _best_partners(met: DataFrame) -> DataFrame:
    """Of rows (node, n, rest, lead) each node's partner with most common shingles, if these can be enough."""
    met = met.select("node", "n", "rest", F.col("lead.node").alias("partner"), F.col("lead.n").alias("m"), F.col("lead.rest").alias("behind"))
    asked = (_alpha(F.col("n"), F.col("m")) - F.greatest("rest", "behind")).alias("asked")
    met = met.where(_near_sizes("n", "m")).select("node", "partner", asked)
    counted = met.groupBy("node", "partner", "asked").agg(F.count("*").alias("common")).where("common >= asked")
    best = counted.groupBy("node").agg(F.max(F.struct("common", (-F.col("partner")).alias("p"), "partner")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.partner").alias("b"))


def _across(shared: DataFrame, roots: DataFrame, maps: DataFrame) -> DataFrame:
    """Candidate pairs of nodes in different components.

    For each shingle the component with most rows is set apart: a pair has one side at least outside of it.
    """
    placed = written(_in_parts(shared, roots), "placed")
    parts = placed.groupBy("token", "part").agg(F.count("*").alias("c"))
    tops = parts.groupBy("token").agg(F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("parts"))
    tops = tops.where("parts > 1").select("token", F.col("top.part").alias("top"))
    rows = written(placed.join(tops, "token").join(maps, "node"), "contested")
    words = [f"x{i}" for i in range(MAP_WORDS)]
    names = ("node", "n", "place", "k", "rest", "part", "alone", *words)
    left = rows.where("part <> top").select("token", *(F.col(c).alias(f"{c}_a") for c in names))
    right = rows.select("token", "top", *(F.col(c).alias(f"{c}_b") for c in names))
    # two similar sets share k shingles among the first n - alpha + k of each, for any k up to the prefixes' ends
    alpha = _alpha(F.col("n_a"), F.col("n_b"))
    asked = F.greatest(F.lit(1), F.least("k_a", "k_b", alpha - F.greatest("rest_a", "rest_b")))
    apart = F.col("alone_a") + F.col("alone_b")
    for x in words:
        apart = apart + F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b")))
    met = left.join(right, "token").where(
        (F.col("part_a") != F.col("part_b"))
        & ((F.col("part_b") == F.col("top")) | (F.col("node_a") < F.col("node_b")))
        & _near_sizes("n_a", "n_b")
        & (F.col("place_a") < F.col("n_a") - alpha + asked)
        & (F.col("place_b") < F.col("n_b") - alpha + asked)
        & (apart <= F.col("n_a") + F.col("n_b") - 2 * alpha)
    )
    pairs = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), asked.alias("asked"))
    return pairs.groupBy("a", "b", "asked").agg(F.count("*").alias("common")).where("common >= asked").select("a", "b")


def _verified(reduced: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough; only shared shingles can be in both."""
    sets = reduced.select("node", "n", "tokens")
    one = pairs.join(sets.withColumnsRenamed({"node": "a", "n": "p", "tokens": "x"}), "a")
    both = one.join(sets.withColumnsRenamed({"node": "b", "n": "q", "tokens": "y"}), "b")
    sized = both.select("a", "b", "p", "q", F.size(F.array_intersect("x", "y")).alias("i"))
    return sized.where(F.col("i") * 100 >= (F.col("p") + F.col("q") - F.col("i")) * PERCENT).select("a", "b")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``. A shingle of few sets adds its pairs one by one, others go by a matrix product."""
    sizes = [len(x) for x in (*a, *b)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    token = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")  # by shingle, first the sets of ``a``
    row, token = row[order], token[order]
    left = row < len(a)
    in_a, in_b = (np.bincount(token[side], minlength=token.max(initial=-1) + 1) for side in (left, ~left))
    pairs = in_a * in_b
    out = np.zeros(len(a) * len(b), np.int64)
    begin = np.concatenate([[0], np.cumsum(in_a + in_b)])
    often = pairs * DENSE > len(out)
    few = np.flatnonzero(left & (pairs > 0)[token] & ~often[token])
    each = in_b[token[few]]
    cuts = np.searchsorted(np.cumsum(each), np.arange(1 << 22, int(each.sum()) + (1 << 22), 1 << 22))
    for part in np.split(np.arange(len(few)), cuts):
        times = each[part]
        ahead = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        first = (begin[:-1] + in_a)[token[few[part]]]
        other = row[np.repeat(first, times) + ahead] - len(a)
        out += np.bincount(np.repeat(row[few[part]], times) * len(b) + other, minlength=len(out))
    out = out.reshape(len(a), len(b))
    many = np.flatnonzero(often & (pairs > 0))
    for at in range(0, len(many), COLUMNS):
        some = many[at : at + COLUMNS]
        column = np.full(len(pairs), -1)
        column[some] = np.arange(len(some))
        held = np.flatnonzero(column[token] >= 0)
        flags = np.zeros((len(sizes), len(some)), np.float32)
        flags[row[held], column[token[held]]] = 1
        out += (flags[: len(a)] @ flags[len(a) :].T).astype(np.int64)
    return out


def _linked(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Which sets of ``a`` are similar enough to which of ``b``."""
    common = _common(a["tokens"].tolist(), b["tokens"].tolist())
    sizes = a["n"].to_numpy(np.int64)[:, None] + b["n"].to_numpy(np.int64)
    return common * 100 >= (sizes - common) * PERCENT


def _block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """(node, c): links of each set inside a block, or between two blocks of one component."""
    found = []
    for _, sets in frame.groupby("root", sort=False):
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            linked = _linked(sets, sets)
            np.fill_diagonal(linked, False)
            found.append((sets["node"], linked.sum(axis=1)))
            continue
        one = sets["home"] == frame["i"].iloc[0]
        if one.any() and not one.all():
            linked = _linked(sets[one], sets[~one])
            found += [(sets["node"][one], linked.sum(axis=1)), (sets["node"][~one], linked.sum(axis=0))]
    if not found:
        return pd.DataFrame({"node": [], "c": []}).astype("int64")
    return pd.DataFrame({"node": np.concatenate([n for n, _ in found]), "c": np.concatenate([c for _, c in found])})


def _degrees(reduced: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n_links): for each node with links the number of all of them; each is inside a component.

    Small components share a group. One of several blocks has a group for each two of them, which is quadratic in its sets, as are its links,
    but bounded in memory for each group.
    """
    members = written(reduced.join(roots, "node").select("node", "root", "n", "tokens"), "members")
    weight = F.sum(F.size("tokens"))
    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(weight / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    bins = 1 + (members.agg(weight).first()[0] or 0) // BLOCK_SHINGLES
    home = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    key = F.when(F.col("parts") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bins)))
    placed = members.join(sizes, "root").select("node", "root", "n", "tokens", "parts", home.alias("home"), key.alias("key"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", "root", "node", "n", "tokens"
    )
    return met.groupBy("key", "i", "j").applyInPandas(_block_links, "node long, c long").groupBy("node").agg(F.sum("c").alias("n_links"))


def _links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, tokens) of the sets that may have links, with their shared shingles, and (node, root) of all nodes with links."""
    reduced = written(_reduced(sets), "reduced")
    shared = written(_prefixes(reduced), "prefixes")
    links = written(_verified(reduced, written(_first_partners(shared), "partners")), "links")
    roots = written(connected_components(links), "roots")
    turn, found, tried = 0, 1, 1
    while found > USEFUL * tried:
        pairs = written(_crowd_partners(shared, roots, turn), "partners")
        more = written(_verified(reduced, pairs), "links")
        turn, tried, found = turn + 1, pairs.count(), more.count()
        if found:
            roots = more_links(roots, more)
    more = written(_verified(reduced, written(_across(shared, roots, _maps(reduced)), "candidates")), "links")
    return reduced, more_links(roots, more)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    ``component_id`` is the least id that links reach, itself included. A null or empty text has no shingles and its own id; an empty table gives no
    rows. Texts of any length are read whole. Rows with equal sets are linked whatever their ids; a null id takes part and is nobody's component id
    unless all ids of the component are null. ``n_links`` counts all links of the row's set to other sets (rows with equal sets are one); without
    ``count_links`` it is null where there are any. Other columns of ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = input_bytes(docs)
    if size > _UNKNOWN:  # not read from files
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scan = written(_scan(docs, max(shuffle_partitions(spark), size // BUCKET_BYTES)), "scan")
    listed = scan.where("bucket = -1").select(F.explode(F.arrays_zip("ids", "at")).alias("d"), "n", "high", "low")
    place = F.col("d.at") + 1
    pick = lambda c: F.when(place > 0, F.get(c, place - 1))
    members = listed.select(
        F.col("d.ids").alias("doc_id"), F.coalesce(pick("n"), F.lit(0)).cast("long").alias("n"), pick("high").alias("high"), pick("low").alias("low")
    )
    left = written(_linkable(scan), "linkable")
    sets = _left_sets(docs, left)
    reduced, roots = _links(sets)
    if count_links:
        roots = roots.join(_degrees(reduced, roots), "node")
    else:
        roots = roots.withColumn("n_links", F.lit(None).cast("long"))
    tops = roots.join(sets.select("node", "high", "low"), "node").select("high", "low", "root", "n_links")
    firsts = members.where("high IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("first"))
    nodes = written(firsts.join(tops, ["high", "low"], "left"), "nodes")
    least = nodes.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    nodes = nodes.join(least, "root", "left").select(
        "high", "low", F.coalesce("least", "first").alias("component_id"), F.when(F.col("root").isNull(), 0).otherwise(F.col("n_links")).alias("n_links")
    )
    out = members.join(nodes, ["high", "low"], "left")
    bare = F.when(F.col("high").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), bare.alias("component_id"), F.when(F.col("high").isNull(), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the one with its least id, columns unchanged, whatever their names.

    Rows that repeat that id are one document, of which one row stays. Rows with a null id all stay, they cannot be named.
    A null or empty text is a component of its own; an empty table stays empty.
    """
    name = "kept"
    while name in docs.columns:
        name += "_"
    placed = similar_documents(docs, id_col, text, count_links=False)
    kept = placed.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    once = known.join(kept, F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
