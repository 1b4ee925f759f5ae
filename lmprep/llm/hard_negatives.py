"""Hard negatives by exact integer scores, computed with the method of the Four Russians.

The sum over eight dimensions of an anchor has 256 values when each dimension is in or out; they are tabulated once per anchor and group of
eight. A candidate is stored as bit planes of its two's complement components, eight dimensions to a byte; plane ``p``
picks one entry of each group's table, and the entries, doubled from plane to plane (the sign plane counts negative), add up to
the full inner product. Nothing is estimated.

Anchors are a stated query set against all rows, both in blocks. Blocks of candidates hold consecutive ids and are dealt in stripes; a task has
one block of anchors and one stripe, carries its best scores on, and gives at most a fixed number of rows per anchor. Candidates
are scored with anchors of their own label for the positives, then with all for the negatives. A label may hold any share of the rows, since blocks
are made by id. Of equal vectors with one label only the least ids can be in a result, so the others are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmprep.cluster import shuffle_partitions
from lmprep.llm.best import LOWEST, Best, growing
from lmprep.llm.store import written
from lmprep.llm.vectors import longest, matrix

#: Anchors and candidates of a block, and candidate blocks of a stripe, about.
ANCHORS, CANDIDATES, STRIPE = 256, 4096, 16
#: Dimensions of a table: one byte of a bit plane.
GROUP = 8


class Tables:
    """Subset sums of each anchor's groups: ``tables[g][byte]`` is a row with a sum for every anchor."""

    def __init__(self, anchors: np.ndarray):
        count, width = anchors.shape
        padded = np.zeros((count, -(-width // GROUP) * GROUP), np.int64)
        padded[:, :width] = anchors
        self.kind = np.int32 if int(np.abs(anchors).sum(axis=1).max(initial=0)) < 1 << 31 else np.int64
        self.sums = np.abs(padded).sum(axis=1)
        self.tables = []
        for g in range(0, padded.shape[1], GROUP):
            table = np.zeros((1 << GROUP, count), self.kind)
            for bit in range(GROUP):
                table[1 << bit : 2 << bit] = table[: 1 << bit] + padded[:, g + bit].astype(self.kind)
            self.tables.append(table)

    def scores(self, planes: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Scores of candidates (rows) with anchors ``first:last``; ``planes[p, g]`` is a byte per candidate, sign plane first."""
        last = len(self.sums) if last is None else last
        count, groups, rows = planes.shape
        # |score| is at most the anchor's sum of sizes times 2^(planes - 1)
        small = int(self.sums[first:last].max(initial=0)) << max(count - 1, 0) < 1 << 31
        total = np.zeros((rows, last - first), np.int32 if small else np.int64)
        for p in range(count):
            if p == 1:
                np.negative(total, out=total)  # the sign plane
            total += total
            for g in range(groups):
                total += self.tables[g][:, first:last].take(planes[p, g], axis=0)
        return -total if count == 1 else total


def bit_planes(x: np.ndarray) -> np.ndarray:
    """``[plane, group, row]``: bytes of the two's complement of integer rows, most significant plane first."""
    rows, width = x.shape
    bits = 1 + max(int(x.max(initial=0)).bit_length(), int(-1 - x.min(initial=0)).bit_length())
    groups = -(-width // GROUP)
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :width] = x
    out = np.empty((bits, groups, rows), np.uint8)
    for p in range(bits):
        plane = (padded >> (bits - 1 - p)) & 1
        out[p] = np.packbits(plane.astype(np.uint8).reshape(rows, groups, GROUP), axis=2, bitorder="little")[:, :, 0].T
    return out


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("planes", pa.binary()), ("depth", pa.int32())])


def _candidate_blocks(rows: DataFrame, count: int, width: int, size: int) -> DataFrame:
    """(block, ids, labels, planes, depth) of consecutive ids, about ``size`` rows each."""
    dealt = rows.select("id", "label", "x").repartitionByRange(max(1, -(-count // size)), "id").sortWithinPartitions("id")

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        one = pa.Table.from_batches(held).combine_chunks()
        planes = bit_planes(matrix(one.column("x").combine_chunks(), width))
        lists = {name: one.column(column).to_pylist() for name, column in (("ids", "id"), ("labels", "label"))}
        return pa.RecordBatch.from_pylist([{**lists, "planes": planes.tobytes(), "depth": len(planes)}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield block(held)
                held = []
        if any(b.num_rows for b in held):
            yield block(held)

    made = dealt.mapInArrow(run, "ids array<long>, labels array<long>, planes binary, depth int")
    return written(made.withColumn("block", F.xxhash64(F.element_at("ids", 1))), "candidates")


def _met(anchors: DataFrame, candidates: DataFrame, run, schema: str) -> DataFrame:
    """Every block of anchors with every stripe of candidate blocks, one group of rows for each such pair."""
    n_anchors = max(1, -(-anchors.count() // ANCHORS))
    blocks = max(1, -(-candidates.agg(F.sum(F.size("ids"))).first()[0] // CANDIDATES)) if candidates.count() else 1
    # stripes are short where otherwise too few pairs would keep all cores at work
    stripes = max(-(-blocks // STRIPE), min(blocks, -(-3 * shuffle_partitions(anchors.sparkSession) // n_anchors)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumn("anchors", F.pmod(F.xxhash64("id"), F.lit(n_anchors)).cast("int")).withColumn("stripe", every(stripes))
    offered = candidates.withColumn("stripe", F.pmod("block", F.lit(stripes)).cast("int")).withColumn("anchors", every(n_anchors))
    return asked.groupBy("anchors", "stripe").cogroup(offered.groupBy("anchors", "stripe")).applyInPandas(run, schema)


def _rows(frame: pd.DataFrame, width: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Anchors ordered by label, and their vectors."""
    frame = frame.sort_values(["label", "id"])
    return frame, matrix(pa.array(frame.x.tolist(), pa.list_(pa.int64())), width)


def _in_order(frame: pd.DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, planes) of each candidate block, ids rising from block to block."""
    for row in frame.iloc[np.argsort([ids[0] for ids in frame.ids])].itertuples():
        planes = np.frombuffer(row.planes, np.uint8).reshape(row.depth, -(-width // GROUP), len(row.ids))
        yield np.asarray(row.ids, np.int64), np.asarray(row.labels, np.int64), planes


def _positives(anchors: DataFrame, candidates: DataFrame, k: int, width: int) -> DataFrame:
    """(anchor_id, id, score): the ``k`` best other rows of an anchor's label."""

    def run(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame({"anchor_id": [], "id": [], "score": []}).astype("int64")
        asked, x = _rows(asked, width)
        ids, labels = asked.id.to_numpy(), asked.label.to_numpy()
        tables, best = Tables(x), Best(len(ids), k, np.int64)
        for c_ids, c_labels, planes in _in_order(offered, width):
            for label in np.intersect1d(labels, c_labels):
                first, last = np.searchsorted(labels, [label, label + 1])
                own = np.flatnonzero(c_labels == label)
                for chunk in growing(len(own)):
                    rows = own[chunk]
                    scores = tables.scores(planes[:, :, rows], first, last)
                    r, s = np.nonzero(scores > best.bar()[first:last])  # ids rise, so a tie comes too late
                    other = c_ids[rows[r]] != ids[first + s]
                    r, s = r[other], s[other]
                    best.offer(first + s, scores[r, s].astype(np.int64), c_ids[rows[r]])
        found = best.scores > LOWEST
        return pd.DataFrame({"anchor_id": np.repeat(ids, found.sum(axis=1)), "id": best.ids[found], "score": best.scores[found]})

    met = _met(anchors, candidates, run, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _negatives(anchors: DataFrame, candidates: DataFrame, k: int, slots: int, low: int, high: int, width: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): for each positive the ``k`` best rows of other labels in its window.

    ``anchors`` have up to ``slots`` positives, in the arrays ``positives`` and ``scores``.
    """
    names = ("anchor_id", "positive_id", "positive_score", "id", "score")

    def run(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame({n: [] for n in names}).astype("int64")
        asked, x = _rows(asked, width)
        ids, labels = asked.id.to_numpy(), asked.label.to_numpy()
        real = np.arange(slots) < np.array([len(p) for p in asked.positives])[:, None]
        positives, wanted = np.zeros(real.shape, np.int64), np.zeros(real.shape, np.int64)
        positives[real], wanted[real] = np.concatenate(asked.positives.tolist()), np.concatenate(asked.scores.tolist())
        # low * wanted <= 100 * score <= high * wanted; an empty slot's window is empty
        least, most = np.where(real, -(-low * wanted // 100), 1), np.where(real, high * wanted // 100, 0)
        tables, best = Tables(x), Best(wanted.size, k, np.int64)
        for c_ids, c_labels, planes in _in_order(offered, width):
            for chunk in growing(len(c_ids)):
                scores = tables.scores(planes[:, :, chunk])
                bar = best.bar().reshape(wanted.shape)
                floor = np.where(bar > LOWEST, np.maximum(least, bar + 1), least)  # ids rise, so a tie comes too late
                r, s = np.nonzero((scores >= floor.min(axis=1)) & (scores <= most.max(axis=1)))
                other = c_labels[chunk][r] != labels[s]
                r, s = r[other], s[other]
                score, own = scores[r, s].astype(np.int64), c_ids[chunk][r]
                for j in range(slots):
                    useful = (score >= floor[s, j]) & (score <= most[s, j])
                    best.offer(s[useful] * slots + j, score[useful], own[useful])
        found = best.scores > LOWEST
        slot = np.repeat(np.arange(wanted.size), found.sum(axis=1))
        columns = ids[slot // slots], positives.ravel()[slot], wanted.ravel()[slot], best.ids[found], best.scores[found]
        return pd.DataFrame(dict(zip(names, columns)))

    met = _met(anchors, candidates, run, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has ``id``, an integer ``label`` and ``x``, an array of longs without nulls; ``is_anchor`` is a condition on them. An anchor's positives are
    its best other rows of the same label by inner product, ties to the smaller id; a positive's negatives are the best rows of other labels
    with ``low * positive_score <= 100 * negative_score <= high * positive_score``. All, if fewer. A positive without any has no row, neither has
    an empty table; a positive score below 0 has an empty window.

    Rows with a null id, label or vector take no part. Shorter vectors count as filled up with zeros; vectors may be of any length. Of rows that
    share an id one takes part, that with the least label, then vector. Columns besides the three are not read. Scores must fit in 62 bits.
    """
    least = F.min(F.struct("label", "x")).alias("row")
    rows = vectors.select("id", F.col("label").cast("long").alias("label"), "x", is_anchor.alias("asked")).where(
        "id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL"
    )
    rows = written(rows.groupBy("id", "asked").agg(least).select("id", "asked", "row.*"), "rows")
    width = longest(rows, "x")
    anchors = rows.where("asked").select("id", "label", "x")
    same = Window.partitionBy("label", "x").orderBy("id")
    told = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= max(positives + 1, negatives))
    candidates = _candidate_blocks(told, rows.count(), width, CANDIDATES)
    best = _positives(anchors, candidates, positives, width).where("score >= 0")
    known = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("own"))
    known = known.select("id", F.col("own.id").alias("positives"), F.col("own.score").alias("scores"))  # ``positives`` at most
    found = _negatives(written(anchors.join(known, "id"), "anchors"), candidates, negatives, positives, low, high, width)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
