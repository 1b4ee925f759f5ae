"""Exact top-k by inner product: dual-tree search on cover trees.

Queries and data are dealt into blocks of near vectors; each block holds a cover tree. A node has a centre, which is one of its points, and
a radius that covers all of them; the children's centres lie farther apart than the radius they cover. For a
pair of nodes no inner product exceeds ``cq.cd + |cq| rd + |cd| rq + rq rd``; the pair is left out if that is below the worst k-th score of
the queries under its query node. Pairs are visited best bound first. A node whose points are too scattered for children of a leaf's
size on average is a leaf itself: a pair of leaves is one matrix product, of which only scores above the bar are looked at.

Every query block meets every data block, dealt in stripes of a few data blocks to a task; within a stripe a task carries
its k-th scores on. Of equal vectors only the ``k + 1`` least ids can be in a result, so the others are left out first.
Components are integers below 2^20 in size and scores stay exact in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmprep.llm.best import Best, growing
from lmprep.llm.store import written

#: Vectors of a block, of a leaf, and data blocks of a stripe.
QUERY_BLOCK, DATA_BLOCK, LEAF, STRIPE = 512, 2048, 48, 16
#: The radius that children cover, as a part of their parent's.
SHRINK = 1 / 1.5
_CODE_BITS = 12


class CoverTree:
    """``order`` sorts the points so that a node's are ``start:end``; children of a node are adjacent."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.order = np.arange(len(points))
        self.start, self.end, self.first, self.children, self.centre, self.radius = [], [], [], [], [], []
        if len(points):
            self._split(points, self._add(points, 0, len(points), 0))
        self.points = points[self.order]
        self.start, self.end, self.first, self.children = map(np.array, (self.start, self.end, self.first, self.children))
        self.centres = points[np.array(self.centre, int)] if len(points) else points
        self.radius = np.array(self.radius)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    def _add(self, points: np.ndarray, start: int, end: int, centre: int) -> int:
        self.start.append(start)
        self.end.append(end)
        self.first.append(-1)
        self.children.append(0)
        self.centre.append(centre)
        own = points[self.order[start:end]] - points[centre]
        self.radius.append(float(np.sqrt((own**2).sum(axis=1).max())))
        return len(self.start) - 1

    def _split(self, points: np.ndarray, root: int) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            start, end = self.start[node], self.end[node]
            if end - start <= self.leaf or self.radius[node] == 0:
                continue
            index = self.order[start:end]
            own = points[index]
            cover = (self.radius[node] * SHRINK) ** 2
            centres, nearest, owner = [], np.full(len(own), np.inf), np.zeros(len(own), int)
            most = len(own) // self.leaf
            far = int(np.flatnonzero(index == self.centre[node])[0])  # a node's centre is its first child's too
            while (nearest.max() > cover or not centres) and len(centres) <= most:
                distance = ((own - own[far]) ** 2).sum(axis=1)
                closer = distance < nearest
                owner[closer], nearest[closer] = len(centres), distance[closer]
                centres.append(int(index[far]))
                far = int(nearest.argmax())
            if len(centres) > most:
                continue  # too scattered: children would hold less than a leaf each, a matrix product is cheaper
            sizes = np.bincount(owner, minlength=len(centres))
            self.order[start:end] = index[np.argsort(owner, kind="stable")]
            cuts = start + np.r_[0, np.cumsum(sizes)]
            self.first[node], self.children[node] = len(self.start), len(centres)
            for c, a, b in zip(centres, cuts[:-1], cuts[1:]):
                todo.append(self._add(points, int(a), int(b), c))


def search(queries: CoverTree, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Offer every point of ``data`` that may be among the best; ``ids`` are in tree order. Returns the scores computed."""
    if not len(queries.points) or not len(data.points):
        return 0
    computed = 0

    def bounds(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        inner = (queries.centres[q] * data.centres[d]).sum(axis=1)
        rq, rd = queries.radius[q], data.radius[d]
        return inner + queries.norms[q] * rd + data.norms[d] * rq + rq * rd + 1e-3  # above rounding

    todo = [(float(bounds(np.array([0]), np.array([0]))[0]), 0, 0)]
    while todo:
        bound, q, d = todo.pop()
        start, end = queries.start[q], queries.end[q]
        worst = best.bar()[start:end].min()
        if bound < worst:
            continue
        split_q, split_d = queries.children[q] > 0, data.children[d] > 0
        if not split_q and not split_d:
            points, own = data.points[data.start[d] : data.end[d]], ids[data.start[d] : data.end[d]]
            for part in growing(len(points)):
                scores = points[part] @ queries.points[start:end].T
                r, s = np.nonzero(scores >= best.bar()[start:end])
                best.offer(start + s, scores[r, s], own[part][r])
                computed += scores.size
            continue
        if split_d and (not split_q or data.radius[d] >= queries.radius[q]):
            ds = np.arange(data.first[d], data.first[d] + data.children[d])
            qs = np.full(len(ds), q)
        else:
            qs = np.arange(queries.first[q], queries.first[q] + queries.children[q])
            ds = np.full(len(qs), d)
        found = bounds(qs, ds)
        for i in np.argsort(found, kind="stable"):
            if found[i] >= worst:
                todo.append((float(found[i]), int(qs[i]), int(ds[i])))
    return computed


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): each component x as floor(scale * x), for ids that are not null and vectors without null or non-finite components."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & fine)
    return rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"),
    )


def _codes(rows: DataFrame) -> DataFrame:
    """Signs of fixed random projections: near vectors mostly share them, so a range of codes is a near block."""

    @F.arrow_udf("int")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            vectors = [np.asarray(x, float) for x in v.to_pylist()]
            width = max(map(len, vectors), default=0)
            plane = np.random.default_rng(7).standard_normal((width, _CODE_BITS))
            out = [int((x @ plane[: len(x)] > 0) @ (1 << np.arange(_CODE_BITS)[::-1])) for x in vectors]
            yield pa.array(out, pa.int32())

    return rows.withColumn("code", code("v"))


def _blocks(rows: DataFrame, count: int, size: int, label: str) -> DataFrame:
    """(block, ids, values, width): about ``size`` rows each, by code; ``values`` are row by row."""
    parts = max(1, -(-count // size))
    dealt = _codes(rows).repartitionByRange(parts, "code", "id").coalesce(parts)
    dealt = dealt.withColumn("block", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, block = [], [], 0
        for b in batches:
            ids += b.column("id").to_pylist()
            values += b.column("v").to_pylist()
            block = b.column("block")[0].as_py() if len(b) else block
        if ids:
            width = max(map(len, values))
            flat = [x for v in values for x in (*v, *([0.0] * (width - len(v))))]
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())),
                 "values": pa.array([flat], pa.list_(pa.float64())), "width": pa.array([width], pa.int32())}
            )

    return written(dealt.select("id", "v", "block").mapInArrow(run, "block int, ids array<long>, values array<double>, width int"), label)


def _matrix(row, width: int) -> np.ndarray:
    own = np.asarray(row.values, float).reshape(len(row.ids), -1) if row.width else np.zeros((len(row.ids), 0))
    return np.pad(own, ((0, 0), (0, width - own.shape[1])))


def top_k(
    vectors: DataFrame, is_query, k: int = 5, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` best other rows, ties to the smaller id; all, if fewer.

    ``vectors`` has ``id`` and ``v``; ``is_query`` is a condition on them. Shorter vectors count as filled up with zeros. Rows that repeat an id
    are one row of the result per rank: an id is offered once for each different vector, and never to itself.
    """
    vectors = written(vectors.distinct(), "vectors")
    queries = vectors.where(is_query)
    first = Window.partitionBy("v").orderBy("id")
    data = vectors.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).drop("at")
    n_queries = queries.count()
    left = _blocks(queries, n_queries, query_block, "query-blocks")
    right = _blocks(data, vectors.count(), data_block, "data-blocks")
    q_blocks = left.agg(F.max("block")).first()[0]
    d_blocks = right.agg(F.max("block")).first()[0]
    stripes = 1 if d_blocks is None else d_blocks // STRIPE + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    asked = left.withColumn("stripe", every(stripes - 1)).withColumnRenamed("block", "q")
    offered = right.withColumn("stripe", (F.col("block") % stripes).cast("int")).withColumn("q", every(q_blocks or 0))

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = int(max(q.width.max(), d.width.max()))
        parts = list(q.itertuples())
        tree = CoverTree(np.vstack([_matrix(p, width) for p in parts]))
        q_ids = np.concatenate([np.asarray(p.ids, np.int64) for p in parts])[tree.order]
        best = Best(len(q_ids), k + 1)
        for row in d.sort_values("block").itertuples():
            other = CoverTree(_matrix(row, width))
            search(tree, other, np.asarray(row.ids, np.int64)[other.order], best)
        found = np.isfinite(best.scores) & (best.ids != q_ids[:, None])
        return pd.DataFrame(
            {"query_id": np.repeat(q_ids, found.sum(axis=1)), "vec_id": best.ids[found], "score": best.scores[found].astype(np.int64)}
        )

    schema = "query_id long, vec_id long, score long"
    met = asked.groupBy("q", "stripe").cogroup(offered.groupBy("q", "stripe")).applyInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
