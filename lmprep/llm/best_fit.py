"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces behind a first, shorter one. Best-fit decreasing takes pieces from the longest to the shortest
and puts each into the open sequence with the least room that still holds it. Pieces of one length are alike, and so are sequences
with equal room, so the exact run needs only the number of pieces of each length: at most ``capacity``
numbers, however many documents there are. A segment tree over the rooms 0..capacity finds the tightest room in
logarithmic time. Its outcome is a list of steps, each saying where a run of equal pieces goes.

The pieces then get a number among those of their length (a distributed range sort, so a length that a third of
all pieces share is no hot key) and read their place from the steps.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lmprep.llm.arrow import struct, text_list
from lmprep.llm.byte_bpe import ByteTokenizer, read_vocabulary
from lmprep.llm.store import written

CAPACITY = 1024
EOS = 2


class RoomTree:
    """A segment tree over rooms: which ones are open, and the least open one of at least a given size."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def set(self, room: int, is_open: bool) -> None:
        node = self.width + room
        self.open[node] = int(is_open)
        node //= 2
        while node:
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]
            node //= 2

    def tightest(self, size: int) -> int | None:
        node = self.width + size
        if self.open[node]:
            return size
        while node > 1:  # up until an open right neighbour
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.width:  # then to its leftmost open leaf
            node *= 2
            if not self.open[node]:
                node += 1
        return node - self.width


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first number, end number, first sequence, pieces per sequence, offset).

    Piece ``first + i`` of this length goes to sequence ``first sequence + i // per`` at ``offset + (i % per) * length``.
    """
    tree = RoomTree(capacity)
    rooms: dict[int, deque[tuple[int, int]]] = {}  # room -> runs of sequences (first, number)
    steps, n_sequences = [], 0

    def put(room: int, first: int, number: int) -> None:
        rooms.setdefault(room, deque()).append((first, number))
        tree.set(room, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                # as many new sequences as the rest of this length fills
                put(capacity, n_sequences, -(-(total - done) // (capacity // length)))
                n_sequences += rooms[capacity][-1][1]
                room = capacity
            first, number = rooms[room].popleft()
            if not rooms[room]:
                tree.set(room, False)
            per, left = room // length, total - done
            full = min(number, left // per)
            offset = capacity - room
            if full:
                steps.append((length, done, done + full * per, first, per, offset))
                done += full * per
                if room - per * length:
                    put(room - per * length, first, full)
            elif left:
                steps.append((length, done, total, first, left, offset))
                done, full = total, 1
                put(room - left * length, first, 1)
            if number > full:
                rooms[room].appendleft((first + full, number - full))
                tree.set(room, True)
    return steps


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text",
    eos: int = EOS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document's ids are those of its text (null: empty) and ``eos``, so every document has a piece.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    types = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        types["ids"] = pa.list_(pa.int32())
    fields = "piece: int, start: long, length: long, ids_crc32: long" + ", ids: array<int>" * with_ids

    @F.arrow_udf(f"array<struct<{fields}>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = ByteTokenizer(shipped.value)
        end = np.uint32(eos).tobytes()
        for texts in batches:
            rows, ends = [], [0]
            for t in text_list(texts):
                ids = tokenizer.encode(t) + end
                total = len(ids) // 4
                start, size = 0, total % capacity or capacity
                while start < total:
                    part = ids[4 * start : 4 * (start + size)]
                    number = -(-start // capacity)
                    row = (number, start, size, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                    start, size = start + size, capacity
                ends.append(len(rows))
            values = struct(dict(zip(types, zip(*rows) if rows else [[]] * len(types))), types)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    pieces = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(cut(F.col(f"`{text}`"))).alias("p"))
    return pieces.select("doc_id", "p.*")


def _numbered(pieces: DataFrame) -> DataFrame:
    """Each row's number among the rows of its length.

    Rows are range-sorted by length and id and written; a partition's runs of a length then follow one another.
    """
    order = ("length", "doc_id", "piece")
    ordered = written(
        pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "pieces-in-order",
    )
    tagged = ordered.withColumn("part", F.shiftright("at", 33))
    runs = tagged.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("part", "length", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return tagged.join(shifts, ["part", "length"]).withColumn("number", F.col("at") + F.col("shift"))


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``.

    Other columns stay as they are, whatever their names, but for those two, which raise ``ValueError``. Lengths are 1 to ``capacity``. Every row is placed, rows that repeat included; null ids sort first. An empty table gives an
    empty one. Only the counts by length (at most ``capacity``) and the steps, whose number they bound, reach the driver.
    """
    if taken := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(taken)} would be replaced")
    # the row travels as one struct, so no column of ours can be taken for one of its own
    row = F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("row")
    numbered = _numbered(written(pieces.select("length", "doc_id", "piece", row), "pieces"))  # range bounds are sampled: tokens must not be made twice
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    steps = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    shipped = pieces.sparkSession.sparkContext.broadcast(steps)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        steps = shipped.value
        # lengths run downwards in the plan; turned round they sort together with the numbers
        keys = (capacity - steps[:, 0] << 40) + steps[:, 1]
        for lengths, numbers in batches:
            length, number = lengths.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (capacity - length << 40) + number, side="right") - 1
            _, first, _, sequence, per, offset = steps[at].T
            i = number - first
            types = {"sequence_id": pa.int64(), "offset": pa.int64()}
            yield struct({"sequence_id": sequence + i // per, "offset": offset + i % per * length}, types)

    placed = numbered.withColumn("placed", place("length", "number"))
    return placed.select("row.*", "placed.sequence_id", "placed.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """Token arrays of whole sequences, from placed pieces that carry their ids: at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
