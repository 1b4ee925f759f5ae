"""Masked pseudo-likelihood: documents scored by a network that predicts each word from both sides.

Vocabulary: the most frequent words of all documents; every other word is its ending (one of ``ENDINGS`` groups). The network
adds up an embedding of each of the two words before and the two after, one table for each place, takes a tanh, and predicts the
word in two steps, its frequency class and the word within the class, so that probabilities are exactly normalised at a cost of
about 100 outputs. It is trained in NumPy with Adagrad; every position of every document is masked once, in one of ``ROUNDS`` rounds. Each
partition trains its own copy from the same start, and the copies are averaged in Spark, weighted by words, as exact fixed-point sums; this is
repeated in each round. The score of a document is the sum of log P(word | words around) over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.llm.arrow import CHUNK_BYTES, chunks, text_buffer
from lmprep.llm.store import written
from lmprep.llm.words import word_hashes, word_spans

WORDS, ENDINGS, GROUP, DIM, SIDES = 1984, 64, 64, 16, (-2, -1, 1, 2)
#: One position in ``MASK`` is trained on, split over ``ROUNDS`` rounds; 1 is all of them.
MASK, ROUNDS, RATE, BATCH = 1, 2, 0.2, 512
#: Words scored at once.
SCORED = 32_768
_FIXED = 1e4
_ROW = 64


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the words kept, their numbers by frequency, and log-frequencies of all outputs."""

    hashes: np.ndarray
    numbers: np.ndarray
    weights: np.ndarray

    @property
    def outputs(self) -> int:
        return WORDS + ENDINGS


def tokens(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of some texts, and how many words stand before each text."""
    data, offsets = text_buffer(texts)
    starts, ends, counts = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    out = _endings(data, ends)
    if len(vocabulary.hashes):
        at = np.minimum(np.searchsorted(vocabulary.hashes, hashes), len(vocabulary.hashes) - 1)
        known = vocabulary.hashes[at] == hashes
        out[known] = vocabulary.numbers[at[known]]
    return out, counts


def _numbered(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``tokens`` of consecutive parts of a column, which holds texts or what ``number_words`` makes of them."""
    if not pa.types.is_binary(column.type):
        yield from (tokens(part, vocabulary) for part in chunks(column))
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, start = column.buffers()[2], 0
    while start < len(column):
        stop = min(len(column), max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK_BYTES // 4, side="right")) - 1))
        words = np.frombuffer(data, np.uint8)[ends[start] : ends[stop]] if data else np.zeros(0, np.uint8)
        yield words.copy().view("<i2").astype(np.int64), (ends[start : stop + 1] - ends[start]).astype(np.int64) // 2
        start = stop


def _endings(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = data[ends - 1].astype(np.int64)
    return WORDS + (last * 31 + data[np.maximum(ends - 2, 0)]) % ENDINGS


def _windows(ids: np.ndarray, counts: np.ndarray, chosen: slice = slice(None)) -> np.ndarray:
    """For each word, or each chosen one, the words at ``SIDES``; outside the text there is the number behind the last output."""
    edge = WORDS + ENDINGS
    reach = max(SIDES)
    n_texts = len(counts) - 1
    text = np.repeat(np.arange(n_texts), np.diff(counts))
    spaced = np.full(len(ids) + reach * (n_texts + 1), edge, np.int64)
    place = np.arange(len(ids)) + reach * (text + 1)
    spaced[place] = ids
    place = place[chosen]
    return np.stack([spaced.take(place + s) for s in SIDES], axis=1)


class Network:
    """Parameters are views of one array, the tables of all sides first, so that a step is taken on all others at once."""

    def __init__(self, weights: np.ndarray):
        rng = np.random.default_rng(11)
        size, classes = WORDS + ENDINGS, (WORDS + ENDINGS) // GROUP
        grouped = weights.reshape(classes, GROUP)
        self.shapes = {"E": (len(SIDES), size + 1, DIM), "U": (DIM, classes), "c": (classes,), "W": (classes, DIM, GROUP), "w": (classes, GROUP)}
        start = {
            "E": rng.normal(0, 0.3, self.shapes["E"]), "U": rng.normal(0, 0.1, self.shapes["U"]), "c": np.log(grouped.sum(axis=1)),
            "W": rng.normal(0, 0.1, self.shapes["W"]), "w": np.log(grouped) - np.log(grouped.sum(axis=1, keepdims=True)),
        }
        self.all = np.concatenate([start[k].ravel() for k in self.shapes]).astype(np.float32)
        self.params = self._views(self.all)
        self.tables = self.params["E"].reshape(-1, DIM)
        self.speed = np.full(len(self.all), 0.1, np.float32)
        self.step = np.zeros(len(self.all), np.float32)
        self.steps = self._views(self.step)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([int(np.prod(shape)) for shape in self.shapes.values()])[:-1]
        return {k: part.reshape(shape) for (k, shape), part in zip(self.shapes.items(), np.split(flat, ends))}

    def flat(self) -> np.ndarray:
        return self.all.copy()

    def load(self, flat: np.ndarray) -> "Network":
        self.all[:] = flat
        return self

    def _rows(self, around: np.ndarray) -> np.ndarray:
        """For each side, the rows of ``tables`` that its words have."""
        return np.add(around.T, np.arange(len(SIDES))[:, None] * self.shapes["E"][1], order="C")

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        total = self.tables.take(rows[0], axis=0)
        for side in range(1, len(SIDES)):
            total += self.tables.take(rows[side], axis=0)
        return np.tanh(total, out=total)

    def log_probs(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log P(word | around) of each row."""
        h, cls, out = self.hidden(self._rows(around)), words // GROUP, np.empty(len(words))
        logits = h @ self.params["U"]
        logits += self.params["c"]
        out[:] = _at(logits, cls) - _log_sum(logits)
        order, slices = _by_class(cls)
        h, within, inner = h.take(order, axis=0), (words % GROUP)[order], np.empty(len(words), np.float32)
        for c, rows in slices:
            logits = h[rows] @ self.params["W"][c]
            logits += self.params["w"][c]
            inner[rows] = _at(logits, within[rows]) - _log_sum(logits)
        out[order] += inner
        return out

    def train(self, around: np.ndarray, words: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        order, slices = _by_class(words // GROUP)
        around, words = around.take(order, axis=0), words[order]  # by class, so that each one's rows are a slice
        n, rows, cls = len(words), self._rows(around), words // GROUP
        params, steps = self.params, self.steps
        h = self.hidden(rows)
        logits = np.dot(h, params["U"])
        logits += params["c"]
        error = _errors(logits, cls)
        back = np.dot(error, params["U"].T)
        np.dot(h.T, error, out=steps["U"])
        error.sum(axis=0, out=steps["c"])
        logits, products = params["w"].take(cls, axis=0), np.empty((n, GROUP), np.float32)
        # np.dot makes the same calls as np.matmul with less around them; there are about 90 small products
        for c, part in slices:
            np.dot(h[part], params["W"][c], out=products[part])
        logits += products
        error, products = _errors(logits, words % GROUP), np.empty_like(back)
        steps["W"].fill(0)
        steps["w"].fill(0)
        for c, part in slices:
            of = error[part]
            np.dot(of, params["W"][c].T, out=products[part])
            np.dot(h[part].T, of, out=steps["W"][c])
        back += products
        steps["w"][[c for c, _ in slices]] = np.add.reduceat(error, [part.start for _, part in slices], axis=0)
        back *= 1 - h * h
        back /= np.float32(n)
        others = slice(self.tables.size, None)
        step, speed = self.step[others], self.speed[others]
        step /= np.float32(n)
        square = step * step
        speed += square
        step *= RATE
        step /= np.sqrt(speed, out=square)
        self.all[others] -= step
        step, rows = _sums_by_row(rows.ravel(), back)
        speed = self.speed[: self.tables.size].reshape(-1, DIM)
        moved = speed.take(rows, axis=0)
        moved += step * step
        speed[rows] = moved
        step *= RATE
        step /= np.sqrt(moved, out=moved)
        self.tables[rows] = np.subtract(self.tables.take(rows, axis=0), step, out=step)


def _sums_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values``, which repeat until there is one for each of ``rows``, by row, and the distinct rows in order."""
    order = np.argsort(rows.astype(np.int16), kind="stable")
    rows, order = rows[order], order % len(values)
    firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return np.add.reduceat(values.take(order, axis=0), firsts, axis=0), rows[firsts]


def _at(table: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """One entry of each row."""
    return table.ravel().take(np.arange(0, table.size, table.shape[1]) + columns)


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; ``logits`` is used up."""
    top = logits.max(axis=1)
    logits -= top[:, None]
    return top + np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))


def _errors(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Probabilities of each row less 1 at its target, in the place of ``logits``."""
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= (p @ np.ones(p.shape[1], p.dtype))[:, None]
    p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + target] -= 1
    return p


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by class, and the slice of each class in it."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(cls)).tolist()
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def count_words(docs: DataFrame, text: str = "text") -> Vocabulary:
    """The vocabulary, from counts over all words of all texts; ties go by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        endings, waiting, size = np.zeros(ENDINGS, np.int64), [], 0
        for batch in batches:
            for part in chunks(batch.column(0)):
                data, offsets = text_buffer(part)
                starts, ends, _ = word_spans(data, offsets)
                endings += np.bincount(_endings(data, ends) - WORDS, minlength=ENDINGS)
                waiting.append(np.unique(word_hashes(data, starts, ends, lower=True), return_counts=True))
                size += len(waiting[-1][0])
                if size > len(words):  # so that a word is moved a few times only, however many parts there are
                    words, counts = _added_up([(words, counts), *waiting])
                    waiting, size = [], 0
        words, counts = _added_up([(words, counts), *waiting])
        for at in range(0, len(words), 50_000):
            part = slice(at, at + 50_000)
            yield _pairs(words[part].astype(np.int64), counts[part], False)
        yield _pairs(np.arange(ENDINGS), endings, True)

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word long, n long, ending boolean")
    totals = found.groupBy("ending", "word").agg(F.sum("n").alias("n"))
    # one job: each partition yields all endings, so they are the first ENDINGS rows, and the words are counted once
    first = totals.orderBy(F.desc("ending"), F.desc("n"), "word").limit(ENDINGS + WORDS).collect()
    rows = [r for r in first if not r["ending"]]
    endings = {r["word"]: r["n"] for r in first if r["ending"]}
    hashes = np.array([r["word"] for r in rows], np.int64).astype(np.uint64)
    weights = np.full(WORDS + ENDINGS, 0.5)
    weights[: len(rows)] += [r["n"] for r in rows]
    # endings also count the words kept; a constant share of them is a good enough start for the bias
    weights[WORDS:] += [0.4 * endings.get(i, 0) for i in range(ENDINGS)]
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, weights / weights.sum())


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and their sums of counts, from parts that are sorted by word."""
    words, counts = (np.concatenate(x) for x in zip(*parts))
    order = words.argsort(kind="stable")  # merges sorted runs
    words, counts = words[order], counts[order]
    firsts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]][: len(words)])
    return words[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts


def _pairs(words: np.ndarray, counts: np.ndarray, ending: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"word": pa.array(words, pa.int64()), "n": pa.array(counts, pa.int64()), "ending": pa.array(np.full(len(words), ending))}
    )


def number_words(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words): the word numbers of each text, two bytes each, which ``train`` and ``score`` take in place of the text."""
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary.hashes, vocabulary.numbers, vocabulary.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(*shipped.value)
        for batch in batches:
            start = 0
            for part in chunks(batch.column(1)):
                ids, counts = tokens(part, known)
                words = pa.Array.from_buffers(
                    pa.binary(), len(part), [None, pa.py_buffer((2 * counts).astype(np.int32)), pa.py_buffer(ids.astype("<i2"))]
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), words], names=["doc_id", "words"])
                start += len(part)

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "doc_id long, words binary")


def train(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rounds: int = ROUNDS, mask: int = MASK, batch_size: int = BATCH
) -> np.ndarray:
    """Parameters of the network; the driver gets the averages only, whose number is fixed."""
    spark = docs.sparkSession
    flat = Network(vocabulary.weights).flat()
    names = [f"p{i}" for i in range(_ROW)]
    fields = ", ".join(f"{c} int" for c in names)
    vocab = spark.sparkContext.broadcast((vocabulary.hashes, vocabulary.numbers, vocabulary.weights))
    for turn in range(rounds):
        shipped = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shipped=shipped) -> Iterator[pa.RecordBatch]:
            known, start = Vocabulary(*vocab.value), shipped.value
            network, seen = Network(known.weights).load(start), 0
            around, words = np.zeros((0, len(SIDES)), np.int64), np.zeros(0, np.int64)
            for batch in batches:
                for ids, counts in _numbered(batch.column(0), known):
                    seen += len(ids)
                    masked = slice(turn, None, mask * rounds)
                    around = np.concatenate([around, _windows(ids, counts, masked)])
                    words = np.concatenate([words, ids[masked]])
                    shuffled = np.random.default_rng(turn).permutation(len(words))
                    around, words = around.take(shuffled, axis=0), words[shuffled]
                    whole = len(words) - len(words) % batch_size
                    for at in range(0, whole, batch_size):
                        network.train(around[at : at + batch_size], words[at : at + batch_size])
                    around, words = around[whole:], words[whole:]
            if len(words):
                network.train(around, words)
            if seen:
                weight = -(-seen // 1000)
                moved = np.clip(np.round((network.flat() - start) * _FIXED), -10 * _FIXED, 10 * _FIXED).astype(np.int64)
                moved = np.pad(moved, (0, -len(moved) % _ROW)).reshape(-1, _ROW)
                rows = {"at": pa.array(np.arange(len(moved)), pa.int32()), "weight": pa.array(np.full(len(moved), weight), pa.int64())}
                rows |= {c: pa.array(moved[:, i], pa.int32()) for i, c in enumerate(names)}
                yield pa.RecordBatch.from_pydict(rows)

        parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, f"at int, weight long, {fields}")
        sums = parts.groupBy("at").agg(F.sum("weight").alias("weight"), *(F.sum(F.col(c) * F.col("weight")).alias(c) for c in names))
        change = np.zeros(-(-len(flat) // _ROW) * _ROW)
        for r in sums.collect():  # as many rows as the network has parameters / 64
            change[r["at"] * _ROW : (r["at"] + 1) * _ROW] = np.array([r[c] for c in names]) / (r["weight"] * _FIXED)
        flat = (flat + change[: len(flat)]).astype(np.float32)
        shipped.unpersist()
    return flat


def score(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) for every row; without words the sum is 0 and the mean null."""
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary.hashes, vocabulary.numbers, vocabulary.weights, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers, weights, flat = shipped.value
        known = Vocabulary(hashes, numbers, weights)
        network = Network(weights).load(flat)
        for batch in batches:
            sizes, sums = [], []
            for ids, counts in _numbered(batch.column(1), known):
                around, probs = _windows(ids, counts), np.empty(len(ids))
                for at in range(0, len(ids), SCORED):
                    probs[at : at + SCORED] = network.log_probs(around[at : at + SCORED], ids[at : at + SCORED])
                sizes.append(np.diff(counts))
                sums.append(np.diff(np.r_[0, np.cumsum(probs)][counts]))
            if not sizes:
                continue
            n, total = np.concatenate(sizes), np.round(np.concatenate(sums), 4)
            mean = [s / k if k else None for s, k in zip(total.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())],
                names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"],
            )

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Vocabulary, training and scores over all of ``docs``. A null text is empty; ids play no part, so they may repeat or be null."""
    vocabulary = count_words(docs, text)
    # hashed and looked up once; the rounds and the scores read the numbers
    numbered = written(number_words(docs, vocabulary, id_col, text), "words")
    return score(numbered, vocabulary, train(numbered, vocabulary, "words"), "doc_id", "words")
