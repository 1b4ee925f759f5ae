"""Training documents that share a word n-gram with evaluation queries."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lmprep.cluster import BROADCAST_ROWS, fits_broadcast, once, reliable, spread_small


#: Most bits of a Bloom filter (16 MB), and the parts of a hash that name its bits.
BLOOM_BITS = 1 << 27
_BLOOM_SHIFTS = (0, 17, 34)

_SPACES = "\t\n\r\f"


def normalized_words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation."""
    plain = F.translate(F.lower(text), _SPACES + string.punctuation, " " * len(_SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _phrases(queries: DataFrame, query: str, n: int, min_words: int) -> DataFrame:
    """(words, hash, gram): the distinct n-grams of queries, and whole those of ``min_words`` to ``n - 1`` words."""
    worded = queries.select(once(normalized_words(F.col(query))).alias("_w")).where(F.size("_w") >= min_words)
    length = F.least(F.size("_w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("_w") - (length - 1))
    rows = worded.select("_w", length.alias("words"), F.explode(starts).alias("_i"))
    gram = F.array_join(F.slice("_w", F.col("_i"), F.col("words")), " ")
    return rows.select("words", once(gram).alias("gram")).select("words", F.xxhash64("gram").alias("hash"), "gram").distinct()


def _hashed(train: DataFrame, text: str, n: int, key: str, *more: str) -> DataFrame:
    """(key, hash) and ``more`` of one row per word n-gram; a text shorter than ``n`` words has none."""
    worded = train.select(key, once(normalized_words(F.col(text))).alias("_w"))
    starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1)))
    grams = worded.select(key, "_w", F.explode(starts).alias("_i"))
    grams = grams.select(key, once(F.array_join(F.slice("_w", F.col("_i"), F.lit(n)), " ")).alias("gram"))
    return grams.select(key, F.xxhash64("gram").alias("hash"), *more)


def _bloom_filter(hashes: DataFrame, count: int, most_bits: int = BLOOM_BITS) -> Callable[[Column], Column]:
    """A test that every hash of the query side passes, and of others few; the filter has a bounded size whatever the queries."""
    bits = min(most_bits, 1 << max(16, (16 * count).bit_length()))
    places = F.explode(F.array(*(F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(bits - 1)) for s in _BLOOM_SHIFTS)))
    words = hashes.select(places.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")
    )
    found = words.toArrow()  # BLOOM_BITS / 64 rows at most
    flags = np.zeros(bits // 64, np.int64)
    flags[found["word"].to_numpy()] = found["bits"].to_numpy()
    shipped = hashes.sparkSession.sparkContext.broadcast(flags)

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shipped.value.view(np.uint64)
        for batch in batches:
            h = batch.to_numpy(zero_copy_only=False).view(np.uint64)
            fine = np.ones(len(h), bool)
            for s in _BLOOM_SHIFTS:
                place = (h >> np.uint64(s)) & np.uint64(bits - 1)
                fine &= (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            yield pa.array(fine)

    return passes


def _phrase_finder(spark: SparkSession, phrases: list[str]) -> Callable[[Column], Column]:
    """A test whether a text's normalized words hold any of the phrases, all of them looked for in one pass."""
    shipped = spark.sparkContext.broadcast(phrases)

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in shipped.value:
            automaton.add_word(f" {phrase} ", 1)
        automaton.make_automaton()
        for batch in batches:
            yield pa.array([next(automaton.iter(f" {t} "), None) is not None for t in batch.fill_null("").to_pylist()], pa.bool_())

    return holds


def _hits(train: DataFrame, phrases: DataFrame, n: int, key: str, text: str, limit: int) -> DataFrame:
    """(key, hash) of documents' n-grams whose hash is a query's."""
    hashes = phrases.select("hash").distinct()
    grams = _hashed(train, text, n, key)
    if fits_broadcast(hashes, limit):
        return grams.join(F.broadcast(hashes), ["hash"], "left_semi").distinct()
    # most n-grams are no query's: they stop at the filter, and only keys and 8-byte hashes of the rest are shuffled
    passes = _bloom_filter(hashes, hashes.count())
    return grams.where(passes(F.col("hash"))).distinct().join(hashes, ["hash"], "left_semi")


def contaminated_keys(
    train: DataFrame, queries: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text",
    query: str = "query", limit: int = BROADCAST_ROWS, min_words: int | None = None,
) -> DataFrame:
    """Keys of the training documents that share an n-gram with any query.

    Queries shorter than ``n`` words are not looked for, unless ``min_words`` is given: those of ``min_words`` words or more are then looked
    for as whole phrases, all in one automaton as long as they fit a broadcast, else by the hashes of their lengths.

    The distinct phrases are written and measured. Within ``limit`` rows and the byte bound their hashes are broadcast and the
    documents are scanned without a shuffle; past it a Bloom filter of bounded size keeps most n-grams out of the shuffle. Hashes of
    64 bits only propose documents: the phrases themselves are compared in those proposed.
    """
    spark = train.sparkSession
    phrases = reliable(_phrases(queries, query, n, min(n, min_words or n)))
    train = spread_small(train.select(key, text))
    found = [_hits(train, phrases.where(F.col("words") == n), n, key, text, limit)]
    short = phrases.where(F.col("words") < n)
    lengths = [r["words"] for r in short.select("words").distinct().collect()]  # below n
    exact = None
    if lengths and fits_broadcast(short, limit):
        holds = _phrase_finder(spark, [r["gram"] for r in short.select("gram").collect()])  # within the bound
        exact = train.where(holds(F.array_join(normalized_words(F.col(text)), " "))).select(key).distinct()
    else:
        found += [_hits(train, short.where(F.col("words") == m), m, key, text, limit) for m in lengths]
    proposed = reliable(reduce(DataFrame.unionByName, found))
    kept = proposed.select(key).distinct()
    few = train.join(F.broadcast(kept) if fits_broadcast(kept, limit) else kept, [key], "left_semi")
    equal = []
    for m in [n, *lengths][: len(found)]:
        same = phrases.where(F.col("words") == m).select("hash", "gram")
        hashed = _hashed(few, text, m, key, "gram").join(proposed.select("hash").distinct(), ["hash"], "left_semi")
        equal.append(hashed.join(same, ["hash", "gram"], "left_semi").select(key))
    if exact is not None:
        equal.append(exact)
    return reduce(DataFrame.unionByName, equal).distinct()


def decontaminate(
    train: DataFrame, queries: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text",
    query: str = "query", mode: str = "drop", limit: int = BROADCAST_ROWS, min_words: int | None = None,
) -> DataFrame:
    """``drop`` the matching documents, keep ``only`` them, or ``flag`` them.

    The matching keys are measured first: when they are few, the documents are filtered where they lie.
    """
    hits = reliable(contaminated_keys(train, queries, n, key, text, query, limit, min_words))
    if fits_broadcast(hits, limit):
        hits = F.broadcast(hits)
    if mode == "drop":
        return train.join(hits, [key], "left_anti")
    if mode == "only":
        return train.join(hits, [key], "left_semi")
    if mode == "flag":
        marked = train.join(hits.withColumn("contaminated", F.lit(True)), [key], "left")
        return marked.withColumn("contaminated", F.coalesce("contaminated", F.lit(False)))
    raise ValueError(f"unknown mode: {mode}")
