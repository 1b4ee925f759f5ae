import os
import random

import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from lmprep.cluster import ensure_checkpoint_dir
from lmprep.functions.tokenizers import CodepointTokenizer
from lmprep.operators import packing, wide_buffers
from lmprep.operators.mixing import mix_sources
from lmprep.sources import readers
from lmprep.operators.packing import (
    chars_per_token, pack_documents, pack_sequences, steps_of_documents, then,
)
from lmprep.plans.datasets import DatasetOptions, build_dataset

TOK = CodepointTokenizer()


def docs(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def collected(df):
    return {(r.buffer_id, r.chunk_id): tuple(r.input_ids) for r in df.collect()}


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abé😀 ", k=rng.choice([0, 0, 1, 3, 10, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("block_rows,fan_in,num_sequences", [(1000, 512, 4), (7, 512, 1), (7, 2, 4), (1, 3, 1)])
def test_equals_sequential_pass(spark, block_rows, fan_in, num_sequences):
    texts = random_texts(60, 5)
    got = pack_sequences(
        docs(spark, texts), TOK, 16, num_sequences=num_sequences, chars_per_token=1.5,
        block_rows=block_rows, fan_in=fan_in,
    )
    assert collected(got) == models.chunks(texts, 16, 16 * 1.5 * num_sequences)


@pytest.mark.parametrize("block_rows,num_sequences,bin_rows", [(7, 1, 3), (7, 4, 1), (20, 40, 50), (1, 2**40, 4)])
def test_wide_buffers_equal_the_sequential_pass(spark, monkeypatch, block_rows, num_sequences, bin_rows):
    monkeypatch.setattr(wide_buffers.assign_wide, "__defaults__", (bin_rows,))
    texts = random_texts(60, 6)
    got = pack_sequences(
        docs(spark, texts), TOK, 16, num_sequences=num_sequences, chars_per_token=1.5, block_rows=block_rows, widest=0
    )
    assert collected(got) == models.chunks(texts, 16, 16 * 1.5 * num_sequences)


def test_wide_buffers_of_empty_documents(spark):
    got = pack_sequences(docs(spark, [""] * 40), TOK, 16, num_sequences=4, chars_per_token=1.5, block_rows=5, widest=0)
    assert collected(got) == models.chunks([""] * 40, 16, 16 * 1.5 * 4)


@pytest.mark.parametrize("seed", range(30))
def test_block_functions_compose(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(rng.randint(1, 60))]
    limit = rng.choice([1, 3.5, 10, 40, 1000])
    cuts = sorted(rng.sample(range(len(lengths) + 1), min(3, len(lengths))))
    runs = [lengths[a:b] for a, b in zip([0, *cuts], [*cuts, len(lengths)]) if b > a]
    whole = None
    for run in runs:
        s = steps_of_documents(np.array(run, dtype=np.int64), limit)
        whole = s if whole is None else then(whole, s, limit)
    numbers = models.buffers(lengths, limit)
    left = sum(n for n, b in zip(lengths, numbers) if b == numbers[-1])
    assert whole.apply(0, limit) == (left, numbers[-1])
    assert len(whole.before) <= limit + 1  # bounded by one buffer, not by the block


@pytest.mark.parametrize(
    "texts",
    [
        [], ["", "", ""], ["a" * 500], ["a" * 30, "b" * 2, "c" * 32], ["a" * 32, "b" * 32],
        ["x" * 100, *[""] * 20, "y" * 3, "z" * 100],
    ],
)
def test_edges(spark, texts):
    got = pack_sequences(docs(spark, texts), TOK, 16, num_sequences=2, chars_per_token=1.0, block_rows=2, fan_in=2)
    assert collected(got) == models.chunks(texts, 16, 32)


@pytest.mark.parametrize("shards", [3])
def test_shards_are_passes_of_their_own(spark, shards):
    from lmprep.functions.text import hash_shard

    texts = random_texts(80, 9)
    df = docs(spark, texts)
    got = pack_sequences(df, TOK, 16, num_sequences=2, chars_per_token=1.0, shards=shards, block_rows=5, fan_in=2)
    placed = {r.doc_id: r.s for r in df.select("doc_id", hash_shard(F.col("doc_id"), shards).alias("s")).collect()}
    by_shard = {}
    for r in got.collect():
        by_shard.setdefault(r.shard, {})[(r.buffer_id, r.chunk_id)] = tuple(r.input_ids)
    for s in range(shards):
        own = [t for i, t in enumerate(texts) if placed[i] == s]
        assert by_shard.get(s, {}) == models.chunks(own, 16, 32)


def test_report_and_labels(spark):
    texts = random_texts(40, 2)
    done = pack_documents(docs(spark, texts), TOK, 16, num_sequences=2, chars_per_token=1.0)
    totals = done.buffers.agg(*(F.sum(c) for c in ("n_documents", "n_chars", "n_tokens", "n_chunks", "n_dropped_tokens"))).first()
    assert totals[0] == 40 and totals[1] == sum(map(len, texts))
    assert totals[2] == sum(len(t) + 2 for t in texts) == totals[3] * 16 + totals[4]
    assert totals[3] == done.chunks.count()
    row = pack_sequences(docs(spark, texts), TOK, 16, num_sequences=2, chars_per_token=1.0).first()
    assert row.input_ids == row.labels and len(row.labels) == 16


def test_shuffle_stays_in_its_buffer(spark):
    texts = random_texts(80, 3)
    options = dict(num_sequences=8, chars_per_token=1.0)
    plain = collected(pack_sequences(docs(spark, texts), TOK, 16, **options))
    rows = pack_sequences(docs(spark, texts), TOK, 16, shuffle_seed=1, **options).collect()
    assert {(r.buffer_id, r.chunk_id): tuple(r.input_ids) for r in rows} == plain
    places = {}
    for r in rows:
        places.setdefault(r.buffer_id, []).append(r.chunk_pos)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = pack_sequences(docs(spark, texts, 7), TOK, 16, shuffle_seed=1, **options).collect()
    assert sorted(rows) == sorted(again)
    assert any(r.chunk_pos != r.chunk_id for r in rows)


def test_formatting_and_null_text(spark):
    df = spark.createDataFrame([(0, "a" * 20), (1, None), (2, "b" * 20)], "doc_id long, text string")
    got = pack_sequences(df, TOK, 8, num_sequences=100, formatting=lambda d: F.upper("text"))
    assert collected(got) == models.chunks(["A" * 20, "B" * 20], 8, 8 * 3.6 * 100)


def test_null_texts_are_set_aside_and_counted(spark):
    df = spark.createDataFrame([(0, "a" * 20), (1, None), (2, ""), (3, None)], "doc_id long, text string")
    done = pack_documents(df, TOK, 8, num_sequences=100)
    assert done.counts == {"documents": 4, "null_texts": 2} and sorted(r.doc_id for r in done.rejected.collect()) == [1, 3]
    assert done.buffers.first().n_documents == 2
    with pytest.raises(ValueError, match="2 of 4"):
        pack_documents(df, TOK, 8, null_text="raise")
    with pytest.raises(ValueError):
        pack_documents(df, TOK, 8, null_text="other")
    nothing = pack_documents(df.where("text IS NULL"), TOK, 8)
    assert nothing.chunks.count() == 0 and nothing.counts["null_texts"] == 2


def test_source_order_is_that_of_the_files(spark, tmp_path):
    """Texts without any key, in files of several row groups and splits."""
    texts = random_texts(90, 7)
    for i in range(3):
        part = spark.createDataFrame([(t,) for t in texts[30 * i : 30 * i + 30]], "text string").coalesce(1)
        part.write.option("parquet.block.size", 512).parquet(str(tmp_path / f"corpus/part={i}"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        (corpus,) = readers.scan_raw_text(spark, str(tmp_path / "corpus"), order_key=None).values()
        got = pack_sequences(corpus, TOK, 16, num_sequences=4, chars_per_token=1.5, order_key=readers.SOURCE_KEY, block_rows=7)
        assert collected(got) == models.chunks(texts, 16, 16 * 1.5 * 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="place"):
        readers.with_source_key(spark.range(3))
    with pytest.raises(ValueError, match="already"):
        readers.with_source_key(corpus)


def test_chars_per_token(spark):
    df = docs(spark, ["abc", "de", "f"])
    row = chars_per_token(df, TOK, n=2).first()
    assert (row.n_chars, row.n_tokens, row.chars_per_token) == (5, 7, 5 / 7)
    with pytest.raises(Exception, match="no rows to estimate from"):
        chars_per_token(df.limit(0), TOK).collect()


def test_texts_and_not_ids_are_sent_to_their_chunks(spark, monkeypatch):
    """Documents within a group of chunks, across groups, and longer than one; whatever group they meet in, chunks are the same."""
    texts = [(i, "abcdefg"[i % 7] * (i * 37 % 90)) for i in range(60)] + [(60, "x" * 700), (61, ""), (62, "y" * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tokens = [t for _, text in texts for t in [1, *(ord(c) + 3 for c in text), TOK.eos_id]]
    want = [tokens[i : i + 8] for i in range(0, len(tokens) - 7, 8)]
    for group in (1, 3, 64):
        monkeypatch.setattr(packing, "GROUP", group)
        got = pack_sequences(df, TOK, 8, shuffle_seed=3, num_sequences=10_000, chars_per_token=1.0)
        rows = got.orderBy("chunk_id").collect()
        assert [list(r.input_ids) for r in rows] == want
        assert sorted(r.chunk_pos for r in rows) == list(range(len(want)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    moved = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert "_group" in moved and "_text" in plan[plan.index(moved) :].splitlines()[2]


@pytest.mark.parametrize("copied", [64, 2])
def test_texts_are_taken_by_key_as_often_as_drawn(spark, monkeypatch, copied):
    """Documents that name their text give the chunks of documents that hold it; texts of many documents are copied."""
    monkeypatch.setattr(packing, "COPIED", copied)
    texts = [(s, i, s * (i * 23 % 70) if i != 4 else None) for s in "ab" for i in range(7)] + [("a", 7, "z" * 700)]
    rng = random.Random(4)
    steps = [(step, *(texts[0] if step % 3 == 0 else rng.choice(texts))) for step in range(90)]
    held = spark.createDataFrame(steps, "step long, source string, doc_id long, text string")
    named = held.drop("text").union(spark.createDataFrame([(90, "c", 1)], "step long, source string, doc_id long"))
    options = dict(order_key="step", num_sequences=7, chars_per_token=1.0, block_rows=11)
    want = pack_documents(held, TOK, 8, **options)
    given = spark.createDataFrame(texts, "source string, doc_id long, text string")
    got = pack_documents(named.repartition(3), TOK, 8, texts=given, text_key=["source", "doc_id"], **options)
    assert collected(got.chunks) == collected(want.chunks) and got.chunks.count() == want.chunks.count() > 50
    missing = {r.step for r in want.rejected.collect()}
    assert {r.step for r in got.rejected.collect()} == {*missing, 90} and got.counts["null_texts"] == len(missing) + 1


def test_mixed_texts_are_stored_once_however_often_drawn(spark, tmp_path):
    """Corpora that are drawn more than once: keys are mixed, and each text is stored as often as it is there."""
    rows = [(i, chr(97 + i % 26) * (20 + i % 50), "en" if i % 4 else "de") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "corpus"))
    spec = ",".join(f"{tmp_path}/corpus:{x}" for x in ("de", "en"))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    chunks = build_dataset(spark, "culturax", spec, TOK, DatasetOptions(16, num_sequences=8, interleave_probs="0.6,0.4", seed=5))
    new = [spark.read.parquet(f"{folder}/{x}") for x in set(os.listdir(folder)) - before if x.startswith("stored")]
    mix, texts = sorted(new, key=lambda x: "text" in x.columns)
    assert sorted(mix.columns) == ["doc_id", "source", "step"] and mix.count() > 1.5 * len(rows)
    assert texts.count() == len(rows) and len(new) == 2
    corpora = readers.scan_raw_text(spark, spec)
    mixed = mix_sources(corpora, "doc_id", "0.6,0.4", 5).orderBy("step").collect()
    assert len(mixed) == mix.count()
    texts = [r.text for r in mixed]
    ratio = sum(map(len, texts[:500])) / sum(len(t) + 1 for t in texts[:500])
    assert collected(chunks) == models.chunks(texts, 16, 16 * ratio * 8)
