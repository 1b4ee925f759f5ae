import models
import pytest
from pyspark.sql import functions as F

from lmprep.operators import mixing
from lmprep.operators.mixing import combine_sources, mix_probabilities, mix_sources, mixture_report


def source(spark, name, n, parts=2):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(name), "id").alias("text")).repartition(parts)


def run(spark, sizes, probs, stop, seed=3, parts=2):
    names = "abcdef"[: len(sizes)]
    frames = {c: source(spark, c, n, parts) for c, n in zip(names, sizes)}
    got = mix_sources(frames, "doc_id", probs, seed, stop).orderBy("step").collect()
    rows = [[f"{c}{i}" for i in range(n)] for c, n in zip(names, sizes)]
    want = models.mixture(rows, mix_probabilities(probs, len(sizes)), seed, stop)
    assert [r.step for r in got] == list(range(len(got)))
    assert [(names.index(r.source), r.text) for r in got] == want


@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
@pytest.mark.parametrize("sizes,probs", [([30, 10, 20], "0.5,0.3,0.2"), ([1, 1], None), ([5, 40], [0.9, 0.1])])
def test_equals_sequential_draws(spark, sizes, probs, stop):
    run(spark, sizes, probs, stop)


def test_tiny_source_is_copied_not_hot(spark):
    run(spark, [1, 700], "0.5,0.5", "all_exhausted")


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_MIN_BLOCK_STEPS", 16)
    monkeypatch.setattr(mixing, "_RUN_STEPS", 5)
    run(spark, [40, 90], "0.3,0.7", "all_exhausted", parts=5)


def test_schedule_grows_until_every_source_ran_out(spark, monkeypatch):
    monkeypatch.setattr(mixing.math, "sqrt", lambda n: -n / 8)  # start far too short
    run(spark, [60, 60], None, "all_exhausted")


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CASE_SOURCES", 2)
    run(spark, [9, 4, 6, 5], "0.4,0.2,0.3,0.1", "all_exhausted")


def test_probabilities():
    assert mix_probabilities(None, 4) == [0.25] * 4
    assert mix_probabilities("0.25,0.75", 2) == [0.25, 0.75]
    for bad in ("0.5,0.6", "1.5,-0.5"):
        with pytest.raises(ValueError):
            mix_probabilities(bad, 2)
    with pytest.raises(ValueError):
        mix_probabilities("0.5,0.5", 3)


def test_errors_and_single_source(spark):
    with pytest.raises(ValueError, match="No datasets found"):
        combine_sources({})
    one = mix_sources({"a": source(spark, "a", 4)}, "doc_id").orderBy("step").collect()
    assert [r.text for r in one] == ["a0", "a1", "a2", "a3"]
    frames = {"a": source(spark, "a", 3), "b": source(spark, "b", 3)}
    with pytest.raises(ValueError, match="probability 0"):
        mix_sources(frames, "doc_id", "1.0,0.0")
    with pytest.raises(ValueError, match="a source is empty"):
        mix_sources({**frames, "b": source(spark, "b", 3).limit(0)}, "doc_id")
    with pytest.raises(ValueError, match="unknown stopping strategy"):
        mix_sources(frames, "doc_id", stop="never")
    assert {r.source for r in mix_sources(frames, "doc_id", "1.0,0.0", stop="first_exhausted").collect()} == {"a"}


def test_report(spark):
    frames = {"a": source(spark, "a", 300), "b": source(spark, "b", 300)}
    mixed = mix_sources(frames, "doc_id", "0.7,0.3")
    report = {r.source: r for r in mixture_report(mixed, {"a": 0.7, "b": 0.3}, F.length("text")).collect()}
    assert abs(report["a"].realized_share - 0.7) < 0.06 and report["b"].asked_share == 0.3
