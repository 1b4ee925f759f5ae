from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lmprep.functions.text import PY_WHITESPACE, hash_shard, normalize_prediction, py_strip, seeded_uniform

ALPHABET = st.sampled_from(PY_WHITESPACE + "abé😀​﻿\x00<|>\\'\"%{}$")
TEXTS = st.lists(st.text(ALPHABET, max_size=12), min_size=1, max_size=60)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_whitespace_set_is_complete():
    assert len(PY_WHITESPACE) == 29
    assert {chr(i) for i in range(0x110000) if chr(i).isspace()} == set(PY_WHITESPACE)


@QUICK
@given(TEXTS)
def test_strip_and_normalize(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", py_strip(F.col("t")), normalize_prediction(F.col("t"))).collect()
    for i, stripped, normal in got:
        assert stripped == texts[i].strip()
        assert normal == " ".join(map(str.strip, texts[i].splitlines())).strip()


def test_line_breaks(spark):
    texts = ["a\r\nb", "a b c", "a\x85b", "a\n\n b ", "\n\r\n", "a\x1cb\x1dc\x1ed", "a\x0bb\x0cc\rd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(normalize_prediction(F.col("t"))).collect()]
    assert got == [" ".join(map(str.strip, t.splitlines())).strip() for t in texts]
    assert got[3] == "a  b"


def test_hashing_is_uniform_and_free_of_layout(spark):
    df = spark.range(20000)
    one = df.select(seeded_uniform(7, F.col("id")).alias("u")).agg(F.sum("u"), F.min("u"), F.max("u")).first()
    assert abs(one[0] / 20000 - 0.5) < 0.02 and one[1] >= 0 and one[2] < 1
    a = df.repartition(7).select("id", seeded_uniform(7, F.col("id")).alias("u"))
    b = df.coalesce(1).select("id", seeded_uniform(7, F.col("id")).alias("u"))
    assert a.exceptAll(b).count() == 0
    shards = {r[0]: r[1] for r in df.groupBy(hash_shard(F.col("id"), 4)).count().collect()}
    assert set(shards) == {0, 1, 2, 3} and min(shards.values()) > 4500
