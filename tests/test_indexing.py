import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lmprep.cluster import ensure_checkpoint_dir, fits_broadcast, spread_small
from lmprep.operators.batching import make_batches, pad_batch_left, pad_batch_longest
from lmprep.operators.indexing import with_row_index
from lmprep.operators.sampling import repeat_epochs


def skewed(spark, n=3000):
    """A third of the rows in one group, in scattered order."""
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50))
    return spark.range(n).select(
        ((F.col("id") * 7919) % 100003).alias("k"), group.alias("g"), F.lit("payload").alias("v")
    )


def test_index_over_all_rows(spark):
    df = skewed(spark)
    want = df.withColumn("row_index", F.row_number().over(Window.orderBy("k")).cast("long") - 1)
    for parts in (1, 6):
        assert with_row_index(df.repartition(parts), ["k"]).select(want.columns).exceptAll(want).count() == 0


def test_index_within_groups(spark):
    df = skewed(spark)
    want = df.withColumn("row_index", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long") - 1)
    got = with_row_index(df.repartition(5), ["k"], ["g"]).select(want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", "v") for i in range(10)], "k int, g string, v string")
    got = with_row_index(df, ["k"], ["g"]).orderBy("k").collect()
    assert [r.row_index for r in got] == [i // 2 for i in range(10)]


def test_broadcast_bounds(spark):
    df = spark.createDataFrame([("x" * 100,)] * 5, "s string")
    assert fits_broadcast(df) and not fits_broadcast(df, rows=4) and not fits_broadcast(df, size=400)
    assert fits_broadcast(df.limit(0))


def test_batches(spark):
    df = spark.range(21).select((100 - F.col("id")).alias("k"))
    got = make_batches(df.repartition(4), 8, "k").orderBy("k").collect()
    assert [(r.batch_id, r.batch_pos) for r in got] == [(i // 8, i % 8) for i in range(21)]
    assert make_batches(df, 8, "k", drop_last=True).count() == 16
    assert make_batches(df, 7, "k", drop_last=True).count() == 21
    assert make_batches(df.limit(0), 8, "k").count() == 0


def test_batch_padding(spark):
    rows = [(i, i // 4, list(range(1, n + 1)), [-100] * n, [1] * n) for i, n in enumerate([3, 8, 5, 1, 9, 2])]
    df = spark.createDataFrame(rows, "k int, batch_id long, input_ids array<int>, labels array<int>, attention_mask array<int>")
    right = {r.k: r for r in pad_batch_longest(df, 0).collect()}
    assert [len(right[i].input_ids) for i in range(6)] == [8, 8, 8, 8, 16, 16]
    assert right[0].input_ids == [1, 2, 3, 0, 0, 0, 0, 0] and right[0].labels == [-100] * 8
    assert right[5].attention_mask == [1] * 2 + [0] * 14
    left = {r.k: r for r in pad_batch_left(df.drop("labels", "attention_mask")).collect()}
    assert left[3].input_ids == [0] * 7 + [1] and left[3].attention_mask == [0] * 7 + [1]
    assert len(left[4].input_ids) == 9


def test_epochs(spark):
    got = repeat_epochs(spark.range(3), 2).orderBy("epoch", "id").collect()
    assert [(r.id, r.epoch) for r in got] == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1)]


def test_session_helpers(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert spread_small(spark.range(10, numPartitions=1)).count() == 10
    big = spark.range(10, numPartitions=1)
    assert spread_small(big, limit_bytes=1) is big


@pytest.mark.parametrize("key", [1, None])
def test_bad_keys_raise(spark, key):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (key, "c")], "k int, text string")
    with pytest.raises(ValueError, match="unique and not null"):
        with_row_index(df, ["k"])
