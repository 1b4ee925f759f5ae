import numpy as np
import pytest
from pyspark.sql import functions as F

from lmprep.llm import hard_negatives
from lmprep.llm.hard_negatives import Tables, bit_planes

TABLE = "id long, label int, x array<long>, anchors string, stripe string, score string"


def brute(rows, asked, k, m, low=50, high=95):
    out = set()
    width = max((len(x) for _, _, x in rows), default=0)
    rows = [(i, label, np.array([*x, *[0] * (width - len(x))], object)) for i, label, x in rows]
    for a, label, x in rows:
        if not asked(a):
            continue
        scored = [(-int(x @ y), i, other) for i, other, y in rows if i != a]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:k]:
            fine = sorted((s, j) for s, j, other in scored if other != label and low * -p <= -100 * s <= high * -p)
            out |= {(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fine[:m])}
    return out


def mined(df, k=5, m=3):
    out = hard_negatives.hard_negatives(df, F.col("id") % 3 == 0, k, m).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


@pytest.mark.parametrize("most", [1, 3, 100, 1 << 20])
def test_tables_give_inner_products(most):
    rng = np.random.default_rng(most)
    for width in (1, 8, 13):
        a, c = rng.integers(-most, most, (7, width)), rng.integers(-most, most + 1, (50, width))
        assert (Tables(a).scores(bit_planes(c)) == c @ a.T).all()
        assert (Tables(a).scores(bit_planes(c), 2, 5) == c @ a[2:5].T).all()
    assert (Tables(a).scores(bit_planes(np.full((3, width), -1))) == -a.sum(axis=1)).all()
    assert not Tables(a).scores(bit_planes(np.zeros((3, width), int))).any()


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    rng = np.random.default_rng(11)
    centres = rng.integers(-40, 40, (5, 11))
    rows = [(int(i), int(rng.integers(0, 4)), (centres[i % 5] + rng.integers(-9, 9, 11)).tolist()) for i in range(150)]
    # many copies of one vector under two labels, ties, short and empty vectors
    rows += [(200 + i, i % 2, rows[0][2]) for i in range(60)] + [(300, 1, [3, 4]), (303, 1, []), (306, 9, rows[3][2])]
    odd = [(None, 1, [1] * 11), (400, None, [1] * 11), (401, 1, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows + odd + rows[:20]], TABLE).repartition(4)
    assert mined(df) == brute(rows, lambda i: i % 3 == 0, 5, 3)


def test_one_label_and_empty(spark):
    rows = [(i, 1, [i, 1]) for i in range(30)]
    assert mined(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TABLE)) == set()
    assert mined(spark.createDataFrame([], TABLE)) == set()
    assert mined(spark.createDataFrame([(1, 1, [1], "a", "b", "c")], TABLE)) == set()


def test_rows_that_share_an_id(spark):
    rows = [(0, 1, [5]), (0, 0, [4]), (1, 0, [3]), (2, 1, [2])]
    got = mined(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TABLE))
    assert got == brute([(0, 0, [4]), (1, 0, [3]), (2, 1, [2])], lambda i: i % 3 == 0, 5, 3) == {(0, 1, 1, 2, 12, 8)}
