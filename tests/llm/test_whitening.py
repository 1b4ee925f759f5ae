import decimal

import numpy as np
import pytest

from lmprep.llm import whitening
from lmprep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<float>, component string, n string, x string"


def expected(vectors: list[list[float]], most: int = 4):
    """(n, sums, eigenvalues, eigenvectors, mean, trace) of the distinct integer vectors."""
    width = max(map(len, vectors))
    fit = np.unique([[int(np.floor(256.0 * np.float32(c))) for c in v] + [0] * (width - len(v)) for v in vectors], axis=0)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    values, found = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return len(fit), fit.sum(axis=0), values[order], found[:, order], fit.mean(axis=0), np.trace(cov), fit


def check(rows, source, kept):
    n, sums, values, vectors, mean, trace, fit = expected([v for _, v in source])
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == kept * len(source)
    turn = None
    for i, v in source:
        x = np.zeros(len(sums), int)
        x[: len(v)] = np.floor(256.0 * np.array(v, np.float32).astype(float))
        want = (x - mean) @ vectors[:, :kept] / np.sqrt(values[:kept])
        got = np.array([by[i][c].whitened for c in range(1, kept + 1)])
        if turn is None and (np.abs(want) > 1e-3).all():
            turn = np.sign(want * got)
        if turn is not None:
            assert np.allclose(got, want * turn, atol=1e-7), i
        assert by[i][1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        assert all(r.n == n and r.identity_error < 1e-10 for r in by[i].values())
        assert np.allclose([by[i][c].explained for c in range(1, kept + 1)], values[:kept] / trace, rtol=1e-9)
    assert turn is not None


def test_query_equals_eigendecomposition(spark):
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    source = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, source, 4)


def test_dependent_columns_repeats_and_rows_that_do_not_count(spark):
    rng = np.random.default_rng(3)
    free = rng.normal(size=(40, 3))
    # a constant, a repeat, a combination and a column a million times smaller in variance
    rows = [[*map(float, f), 0.5, float(f[0]), float(np.float32(f[0])) * 2, 1 / 256 if i == 7 else 0.0] for i, f in enumerate(free)]
    source = list(enumerate(rows)) + [(100 + i, rows[0]) for i in range(30)] + [(200, [1.0, 2.0]), (201, [])]
    bad = [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (303, [1.0, float("inf")])]
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in source + bad], TABLE).repartition(5)
    check(whitening.whiten(table).collect(), source, 4)


def test_fewer_dimensions_than_components(spark):
    source = [(i, [float(i), float(i % 3)]) for i in range(9)]
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in source], TABLE)
    check(whitening.whiten(table).collect(), source, 2)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0]] * 3, [[], []], [None]])
def test_without_variance_there_are_no_rows(spark, vectors):
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in enumerate(vectors)], TABLE)
    out = whitening.whiten(table)
    assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_null_and_repeated_ids_keep_their_rows(spark):
    table = spark.createDataFrame([(None, [1.0]), (None, [1.0]), (5, [2.0]), (5, [4.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, round(r.whitened, 6)) for r in rows) == [(0, -1.069045), (0, -1.069045), (5, -0.267261), (5, 1.336306)]


def test_large_components_stay_exact(spark):
    table = spark.createDataFrame([(1, [1e12]), (2, [-3e12]), (3, [7.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(table).collect()}
    xs = {1: int(256 * 1e12), 2: -int(256 * 3e12), 3: 1792}
    total = sum(xs.values())
    assert got == {i: decimal.Decimal((3 * x - total) ** 2) for i, x in xs.items()}


def test_ill_conditioned_vectors_become_white(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 1)) * 1e5
    vectors = (base + rng.normal(size=(300, 6)) * 0.02).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).collect()
    assert {r.component for r in rows} == {1, 2, 3, 4} and rows[0].identity_error < 1e-6
