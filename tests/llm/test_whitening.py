"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import whitening
from rollbook.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    (900, None), (901, [1.0, None, 0.0]), (902, [1.0, float("nan"), 0.0]), (903, [float("inf"), 1.0, 0.0]),
    (904, []), (None, [0.5, -0.25, 1.0]), (905, [0.0, 0.0, 0.0]), (906, [-0.0, 0.0, 0.0]),
    (907, [1.0, 2.0]), (908, [3.0, 2.5]), (909, [7.0]),
]


def wanted(rows, dim, components=4):
    """(key, component) to (n, deviation, whitened), and the explained parts, by the whole covariance."""
    ok = [(k, v) for k, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in ok])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    live = e > 1e-9 * max(e[0], 1e-300)
    z = (x - s / n) @ q[:, live] / np.sqrt(e[live])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    return n, [k for k, _ in ok], deviation, z, e[live] / np.trace(v) if n > 1 else []


def compare(got, rows, dim):
    n, keys, deviation, z, explained = wanted(rows, dim)
    want = [
        (k, j + 1, n, int(d), abs(z[i, j])) for i, (k, d) in enumerate(zip(keys, deviation)) for j in range(z.shape[1])
    ]
    have = [(r.key, r.component, r.n, r.deviation, abs(r.whitened)) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=repr), sorted(want, key=repr)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_odd_rows_and_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * [3, 2, 1]).tolist()) for i in range(60)]
    rows += rows[:5] + [(300 + i, rows[i][1]) for i in range(40)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "x", "dim", "data", "cell", "component", "n")})
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    three = {m.n for m in whitening.fit(df, "embedding") if m.dim == 3}
    two = [r for r in got if r.key in (907, 908)]
    compare([r for r in got if r.n in three], rows, 3)
    assert len(two) == 2 and {r.component for r in two} == {1}  # two vectors differ in one direction
    compare(two, rows, 2)
    assert not {r.key for r in got} & {900, 901, 902, 903, 904, 909}


def test_small_blocks_and_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 80 * 7)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=80).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    compare(whitening.whiten(df, "vec_id", "embedding").collect(), rows, 80)


def test_huge_entries_have_no_deviation(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").collect()
    assert {r.key for r in got} == {1, 2, 3}
    assert all((r.deviation is None) == (r.key != 3) for r in got)  # the sums nearly cancel in the third


def test_no_rows_and_no_variance(spark):
    empty = spark.createDataFrame([], "k long, v array<float>")
    assert whitening.whiten(empty, "k", "v").count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "k long, v array<float>")
    assert whitening.whiten(same, "k", "v").count() == 0


@pytest.mark.parametrize("dim,guard", [(40, 2), (40, 8), (6, 44)])
def test_leading_pairs_of_close_and_equal_values(dim, guard):
    rng = np.random.default_rng(dim + guard)
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    e = np.concatenate([[9.0, 9.0, 8.999, 5.0], np.linspace(4.9, 0, dim - 4)])
    v = (q * e) @ q.T
    values, vectors, residual = whitening.leading_pairs(lambda b: v @ b, dim, 4, guard)
    assert np.allclose(values, e[:4], rtol=1e-12) and residual < 1e-9
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-8)


def test_query_equals_the_whole_covariance(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op12_embedding_whitening"](spark, SF_DIR).withColumnRenamed("vec_id", "key").collect()
    compare(got, rows, len(rows[0][1]))
