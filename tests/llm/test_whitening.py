"""Whitening against a full eigendecomposition, and its parts against theirs."""

import math

import numpy as np
import pytest

from granary.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, key string, x int, n int"


def by_hand(rows, wanted=4):
    """(vec_id, n, deviation, whitened up to sign, explained) per kept row and component."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float((n * a - s)) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    top = [j for j in range(len(values))[::-1] if values[j] > values.sum() * 1e-12][:wanted]
    out = {}
    for i, x in kept:
        y = np.array([float(n * a - s) / n for a, s in zip(x, sums)])
        deviation = sum(int(n * a - s) ** 2 for a, s in zip(x, sums))
        out.setdefault(i, []).append((n, deviation, [abs(y @ vectors[:, j]) / math.sqrt(values[j]) for j in top],
                                      [values[j] / values.sum() for j in top]))
    return out


def check(spark, frame, rows):
    want, got = by_hand(rows), {}
    for r in whitening.report(frame).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert got.keys() == {i for i, found in want.items() if found[0][2]}
    for i, found in got.items():
        k = len(want[i][0][2])
        assert len(found) == k * len(want[i])
        for c in range(1, k + 1):
            mine = sorted((r for r in found if r.component == c), key=lambda r: (r.deviation, abs(r.whitened)))
            theirs = sorted(want[i], key=lambda w: (w[1], w[2][c - 1]))
            for r, (n, deviation, scores, explained) in zip(mine, theirs):
                assert (r.n, r.deviation) == (n, deviation)
                assert abs(r.whitened) == pytest.approx(scores[c - 1], abs=1e-9)
                assert r.explained == pytest.approx(explained[c - 1], rel=1e-10)
                assert 0 <= r.identity_error < 1e-9


def test_whole_table(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(spark, frame, [(r.vec_id, r.embedding) for r in frame.collect()])


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(size=(60, 6)).astype(np.float32)]
    rows = list(enumerate(vectors)) + [(100, None), (101, [1.0, None] + [0.0] * 4), (102, [float("nan")] * 6),
                                       (103, [float("inf")] + [0.0] * 5), (None, vectors[0]), (None, vectors[1]), (7, vectors[7]), (7, vectors[8])]
    rows += [(200 + i, vectors[5]) for i in range(300)]
    frame = spark.createDataFrame([(i, v, "k", 1, 2) for i, v in rows], SCHEMA).repartition(4)
    check(spark, frame, rows)


def test_another_length_has_no_measures(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(50, [1.0]), (51, [])]
    found = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1, 2}
    assert all((r.whitened is None) == (r.deviation is None) == (r.vec_id >= 50) for r in found) and len(found) == 84


def test_no_variance_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.report(frame).collect() == []
    assert whitening.report(frame.where("vec_id < 0")).collect() == []
    assert whitening.report(frame.selectExpr("vec_id", "cast(array() as array<double>) as embedding")).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e6 + i, 3e6 - 2 * i * i, float(i % 3)]) for i in range(50)]
    check(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 9, 40):
        m = rng.normal(size=(d, d))
        a = m @ m.T
        t, values = whitening.tridiagonal(a), np.linalg.eigvalsh(a)
        for shift in np.concatenate([values[:-1] + np.diff(values) / 2, [values.min() - 1, values.max() + 1]]):
            assert whitening.above(t, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 1], [4, 3, 2, 1, 1, 1, 1], [9, 1e-3, 1e-4, 1e-5, 1e-6], [1] * 7, [1e8, 3, 0, 0, 0]])
def test_equal_and_distant_eigenvalues(spark, values):
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(len(values), len(values))))
    a = q @ np.diag(values).astype(float) @ q.T
    found, axes = whitening.leading(spark, a)
    want = [v for v in sorted(values, reverse=True)[:4] if v > 0]
    assert np.allclose(found, want, rtol=1e-9, atol=1e-14 * sum(values))
    assert np.allclose(axes.T @ axes, np.eye(len(want)), atol=1e-12)
    assert np.linalg.norm(a @ axes - axes * found) < 1e-12 * sum(values)
