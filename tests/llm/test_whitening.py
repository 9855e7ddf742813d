"""Whitening (operator 12) against exact fractions and the plain eigenproblem."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import whitening
from threadlens.llm.entry import op12_whitening

SF = "/root/testdata/sf0.001"


def brute(rows):
    """vec_id, deviation and exact centred rows of (vec_id, vector) rows, by fractions; then V."""
    good = [(i, [floor(Fraction(float(c)) * 64) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, sums = len(good), [sum(c) for c in zip(*[x for _, x in good])]
    centred = [(i, [n * c - s for c, s in zip(x, sums)]) for i, x in good]
    y = np.array([[float(Fraction(c, n)) for c in r] for _, r in centred])
    return [(i, sum(c * c for c in r)) for i, r in centred], y, y.T @ y / n


def check(got, rows):
    want, y, v = brute(rows)
    values = np.linalg.eigh(v)[0][::-1]
    m = min(32, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == m * len(want) and {r.component for r in got} == set(range(1, m + 1))
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(want), key=str) and {r.n for r in got} == {len(want)}
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-8 * r.explained
    if len({i for i, _ in want}) == len(want):
        place = {i: k for k, (i, _) in enumerate(want)}
        w = np.empty((len(want), m))
        for r in got:
            w[place[r.vec_id], r.component - 1] = r.whitened
        w -= w.mean(0)
        error = np.abs(w.T @ w / len(want) - np.eye(m)).max()
        assert error <= 1e-8 and {abs(r.identity_error - error) < 1e-9 for r in got} == {True}
        # Each column is the centred rows on a unit eigenvector over the square root of its eigenvalue, whatever the sign.
        for k in range(m):
            axis = np.linalg.lstsq(y, w[:, k] * np.sqrt(values[k]), rcond=None)[0]
            assert np.abs(v @ axis - values[k] * axis).max() <= 1e-8 * values[0]


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(op12_whitening(spark, SF).collect(), rows)


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumns({c: F.lit("x") for c in ("n", "x", "y", "w", "component", "deviation", "whitened")})


def test_cases(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=5) * [1, 10, 0.5, 3, 2]).tolist()) for i in range(40)]
    odd = [(50, None), (51, [1.0, None, 1.0, 1.0, 1.0]), (52, [float("nan")] + [0.0] * 4), (53, [0.0, float("-inf"), 0.0, 0.0, 0.0]), (None, rows[0][1]), (None, None)]
    check(whitening.components(spark, vectors(spark, rows + odd)).collect(), rows + odd)
    check(whitening.components(spark, vectors(spark, rows + rows[:3] + odd)).collect(), rows + rows[:3] + odd)
    single = [(i, np.float32(v).tolist()) for i, v in rows]
    check(whitening.components(spark, vectors(spark, single, "array<float>")).collect(), single)
    far = [(i, [c + 1e6 for c in v]) for i, v in rows]
    check(whitening.components(spark, vectors(spark, far)).collect(), far)
    flat = [(i, [v[0], v[1], v[0], 7.0, floor(64 * v[0]) / 32]) for i, v in rows]
    got = whitening.components(spark, vectors(spark, flat)).collect()
    check(got, flat)
    assert {r.component for r in got} == {1, 2}
    for none in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.components(spark, vectors(spark, none)).collect() == []
    two = whitening.components(spark, vectors(spark, rows + [(60 + i, v[:2]) for i, v in rows])).collect()
    check([r for r in two if r.vec_id < 60], rows)
    check([r for r in two if r.vec_id >= 60], [(60 + i, v[:2]) for i, v in rows])
    with pytest.raises(ValueError, match="lengths"):
        whitening.components(spark, vectors(spark, [(i, [1.0] * i) for i in range(40)]))
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        whitening.components(spark, vectors(spark, [(1, [1e300]), (2, [0.0])])).collect()
