from __future__ import annotations

import numpy as np
import pytest

from sensorgrid.llm import neighbours
from sensorgrid.llm.neighbours import Quantised, bounds, nearest


def brute(rows, k, every):
    ok = [(p, i, np.array(v, np.float64)) for p, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for p, i, v in ok:
        if i % every == 0:
            found = sorted((-(float(np.dot(v, w)) / float(np.linalg.norm(v) * np.linalg.norm(w))), j, q) for q, j, w in ok if q != p and len(v) == len(w))
            out += [(i, r + 1, j, pytest.approx(-s, abs=1e-12)) for r, (s, j, _) in enumerate(found[:k])]
    return sorted(out, key=lambda x: x[:3])


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, groups and slices
        for name, n in (("BLOCK_ROWS", 7), ("GROUP_ROWS", 3), ("SLICE_ROWS", 20)):
            monkeypatch.setattr(neighbours, name, n)
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(size=(150, 8)))]
    rows[3] = (3, rows[10][1])  # ties
    rows[4] = (4, rows[10][1])
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (204, [float("inf")] * 8), (205, [1.0, None] + [1.0] * 6), (210, [1.0, 2.0]), (10, rows[10][1]), (211, [2.0, 1.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string")
        found = sorted(tuple(x) for x in nearest(df, 5, 10).collect())
        assert found == brute(rows, 5, 10)


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert [tuple(r) for r in nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema), 5, 50).select("query_id", "rank", "vec_id").collect()] == [(0, 1, 1)]
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(50, 16)), r.normal(size=(60, 16)) * 10.0 ** r.integers(-20, 20, size=(60, 1))
    low, high = bounds(Quantised(a), Quantised(b))
    true = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert (low <= true).all() and (true <= high).all() and (high - low).max() < 0.1
