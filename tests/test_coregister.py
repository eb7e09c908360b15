"""Co-registration against a plain walk, whatever the layout."""

from __future__ import annotations

import math
import random

import pytest

from sensorgrid.operators.coregister import MODES, coregister, nested

SCHEMA = "capture_id string, instrument int, ts_ms long, lat double, lon double"


def plain(rows, mode):
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[4], r[0]))
    primaries, out, k = [r for r in rows if r[1] == 0], {}, -1

    def far(a, b):
        return math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2)

    for r in rows:
        if r[1] == 0:
            k += 1
        elif primaries:
            if mode == "walk":
                i = max(k, 0)
                while i < len(primaries) - 1 and not far(r, primaries[i]) < far(r, primaries[i + 1]):
                    i += 1
            elif mode == "adjacent":
                around = [i for i in (k, k + 1) if 0 <= i < len(primaries)]
                i = around[0] if len(around) == 1 or far(r, primaries[around[0]]) < far(r, primaries[around[1]]) else around[1]
            else:
                i = min(range(len(primaries)), key=lambda i: (far(r, primaries[i]), i))
            out[r[0]] = primaries[i][0]
    return out


def made(n, times, seed=1):
    r = random.Random(seed)
    return [(f"c{i:04d}", 0 if r.random() < 0.25 else r.randint(1, 3), r.randint(0, times), float(r.randint(0, 10)), r.random() * 10) for i in range(n)]


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("times", [4, 10**7])
def test_equals_plain_walk_for_any_layout(spark, mode, times):
    rows = made(200, times)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7):
        found = {r.capture_id: r.primary_id for r in coregister(df, mode, parts, ahead=2).collect()}
        assert found == plain(rows, mode)


@pytest.mark.parametrize("mode", MODES)
def test_edge_cases(spark, mode):
    cases = {
        "no rows": [],
        "no primary": [("a", 1, 1, 0.0, 0.0)],
        "one primary, leading and trailing secondaries": [("a", 1, 1, 0.0, 0.0), ("b", 0, 5, 0.0, 0.0), ("c", 2, 9, 0.0, 0.0)],
        "no secondary": [("a", 0, 1, 0.0, 0.0)],
        "equal distance": [("a", 0, 0, 0.0, 0.0), ("b", 1, 5, 0.0, 0.0), ("c", 0, 10, 0.0, 0.0)],
        "equal keys": [("a", 0, 0, 0.0, 0.0), ("b", 1, 0, 0.0, 0.0), ("c", 0, 0, 0.0, 0.0), ("d", 1, 0, 0.0, 0.0)],
    }
    for name, rows in cases.items():
        found = {r.capture_id: r.primary_id for r in coregister(spark.createDataFrame(rows, SCHEMA), mode).collect()}
        assert found == plain(rows, mode), name


def test_nested_keeps_primaries_without_associations(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("b", 1, 1, 0.0, 0.0), ("c", 0, 90, 0.0, 0.0)], SCHEMA)
    found = {r.capture_id: r.associated for r in nested(coregister(df), df.where("instrument = 0")).collect()}
    assert found == {"a": {1: ["b"]}, "c": {}}


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        coregister(spark.createDataFrame([], SCHEMA), "best")
