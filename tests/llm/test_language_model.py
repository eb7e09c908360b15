from __future__ import annotations

import collections
import math
import os
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sensorgrid.llm import files, language_model
from sensorgrid.llm.language_model import train_and_score

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows, order):
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), "</s>"] for _, t in rows]
    learnt = [t for (i, _), t in zip(rows, tokens, strict=True) if not held(i)]
    c = collections.Counter(w for t in learnt for w in t)
    n, v, levels = sum(c.values()), len(c), {}
    levels[order] = collections.Counter(tuple((["<s>"] * (order - 1) + t)[i : i + order]) for t in learnt for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    discount, context = {}, {k: {} for k in levels}
    for k, grams in levels.items():
        n1, n2, n3, n4 = (max(1, sum(x == m for x in grams.values())) for m in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount[k] = [0, *(min(max(m - (m + 1) * y * b / a, 0.05), m - 0.05) for m, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
        for g, x in grams.items():
            told = context[k].setdefault(g[:-1], [0, 0, 0, 0])
            told[0] += x
            told[min(x, 3)] += 1

    def p(k, g):
        if k == 0:
            return 1 / (v + 1)
        lower, told = p(k - 1, g[1:]), context[k].get(g[:-1])
        if not told:
            return lower
        x = levels[k].get(g, 0)
        return max(x - discount[k][min(x, 3)], 0) / told[0] + sum(discount[k][m] * told[m] for m in (1, 2, 3)) / told[0] * lower

    out = []
    for (i, _), t in zip(rows, tokens, strict=True):
        padded = ["<s>"] * (order - 1) + t
        out.append((i, held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(math.log10(p(order, tuple(padded[j : j + order]))) for j in range(len(t)))))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_equals_brute_force(spark, documents, odd, prose, order):
    rows = [(i, t) for i, t in odd if i != 4] + [(i, prose(30, i)) for i in range(20, 60)] + [(4, prose(3000, 3))]
    found = train_and_score(documents(rows), order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(brute(rows, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-12) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_nothing_to_learn_from(spark, documents):
    assert train_and_score(documents([])).count() == 0
    only = next(i for i in range(100) if held(i))
    row = train_and_score(documents([(only, "a b")])).first()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score == pytest.approx(0.0)


def test_query_counts_trigrams(spark, documents, prose, tmp_path):
    from sensorgrid.llm.queries import op3_language_model

    rows = [(i, prose(30, i)) for i in range(40)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.score for r in op3_language_model(spark, str(tmp_path)).collect()}
    assert found == pytest.approx({r[0]: r[6] for r in brute(rows, 3)}, rel=1e-9)
    assert found != pytest.approx({r[0]: r[6] for r in brute(rows, 2)}, rel=1e-3)


def test_large_counts_are_kept_whole(spark, documents):
    rows = [(i, "a b c " * 300 + "d e") for i in range(30)]
    found = {r.doc_id: r.score for r in train_and_score(documents(rows), 3).collect()}
    assert found == pytest.approx({r[0]: r[6] for r in brute(rows, 3)}, rel=1e-9)


def test_wide_sums_and_columns():
    keys, _, (sums,) = language_model._summed(np.array([3, 1, 3], np.uint64), np.array([2**32 - 1, 5, 7], np.uint32))
    assert keys.tolist() == [1, 3] and sums.tolist() == [5, 2**32 + 6]
    columns = [np.array([0, 1, 2**40], np.uint64), np.array([1, 255, 65536], np.uint32), np.zeros(3, np.uint32)]
    assert [c.tolist() for c in language_model._unpacked(language_model._packed(columns))] == [c.tolist() for c in columns]


@pytest.mark.parametrize("shards", [1, 3, 64, 5000])
def test_written_grams_are_found(tmp_path, shards):
    ids = np.random.default_rng(1).integers(0, 10**6, (20000, 3)).astype(np.uint32)
    keys = np.unique(language_model._joined(ids, shards))
    cuts = language_model._cuts(keys, shards)
    for s in {0, shards // 2, shards - 1}:
        mine = keys[cuts[s] : cuts[s + 1]]
        language_model._write_grams(f"{tmp_path}/{shards}-{s}", mine, (np.arange(len(mine)) % 700)[:, None], s, shards)
        some = np.unique(np.concatenate([mine[::3], mine[1::3] + np.uint64(1 << 20)]))
        some = some[np.searchsorted(language_model._bounds(shards), some, side="right") == s]
        ok, counts = language_model._found(f"{tmp_path}/{shards}-{s}", some, s, shards)
        assert some[ok].tolist() == np.intersect1d(some, mine).tolist()
        assert counts[:, 0].tolist() == (np.searchsorted(mine, some[ok]) % 700).tolist()


@pytest.mark.parametrize("wide", [np.uint32(1), np.uint64(1 << 20), np.uint64(1 << 42)])
def test_rows_of_any_width_come_back(wide):
    ids = np.random.default_rng(2).integers(0, 3000, (5000, 3)).astype(np.uint32) * wide
    ids[0] = 0
    place = language_model._order(ids)
    assert sorted(place.tolist()) == list(range(len(ids))) and (np.diff(ids[place, 0].astype(np.int64)) >= 0).all()
    assert language_model._order(ids[:0]).tolist() == []
    sent = language_model._gram_rows(3, "seen", ids, [np.ones(len(ids), np.uint32)], 4)
    rows, (counts, *_) = language_model._gathered(pa.table(sent), "seen", 3)
    seen = collections.Counter(map(tuple, ids.tolist()))
    assert dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == seen


def test_rows_are_sorted_by_single_keys():
    """Making rows takes four fifths at most of the CPU time of sorting them column by column and stably by hash."""
    ids = np.random.default_rng(3).zipf(1.3, (1 << 20, 3)).clip(0, 800_000).astype(np.uint32)
    keys, ones = language_model._joined(ids, 8), np.ones(len(ids), np.uint32)

    def least(run):
        took = []
        for _ in range(3):
            began = time.thread_time()
            run()
            took.append(time.thread_time() - began)
        return min(took)

    columns = least(lambda: (np.argsort(keys, kind="stable"), np.lexsort(ids.T[::-1])))
    assert least(lambda: language_model._gram_rows(3, "seen", ids, [ones], 8)) < 0.8 * columns


@pytest.mark.skipif(files.LOCAL_MAPS < 2100, reason="maps keep descriptors before Python 3.13")
def test_maps_of_many_shards_stay_open(tmp_path):
    """More files than a model of 128 shards has are mapped once each, without descriptors; arrays of any order and no size come back."""
    for i in range(2100):
        files.write_array(f"{tmp_path}/{i}.npy", np.arange(i % 3))
    arrays = [files.mapped(f"{tmp_path}/{i}.npy") for i in range(2100)]
    assert all(a.tolist() == list(range(i % 3)) for i, a in enumerate(arrays))
    assert all(files.mapped(f"{tmp_path}/{i}.npy") is a for i, a in enumerate(arrays))
    assert sum(str(tmp_path) in os.path.realpath(f"/proc/self/fd/{x}") for x in os.listdir("/proc/self/fd")) == 0
    files.write_array(f"{tmp_path}/columns.npy", np.arange(6).reshape(2, 3).T)
    assert files.mapped(f"file://{tmp_path}/columns.npy").tolist() == [[0, 3], [1, 4], [2, 5]]
