from __future__ import annotations

import hashlib
import random
import re

import pytest

from sensorgrid.llm.decontamination import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, told in items:
            v = words(told)
            n = min(len(v), 13)
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if item is not None and v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add(str(item))
        out.append((i if i is not None else -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("bound", [1 << 22, 0])
def test_equals_brute_force_on_both_paths(spark, documents, prose, odd, bound):
    r = random.Random(1)
    items = [(k, prose(r.randint(10, 40), 500 + k)) for k in range(12)] + [(20, "alpha beta"), (21, "Omega"), (22, ""), (23, None), (None, prose(30, 1)), (3, prose(30, 503)), (24, "!!"), (25, prose(13, 600))]
    docs = [*odd, (4, prose(3000, 3))]
    for k in range(30):
        text, (_, told) = prose(50, 700 + k).split(" "), r.choice(items[:12])
        part = told.split(" ")
        a = r.randint(0, len(part))
        at = r.randint(0, len(text))
        docs.append((100 + k, " ".join(text[:at] + part[a : a + r.randint(8, 30)] + text[at:]) if k % 3 else told.upper() + " x " + told))
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    found = decontaminate(documents(docs), table, bound).collect()
    assert sorted((-1 if x[0] is None else x[0], *x[1:]) for x in map(tuple, found)) == brute(docs, items)


@pytest.mark.parametrize("bound", [1 << 22, -1])
def test_empty_tables_and_kept_columns(spark, documents, odd, bound):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate(documents(odd), none, bound, keep=("source", "n_chars")).collect()
    assert len(found) == len(odd) and not any(x.n_hit or x.contaminated for x in found)
    assert sorted((x.text or "~", x.kept.n_chars) for x in found) == sorted((t or "~", len(t or "")) for _, t in odd)
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(documents([]), some, bound).count() == 0


@pytest.mark.parametrize("bound", [1 << 22, 0])
def test_short_items_of_many_characters(spark, documents, bound):
    items = [(1, "alpha" + "!" * 70000 + "beta"), (2, "x" * 70000)]
    docs = [(1, "gamma alpha beta delta"), (2, "gamma " + "x" * 70000), (3, "gamma delta")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(documents(docs), table, bound).collect()
    assert sorted(tuple(x) for x in found) == brute(docs, items)


def test_paths_agree_on_the_tables(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    by_broadcast, by_shuffle = (sorted(map(tuple, decontaminate(d, b, n).collect())) for n in (1 << 22, 0))
    assert by_broadcast == by_shuffle and any(r[2] for r in by_shuffle)
