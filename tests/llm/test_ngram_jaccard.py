from __future__ import annotations

import itertools
import random
import re

import pytest

from sensorgrid.llm import ngram_jaccard
from sensorgrid.llm.components import components
from sensorgrid.llm.ngram_jaccard import bands_and_rows, join_similar, keep_one

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset([text or ""])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        out.append((-1 if i is None else i, min(ids, default=-1), links[k]))
    return sorted(out)


def near(text, changes, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus(prose):
    rows = [(i, prose(60 + i, 1000 + i)) for i in range(20)]
    for base in range(4):  # groups of near copies and exact ones
        rows += [(100 + 40 * base + k, near(rows[base][1], k % 3, 50 * base + k)) for k in range(12)]
    return rows


@pytest.mark.parametrize(("block", "shingles"), [(512, 1 << 20), (3, 1 << 20), (512, 300)])
def test_equals_brute_force(spark, documents, prose, odd, block, shingles):
    rows = corpus(prose) + odd + [(900, "one two"), (901, "One, two!"), (902, "one two three"), (903, "???"), (904, "???"), (905, "!?!")]
    found = join_similar(documents(rows), block=block, block_shingles=shingles).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in found) == brute(rows)


def test_one_of_each_class_stays(spark, documents, prose, odd):
    rows = corpus(prose) + [(i and i + 1000, t) for i, t in odd if i != 4]
    kept = keep_one(documents(rows))
    assert kept.columns == documents([]).columns
    found = brute(rows)
    assert kept.count() == len({c if c != -1 else ("none", i) for i, c, _ in found})
    assert {r.doc_id for r in kept.collect()} == {None if i == -1 else i for i, c, _ in found if c in (i, -1)}


def test_chains_of_unlike_texts_are_not_compared(spark, documents, prose):
    """Each text shares two thirds with the next: some share a bucket, so that all are chained; far ones never meet."""
    parts = [prose(30, 2000 + k) for k in range(60)]
    rows = [(k, " ".join(parts[k : k + 12])) for k in range(48)]
    found = join_similar(documents(rows), recall=0.9995).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == brute(rows)


def test_large_group_with_many_masks(spark, documents, prose):
    base = prose(80, 7)
    rows = [(k, near(base, k % 4, 70 + k)) for k in range(90)]
    for block in (512, 4):
        found = join_similar(documents(rows), block=block).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == brute(rows)


def test_very_long_texts(spark, documents, prose):
    long = " ".join(prose(20000, k) + f" w{k}" for k in range(20))
    rows = [(1, long), (2, long + " more words than before"), (3, prose(20000, 5)), (4, long)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in join_similar(documents(rows)).collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (1, 2)}


def test_empty(spark, documents):
    assert join_similar(documents([])).count() == 0 and keep_one(documents([])).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= ngram_jaccard.MAX_HASHES


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, x) for x in range(8, 30)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)] + [(1, 1)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
