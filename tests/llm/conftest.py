from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()

#: Columns whose names the operators use themselves.
CLASHING = "key kept k1 k2 found spans score held_out n_words text_hash class_id class_key id none ids links node band told part entities label".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0, words=WORDS):
        r = random.Random(seed)
        return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from (doc_id, text) with the other columns and ones with clashing names."""

    def make(rows, langs=None):
        full = [(i, t, (langs or {}).get(k, "en"), "src", len(t or ""), *("x" for _ in CLASHING)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [(1, prose(40, 1)), (2, None), (3, ""), (None, prose(30, 2)), (4, prose(30000, 3)), (5, prose(40, 4)), (5, prose(40, 4)), (6, "!!! 123 ---"), (7, prose(40, 1)), (8, "é漢😀\x00\t\n ")]
