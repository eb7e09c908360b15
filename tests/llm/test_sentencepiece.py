from __future__ import annotations

import itertools
import os
import random
import re

import pytest

from sensorgrid.llm.sentencepiece import LEVELS, MARK, MERGES, MODEL, NORMAL, UNIGRAM, UNKNOWN, Decoder, Encoder, Vocabulary, decode, encode

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
PARTS = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "　", "x", "1", ".", "-", "\x01", "the", "́", "ﬁ", "    ", "Ж", MARK]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def texts(n, seed=1):
    r = random.Random(seed)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]
    return [*made, "", "a" * 3000, " " * 500, "\x00a", " a  ", "<s> a </s> <unk>", "https://foo.bar/baz?x=1&y=2 " * 3]


def test_equals_the_library(vocabulary):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    told = texts(1500)
    flat, counts = Encoder(vocabulary).encode(told)
    at = 0
    for text, n in zip(told, counts, strict=True):
        assert flat[at : at + n].tolist() == library.encode(text), text
        at += n


def test_round_trip(vocabulary):
    told = [t for t in texts(500, 2) if MARK not in t]
    assert Decoder(vocabulary).decode(*Encoder(vocabulary).encode(told)) == [t.encode() for t in told]


def test_unigram_models_take_the_best_segmentation():
    r = random.Random(4)
    pieces = ["<unk>", MARK, "a", "b", "ab", "ba", "aab", MARK + "a", MARK + "ab", "bab", "abab"]
    v = Vocabulary(pieces, [0.0, *(-r.random() * 5 for _ in pieces[1:])], [UNKNOWN, *(NORMAL for _ in pieces[1:])], UNIGRAM)
    words = sorted({MARK + "".join(r.choice("ab") for _ in range(r.randint(0, 7))) for _ in range(60)})
    for word, found in Encoder(v).encode_sorted(words):
        best = max(
            (sum(v.scores[pieces.index(word[a:b])] for a, b in itertools.pairwise(cut)) for k in range(len(word)) for mid in itertools.combinations(range(1, len(word)), k) for cut in [(0, *mid, len(word))] if all(word[a:b] in pieces[1:] for a, b in itertools.pairwise(cut))),
        )
        assert sum(v.scores[i] for i in found) == pytest.approx(best) and "".join(pieces[i] for i in found) == word


def test_documents(spark, documents, odd, vocabulary):
    found = encode(documents(odd), vocabulary)
    assert sorted((x.doc_id or -1, x.n_tokens, x.round_trip) for x in found.collect()) == sorted((i or -1, int(Encoder(vocabulary).encode([t or ""])[1][0]), True) for i, t in odd)
    back = decode(found, vocabulary)
    assert sorted((x.doc_id or -1, x.text) for x in back.collect()) == sorted((i or -1, t or "") for i, t in odd)
    assert encode(documents([]), vocabulary).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), vocabulary).first().text == ""


def merged(encoder, text):
    """Pieces of a text by the merges alone."""
    return [i for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) for i in encoder._with_bytes(encoder.merged(w))] if text else []


def test_ordinary_words_of_merge_models_go_level_by_level(vocabulary, monkeypatch):
    """No pair of pieces goes through the merges one by one, and no word node by node, but for long ones and runs of marks."""
    monkeypatch.setattr(Encoder, "_stays", lambda *_: pytest.fail("a pair by itself"))
    encoder, r = Encoder(vocabulary), random.Random(5)
    parts = [p for p in PARTS if " " not in p and p != MARK]
    told = [" ".join("".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(20)) for _ in range(100)]
    flat, counts = encoder.encode(told)
    assert flat.tolist() == [i for t in told for i in merged(encoder, t)] and len(flat) > 2000
    assert counts.tolist() == [len(merged(encoder, t)) for t in told]


def test_merge_models_equal_the_merges():
    r, levels = random.Random(6), 0
    for _ in range(60):
        letters = r.choice(["a", "ab", "abc"])
        pool = [MARK, *letters]
        for _ in range(r.randint(1, 14)):
            left, right = r.choice(pool), r.choice(pool)
            if MARK not in right and left + right not in pool:
                pool.append(left + right)
        pieces = ["<unk>", *pool]
        scores = [0.0, *(-float(k) for k, _ in enumerate(pool))]
        encoder = Encoder(Vocabulary(pieces, scores, [UNKNOWN, *(NORMAL for _ in pool)], MERGES))
        levels += encoder.levels is not None
        told = ["".join(r.choice(letters + " z") for _ in range(r.randint(0, 20))) for _ in range(40)] + ["a" * n for n in (1, 2, 7, 31, LEVELS, LEVELS + 1, 200)]
        flat, counts = encoder.encode(told)
        assert flat.tolist() == [i for t in told for i in merged(encoder, t)]
        assert counts.tolist() == [len(merged(encoder, t)) for t in told]
    assert levels > 30
