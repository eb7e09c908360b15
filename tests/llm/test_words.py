"""Word hashes do not depend on where a word stands, nor on the blocks in which they are computed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sensorgrid.llm import words

WHOLE = (1 << 64) - 1


def plain(word: bytes) -> int:
    total = 0
    for b in reversed(word):
        total = (total * words._P + int(words.LETTER[b])) & WHOLE
    return int(words.mix(np.array([total], np.uint64))[0])


def test_hashes_equal_plain_polynomials():
    n = words.BLOCK
    texts = ["Ab  c", None, "", "x" * (n + 5) + " tail " + "é" * n, "one two " * n, "y" * n, "z" * (3 * n + 1)]
    for kept in (words.ALNUM, words.SPACED):
        found = [h for _, _, data, offsets in words.chunks(pa.array(texts)) for h in words.Words(data, offsets, kept).hashes().tolist()]
        known: dict[str, int] = {}
        wanted = [known.setdefault(w, plain(w.encode())) for t in texts for w in (t or "").lower().split()]
        assert found == wanted


def test_memory_goes_back_after_all_batches_or_an_early_end():
    run = words.giving_back(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2, 3]))) == [2, 4, 6] and list(run(iter([]))) == []
    begun = run(iter([1, 2, 3]))
    assert next(begun) == 2
    begun.close()
    assert list(begun) == []
