"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words (A-Z lower-cased; runs of ASCII letters, digits and characters
beyond ASCII). Of every 9 consecutive 5-gram hashes the least is kept as a fingerprint, so any 13 words that a
document and an item share leave at least one common fingerprint (9 + 5 - 1 = 13). Fingerprints are joined and each
hit is extended word by word to both sides; runs of 13 or more words are marked. An item of fewer than 13 words is one
window and is matched by the hash of all its words.

The item side is broadcast only if its word count is within MAX_BROADCAST_WORDS, and is indexed once in each worker. A larger one
goes through shuffled joins with the same result: fingerprints meet, and each distinct text that shares some is sent once to
its verification, followed there, a row at a time, by the items that it shares them with.

Edge cases: null and wordless texts have no words and are never hit or hitting; items with a null id take no part;
repeated rows of an item count once; repeated documents each get their row; empty tables give an empty or unhit result;
other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.shared import stored
from sensorgrid.llm.words import ALNUM, Words, chunks, expand, giving_back, grams

WINDOW = 13
GRAM = 5
#: Words of benchmark text that may be broadcast: 4 Mi words are 32 MB of hashes and 13 MB of fingerprints at most.
MAX_BROADCAST_WORDS = 1 << 22

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Indices into `hashes` (grams that start at words `at`) that are the least of some run of consecutive grams.

    A run has window - gram + 1 grams, so that it spans `window` words; among equal hashes the last is kept. Runs do not
    cross documents, because `at` skips a document's last words.
    """
    size = window - gram + 1
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(at[size - 1 :] - at[:m] == size - 1)
    least, where = hashes[whole], np.zeros(len(whole), dtype=np.int64)
    for j in range(1, size):
        other = hashes[whole + j]
        better = other <= least
        least = np.where(better, other, least)
        where[better] = j
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[whole + where] = True
    return np.flatnonzero(chosen)


class Items:
    """Benchmark items: word hashes end to end, fingerprints of long items, whole-item hashes of short ones."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW, gram: int = GRAM):
        parts, first, self.ids = [], [0], ids
        for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
            words = Words(data, offsets, ALNUM)
            parts.append(words.hashes())
            first.extend((words.first[1:] + first[-1]).tolist())
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.first = np.array(first, dtype=np.int64)
        self.window, self.gram = window, gram
        lengths = np.diff(self.first)
        hashes, at = grams(self.words, self.first, gram)
        kept = winnow(hashes, at, window, gram)
        order = np.argsort(hashes[kept], kind="stable")
        self.prints, self.print_at = hashes[kept][order], at[kept][order]
        self.print_item = np.searchsorted(self.first, self.print_at, side="right") - 1
        self.short = {}
        for n in sorted({int(x) for x in lengths if 0 < x < window}):
            items = np.flatnonzero(lengths == n)
            hashes, at = grams(self.words, self.first, n)
            value = hashes[np.searchsorted(at, self.first[items])]
            order = np.argsort(value, kind="stable")
            self.short[n] = value[order], items[order]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item): maximal runs of document words in which windows of the item occur."""
        out = []
        hashes, at = grams(words, first, self.gram)
        kept = winnow(hashes, at, self.window, self.gram)
        lo = np.searchsorted(self.prints, hashes[kept], side="left")
        hi = np.searchsorted(self.prints, hashes[kept], side="right")
        found = np.flatnonzero(hi > lo)
        owner, which = expand(lo[found], (hi - lo)[found])
        p, q = at[kept][found][owner], self.print_at[which]
        doc = np.searchsorted(first, p, side="right") - 1
        item = self.print_item[which]
        left = self._extend(words, p, q, np.minimum(p - first[doc], q - self.first[item]), -1)
        right = self._extend(words, p, q, np.minimum(first[doc + 1] - p, self.first[item + 1] - q), 1)
        long = left + right >= self.window
        out.append((p[long] - left[long], p[long] + right[long], item[long]))
        for n, (values, items) in self.short.items():
            hashes, at = grams(words, first, n)
            lo, hi = np.searchsorted(values, hashes, side="left"), np.searchsorted(values, hashes, side="right")
            found = np.flatnonzero(hi > lo)
            owner, which = expand(lo[found], (hi - lo)[found])
            out.append((at[found][owner], at[found][owner] + n, items[which]))
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))

    def _extend(self, words: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from p and q on (step 1), or before them (step -1), up to `most`."""
        length = np.zeros(len(p), dtype=np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            ahead = length[active] if step > 0 else -length[active] - 1
            same = words[p[active] + ahead] == self.words[q[active] + ahead]
            active = active[same]
            length[active] += 1
            active = active[length[active] < most[active]]
        return length


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in some range."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def scan(items: Items, column: pa.Array) -> Iterator[tuple[int, int, list[set[str]]]]:
    """For each text: number of words, number hit, ids of the items that hit."""
    for _, _, data, offsets in chunks(column):
        words = Words(data, offsets, ALNUM)
        starts, ends, item = items.hits(words.hashes(), words.first)
        hit = np.concatenate([[0], np.cumsum(_covered(starts, ends, len(words)))])
        found: dict[int, set[str]] = {}
        docs = np.searchsorted(words.first, starts, side="right") - 1
        for d, i in np.unique(np.stack([docs, item], axis=1), axis=0).tolist() if len(docs) else ():
            found.setdefault(d, set()).add(items.ids[i])
        n_words, n_hit = np.diff(words.first), np.diff(hit[words.first])
        for d in range(len(n_words)):
            yield int(n_words[d]), int(n_hit[d]), found.get(d, set())


def _result(batch: pa.RecordBatch, rows: list[tuple[int, int, set[str]]], keep: bool) -> pa.RecordBatch:
    return _table(batch, [n for n, _, _ in rows], [h for _, h, _ in rows], [len(x) for _, _, x in rows], [_digest(x) for _, _, x in rows], keep)


def _table(batch: pa.RecordBatch, n_words: list[int], n_hit: list[int], n_items: list[int], digests: list[str], keep: bool) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array(n_items, pa.int64()),
            "items_sha256": pa.array(digests, pa.string()),
            "contaminated": pa.array([h > 0 and 20 * h >= n for n, h in zip(n_words, n_hit, strict=True)], pa.bool_()),
        }
        | ({"text": batch.column("text"), "kept": batch.column("kept")} if keep else {})
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_broadcast_words: int = MAX_BROADCAST_WORDS, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row of SCHEMA for each row of docs (doc_id, text), against benchmark (item_id, text); with `keep`, also text and
    kept, a struct of those columns."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("item_text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.struct(*keep).alias("kept") for _ in [0] if keep))
    # The sum of the lengths bounds the words, the item count the ids; one number comes to the driver.
    load = items.agg(F.coalesce(F.sum(F.length("item_text") / 2 + 8), F.lit(0.0))).first()[0]
    if load <= max_broadcast_words:
        return _by_broadcast(docs, items, window, gram)
    return _by_shuffle(docs, items, window, gram)


def _schema(docs: DataFrame) -> str:
    return SCHEMA + (f", text string, kept {docs.schema['kept'].dataType.simpleString()}" if "kept" in docs.columns else "")


#: The index that this worker holds, by the name of its broadcast.
_HELD: dict[str, Items] = {}


def _by_broadcast(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    rows = items.distinct().collect()  # within max_broadcast_words
    keep, name = "kept" in docs.columns, uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(([r.item for r in rows], [r.item_text for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = Items(*sent.value, window, gram)
        for batch in batches:
            yield _result(batch, list(scan(_HELD[name], batch.column("text"))), keep)

    return docs.mapInArrow(giving_back(run), _schema(docs))


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """For benchmarks of any size. A text is known by two hashes, so that copies of a text are verified once."""
    key = ["k1", "k2"]
    keyed = docs.withColumns({"k1": F.xxhash64(F.lit(1), "text"), "k2": F.xxhash64(F.lit(2), "text")})
    items = items.distinct()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                n = np.unique(np.diff(Words(data, offsets, ALNUM).first))
                yield pa.record_batch({"n": pa.array(n[(n > 0) & (n < window)], pa.int64())})

    short = sorted(r.n for r in items.select(F.col("item_text").alias("text")).mapInArrow(giving_back(lengths), "n long").distinct().collect())  # fewer than `window` rows

    def prints(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, end, data, offsets in chunks(batch.column("text")):
                    found = Words(data, offsets, ALNUM)
                    h = found.hashes()
                    value, at = grams(h, found.first, gram)
                    kept = winnow(value, at, window, gram)
                    sets = [(value[kept], at[kept], 0), *((*grams(h, found.first, n), n) for n in short)]
                    for value, at, kind in sets:
                        doc = np.searchsorted(found.first, at, side="right") - 1
                        if kind and name == "item":  # only an item of just that length is a window
                            ok = np.diff(found.first)[doc] == kind
                            value, doc = value[ok], doc[ok]
                        pairs = np.unique(np.stack([doc.astype(np.uint64), value], axis=1), axis=0)
                        picked = batch.slice(row, end - row).drop_columns(["text"]).take(pa.array(pairs[:, 0].astype(np.int64)))
                        yield pa.record_batch([*picked.columns, pa.array(pairs[:, 1].view(np.int64)), pa.array(np.full(len(pairs), kind, np.int32))], [*picked.schema.names, "print", "kind"])

        return run

    of_docs = keyed.select(*key, "text").mapInArrow(giving_back(prints("doc")), "k1 long, k2 long, print long, kind int").distinct()
    of_items = items.select("item", F.col("item_text").alias("text")).mapInArrow(giving_back(prints("item")), "item string, print long, kind int")
    pairs = stored(of_docs.join(of_items, ["print", "kind"]).select(*key, "item").distinct(), "shared")
    texts = keyed.select(*key, "text").join(pairs.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
    rows = texts.select(*key, F.lit("").alias("item"), F.lit(0).alias("order"), "text").union(pairs.join(items, "item").select(*key, "item", F.lit(1).alias("order"), "item_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by text: the text, then its items. Nothing of a text is held but its words, the hits and the items' names."""
        now, words, hit, ids = None, None, None, set()

        def told() -> pa.RecordBatch:
            return pa.record_batch({"k1": [now[0]], "k2": [now[1]], "n_hit": [int(hit.sum())], "n_items": [len(ids)], "items_sha256": [_digest(ids)]}, _HITS)

        for batch in batches:
            for k1, k2, item, order, text in zip(*(batch.column(c) for c in ("k1", "k2", "item", "order", "text")), strict=True):
                _, _, data, offsets = next(chunks(pa.array([text.as_py()], pa.large_string())))
                if not order.as_py():
                    if ids:
                        yield told()
                    found = Words(data, offsets, ALNUM)
                    now, words, ids = (k1.as_py(), k2.as_py()), (found.hashes(), found.first), set()
                    hit = np.zeros(len(found), bool)
                    continue
                starts, ends, _ = Items([item.as_py()], [text.as_py()], window, gram).hits(*words)
                if len(starts):
                    hit |= _covered(starts, ends, len(hit))
                    ids.add(item.as_py())
        if ids:
            yield told()

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = rows.repartition(tasks, *key).sortWithinPartitions(*key, "order").mapInArrow(giving_back(verify), "k1 long, k2 long, n_hit long, n_items long, items_sha256 string")
    joined = keyed.join(stored(hits, "hits"), key, "left").drop(*key)
    keep = "kept" in docs.columns
    none = _digest(set())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [int(n) for _, _, data, offsets in chunks(batch.column("text")) for n in np.diff(Words(data, offsets, ALNUM).first)]
            n_hit, n_items, ids = (batch.column(c).to_pylist() for c in ("n_hit", "n_items", "items_sha256"))
            yield _table(batch, n_words, [h or 0 for h in n_hit], [n or 0 for n in n_items], [i or none for i in ids], keep)

    return joined.mapInArrow(giving_back(finish), _schema(docs))


_HITS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])
