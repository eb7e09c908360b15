"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A text's features are its words and their byte n-grams with word ends marked, hashed into BUCKETS vectors. The vectors
are averaged over the text, frequent ones with less weight, and a linear softmax over the average gives the two classes;
vectors and softmax are trained together with Adagrad. A misspelt word still shares most n-grams with the word that was
learnt. Buckets met in too few documents of the sample have weight zero, so that they cannot learn single texts; how many are too
few is chosen among MIN_DOCUMENTS by the loss on a fifth of the training rows.

As the average and the softmax are both linear, scoring needs two numbers per bucket, a table of fixed size (16 MiB), which
is broadcast. Training takes at most MAX_TOXIC + MAX_CLEAN labelled documents, the first by a hash of the id, each counted once; their
features are extracted in Spark, at most MAX_FEATURES of a text, those of the least hashes. So what comes to the driver is bounded.

Edge cases: a null text is an empty one; a text without words is scored by the bias alone; a null doc_id hashes as an
empty string; unlabelled rows and null labels are not learnt from; rows with several labels count as toxic if one says so;
repeated rows each get a row; without labelled rows of both classes every score is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.words import ALNUM, LETTER, P, Words, chunks, mix

BUCKETS = 1 << 21
DIMENSIONS = 8
SIZES = (3, 4, 5)
THRESHOLD = 0.7
#: Bounds of the training sample.
MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 3000, 4500, 3000
EPOCHS, RATE, BATCH, DECAY = 8, 0.5, 32, 1e-4
MIN_DOCUMENTS = (3, 10)
#: Share of documents beyond which a feature's weight falls, with the square root of its share.
FREQUENT = 0.01

_DROPPED = np.uint64(64 - (BUCKETS.bit_length() - 1))
_EDGE = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, score double"


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (bucket, document) of arrays: the words, then the n-grams of each size, documents in order."""
    words = Words(data, offsets, ALNUM)
    yield (words.hashes() >> _DROPPED).astype(np.int64), words.owner()
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    place = np.arange(len(data)) + owner + 1  # a word edge before each text and one at the end
    n = len(data) + docs + 1
    value, inside = np.full(n, _EDGE), np.zeros(n + 1, np.int64)
    kept = ALNUM[data]
    value[place] = np.where(kept, LETTER[data], _EDGE)
    inside[place + 1] = kept
    inside = np.cumsum(inside)
    starts_at = offsets[:-1] + np.arange(docs)
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        at = np.flatnonzero(inside[size - 1 : size - 1 + m] - inside[1 : 1 + m] == size - 2)
        total = value[at + size - 1]
        for j in range(size - 2, -1, -1):
            total = total * P + value[at + j]
        hashed = mix(total + np.uint64(size))
        yield (hashed >> _DROPPED).astype(np.int64), np.searchsorted(starts_at, at, side="right") - 1


def _of_documents(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its distinct buckets and how often each occurs."""
    parts = list(features(data, offsets))
    keys = np.concatenate([d * BUCKETS + f for f, d in parts])
    keys, counts = np.unique(keys, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(offsets)) * BUCKETS)
    return [((keys[a:b] % BUCKETS).astype(np.int32), np.minimum(counts[a:b], 65535).astype(np.uint16)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _bounded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most MAX_FEATURES of a document's buckets: those of the least hashes, wherever they stand in the text."""
    if len(ids) <= MAX_FEATURES:
        return ids, counts
    kept = np.sort(np.argpartition(mix(ids.astype(np.uint64)), MAX_FEATURES)[:MAX_FEATURES])
    return ids[kept], counts[kept]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Chooses among MIN_DOCUMENTS by the loss on every fifth bag when the others are learnt from, and trains on all bags."""
    inner = np.arange(len(bags)) % 5 == 0
    learnt = np.flatnonzero(~inner)
    least, best = np.inf, MIN_DOCUMENTS[-1]
    if len(set(toxic[learnt].tolist())) == 2:
        for few in MIN_DOCUMENTS:
            table, bias = _fit([bags[i] for i in learnt], toxic[learnt], few, seed)
            loss = 0.0
            for i in np.flatnonzero(inner):
                ids, counts = bags[i]
                told, weight = (table[ids].astype(np.float64) * counts[:, None]).sum(axis=0)
                loss += np.logaddexp(0, (1 - 2 * toxic[i]) * (told / max(weight, 1) + bias))
            if loss < least:
                least, best = loss, few
    return _fit(bags, toxic, best, seed)


def _fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, few: int, seed: int) -> tuple[np.ndarray, float]:
    """Trains on bags of buckets; returns for each bucket its contribution to the log-odds of class 1 and its weight, and the bias."""
    rng = np.random.default_rng(seed)
    met = np.zeros(BUCKETS, np.int32)
    for ids, _ in bags:
        met[ids] += 1
    weight = np.minimum(1, np.sqrt(FREQUENT * len(bags) / np.maximum(met, 1))).astype(np.float32)
    weight[met < few] = 0
    used = np.flatnonzero(weight)
    slot = np.zeros(BUCKETS, np.int32)
    slot[used] = np.arange(len(used))
    kept = []
    for ids, counts in bags:
        ids, counts = ids[weight[ids] > 0], (counts * weight[ids])[weight[ids] > 0]
        kept.append((slot[ids], (counts / max(counts.sum(), 1)).astype(np.float32)))
    bags = kept
    vectors = (rng.random((len(used), DIMENSIONS), dtype=np.float32) * 2 - 1) / DIMENSIONS
    softmax, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    squares = [np.full(x.shape, 1e-8, np.float32) for x in (vectors[:, 0], softmax, bias)]
    target = np.eye(2, dtype=np.float32)[toxic]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = [i for i in order[at : at + BATCH] if len(bags[i][0])]
            if not rows:
                continue
            ids, share = np.concatenate([bags[i][0] for i in rows]), np.concatenate([bags[i][1] for i in rows])
            cuts = np.cumsum([0, *(len(bags[i][0]) for i in rows[:-1])])
            mean = np.add.reduceat(vectors[ids] * share[:, None], cuts)
            logit = mean @ softmax + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            wrong = p / p.sum(axis=1, keepdims=True) - target[rows]
            per_row = np.repeat(wrong @ softmax.T, np.diff(np.append(cuts, len(ids))), axis=0) * share[:, None]
            for value, gradient, square in ((softmax, mean.T @ wrong, squares[1]), (bias, wrong.sum(axis=0), squares[2])):
                square += gradient**2
                value -= rate * gradient / np.sqrt(square)
            distinct, place = np.unique(ids, return_inverse=True)
            gradient = np.stack([np.bincount(place, per_row[:, d], len(distinct)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            gradient += DECAY * vectors[distinct]
            squares[0][distinct] += (gradient**2).mean(axis=1)
            vectors[distinct] -= rate * gradient / np.sqrt(squares[0][distinct])[:, None]
    told = np.zeros(BUCKETS, np.float32)
    told[used] = weight[used] * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    return np.stack([told, weight], axis=1).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on the labelled documents that are not held out; labels (doc_id, toxic)."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("labelled"), "toxic")
    told = told.groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    told = told.join(docs.select(F.col("doc_id").cast("long").alias("labelled")), "labelled", "left_semi")
    order = F.xxhash64("labelled"), F.col("labelled")
    chosen = told.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).union(told.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    # At most MAX_TOXIC + MAX_CLEAN ids are broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                found = [_bounded(*f) for f in _of_documents(data, offsets)]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(row, end - row),
                        "toxic": batch.column("toxic").slice(row, end - row).cast(pa.int32()),
                        "ids": pa.array([f.tobytes() for f, _ in found], pa.binary()),
                        "counts": pa.array([c.tobytes() for _, c in found], pa.binary()),
                    }
                )

    extracted = sample.select("doc_id", "toxic", "text").mapInArrow(bags, "doc_id long, toxic int, ids binary, counts binary")
    found = extracted.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")  # the bounded sample
    toxic = np.array(found.column("toxic"), np.int64)
    if len(set(toxic.tolist())) < 2:
        return np.zeros((BUCKETS, 2), np.float32), -np.inf
    bags = [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.uint16)) for a, b in zip(found.column("ids"), found.column("counts"), strict=True)]
    del found
    return fit(bags, toxic)


def scores(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    out = []
    for _, _, data, offsets in chunks(column):
        sums = np.zeros((len(offsets) - 1, 2))
        for bucket, doc in features(data, offsets):
            if len(doc):
                n = np.bincount(doc, minlength=len(sums))
                some = np.flatnonzero(n)
                sums[some] += np.add.reduceat(table[bucket].astype(np.float64), (np.cumsum(n) - n)[some])
        logit = sums[:, 0] / np.maximum(sums[:, 1], 1) + bias
        out.append(1 / (1 + np.exp(-np.clip(logit, -700, 700))) if np.isfinite(bias) else np.zeros(len(logit)))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """Rows (doc_id, score) of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)  # two numbers per bucket, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores(batch.column("text"), sent.value, bias))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def train_and_score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = score(docs, *train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
