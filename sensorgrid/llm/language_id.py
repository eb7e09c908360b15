"""Language identification by a byte convolutional network.

The UTF-8 bytes of a text are cut into windows of WINDOW bytes that cover it whole. Bytes are embedded; filters of several
widths slide over the window; each filter's greatest activation goes to a softmax over the languages met in training. A
text's language is the one with the greatest mean probability over its windows (by bytes), which is also its score.

The network is trained in numpy with Adam, on up to MAX_PER_LANGUAGE labelled documents of each language (the first by a
hash of the id) and up to WINDOWS_EACH windows of each, spread over the text. Its weights have a fixed size and are
broadcast.

Edge cases: a null text or one without a letter is `und` with score 0; a null doc_id hashes as an empty string; rows
without a language or an id are not learnt from; ties go to the first language by name; repeated rows each get a row; if nothing
could be learnt, every text is `und`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.llm.shared import stored
from sensorgrid.llm.words import chunks, giving_back

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bounds of the training sample.
MAX_PER_LANGUAGE = 500
#: Languages beyond which each gets a smaller sample.
MAX_LANGUAGES = 200
WINDOWS_EACH = 4
EPOCHS, BATCH, RATE = 6, 32, 0.004
#: Windows that go through the network at once.
SLAB = 128
#: Bytes of text whose windows are made at once, unless one text has more.
CHUNK = 1 << 19

UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: Column | str) -> Column:
    return F.coalesce(F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(r"\p{L}")), F.lit(False))


class Network:
    """Byte embedding, filters of several widths with ReLU and max pooling, softmax. Byte 0 pads windows."""

    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        self.p = {"embed": rng.normal(0, 0.3, (256, EMBEDDING))}
        filters = np.zeros((wide * EMBEDDING, FILTERS * len(WIDTHS)))
        for i, w in enumerate(WIDTHS):
            filters[: w * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
        self.mask = (filters != 0).astype(np.float32)
        self.p |= {"filters": filters, "shift": np.zeros(filters.shape[1]), "out": rng.normal(0, 0.1, (filters.shape[1], classes)), "bias": np.zeros(classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """For every place the embeddings of the next bytes, as many as the widest filter takes."""
        wide = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, wide - 1)))
        n, length = windows.shape
        embedded = self.p["embed"][padded]
        out = np.empty((n, length, wide, EMBEDDING), np.float32)
        for j in range(wide):
            out[:, :, j] = embedded[:, j : j + length]
        return out.reshape(n, length, wide * EMBEDDING)

    def pooled(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        active = columns @ self.p["filters"]
        return np.maximum(active.max(axis=1) + self.p["shift"], 0), active

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), SLAB):
            logit = self.pooled(self._columns(windows[at : at + SLAB]))[0] @ self.p["out"] + self.p["bias"]
            e = np.exp(logit - logit.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.p["bias"])), np.float32)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        columns = self._columns(windows)
        pooled, active = self.pooled(columns)
        logit = pooled @ self.p["out"] + self.p["bias"]
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        wrong = (e / e.sum(axis=1, keepdims=True) - target) / len(windows)
        back = (wrong @ self.p["out"].T) * (pooled > 0)
        where = active.argmax(axis=1)
        n, kinds = where.shape
        picked = columns[np.arange(n)[:, None], where]  # n x filters x inputs
        filters = np.einsum("nf,nfi->if", back, picked) * self.mask
        to_bytes = back[:, :, None] * self.p["filters"].T[None]
        wide = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, wide - 1)))
        ids = padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(wide)]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, ids.reshape(-1), to_bytes.reshape(n * kinds * wide, EMBEDDING))
        return {"embed": embed, "filters": filters, "shift": back.sum(axis=0), "out": pooled.T @ wrong, "bias": wrong.sum(axis=0)}

    def fit(self, windows: np.ndarray, classes: np.ndarray, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        target = np.eye(len(self.p["bias"]), dtype=np.float32)[classes]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self.gradients(windows[rows], target[rows]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (short ones padded), the text of each, and the bytes in each."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(sizes)), n)
    held = np.minimum(sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, WINDOW)
    flat = np.zeros(len(owner) * WINDOW, np.uint8)
    for at, a, b in zip((first * WINDOW).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[at : at + b - a] = data[a:b]
    return flat.reshape(-1, WINDOW), owner, held


def train(docs: DataFrame, where: Column | None = None) -> tuple[list[str], Network | None]:
    """Fits on docs (doc_id, text, lang) that are not held out and satisfy `where`; the languages in order, and the network."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & has_letter("text") & ~held_out("doc_id"))
    ids = told.select("doc_id", "lang").where(F.col("doc_id").isNotNull()).distinct().withColumn("hash", F.xxhash64("doc_id", "lang").bitwiseAND(F.lit((1 << 63) - 1)))
    # Counts by the hash's magnitude, 64 at most a language, tell which magnitudes hold a language's first; each has half of the
    # rows of the next, so that about twice the wanted rows are left to be numbered, however many there are.
    ids = stored(ids.withColumn("size", F.floor(F.log2(F.col("hash") + 1.0))), "labelled")
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("size"))
    sizes = ids.groupBy("lang", "size").agg(F.count("*").alias("n")).withColumn("before", up_to - F.col("n")).where(F.col("before") < MAX_PER_LANGUAGE)
    few = ids.join(sizes.select("lang", "size"), ["lang", "size"], "left_semi")
    ids = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))).where(F.col("n") <= MAX_PER_LANGUAGE).drop("hash", "size")
    # The more languages, the fewer documents of each; every language keeps one at least.
    each = ids.where("n = 1").agg(F.greatest(F.lit(1), F.floor(F.lit(MAX_PER_LANGUAGE * MAX_LANGUAGES) / F.greatest(F.lit(1), F.count("*")))).alias("each"))
    chosen = ids.crossJoin(F.broadcast(each)).where("n <= each").select(F.col("doc_id").alias("chosen"), F.col("lang").alias("chosen_lang"))
    # At most MAX_PER_LANGUAGE x MAX_LANGUAGES ids are broadcast, or one for each language.
    sample = told.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("chosen_lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            for row, _, data, offsets in chunks(batch.column("text"), CHUNK):
                windows, owner, _ = windows_of(data, offsets)
                first = np.searchsorted(owner, np.arange(len(offsets)))
                take = np.unique(np.concatenate([np.linspace(a, b - 1, min(WINDOWS_EACH, b - a)).astype(int) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]))
                yield pa.record_batch(
                    {
                        "doc_id": pa.array([ids[row + d] for d in owner[take]], pa.int64()),
                        "lang": pa.array([langs[row + d] for d in owner[take]], pa.string()),
                        "bytes": pa.array([windows[w].tobytes() for w in take], pa.binary()),
                    }
                )

    found = sample.select("doc_id", "lang", "text").mapInArrow(giving_back(cut), "doc_id long, lang string, bytes binary").distinct().toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("bytes", "ascending")])
    langs = np.array(found.column("lang").to_pylist(), dtype=object)
    names = sorted(set(langs.tolist()))
    if not names:
        return [], None
    network = Network(len(names))
    network.fit(np.frombuffer(b"".join(found.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW), np.searchsorted(names, langs))
    return names, network


def mean_probabilities(column: pa.Array, network: Network) -> np.ndarray:
    out = []
    for _, _, data, offsets in chunks(column, CHUNK):
        windows, owner, held = windows_of(data, offsets)
        weighted = network.probabilities(windows).astype(np.float64) * held[:, None]
        total = np.stack([np.bincount(owner, weighted[:, c], len(offsets) - 1) for c in range(weighted.shape[1])], axis=1)
        out.append(total / np.maximum(np.diff(offsets), 1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, 1))


def predict(docs: DataFrame, names: list[str], network: Network | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, lang_pred, score) of docs (doc_id, text); with `keep`, also text and kept, a struct of those columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter("text").alias("lettered"), *(F.struct(*keep).alias("kept") for _ in [0] if keep))
    kept = f", text string, kept {rows.schema['kept'].dataType.simpleString()}" if keep else ""
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column("text")
            known = np.asarray(batch.column("lettered")) & (sent.value is not None)
            p = mean_probabilities(told, sent.value) if sent.value is not None else np.zeros((len(told), 1))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            columns = {
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                "score": pa.array(np.where(known, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0)),
            }
            yield pa.record_batch(columns | ({"text": told, "kept": batch.column("kept")} if keep else {}))

    return rows.mapInArrow(giving_back(run), SCHEMA + kept)


def train_and_predict(docs: DataFrame) -> DataFrame:
    found = predict(docs, *train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
