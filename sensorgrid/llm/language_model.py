"""Interpolated modified Kneser-Ney language model, counted in Spark and scored from memory-mapped arrays.

Words. A first pass counts words by a 64-bit hash. Shards are ranges of the hash; each writes its sorted hashes and counts as array
files in the shared folder. Words are then numbered by falling class of their count, so that frequent words have small
numbers; a word's number follows from its shard's files and one table of offsets.

N-grams. A second pass counts n-grams of word numbers per block of text and sends one compressed row per block and shard; shards are
ranges of the n-gram's hash, so their sizes are even whatever the words are. A shard adds up counts, writes its sorted
hashes (their leading bits in a directory) and counts, and passes on to the next lower order (a) what each context needs: its total and its numbers of followers
seen once, twice, three times or more, and (b) one continuation per distinct n-gram. All orders are one job, so nothing is
written between them but the shuffles. Nothing but a few totals per shard comes to the driver. Sums that would not fit 32 bits
are kept in 64.

Scoring. Workers map the files (pages are shared and evictable) and look up sorted, distinct queries, once for each order.

Edge cases: a null text is empty and has the one end token; a null doc_id hashes as an empty string (a training row) and
is kept; repeated rows count as often as they occur and each get a row; without training rows every word is unknown and
scores are uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.files import mapped, write_array
from sensorgrid.llm.shared import checkpoint_dir
from sensorgrid.llm.words import SPACED, Words, chunks, lookup, mix

ORDER = 3
#: Text bytes for which there is one shard.
SHARD_BYTES = 16 << 20
#: Tokens that a counting task adds up before it sends them on; it bounds the task's memory.
BLOCK_TOKENS = 2 << 20
#: Classes of word counts, by every second power of two.
CLASSES = 16

_END = mix(np.array([103], np.uint64))[0]
#: Numbers of what stands before a text, and of words that were not learnt; learnt ones follow.
_START, _NEW, _FIRST = 0, 1, 2
_HEAD = struct.Struct("<QBB")
#: The count from which a row is written whole.
_LARGE = 255
BLOCKS = "level int, kind string, shard int, part string, data binary"
_ROW = pa.schema([("level", pa.int32()), ("kind", pa.string()), ("shard", pa.int32()), ("part", pa.string()), ("data", pa.binary())])
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 5."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end mark of each text, and where each text begins."""
    words = Words(data, offsets, SPACED)
    first = np.concatenate([[0], np.cumsum(np.diff(words.first) + 1)])
    out = np.full(first[-1], _END, dtype=np.uint64)
    out[np.arange(len(words)) + words.owner()] = words.hashes()
    return out, first


def _padded(ids: np.ndarray, first: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with `lead` start marks before each text, and the places of the tokens."""
    place = np.arange(len(ids)) + np.repeat(np.arange(1, len(first)), np.diff(first)) * lead
    out = np.full(len(ids) + lead * (len(first) - 1), _START, ids.dtype)
    out[place] = ids
    return out, place


def _leading(shards: int) -> int:
    """Bits of an n-gram's hash that a shard's directory holds: the more data, the more; 40 others are written."""
    return min(24, max(20, shards.bit_length() + 14))


def _joined(ids: np.ndarray, shards: int) -> np.ndarray:
    """Hash of the numbers in each row, in its leading bits: 60 with few shards, 64 from a thousand on."""
    total = mix(ids[:, 0].astype(np.uint64))
    for j in range(1, ids.shape[1]):
        total = mix(total + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) ^ ids[:, j].astype(np.uint64)
    return mix(total) >> np.uint64(24 - _leading(shards)) << np.uint64(24 - _leading(shards))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of one of each, and sums of the values, in 64 bits where 32 may not do."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = _firsts(keys)
    kinds = [np.uint32 if v.sum(dtype=np.uint64) < 1 << 32 else np.uint64 for v in values]
    return keys[starts], order[starts], [np.add.reduceat(v[order], starts, dtype=k) if len(starts) else v[:0] for v, k in zip(values, kinds, strict=True)]


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, each in as many bytes as its largest number takes, by significance of the bytes; compressed."""
    n, widths, parts = len(columns[0]), [], []
    for c in columns:
        widths.append(max(1, -(-int(c.max(initial=0)).bit_length() // 8)))
        parts.append(np.ascontiguousarray(c.astype("<u8" if widths[-1] > 4 else "<u4")).view(np.uint8).reshape(n, -1).T[: widths[-1]].tobytes())
    return _HEAD.pack(n, len(widths), 0) + bytes(widths) + _CODEC.compress(b"".join(parts), asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n, k, _ = _HEAD.unpack_from(data)
    widths = data[_HEAD.size : _HEAD.size + k]
    raw = np.frombuffer(pa.decompress(data[_HEAD.size + k :], decompressed_size=n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for w in widths:
        wide = np.zeros((n, 8 if w > 4 else 4), np.uint8)
        wide[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(wide.view(np.uint64 if w > 4 else np.uint32).reshape(n))
        at += n * w
    return out


_CODEC = pa.Codec("zstd", compression_level=3)


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of rising numbers; np.cumsum takes them back."""
    return np.diff(a, prepend=a.dtype.type(0))


def _bounds(shards: int) -> np.ndarray:
    """The least key of each shard but the first."""
    return np.array([(-(-(s << 32) // shards)) << 32 for s in range(1, shards)], np.uint64)


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted keys begins, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, _bounds(shards)), [len(keys)]])


def _rows(level: int, part: str, keys: np.ndarray, shards: int, packed: Callable[[slice], bytes]) -> pa.RecordBatch:
    """A row for each shard that has some of the sorted keys."""
    cuts = _cuts(keys, shards)
    some = np.flatnonzero(np.diff(cuts))
    told = [packed(slice(cuts[s], cuts[s + 1])) for s in some]
    return pa.record_batch([pa.array([level] * len(some), pa.int32()), pa.array(["gram"] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([part] * len(some), pa.string()), pa.array(told, pa.binary())], schema=_ROW)


def _order(rows: np.ndarray) -> np.ndarray:
    """An order of rows of numbers by as many of their leading bits as one key of 64 takes: by the first number whole, then by the next."""
    key, left = np.zeros(len(rows), np.uint64), 64
    for column in rows.T:
        column, bits = column.astype(np.uint64), max(1, int(column.max(initial=0)).bit_length())
        left -= bits
        key |= column << np.uint64(left) if left >= 0 else column >> np.uint64(-left)
        if left <= 0:
            break
    return np.argsort(key)


def _gram_rows(level: int, part: str, ids: np.ndarray, counts: list[np.ndarray], shards: int) -> pa.RecordBatch:
    keys, place, counts = _summed(_joined(ids, shards), *counts)
    ids = ids[place]

    def packed(mine: slice) -> bytes:
        rows = ids[mine]
        order = _order(rows)
        rows = rows[order]
        return _packed([_steps(rows[:, 0]), *rows.T[1:], *(c[mine][order] for c in counts)])

    return _rows(level, part, keys, shards, packed)


def _gathered(table: pa.Table, part: str, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of numbers, and columns of counts, of all a shard's blocks of a kind."""
    blocks = [_unpacked(d.as_py()) for p, d in zip(table.column("part"), table.column("data"), strict=True) if p.as_py() == part]
    if not blocks:
        return np.zeros((0, width), np.uint32), [np.zeros(0, np.uint32)] * 4
    for b in blocks:
        b[0] = np.cumsum(b[0], dtype=b[0].dtype if int(b[0].sum(dtype=np.uint64)) < 1 << 32 else np.uint64)
    columns = [np.concatenate(c) for c in zip(*blocks, strict=True)]
    return np.stack(columns[:width], axis=1), columns[width:]


def _blocked(flush: Callable[[list], Iterator[pa.RecordBatch]], read: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Hands BLOCK_TOKENS of what is read from the texts on at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                held.append(read(data, offsets))
                if sum(map(len, held)) >= BLOCK_TOKENS:
                    yield from flush(held)
                    held.clear()
        if held:
            yield from flush(held)

    return run


def _count_words(shards: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        yield _rows(0, "words", words, shards, lambda mine: _packed([_steps(words[mine]), counts[mine]]))

    return _blocked(flush, lambda data, offsets: _tokens(data, offsets)[0])


def _class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1] // 2, CLASSES - 1)


def _reduce_words(path: str):
    """Adds up and writes a shard's words; gives a row with their number, their sum and their number in each class."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = [_unpacked(d.as_py()) for d in table.column("data")]
        words, _, (counts,) = _summed(np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blocks]), np.concatenate([b[1] for b in blocks]))
        kind = _class(counts)
        order = np.argsort(kind, kind="stable")
        sizes = np.bincount(kind, minlength=CLASSES)
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        write_array(f"{path}/gram0-{shard}-keys.npy", words)
        _write_counts(f"{path}/gram0-{shard}", counts[:, None])
        write_array(f"{path}/gram0-{shard}-places.npy", place)
        return _totals(0, shard, np.array([len(words), counts.sum(dtype=np.int64), *sizes], np.int64))

    return run


def _totals(level: int, shard: int, told: np.ndarray) -> pa.Table:
    return pa.Table.from_batches([pa.record_batch([pa.array([level], pa.int32()), pa.array(["totals"]), pa.array([shard], pa.int32()), pa.array([""]), pa.array([told.tobytes()], pa.binary())], schema=_ROW)])


def _count_grams(vocabulary: Vocabulary, order: int, shards: int):
    def read(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, first = _tokens(data, offsets)
        ids, place = _padded(vocabulary.find(words)[1], first, order - 1)
        return np.stack([ids[place - j] for j in range(order - 1, -1, -1)], axis=1)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(held)
        yield _gram_rows(order, "seen", ids, [np.ones(len(ids), np.uint32)], shards)

    return _blocked(flush, read)


def _reduce(path: str, shards: int, order: int):
    """Adds up a shard's n-grams; writes them; gives what the next lower order needs, and a row of totals.

    Rows of the order itself are n-grams and counts; those of a lower order are n-grams and continuations ("seen"), or contexts with
    their totals and numbers of followers ("context").
    """

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == "totals":
            return table
        level, shard = (table.column(x)[0].as_py() for x in ("level", "shard"))
        ids, told = _gathered(table, "seen", level)
        keys, place, (seen,) = _summed(_joined(ids, shards), told[0])
        ids = ids[place]
        if level == order:
            _write_grams(f"{path}/gram{level}-{shard}", keys, seen[:, None], shard, shards)
        else:
            contexts, told = _gathered(table, "context", level)
            others, _, told = _summed(_joined(contexts, shards), *told)
            every = np.sort(np.concatenate([keys, others]))
            every = every[_firsts(every)]
            counts = np.zeros((len(every), 5), np.uint64 if any(c.dtype == np.uint64 for c in (seen, *told)) else np.uint32)
            counts[np.searchsorted(every, keys), 0] = seen
            place = np.searchsorted(every, others)
            for j, c in enumerate(told):
                counts[place, j + 1] = c
            _write_grams(f"{path}/gram{level}-{shard}", every, counts, shard, shards)
            del contexts, others, every, counts
        out = [_totals(level, shard, np.array([*((seen == k).sum() for k in (1, 2, 3, 4)), len(seen), seen.sum(dtype=np.int64)], np.int64))]
        if level > 1 and len(ids):
            followers = [seen, *(x.astype(np.uint32) for x in (seen == 1, seen == 2, seen >= 3))]
            out.append(pa.Table.from_batches([_gram_rows(level - 1, "context", ids[:, :-1], followers, shards)]))
            out.append(pa.Table.from_batches([_gram_rows(level - 1, "seen", ids[:, 1:], [np.ones(len(ids), np.uint32)], shards)]))
        return pa.concat_tables(out)

    return run


def _any(told: np.ndarray) -> np.ndarray:
    """Which rows have a true column; there are few columns."""
    return np.logical_or.reduce(list(told.T))


def _write_counts(name: str, counts: np.ndarray) -> None:
    """Counts take a byte each; rows with one of _LARGE or more are written whole, after their places."""
    large = np.flatnonzero(_any(counts >= _LARGE))
    write_array(f"{name}-counts.npy", np.minimum(counts, _LARGE).astype(np.uint8))
    write_array(f"{name}-large.npy", np.concatenate([large[:, None], counts[large].astype(np.int64)], axis=1))


def _counts(name: str, at: np.ndarray) -> np.ndarray:
    """Rows of counts at sorted places."""
    found = mapped(f"{name}-counts.npy")[at]
    beyond = np.flatnonzero(_any(found == _LARGE))
    found = found.astype(np.int64)
    if len(beyond):
        large = mapped(f"{name}-large.npy")
        found[beyond] = large[np.searchsorted(large[:, 0], at[beyond]), 1:]
    return found


def _prefixes(shard: int, shards: int) -> np.ndarray:
    """The leading bits that keys of a shard can have, and one value more."""
    least, below = (-(-(s << 32) // shards) << 32 for s in (shard, shard + 1))
    down = 64 - _leading(shards)
    return np.arange(least >> down, ((below - 1) >> down) + 2, dtype=np.uint64)


def _write_grams(name: str, keys: np.ndarray, counts: np.ndarray, shard: int, shards: int) -> None:
    """Sorted hashes without their leading bits, 5 bytes each, a directory of where each value of those begins, and counts."""
    leading = _leading(shards)
    rest = keys >> np.uint64(24 - leading)
    write_array(f"{name}-starts.npy", np.searchsorted(keys >> np.uint64(64 - leading), _prefixes(shard, shards)).astype(np.uint32 if len(keys) < 1 << 32 else np.uint64))
    write_array(f"{name}-high.npy", (rest >> np.uint64(8)).astype(np.uint32))
    write_array(f"{name}-low.npy", rest.astype(np.uint8))
    _write_counts(name, counts)


def _found(name: str, keys: np.ndarray, shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of some sorted keys a shard has, and their counts: a search by halves for all keys at once, each within its directory entry."""
    leading = _leading(shards)
    starts, high, low = (mapped(f"{name}-{x}.npy") for x in ("starts", "high", "low"))
    entry = ((keys >> np.uint64(64 - leading)) - _prefixes(shard, shards)[0]).astype(np.int64)
    at, end = starts[entry].astype(np.int64), starts[entry + 1].astype(np.int64)
    wanted = keys >> np.uint64(24 - leading) & np.uint64((1 << 40) - 1)
    open_ = np.flatnonzero(at < end)
    ok = np.zeros(len(keys), bool)
    while len(open_):
        middle = (at[open_] + end[open_]) >> 1
        value = high[middle].astype(np.uint64) << np.uint64(8) | low[middle]
        same = value == wanted[open_]
        ok[open_[same]], at[open_[same]] = True, middle[same]
        right = value < wanted[open_]
        at[open_[right]] = middle[right] + 1
        left = ~(same | right)
        end[open_[left]] = middle[left]
        open_ = open_[~same]
        open_ = open_[at[open_] < end[open_]]
    ok = np.flatnonzero(ok)
    return ok, _counts(name, at[ok])


class Vocabulary:
    """Where the words' arrays are. Small enough to be sent with a task, but for one number in each shard that says if it has any."""

    def __init__(self, path: str, shards: int, present: np.ndarray, size: int):
        self.path, self.shards, self.present, self.size = path, shards, present, size

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of words by their hashes."""
        distinct, back = np.unique(words, return_inverse=True)
        cuts = _cuts(distinct, self.shards)
        counts, ids = np.zeros(len(distinct), np.int64), np.full(len(distinct), _NEW, np.uint64 if self.size >= (1 << 32) - _FIRST else np.uint32)
        offsets = mapped(f"{self.path}/offsets.npy")
        for s in np.flatnonzero((np.diff(cuts) > 0) & self.present):
            name = f"{self.path}/gram0-{s}"
            at, known = lookup(mapped(f"{name}-keys.npy"), distinct[cuts[s] : cuts[s + 1]])
            ok, at = cuts[s] + np.flatnonzero(known), at[known]
            counts[ok] = _counts(name, at)[:, 0]
            ids[ok] = offsets[s, _class(counts[ok])] + mapped(f"{name}-places.npy")[at]
        return counts[back], ids[back]


class Model:
    """The vocabulary, where the n-grams' arrays are, and the few numbers that belong to the whole model."""

    def __init__(self, vocabulary: Vocabulary, tokens: int, order: int, present: dict[int, np.ndarray], totals: dict[int, np.ndarray]):
        self.words, self.tokens, self.order, self.present = vocabulary, tokens, order, present
        none = np.zeros(6, np.int64)
        self.discounts, self.continuations = {}, totals.get(1, none)
        for level in range(1, order + 1):
            n1, n2, n3, n4 = (max(int(x), 1) for x in totals.get(level, none)[:4])
            y = n1 / (n1 + 2 * n2)
            self.discounts[level] = np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])

    def _find(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of counts of the distinct keys (0 where there are none), and each key's row."""
        distinct, back = np.unique(keys, return_inverse=True)
        cuts = _cuts(distinct, self.words.shards)
        out = np.zeros((len(distinct), 1 if level == self.order else 5), np.int64)
        for s in np.flatnonzero((np.diff(cuts) > 0) & self.present[level]):
            ok, counts = _found(f"{self.words.path}/gram{level}-{s}", distinct[cuts[s] : cuts[s + 1]], int(s), self.words.shards)
            out[cuts[s] + ok] = counts
        return out, back

    def probabilities(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each token, given the ones before it. An n-gram's context is the shorter n-gram that ends one token before."""
        n1, n2, _, _, types, total = (int(x) for x in self.continuations)
        p = np.full(len(place), 1.0 / (self.words.size + 1))
        for level in range(1, self.order + 1):
            grams = np.stack([np.roll(ids, j) for j in range(level - 1, -1, -1)], axis=1)
            rows, back = self._find(level, _joined(grams, self.words.shards))
            c, d = rows[:, 0], self.discounts[level]
            discounted = np.maximum(c - d[np.minimum(c, 3)], 0)[back[place]]
            if level == 1:
                if total:
                    p = discounted / total + (d[1] * n1 + d[2] * n2 + d[3] * (types - n1 - n2)) / total * p
            else:
                p = np.where(seen > 0, discounted / np.maximum(seen, 1) + freed * p, p)
            if level < self.order:  # of each token's context at the next level: its total, and the share that discounts free
                d, at = self.discounts[level + 1], back[place - 1]
                seen, freed = rows[:, 1][at], ((rows[:, 2] * d[1] + rows[:, 3] * d[2] + rows[:, 4] * d[3]) / np.maximum(rows[:, 1], 1))[at]
        return p

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """For each text: tokens, tokens known, base score and score (log10)."""
        out = []
        for _, _, data, offsets in chunks(column):
            words, first = _tokens(data, offsets)
            c, ids = self.words.find(words)
            base = np.log10((c + 0.5) / (self.tokens + 0.5 * (self.words.size + 1)))
            full = np.log10(self.probabilities(*_padded(ids, first, self.order - 1)))
            out.append([np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in ((c > 0).astype(np.int64), base, full))])
        names = ("n_tokens", "n_known", "base_score", "score")
        return {k: np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i, k in enumerate(names)}


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Fits the model to docs (text)."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/language-model-{uuid.uuid4().hex}"
    docs = docs.select("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def by_shard(rows: DataFrame, reduce) -> DataFrame:
        # As many tasks as shards, whose size SHARD_BYTES bounds.
        return rows.repartition(shards, "kind", "shard").groupBy("kind", "shard").applyInArrow(reduce, BLOCKS)

    present, totals = {}, {}

    def noted(rows: DataFrame) -> dict[int, np.ndarray]:
        """Adds up the totals of each level; the last, level 0's, by shard. One small row per level and shard."""
        by_row = {}
        for r in rows.collect():
            told = np.frombuffer(r["data"], np.int64)
            present.setdefault(r.level, np.zeros(shards, bool))[r.shard] = True
            totals[r.level] = totals.get(r.level, 0) + told
            by_row[r.shard] = told
        return by_row

    sizes = np.zeros((shards, CLASSES), np.int64)
    for shard, told in noted(by_shard(docs.mapInArrow(_count_words(shards), BLOCKS), _reduce_words(path))).items():
        sizes[shard] = told[2:]
    falling = sizes[:, ::-1].T.reshape(-1)  # frequent classes first, and in each the shards in order
    write_array(f"{path}/offsets.npy", (np.cumsum(falling) - falling + _FIRST).reshape(CLASSES, shards).T[:, ::-1].copy())
    n_words, tokens = (int(x) for x in totals[0][:2]) if 0 in totals else (0, 0)
    vocabulary = Vocabulary(path, shards, present.get(0, np.zeros(shards, bool)), n_words)

    found = docs.mapInArrow(_count_grams(vocabulary, order, shards), BLOCKS)
    for _ in range(order):
        found = by_shard(found, _reduce(path, shards, order))
    noted(found)
    return Model(vocabulary, tokens, order, {k: present.get(k, np.zeros(shards, bool)) for k in range(1, order + 1)}, totals)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = model.score(batch.column("text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{k: pa.array(v) for k, v in told.items()}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the rows that are not held out and scores all rows."""
    model = train(docs.where(~held_out("doc_id")), order)
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
