"""Similarity join of documents on their sets of word n-grams, by MinHash banding with exact verification.

1. Sketch: each text gives the set of hashes of its 5-word shingles, a 128-bit fingerprint of the whole set, and band
   hashes of a MinHash signature. Bands and rows follow from the wished recall at the threshold.
2. Documents with equal sets form a class at once; only one document of a class goes on.
3. Band hashes are shuffled. A bucket is the classes with one band hash; buckets of the same classes are verified once.
   What meets in a bucket is a candidate, and nothing else is.
4. A bucket is one tile, or blocks of bounded numbers of classes and shingles and a tile for each two blocks. The full sets are
   dealt to the tiles. A tile counts all its intersections in a matrix product, leaves pairs that share an earlier
   band to that band's tile, so that each pair counts once, and passes on, for each class, the number of documents that it links
   to and the least class that the tile connects it with. In a bucket of many blocks the classes of a block agree on which of
   the bucket's commonest hashes of earlier bands they have; two blocks that agree on having one have been compared before and
   make no tile.
5. Components of what was verified are the result's classes.

The result has a row per document: its class and the number of documents with a similarity of at least the threshold.
A huge group of near copies is split over many tiles; its work is quadratic, as its links are, but its rows are not. Texts that
are only chained to one another by different buckets are never compared.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A text of fewer words than a shingle
is one shingle; a text without words has its whole text as its only shingle, so that only equal texts link.

Edge cases: a null text is an empty one; a null doc_id is kept, and is no class's id unless all its documents have none;
repeated rows count as documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.components import components
from sensorgrid.llm.shared import stored
from sensorgrid.llm.words import ALNUM, Words, chunks, giving_back, grams, mix

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: Hash functions of a signature: the more, the more rows a band may have and the fewer false candidates there are.
MAX_HASHES = 160
#: Classes on a side of a tile, and shingles, unless one text has more.
BLOCK = 2048
BLOCK_SHINGLES = 2 << 20
#: Earlier bands by which a large bucket's classes are told apart.
EARLIER = 6
#: Bits of the map of wanted texts, which is sent to all tasks: 16 MiB.
WANTED_BITS = 1 << 27
#: Columns of a tile's matrix that are multiplied at once.
_SLAB = 2048


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows a band can have so that, within `most` hashes, pairs at the threshold meet with probability `recall`."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, end to end and in order within a text, and where each text begins."""
    words = Words(data, offsets, ALNUM)
    hashes = words.hashes()
    value, at = grams(hashes, words.first, n)
    owner = np.searchsorted(words.first, at, side="right") - 1
    values, owners = [value], [owner]
    counts = np.diff(words.first)
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            value, at = grams(hashes, words.first, k)
            values.append(value[np.searchsorted(at, words.first[few])])
            owners.append(few)
    none = np.flatnonzero(counts == 0)
    if len(none):
        raw = [data[offsets[d] : offsets[d + 1]].astype(np.uint64) for d in none]
        values.append(np.array([mix((mix(r + np.uint64(7)) * (np.arange(len(r), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(keepdims=True) + np.uint64(len(r)))[0] for r in raw], np.uint64))
        owners.append(none)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def signatures(sets: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, a row per text. Every text has at least one shingle."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    out = np.zeros((len(first) - 1, bands), np.uint64)
    for b in range(bands):
        told = np.full(len(first) - 1, np.uint64(b + 1))
        for r in range(rows):
            i = 2 * (b * rows + r)
            least = np.minimum.reduceat((sets * (seeds[i] | np.uint64(1)) + seeds[i + 1]) >> np.uint64(20), first[:-1])
            told = mix(told ^ least) + np.uint64(r)
        out[:, b] = told
    return out


def _sketch(n: int, bands: int, rows: int, threshold: float):
    fewest = math.floor(threshold / (1 - threshold) + 1e-9)  # smaller sets are too small to link to a different one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                sets, first = shingle_sets(data, offsets, n)
                sizes = np.diff(first)
                prints = [np.add.reduceat(mix(sets ^ np.uint64(x)), first[:-1]).view(np.int64) for x in (0x1234567, 0x89ABCDEF)]
                hashes = signatures(sets, first, bands, rows).view(np.int64)
                kept = np.where(sizes >= fewest, bands, 0)
                flat = hashes[np.repeat(kept > 0, bands).reshape(-1, bands)]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(row, end - row),
                        "text_hash": batch.column("text_hash").slice(row, end - row),
                        "f1": pa.array(prints[0]),
                        "f2": pa.array(prints[1]),
                        "size": pa.array(sizes.astype(np.int64)),
                        "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(flat)),
                    }
                )

    return run


def _sets(n: int, wanted: np.ndarray):
    """The sets of those texts whose hash is marked in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("text_hash")).astype(np.int64) & (WANTED_BITS - 1)
            batch = batch.take(pa.array(np.flatnonzero(wanted.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)))
            for row, end, data, offsets in chunks(batch.column("text")):
                sets, first = shingle_sets(data, offsets, n)
                raw = [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                kept = batch.slice(row, end - row).drop_columns(["text"])
                yield pa.record_batch([*kept.columns, pa.array(raw, pa.binary())], [*kept.schema.names, "shingles"])

    return run


def _marked(wanted: DataFrame) -> np.ndarray:
    """A map of WANTED_BITS bits with those of wanted (text_hash) set: a few thousand rows of 4 KiB at most come to the driver."""
    place = F.col("text_hash").bitwiseAND(F.lit(WANTED_BITS - 1)) + 1
    rows = wanted.select(F.bitmap_bucket_number(place).alias("at"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(WANTED_BITS >> 3, np.uint8)
    for r in rows.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


class Tile:
    """Classes of one or two blocks of the bucket of a band; rows are node, copies, band hashes, shingles."""

    def __init__(self, band: int, mirrored: bool):
        self.band, self.mirrored = band, mirrored
        self.rows: tuple[list[tuple], ...] = ([], [])

    def result(self, threshold: float) -> list[tuple[int, int, int]]:
        """(node, documents that it links to, least node that it is connected with)."""
        left = self.rows[0]
        right = left if self.mirrored else self.rows[1]
        linked = _linked([r[3] for r in left], [r[3] for r in right], self.mirrored, threshold)
        if not linked.any():
            return []
        for k in range(self.band):
            a, b = (np.array([r[2][k] for r in side], np.int64) for side in (left, right))
            linked &= a[:, None] != b
        ids = [np.array([r[0] for r in side], np.int64) for side in (left, right)]
        copies = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
        to_right = np.concatenate([linked[at] @ copies[1] for at in _slices(len(left))])
        # The least node over links, spread until nothing changes.
        most = np.iinfo(np.int64).max
        roots = [ids[0].copy(), ids[1].copy()]
        while True:
            over, back = roots[0].copy(), roots[1]
            for at in _slices(len(left)):
                over[at] = np.minimum(over[at], np.where(linked[at], roots[1][None, :], most).min(axis=1))
            back = over if self.mirrored else back
            for at in _slices(len(left)):
                back = np.minimum(back, np.where(linked[at], over[at, None], most).min(axis=0))
            if (over == roots[0]).all() and (back == roots[1]).all():
                break
            roots = [back, back] if self.mirrored else [over, back]
        found = list(zip(ids[0].tolist(), to_right.tolist(), roots[0].tolist(), strict=True))
        if not self.mirrored:
            found += zip(ids[1].tolist(), sum(copies[0][at] @ linked[at] for at in _slices(len(left))).tolist(), roots[1].tolist(), strict=True)
        return [x for x in found if x[1]]


def _slices(n: int) -> list[slice]:
    """Parts of a matrix's rows, so that what is computed of a large tile is small beside it."""
    return [slice(at, at + 128) for at in range(0, n, 128)]


def _linked(left: list[np.ndarray], right: list[np.ndarray], mirrored: bool, threshold: float) -> np.ndarray:
    """Boolean matrix: which sets are similar enough; none to itself if both sides are the same."""
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    if not left or not right:
        return np.zeros((len(left), len(right)), bool)
    if mirrored and len(left) == 2:
        both = len(np.intersect1d(*left, assume_unique=True))
        return np.array([[0, 1], [1, 0]], bool) & bool(both >= threshold * (len(left[0]) + len(left[1]) - both) - 1e-9)
    every = left if mirrored else left + right
    value = np.concatenate(every)
    owner = np.repeat(np.arange(len(every), dtype=np.int32), [len(s) for s in every])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    del order
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    del value
    shared = ~new  # a value that occurs once is in no intersection
    shared[:-1] |= ~new[1:]
    owner, column = owner[shared], np.cumsum(new[shared], dtype=np.int64) - 1
    del new, shared
    both = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, _SLAB):
        a, b = np.searchsorted(column, [at, at + _SLAB])
        slab = np.zeros((len(every), min(_SLAB, total - at)), np.float32)
        slab[owner[a:b], column[a:b] - at] = 1
        both += slab[: len(left)] @ (slab if mirrored else slab[len(left) :]).T
    linked = np.empty(both.shape, bool)
    for at in _slices(len(left)):
        met = both[at].astype(np.float64)
        linked[at] = met >= threshold * (sizes[0][at, None] + sizes[1][None, :] - met) - 1e-9
    if mirrored:
        np.fill_diagonal(linked, False)
    return linked


def _verify(threshold: float):
    """Rows come by tile; one tile is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])

        now, tile, held = None, None, []
        for batch in batches:
            names = ("band", "b", "i", "j", "side", "node", "copies", "bands", "shingles")
            for band, b, i, j, side, node, copies, bands, shingles in zip(*(batch.column(c) for c in names), strict=True):
                key = band.as_py(), i.as_py(), j.as_py()
                if key != now:
                    if tile is not None:
                        held += tile.result(threshold)
                    now, tile = key, Tile(b.as_py(), i == j)
                    if len(held) > 10_000:
                        yield told(held)
                        held = []
                tile.rows[side.as_py()].append((node.as_py(), copies.as_py(), bands.values.to_numpy(), np.frombuffer(shingles.as_py(), np.uint64)))
        if tile is not None:
            held += tile.result(threshold)
        yield told(held)

    return run


def _dealt(classes: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Rows (node, band, b, i, j, side): the tiles to which each class goes; a tile is two blocks of the bucket of a band hash."""
    members = classes.select("node", "size", "bands", F.posexplode("bands").alias("b", "band"))
    alike = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"alike{k}") for k in (1, 2)]
    buckets = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("b").alias("b"), *alike).where("n > 1")
    # Of buckets with the same classes the one of the first band stays.
    buckets = buckets.groupBy("n", "shingles", "alike1", "alike2").agg(F.min(F.struct("b", "band")).alias("kept")).select("n", "shingles", "kept.band")
    buckets = stored(buckets, "buckets")
    large = (F.col("n") > block) | (F.col("shingles") > block_shingles)
    none = F.lit(0).cast("long")
    small = members.join(buckets.where(~large).select("band"), "band").select("node", "band", "b", none.alias("i"), none.alias("j"), F.lit(0).alias("side"))

    split = stored(members.join(buckets.where(large).select("band"), "band"), "large")
    earlier = split.select("band", F.posexplode(F.slice("bands", 1, F.least("b", F.lit(EARLIER)))).alias("at", "value"))
    votes = earlier.groupBy("band", "at", "value").agg(F.count("*").alias("n"))
    common = votes.groupBy("band", "at").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
    common = common.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("common"))  # EARLIER entries at most
    bits = (F.when(F.get("bands", F.lit(k)) == F.try_element_at("common", F.lit(k)), F.lit(1 << k)).otherwise(0) for k in range(EARLIER))
    masked = stored(split.join(common, "band", "left").select("node", "size", "band", "b", sum(map(lambda x: F.coalesce(x, F.lit(0)), bits), F.lit(0)).alias("mask")), "masked")
    parts = masked.groupBy("band", "mask").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_shingles)).alias("blocks"))
    told = parts.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("mask", "blocks"))).alias("parts"))  # 2 ** EARLIER entries at most
    own = F.shiftleft(F.col("mask").cast("long"), 32) + F.pmod(F.xxhash64(F.lit(5), "node"), F.element_at("parts", F.col("mask")))
    apart = F.filter(F.map_entries("parts"), lambda p: p["key"].bitwiseAND(F.col("mask")) == 0)
    others = F.flatten(F.transform(apart, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), p["value"] - 1), lambda k: F.shiftleft(p["key"].cast("long"), 32) + k)))
    placed = masked.join(told, "band").withColumn("own", own).withColumn("other", F.explode(others))
    tiles = placed.select("node", "band", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return small.union(tiles)


def join_similar(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (doc_id, text_hash, class_key, class_id, n_links, n_copies), one for each row of docs (doc_id, text). class_key
    names the class, class_id is the least id in it (null if it has none)."""
    bands, rows = bands_and_rows(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = stored(docs.mapInArrow(giving_back(_sketch(n, bands, rows, threshold)), "doc_id long, text_hash long, f1 long, f2 long, size long, bands array<long>"), "sketch")
    classes = sketch.groupBy("f1", "f2").agg(
        F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("told"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")
    )
    # A class is named by its row, so that no two have one name; the rows are written once.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    tiles = stored(_dealt(classes, block, block_shingles), "tiles")
    wanted = tiles.select("node").distinct().join(classes.select("node", F.col("n_copies").alias("copies"), "bands", F.col("told.doc_id").alias("told_id"), F.col("told.text_hash").alias("told_hash")), "node")
    wanted = stored(wanted, "wanted")
    sent = docs.sparkSession.sparkContext.broadcast(_marked(wanted.select(F.col("told_hash").alias("text_hash"))))
    sets = docs.mapInArrow(giving_back(_sets(n, sent)), "doc_id long, text_hash long, shingles binary").dropDuplicates(["doc_id", "text_hash"])
    fetched = sets.join(wanted, sets.doc_id.eqNullSafe(wanted.told_id) & (sets.text_hash == wanted.told_hash)).select("node", "copies", "bands", "shingles")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.join(fetched, "node").repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    verified = stored(dealt.select("band", "b", "i", "j", "side", "node", "copies", "bands", "shingles").mapInArrow(giving_back(_verify(threshold)), "node long, links long, root long"), "verified")

    found = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "f1", "f2", "n_copies", "first_id").join(links, "node", "left").join(found, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    told = known.join(least, "root").select("f1", "f2", F.col("root").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), "n_copies")
    return sketch.select("doc_id", "text_hash", "f1", "f2").join(told, ["f1", "f2"]).select("doc_id", "text_hash", "class_key", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without all but one of each class: the one with the least id (null last), then
    the least hash of the text; of repeated rows one."""
    found = join_similar(docs, **options)
    least = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")).alias("kept")).select("kept.*")
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *key)
    return keyed.join(least, ["none", "id", "text_hash"], "left_semi").dropDuplicates(["none", "id", "text_hash"]).select("row.*")
