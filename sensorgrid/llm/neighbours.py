"""Nearest neighbours by a block matrix join.

Vectors are scaled to unit length and rounded to int8 with a scale of their own; the length of what rounding took away is
kept. For a block of queries and a block of candidates one matrix product of the int8 values gives every cosine to within
a bound that follows from those lengths. Pairs whose upper bound does not reach the k-th best lower bound (or the k-th
best cosine met so far) are out; the others are computed in double precision from the original vectors and merged into a
heap per query. As the bounds are strict, the result is exact: recall is 1.

Blocks are dealt to tiles of a grid (groups of queries x slices of candidates), so each task holds one group of queries
and streams its slice; the data moved are each block once per row or column of the grid. The best k of each slice are
merged at the end.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null id; vectors are compared with those of their own length only; repeated rows are candidates of their own, and each
repeated query row has its own result (rows are told apart by position, not by id); ties go to the smaller id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 5
#: Rows of a candidate block, of a query group and of a candidate slice; slices grow beyond MAX_SLICES.
BLOCK_ROWS = 1024
GROUP_ROWS = 2048
SLICE_ROWS = 8192
MAX_SLICES = 1024

BLOCKS = "dim int, query boolean, seat int, ids binary, places binary, vectors binary"
FOUND = "query_id long, place long, vec_id long, other long, score double"
#: Products of two int8 values whose sum float32 holds exactly.
_EXACT_DIM = (1 << 24) // (127 * 127)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise products, summed in the order of the components, so that equal vectors give equal sums anywhere."""
    total = x[:, 0] * y[:, 0]
    for j in range(1, x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


class Quantised:
    """Unit vectors as int8 values and scales, with the length of each rounding error."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors.astype(np.float64)
        peak = np.abs(self.exact).max(axis=1, keepdims=True)
        self.norms = lengths(self.exact)
        tame = self.exact / peak  # squares of what is left can neither overflow nor vanish
        unit = tame / np.sqrt((tame * tame).sum(axis=1, keepdims=True))
        scale = np.abs(unit).max(axis=1, keepdims=True) / 127
        values = np.rint(unit / scale)
        self.values = values.astype(np.float32 if vectors.shape[1] <= _EXACT_DIM else np.float64)
        self.scale = scale[:, 0]
        self.error = np.sqrt(((unit - values * scale) ** 2).sum(axis=1)) + 1e-12


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all cosines of two blocks."""
    near = (q.values @ c.values.T) * q.scale[:, None] * c.scale[None, :]
    slack = (1 + q.error)[:, None] * c.error[None, :] + q.error[:, None]
    return near - slack, near + slack


class Search:
    """A group of queries with a heap of the k best for each."""

    def __init__(self, k: int, ids: np.ndarray, places: np.ndarray, vectors: np.ndarray):
        self.k, self.ids, self.places, self.q = k, ids, places, Quantised(vectors)
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.row_of = {int(p): i for i, p in enumerate(places)}

    def add(self, ids: np.ndarray, places: np.ndarray, vectors: np.ndarray) -> None:
        c = Quantised(vectors)
        low, high = bounds(self.q, c)
        for j, p in enumerate(places.tolist()):  # a query is no candidate of its own
            i = self.row_of.get(p)
            if i is not None:
                low[i, j] = high[i, j] = -np.inf
        least = self.least
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        i, j = np.nonzero((high >= least[:, None]) & (high > -np.inf))
        scores = dots(self.q.exact[i], c.exact[j]) / (self.q.norms[i] * c.norms[j])
        for a, b, s in zip(i.tolist(), j.tolist(), scores.tolist(), strict=True):
            entry, heap = (s, -int(ids[b]), -int(places[b])), self.heaps[a]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for a in np.unique(i).tolist():
            if len(self.heaps[a]) == self.k:
                self.least[a] = self.heaps[a][0][0] - 1e-9  # of equal scores the smaller id may still come

    def result(self) -> pa.RecordBatch:
        rows = [(int(self.ids[a]), int(self.places[a]), -v, -p, s) for a, heap in enumerate(self.heaps) for s, v, p in heap]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "place", "vec_id", "other", "score"])


def _pack(dtype: str, every: int):
    """Turns rows into blocks: each vector as a candidate, those whose id is a multiple of `every` as queries too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat = 0
        for batch in batches:
            vectors = batch.column("vector")
            ids, places = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("vec_id", "place"))
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                values = flat[starts[rows][:, None] + np.arange(dim)]
                wide = values.astype(np.float64)
                ok = np.isfinite(wide).all(axis=1) & (wide != 0).any(axis=1)
                ok &= lengths(np.where(ok[:, None], wide, 1)) > 0
                rows, values = rows[ok], values[ok]
                asked = ids[rows] % every == 0
                for query, chosen, step in ((False, np.arange(len(rows)), BLOCK_ROWS), (True, np.flatnonzero(asked), GROUP_ROWS)):
                    for at in range(0, len(chosen), step):
                        part = chosen[at : at + step]
                        yield pa.record_batch(
                            {
                                "dim": pa.array([dim], pa.int32()),
                                "query": pa.array([query]),
                                "seat": pa.array([seat], pa.int32()),
                                "ids": pa.array([ids[rows[part]].tobytes()], pa.binary()),
                                "places": pa.array([places[rows[part]].tobytes()], pa.binary()),
                                "vectors": pa.array([values[part].tobytes()], pa.binary()),
                            }
                        )
                        seat += 1

    return run


def _search(dtype: str, k: int):
    """Rows come by tile, its queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, search = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column("tile")[i].as_py()
                if now != tile:
                    if search is not None:
                        yield search.result()
                    tile, parts, search = now, [], None
                dim = batch.column("dim")[i].as_py()
                ids, places = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "places"))
                block = ids, places, np.frombuffer(batch.column("vectors")[i].as_buffer(), dtype).reshape(-1, dim)
                if batch.column("query")[i].as_py():
                    parts.append(block)
                elif parts or search is not None:
                    if search is None:
                        search, parts = Search(k, *(np.concatenate(x) for x in zip(*parts, strict=True))), []
                    search.add(*block)
        if search is not None:
            yield search.result()

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows, by cosine, of each row whose id is a multiple of `every`."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_column].dataType
    dtype = "float32" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "float64"
    element = "float" if dtype == "float32" else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{element}>").alias("vector"))
    rows = rows.where("vec_id is not null and size(vector) > 0 and not exists(vector, x -> x is null)")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    groups = max(1, -(-n_queries // GROUP_ROWS))
    slices = min(MAX_SLICES, max(1, -(-n // SLICE_ROWS)))
    blocks = rows.withColumn("place", F.monotonically_increasing_id()).mapInArrow(_pack(dtype, every), BLOCKS)
    own = F.hash("seat", F.spark_partition_id())
    dealt = (
        blocks.withColumn("own", own)
        .withColumn("group", F.explode(F.when(F.col("query"), F.array(F.pmod("own", F.lit(groups)))).otherwise(F.sequence(F.lit(0), F.lit(groups - 1)))))
        .withColumn("slice", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.pmod("own", F.lit(slices))))))
        .withColumn("tile", F.concat_ws("/", "dim", "group", "slice"))
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups * slices, 8 * spark.sparkContext.defaultParallelism))
    found = (
        dealt.select("tile", "dim", "query", "ids", "places", "vectors")
        .repartition(tasks, "tile")
        .sortWithinPartitions("tile", F.desc("query"))
        .mapInArrow(_search(dtype, k), FOUND)
    )
    # A query has k rows from each of at most MAX_SLICES slices.
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, every: int = 50) -> str:
    """The same search as SQL over all pairs, for small tables."""
    dot = "list_reduce(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]), lambda a, b: a + b)".format
    return f"""
with v as (select row_number() over () as place, vec_id, cast(embedding as double[]) as e from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, sqrt({dot('e', 'e')}) as norm from v),
p as (
  select q.vec_id as query_id, q.place, c.vec_id, c.place as other, {dot('q.e', 'c.e')} / (q.norm * c.norm) as score
  from n q join n c on q.place <> c.place and len(q.e) = len(c.e) where q.vec_id % {every} = 0 and q.norm > 0 and c.norm > 0)
select query_id, cast(r as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id, place order by score desc, vec_id, other) as r from p) where r <= {k}
"""
