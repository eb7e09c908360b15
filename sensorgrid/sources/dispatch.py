"""Opening and saving datasets of captures by URI."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.plans import manifest
from sensorgrid.query import RangeQuery
from sensorgrid.schema import CAPTURE
from sensorgrid.sources import block
from sensorgrid.sources.block import CapturesBlock
from sensorgrid.sources.hdf5 import SUFFIX as HDF5, CapturesHdf5

CAPTURE_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CAPTURE)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapturesBlock)
    spark.dataSource.register(CapturesHdf5)


def names_in(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder of any store of Spark's; none if it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []


def _kind(names: list[str]) -> str | None:
    low = [n.lower() for n in names]
    if manifest.DATA in low:
        return "parquet"
    return next((found for suffix, found in ((HDF5, "hdf5"), (block.SUFFIX, "block")) if any(n.endswith(suffix) for n in low)), None)


def format_of(spark: SparkSession, uri: str) -> str:
    """hdf5, block or parquet, from the names in the folder; other folders raise an error."""
    found = _kind(names_in(spark, uri))
    if found is None:
        raise ValueError(f"{uri} holds no captures")
    return found


def open_captures(spark: SparkSession, uri: str, query: RangeQuery | None = None, use_manifest: bool = True, numeric_unit: str = "ms") -> DataFrame:
    """The captures of a folder, or those of a query. HDF5 folders are local; block files may be in any store of Spark's."""
    uri = uri.rstrip("/")
    found = format_of(spark, uri)
    if found == "parquet":
        return manifest.read(spark, uri, query, use_manifest)
    if found == "hdf5":
        register(spark)
        rows = spark.read.format("captures_hdf5").option("numericUnit", numeric_unit).load(uri)
    else:
        rows = read_blocks(spark, uri, block_files(spark, uri, query) if query and use_manifest else None)
    return query.apply(rows) if query else rows


def block_files(spark: SparkSession, uri: str, query: RangeQuery) -> list[str] | None:
    """The block files that can hold rows of a query, by the manifest that their writer left: all but those whose zones do not meet
    it, so that a file without an entry is read. None where the predicate alone is to prune."""
    names = names_in(spark, uri)
    if manifest.ZONES not in names:
        return None
    apart = manifest.manifest(spark, uri).where(~query.zone_predicate()).select("file")  # at most as many rows as there are names
    skipped = {r.file for r in apart.collect()}
    kept = [f"{uri}/{n}" for n in names if n.lower().endswith(block.SUFFIX) and n not in skipped]
    return kept if skipped and len(kept) <= manifest.MAX_FILES else None


def read_blocks(spark: SparkSession, uri: str, files: list[str] | None = None) -> DataFrame:
    """Block files (all of a folder, or those named) through Spark's own file access, one whole block at a time."""
    if files is not None and not files:
        return spark.createDataFrame([], CAPTURE)
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", f"*{block.SUFFIX}").load(uri if files is None else files).select("path", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """The captures of block files (path, content)."""

    def run(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from block.batches(raw.as_py(), path.rpartition("/")[2])

    return files.mapInArrow(run, CAPTURE_DDL)


def save_captures(captures: DataFrame, uri: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Clustered Parquet, block files or array files, each with its manifest. mode is errorifexists, append or overwrite."""
    uri = uri.rstrip("/")
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError("mode is errorifexists, append or overwrite")
    if kind not in ("parquet", "block", "hdf5"):
        raise ValueError("captures are saved as parquet, block or hdf5")
    spark = captures.sparkSession
    there = _kind(names_in(spark, uri))
    if there is not None and (mode == "errorifexists" or there != kind):
        raise FileExistsError(f"{uri} holds captures ({there})")
    if kind == "parquet":
        manifest.ingest(captures, uri, mode=mode)
        return
    register(spark)
    told = captures.select(*(F.col(f.name).cast(f.dataType) for f in CAPTURE))
    told.write.format(f"captures_{kind}").mode("overwrite" if mode == "overwrite" else "append").save(uri)


def blocks(spark: SparkSession, uri: str) -> DataFrame:
    """Files of a dataset with their sizes."""
    return spark.read.format("binaryFile").load(uri).select(F.col("path").alias("file"), F.col("length").alias("size"))
