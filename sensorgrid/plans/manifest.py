"""Zone manifests: each file's ranges of time, latitude and longitude, and what follows from them.

A dataset is Parquet, range-clustered by (time, latitude, longitude), so that files have narrow zones, with its manifest in a
folder beside the data. A query keeps the files whose zones meet it and reads those only; row groups are pruned by
Parquet's own statistics, and the query's predicate is always applied to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.query import RangeQuery
from sensorgrid.schema import INDEX_ENTRY
from sensorgrid.sources.folder import ZONES

DATA = "data"
#: Files whose names the driver may list for one read; with more, the predicate alone prunes.
MAX_FILES = 100_000
#: Bytes that a file is to have, before compression.
FILE_BYTES = 128 << 20


def zones(captures: DataFrame, by: Column | str, *more: Column) -> DataFrame:
    """Number of rows and zone of each group, and further aggregates, all taken before the shuffle as far as can be."""
    return captures.groupBy(by).agg(
        F.count("*").alias("n"),
        *(f(c).alias(f"{name}_{end}") for c, name in (("ts_ms", "ts"), ("lat", "lat"), ("lon", "lon")) for f, end in ((F.min, "min"), (F.max, "max"))),
        *more,
    )


def size_of(captures: DataFrame) -> int:
    """Bytes of a DataFrame: as planned from the sizes of its files, or else measured from its payloads."""
    planned = int(captures._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if planned < 1 << 60:
        return planned
    told = F.coalesce(F.octet_length("payload"), F.lit(0)) if "payload" in captures.columns else F.lit(0)
    return captures.agg(F.coalesce(F.sum(told + 64), F.lit(0))).first()[0]


def ingest(captures: DataFrame, uri: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Writes captures clustered by position, a file per range, and the manifest of the files. Without a number of files, there is
    one for each FILE_BYTES, and one for each core at least."""
    spark = captures.sparkSession
    files = files or max(spark.sparkContext.defaultParallelism, -(-size_of(captures) // FILE_BYTES))
    clustered = captures.repartitionByRange(files, "ts_ms", "lat", "lon").sortWithinPartitions("ts_ms", "lat", "lon")
    clustered.write.mode(mode).parquet(f"{uri}/{DATA}")
    describe(spark, uri)


def describe(spark: SparkSession, uri: str) -> None:
    """(Re)writes the manifest of a dataset: one entry per file, whatever was there."""
    rows = spark.read.parquet(f"{uri}/{DATA}").select("ts_ms", "lat", "lon", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    zones(rows, "file", F.max("size").alias("size")).coalesce(1).write.mode("overwrite").parquet(f"{uri}/{ZONES}")


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(f"{uri}/{ZONES}")


def files_for(spark: SparkSession, uri: str, query: RangeQuery) -> DataFrame:
    """Manifest entries of the files that can hold rows of the query: a superset of those that do."""
    return manifest(spark, uri).where(query.zone_predicate())


def read(spark: SparkSession, uri: str, query: RangeQuery | None = None, use_manifest: bool = True) -> DataFrame:
    """The dataset's rows, or those of a query from the files that can hold some; only those are listed."""
    if query is None:
        return spark.read.parquet(f"{uri}/{DATA}")
    kept = [r.file for r in files_for(spark, uri, query).select("file").limit(MAX_FILES + 1).collect()] if use_manifest else None
    if kept is None or not 0 < len(kept) <= MAX_FILES:
        rows = spark.read.parquet(f"{uri}/{DATA}")
        return rows.where(F.lit(False)) if kept == [] else query.apply(rows)
    return query.apply(spark.read.parquet(*kept))


def index_entry(told: DataFrame) -> DataFrame:
    """Manifest entries in nested form (specs, blocks)."""
    no_dates, no_places = F.lit(None).cast("struct<gte:bigint,lte:bigint>"), F.lit(None).cast("struct<gte:double,lte:double>")

    def spec(key: str, zone: str) -> Column:
        bounds = F.struct(F.col(f"{zone}_min").alias("gte"), F.col(f"{zone}_max").alias("lte"))
        dates, places = (bounds, no_places) if key == "timestamp" else (no_dates, bounds)
        return F.struct(F.lit(key).alias("key"), dates.alias("date_range"), places.alias("geo_range"))

    specs = F.array(spec("timestamp", "ts"), spec("lat", "lat"), spec("lon", "lon"))
    blocks = F.array(F.struct(F.col("file").alias("file_name"), F.array().cast("array<string>").alias("locations")))
    return told.select(specs.alias("specs"), blocks.alias("blocks"))


def to_json(entries: DataFrame) -> DataFrame:
    return entries.select(F.to_json(F.struct("specs", "blocks")).alias("document"))


def from_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("document", INDEX_ENTRY).alias("e")).select("e.specs", "e.blocks")
