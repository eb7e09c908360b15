"""Counting, ordering, merging and spreading of captures."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("ts_ms", "lat", "lon", "capture_id")


def tagged_union(datasets: Iterable[DataFrame]) -> DataFrame:
    """All rows of the datasets with the number of each in `instrument`; the first, 0, is the primary."""
    tagged = [df.withColumn("instrument", F.lit(i)) for i, df in enumerate(datasets)]
    if not tagged:
        raise ValueError("no datasets to merge")
    return reduce(DataFrame.unionByName, tagged)


def ordered(captures: DataFrame) -> DataFrame:
    """In the order of time, latitude and longitude, ids breaking ties: a range shuffle and a sort in each part."""
    return captures.orderBy(*ORDER)


def first_rows(captures: DataFrame, n: int = 10) -> DataFrame:
    """The first n in that order, without sorting the rest."""
    return captures.orderBy(*ORDER).limit(n)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """At least as many partitions as the session has cores (or `parts`); no shuffle if there are enough."""
    wanted = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def edges(captures: DataFrame, by: str) -> DataFrame:
    """The first and the last capture of each group, from minima that are taken before the shuffle."""
    key, row = F.struct(*ORDER), F.struct("capture_id", "ts_ms", "lat", "lon")
    return captures.groupBy(by).agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"))


def host_frequency(blocks: DataFrame) -> DataFrame:
    """Number of blocks on each host, of blocks with an array of locations; the most frequent first."""
    return blocks.select(F.explode("locations").alias("host")).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host")


def host_load(blocks: DataFrame) -> DataFrame:
    """Bytes on each host, of blocks with locations and size."""
    return blocks.select(F.explode("locations").alias("host"), "size").groupBy("host").agg(F.sum("size").alias("bytes"))


def least_loaded(blocks: DataFrame) -> DataFrame:
    load = host_load(blocks)
    return load.agg(F.min_by("host", F.struct("bytes", "host")).alias("host"), F.min("bytes").alias("bytes"))
