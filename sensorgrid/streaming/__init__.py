"""Captures that arrive as block files, as a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorgrid.query import RangeQuery
from sensorgrid.sources import block
from sensorgrid.sources.dispatch import decoded


def arriving(spark: SparkSession, uri: str, query: RangeQuery | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Captures of the block files of a folder, each file once, as they come in; with a query only those that it takes. A file's
    final name appears when it is whole, so no half file is read."""
    columns = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(columns).option("pathGlobFilter", f"*{block.SUFFIX}").option("maxFilesPerTrigger", files_per_batch).load(uri)
    rows = decoded(files.select("path", "content"))
    return query.apply(rows) if query else rows
