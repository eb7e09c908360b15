"""Names of files, blocks and URIs, and captures as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorgrid.sources.block import SUFFIX


def has_suffix(name: Column, suffix: str) -> Column:
    return F.endswith(F.lower(name), F.lit(suffix.lower()))


def block_part(name: Column, k: int) -> Column:
    """The k-th part, from 1, of a block name such as file:start:end."""
    return F.split_part(name, F.lit(":"), F.lit(k))


def in_dataset(file: Column, dataset: Column | str) -> Column:
    """Whether a file lies under a dataset's folder, not under one whose name only begins alike."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    return F.startswith(file, F.concat(without_slash(dataset), F.lit("/")))


def without_prefix(file: Column, dataset: Column | str) -> Column:
    """The file's name within a dataset's folder."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    return F.when(in_dataset(file, dataset), F.substr(file, F.length(without_slash(dataset)) + 2)).otherwise(file)


def without_slash(uri: Column) -> Column:
    return F.rtrim(uri, F.lit("/"))


def scheme(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def block_file_name(part: Column, block: Column) -> Column:
    return F.format_string(f"part-%06d_block%03d{SUFFIX}", part, block)


def rendered() -> Column:
    """A capture as one line of text, without its payload."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    return F.concat_ws(" ", F.concat(F.lit("@"), F.col("ts_ms").cast("string")), F.format_string("(%.6f, %.6f)", "lat", "lon"), F.concat(F.lit("{"), F.coalesce(meta, F.lit("")), F.lit("}")))
