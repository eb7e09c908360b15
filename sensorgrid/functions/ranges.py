"""Range algebra over columns.

A range is a struct (min, max, min_inclusive, max_inclusive); a partitioning is an array of structs (key, range).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(least: Column, greatest: Column, min_inclusive: Column | bool = True, max_inclusive: Column | bool = True) -> Column:
    flags = [x if isinstance(x, Column) else F.lit(x) for x in (min_inclusive, max_inclusive)]
    return F.struct(least.alias("min"), greatest.alias("max"), flags[0].alias("min_inclusive"), flags[1].alias("max_inclusive"))


def contains(outer: Column, inner: Column) -> Column:
    """Whether every value of the inner range is one of the outer."""
    low = (outer["min"] < inner["min"]) | ((outer["min"] == inner["min"]) & (outer["min_inclusive"] | ~inner["min_inclusive"]))
    high = (outer["max"] > inner["max"]) | ((outer["max"] == inner["max"]) & (outer["max_inclusive"] | ~inner["max_inclusive"]))
    return low & high


def intersects(least: Column, greatest: Column, gte: Column, lte: Column) -> Column:
    """Whether a closed interval meets another."""
    return (least <= lte) & (greatest >= gte)


def is_subset(inner: Column, outer: Column) -> Column:
    """Whether two partitionings have the same keys in the same order and each inner range lies in the outer one."""
    pairs = F.zip_with(inner, outer, lambda a, b: (a["key"] == b["key"]) & contains(b["range"], a["range"]))
    return (F.size(inner) == F.size(outer)) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


def combine(a: Column, b: Column) -> Column:
    """The one of two partitionings that holds the other, or null."""
    return F.when(is_subset(a, b), b).when(is_subset(b, a), a)


def partitioning_compatible(a: Column, b: Column) -> Column:
    """Whether one holds the other; two without ranges are compatible."""
    return is_subset(a, b) | is_subset(b, a)


def location_compatible(a: Column, b: Column) -> Column:
    """Whether two arrays of hosts share one, or neither has any."""
    return F.arrays_overlap(a, b) | ((F.size(a) == 0) & (F.size(b) == 0))


def on_host(locations: Column, host: Column | str) -> Column:
    return F.array_contains(locations, host)
