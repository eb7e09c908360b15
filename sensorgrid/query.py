"""Inclusive range queries over time, latitude and longitude."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Option name, column, zone columns, index key.
DIMENSIONS = (("time", "ts_ms", "ts", "timestamp"), ("latitude", "lat", "lat", "lat"), ("longitude", "lon", "lon", "lon"))


@dataclass(frozen=True)
class RangeQuery:
    """Each range is (least, greatest), both inclusive, or None for no condition. At least one is needed."""

    time: tuple[int, int] | None = None
    latitude: tuple[float, float] | None = None
    longitude: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if not self.ranges():
            raise ValueError("a query needs at least one range")
        for name, _, _, _, r in self.ranges():
            if len(r) != 2 or r[0] is None or r[1] is None:
                raise ValueError(f"{name} needs both its least and its greatest value")

    def ranges(self) -> list[tuple[str, str, str, str, tuple]]:
        return [(*d, getattr(self, d[0])) for d in DIMENSIONS if getattr(self, d[0]) is not None]

    def predicate(self) -> Column:
        """Over rows; plain comparisons, which reach the Parquet scan."""
        return reduce(and_, (F.col(column).between(*r) for _, column, _, _, r in self.ranges()))

    def zone_predicate(self) -> Column:
        """Over manifest rows: zones that meet every range."""
        return reduce(and_, ((F.col(f"{zone}_max") >= r[0]) & (F.col(f"{zone}_min") <= r[1]) for _, _, zone, _, r in self.ranges()))

    def specs_predicate(self, specs: str = "specs") -> Column:
        """Over nested index entries: for every range some spec of its key meets it."""

        def met(key: str, r: tuple) -> Column:
            bounds = "date_range" if key == "timestamp" else "geo_range"
            return F.exists(specs, lambda s: (s["key"] == key) & (s[bounds]["gte"] <= r[1]) & (s[bounds]["lte"] >= r[0]))

        return reduce(and_, (met(key, r) for _, _, _, key, r in self.ranges()))

    def apply(self, captures: DataFrame) -> DataFrame:
        return captures.where(self.predicate())


def add_arguments(parser: argparse.ArgumentParser) -> None:
    for name, kind in (("time", int), ("latitude", float), ("longitude", float)):
        for end in ("gte", "lte"):
            parser.add_argument(f"--{name}-{end}", type=kind)


def from_arguments(args: argparse.Namespace) -> RangeQuery:
    """Each of a pair needs the other; at least one pair is needed."""
    ranges = {}
    for name, _, _, _ in DIMENSIONS:
        pair = getattr(args, f"{name}_gte"), getattr(args, f"{name}_lte")
        if (pair[0] is None) != (pair[1] is None):
            raise ValueError(f"--{name}-gte and --{name}-lte go together")
        if pair[0] is not None:
            ranges[name] = pair
    return RangeQuery(**ranges)
