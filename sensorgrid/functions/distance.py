"""Distance between positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(t1: Column, lat1: Column, lon1: Column, t2: Column, lat2: Column, lon2: Column) -> Column:
    """Square root of the summed squares of raw milliseconds and degrees, unscaled."""
    t = (t1 - t2).cast("double")
    lat, lon = lat1 - lat2, lon1 - lon2
    return F.sqrt(t * t + lat * lat + lon * lon)


def between(a: Column, b: Column) -> Column:
    """Distance of two structs with ts_ms, lat and lon."""
    return distance(a["ts_ms"], a["lat"], a["lon"], b["ts_ms"], b["lat"], b["lon"])
