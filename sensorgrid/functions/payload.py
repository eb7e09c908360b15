"""Payloads: little-endian samples in a binary column, or arrays of samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorgrid.schema import BY_NAME


def _together(column: pd.Series, dtype: str) -> np.ndarray | None:
    """All payloads as the rows of one array, if they have one length of whole samples; None otherwise."""
    sizes = {-1 if raw is None else len(raw) for raw in column}
    if len(sizes) != 1 or (size := sizes.pop()) < 1 or size % np.dtype(dtype).itemsize:
        return None
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def samples(payload: Column | str, payload_type: str) -> Column:
    """A payload's samples as an array; all payloads have the one type. An incomplete last sample is left out."""
    kind = BY_NAME[payload_type]
    size = np.dtype(kind.dtype).itemsize

    @F.pandas_udf(f"array<{kind.spark}>")
    def decode(column: pd.Series) -> pd.Series:
        if (values := _together(column, kind.dtype)) is not None and kind.name != "UINT64":
            return pd.Series(list(values))

        def one(raw: bytes | None):
            if raw is None:
                return None
            values = np.frombuffer(raw, kind.dtype, len(raw) // size)
            return [int(v) for v in values] if kind.name == "UINT64" else values

        return column.map(one)

    return decode(payload)


def as_bytes(payload: Column | str) -> Column:
    return samples(payload, "INT8")


def as_shorts(payload: Column | str) -> Column:
    return samples(payload, "INT16")


def as_longs(payload: Column | str) -> Column:
    return samples(payload, "INT64")


def packed(values: Column | str, payload_type: str) -> Column:
    """The reverse of samples(); arrays without nulls."""
    dtype = BY_NAME[payload_type].dtype

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v).astype(dtype).tobytes())

    return encode(values)


def mapped(payload: Column | str, change: Callable[[bytes], bytes]) -> Column:
    """A new payload from each payload; change gets and gives bytes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda raw: None if raw is None else change(raw))

    return run(payload)


def threshold16(payload: Column | str, threshold: int = 0, signed: bool = True) -> Column:
    """A 16-bit payload whose samples that are not over the threshold are 0. An odd last byte becomes 0."""
    dtype = "<i2" if signed else "<u2"

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        if (values := _together(column, dtype)) is not None:
            return pd.Series([v.tobytes() for v in np.where(values > threshold, values, 0).astype(dtype)])

        def one(raw: bytes | None) -> bytes | None:
            if raw is None:
                return None
            values = np.frombuffer(raw, dtype, len(raw) // 2)
            return np.where(values > threshold, values, 0).astype(dtype).tobytes() + b"\0" * (len(raw) % 2)

        return column.map(one)

    return run(payload)


def threshold_samples(values: Column | str, threshold: int = 0) -> Column:
    """The same over an array of samples, without leaving the JVM."""
    return F.transform(values, lambda x: F.when(x > threshold, x).otherwise(F.lit(0).cast("smallint")))


def n_samples(dimensions: Column | str) -> Column:
    """Product of a shape; 1 without dimensions."""
    return F.aggregate(dimensions, F.lit(1).cast("long"), lambda total, n: total * n)
