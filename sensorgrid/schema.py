"""Captures, manifests and numeric types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CAPTURE = _struct(
    capture_id=_STRING, ts_ms=_LONG, lat=_DOUBLE, lon=_DOUBLE, dimensions=T.ArrayType(T.IntegerType()), payload_type=_STRING, metadata=T.MapType(_STRING, _STRING), payload=T.BinaryType()
)

MANIFEST = _struct(file=_STRING, n=_LONG, ts_min=_LONG, ts_max=_LONG, lat_min=_DOUBLE, lat_max=_DOUBLE, lon_min=_DOUBLE, lon_max=_DOUBLE, size=_LONG)

#: The nested form of a manifest entry, as an index service would hold it.
INDEX_ENTRY = _struct(
    specs=T.ArrayType(_struct(key=_STRING, date_range=_struct(gte=_LONG, lte=_LONG), geo_range=_struct(gte=_DOUBLE, lte=_DOUBLE))),
    blocks=T.ArrayType(_struct(file_name=_STRING, locations=T.ArrayType(_STRING))),
)


@dataclass(frozen=True)
class NumericType:
    """A sample type: its numpy name (little-endian) and the Spark type that holds all its values."""

    name: str
    dtype: str
    spark: str


#: The sample types in the order of their number in block files.
NUMERIC_TYPES = (
    NumericType("UINT8", "u1", "smallint"),
    NumericType("INT8", "i1", "tinyint"),
    NumericType("UINT16", "<u2", "int"),
    NumericType("INT16", "<i2", "smallint"),
    NumericType("UINT32", "<u4", "bigint"),
    NumericType("INT32", "<i4", "int"),
    NumericType("UINT64", "<u8", "decimal(20,0)"),
    NumericType("INT64", "<i8", "bigint"),
    NumericType("FLOAT", "<f4", "float"),
    NumericType("DOUBLE", "<f8", "double"),
)
BY_NAME = {t.name: t for t in NUMERIC_TYPES}


def numeric_type(kind: str, size: int, signed: bool = False) -> NumericType:
    """The sample type of an array file's integer or float elements of `size` bytes; other kinds have none."""
    if kind == "integer" and size in (1, 2, 4, 8):
        return BY_NAME[f"{'' if signed else 'U'}INT{8 * size}"]
    if kind == "float" and size in (4, 8):
        return BY_NAME["FLOAT" if size == 4 else "DOUBLE"]
    raise ValueError(f"no sample type for {kind} elements of {size} bytes")
