"""Binary block files (*.p2irc.bin) as a Python data source, `captures_block`.

A file is a little-endian int32 with the length of what is used, itself included, and records one after another. A
record is timestamp, latitude, longitude, shape, number of the sample type, metadata and payload, each after a byte with its
tag. Bytes beyond the length are ignored; an empty block is 4 bytes long. Strings are written with their length in bytes.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sensorgrid.schema import CAPTURE, NUMERIC_TYPES
from sensorgrid.sources.folder import FolderWriter

#: Fixed value: the suffix of block files.
SUFFIX = ".p2irc.bin"
BLOCK_BYTES = 128 << 20
#: Records in a batch that a reader hands on.
BATCH = 256

#: The tags of fields.
NULL, INT8, INT16, INT32, INT64, FLOAT, DOUBLE, STRING, BYTES, MAP, INT32_ARRAY = range(11)
_SCALARS = {INT8: "<b", INT16: "<h", INT32: "<i", INT64: "<q", FLOAT: "<f", DOUBLE: "<d"}
_NUMBER = {t.name: i for i, t in enumerate(NUMERIC_TYPES)}


class _Cursor:
    def __init__(self, raw: bytes, at: int, end: int):
        self.raw, self.at, self.end = raw, at, end

    def take(self, form: str):
        (value,) = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return value

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise ValueError("a field reaches over the end of its block")
        self.at += n
        return self.raw[self.at - n : self.at]

    def field(self, *allowed: int):
        """The value of a tagged field, whose tag must be one of those allowed."""
        tag = self.take("<B")
        if tag not in allowed:
            raise ValueError(f"unexpected tag {tag} at byte {self.at - 1}")
        if tag == NULL:
            return None
        if tag in _SCALARS:
            return self.take(_SCALARS[tag])
        if tag == STRING:
            return self.bytes(self.take("<H")).decode()
        if tag == BYTES:
            return self.bytes(self.take("<i"))
        if tag == INT32_ARRAY:
            return [self.take("<i") for _ in range(self.take("<i"))]
        return {self.field(STRING): self.field(*_SCALARS, STRING, BYTES, NULL) for _ in range(self.take("<i"))}


def _text(value) -> str | None:
    return value.hex() if isinstance(value, bytes) else None if value is None else str(value)


def decode(raw: bytes, name: str) -> Iterator[dict]:
    """The captures of a block; ids are the file's name and the place in it."""
    if len(raw) < 4 or (end := struct.unpack_from("<i", raw)[0]) > len(raw) or end < 4:
        raise ValueError(f"{name} is shorter than its header says")
    at, n = _Cursor(raw, 4, end), 0
    while at.at < end:
        ts, lat, lon = at.field(INT64), at.field(DOUBLE), at.field(DOUBLE)
        shape, kind, meta, payload = at.field(INT32_ARRAY), at.field(INT32), at.field(NULL, MAP), at.field(BYTES)
        yield {
            "capture_id": f"{name}:{n}", "ts_ms": ts, "lat": lat, "lon": lon, "dimensions": shape, "payload_type": NUMERIC_TYPES[kind].name,
            "metadata": None if meta is None else [(k, _text(v)) for k, v in meta.items()], "payload": payload,
        }
        n += 1


def encode(row: dict) -> bytes:
    shape, payload, meta = row["dimensions"] or [], row["payload"] or b"", row["metadata"]
    parts = [struct.pack("<BqBdBd", INT64, row["ts_ms"], DOUBLE, row["lat"], DOUBLE, row["lon"]), struct.pack(f"<Bi{len(shape)}i", INT32_ARRAY, len(shape), *shape), struct.pack("<Bi", INT32, _NUMBER[row["payload_type"]])]
    if meta is None:
        parts.append(struct.pack("<B", NULL))
    else:
        parts.append(struct.pack("<Bi", MAP, len(meta)))
        for key, value in dict(meta).items():
            for text in (key, value):
                told = b"" if text is None else text.encode()
                parts.append(struct.pack("<B", NULL) if text is None else struct.pack("<BH", STRING, len(told)) + told)
    parts.append(struct.pack("<Bi", BYTES, len(payload)) + payload)
    return b"".join(parts)


def local_path(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: this format reads and writes file: paths; use open_captures for other stores")
    return parts.path


@dataclass
class BlockFile(InputPartition):
    path: str


class BlockReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[BlockFile]:
        return [BlockFile(p) for p in sorted(glob.glob(os.path.join(glob.escape(self.path), f"*{SUFFIX}")))]

    def read(self, partition: BlockFile) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from batches(f.read(), os.path.basename(partition.path))


def batches(raw: bytes, name: str) -> Iterator[pa.RecordBatch]:
    schema, held = to_arrow_schema(CAPTURE), []
    for row in decode(raw, name):
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class BlockWriter(FolderWriter):
    """Blocks of up to `limit` bytes; a record that is longer has a block of its own."""

    suffix, stem = SUFFIX, "block"

    def __init__(self, uri: str, limit: int, overwrite: bool):
        super().__init__(uri, overwrite)
        self.limit = limit

    def files(self, rows: Iterator[dict]) -> Iterator[tuple[list[dict], bytes]]:
        held, records, size = [], [], 4
        for row in rows:
            record = encode(row)
            if held and size + len(record) > self.limit:
                yield held, struct.pack("<i", size) + b"".join(records)
                held, records, size = [], [], 4
            held.append({k: row[k] for k in ("ts_ms", "lat", "lon")})
            records.append(record)
            size += len(record)
        if held:
            yield held, struct.pack("<i", size) + b"".join(records)


class CapturesBlock(DataSource):
    """spark.read.format("captures_block").load(folder); write with .save(folder), option blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "captures_block"

    def schema(self):
        return CAPTURE

    def reader(self, schema) -> BlockReader:
        return BlockReader(local_path(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], int(self.options.get("blockbytes", BLOCK_BYTES)), overwrite)
