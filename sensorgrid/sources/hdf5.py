"""Array files (*.hdf5) as a Python data source, `captures_hdf5`, and a writer of such files.

A file has a group /data whose members 0 ... n-1 are datasets of integers or floats with the attributes timestamp (text),
Latitude and Longitude (float or text). The container format is read here as far as it is needed, without a library:
superblocks 0 to 3, both kinds of object header, symbol-table groups and compact links, contiguous, compact and chunked
data with deflate and byte shuffle, and scalar attributes. Anything else raises an error that names it.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sensorgrid.schema import BY_NAME, CAPTURE, NumericType, numeric_type
from sensorgrid.sources.block import BATCH, local_path
from sensorgrid.sources.folder import FolderWriter

SUFFIX = ".hdf5"
#: Bytes of file for one split.
SPLIT_BYTES = 128 << 20
NOWHERE = (1 << 64) - 1
#: Captures that one leaf of a group's tree can name.
MAX_DATASETS = 65534

#: Fixed values of the container format: message numbers.
_DATASPACE, _LINK_INFO, _DATATYPE, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _SYMBOLS = 1, 2, 3, 6, 8, 11, 12, 16, 17


class Unsupported(ValueError):
    pass


@dataclass
class Element:
    """Type of a dataset's or attribute's elements."""

    kind: str
    size: int
    signed: bool = False
    big: bool = False

    @classmethod
    def parse(cls, raw: bytes) -> Element:
        bits, (size,) = raw[1], struct.unpack_from("<I", raw, 4)
        kind = {0: "integer", 1: "float", 3: "text", 9: "varying text"}.get(raw[0] & 15)
        if kind is None or kind == "varying text" and bits & 15 != 1:
            raise Unsupported(f"elements of class {raw[0] & 15}")
        return cls(kind, size, kind == "integer" and bool(bits & 8), kind in ("integer", "float") and bool(bits & 1))

    @property
    def dtype(self) -> np.dtype:
        letter = "f" if self.kind == "float" else "i" if self.signed else "u"
        return np.dtype(f"{'>' if self.big else '<'}{letter}{self.size}")


def _shape(raw: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{raw[1]}Q", raw, 8 if raw[0] == 1 else 4)


class File:
    """A container that is mapped into memory; nothing but what is asked for is read."""

    def __init__(self, raw):
        self.raw = raw
        if bytes(raw[:8]) != b"\x89HDF\r\n\x1a\n":
            raise Unsupported("not an array file")
        version = raw[8]
        if version > 3 or raw[13 if version < 2 else 9] != 8 or raw[14 if version < 2 else 10] != 8:
            raise Unsupported(f"superblock version {version} or its sizes")
        self.root = self.at("<Q", {0: 64, 1: 68}.get(version, 36))

    def at(self, form: str, place: int):
        return struct.unpack_from(form, self.raw, place)[0]

    def messages(self, header: int) -> list[tuple[int, bytes]]:
        raw, out = self.raw, []
        if bytes(raw[header : header + 4]) == b"OHDR":
            flags, place = raw[header + 5], header + 6
            place += 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size = int.from_bytes(raw[place : place + width], "little")
            todo, head, extra = [(place + width, size)], 4, 2 * bool(flags & 4)
        else:
            todo, head, extra = [(header + 16, self.at("<I", header + 8))], 8, 0
        modern = head == 4
        while todo:
            place, size = todo.pop(0)
            end = place + size
            while place + head + extra <= end:
                kind, length = (raw[place], self.at("<H", place + 1)) if modern else struct.unpack_from("<HH", raw, place)
                body = bytes(raw[place + head + extra : place + head + extra + length])
                place += head + extra + length
                if kind == _CONTINUED:
                    where, n = struct.unpack("<QQ", body[:16])
                    todo.append((where + 4, n - 8) if modern else (where, n))
                elif kind:
                    out.append((kind, body))
        return out

    def members(self, header: int) -> dict[str, int]:
        """Names in a group, and where their headers are."""
        found: dict[str, int] = {}
        for kind, body in self.messages(header):
            if kind == _SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                names = self.at("<Q", heap + 24)
                for node in self._leaves(tree):
                    for i in range(self.at("<H", node + 6)):
                        name, where = struct.unpack_from("<QQ", self.raw, node + 8 + 40 * i)
                        start = names + name
                        found[bytes(self.raw[start : self.raw.find(b"\0", start)]).decode()] = where
            elif kind == _LINK:
                flags, place = body[1], 2
                if flags & 8 and body[2]:
                    raise Unsupported("links other than hard ones")
                place += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[place : place + width], "little")
                found[body[place + width : place + width + n].decode()] = struct.unpack_from("<Q", body, place + width + n)[0]
            elif kind == _LINK_INFO and struct.unpack_from("<Q", body, 2 + 8 * (body[1] & 1))[0] != NOWHERE:
                raise Unsupported("groups with dense links")
        return found

    def _leaves(self, node: int) -> Iterator[int]:
        level, used = self.raw[node + 5], self.at("<H", node + 6)
        for i in range(used):
            child = self.at("<Q", node + 32 + 16 * i)
            if level:
                yield from self._leaves(child)
            else:
                yield child

    def attributes(self, messages: list[tuple[int, bytes]]) -> dict[str, object]:
        out = {}
        for kind, body in messages:
            if kind != _ATTRIBUTE:
                continue
            sizes = struct.unpack_from("<HHH", body, 2)
            place, parts = 8 + (body[0] == 3), []
            for n in sizes:
                parts.append(body[place : place + n])
                place += -(-n // 8) * 8 if body[0] == 1 else n
            element = Element.parse(parts[1])
            raw = body[place : place + element.size]
            if element.kind == "text":
                value = raw.split(b"\0")[0].decode().rstrip()
            elif element.kind == "varying text":
                n, heap, index = struct.unpack("<IQI", raw[:16])
                value = self._heap_object(heap, index)[:n].decode()
            else:
                value = np.frombuffer(raw, element.dtype)[0].item()
            out[parts[0].split(b"\0")[0].decode()] = value
        return out

    def _heap_object(self, heap: int, wanted: int) -> bytes:
        place, end = heap + 16, heap + self.at("<Q", heap + 8)
        while place < end:
            index, size = self.at("<H", place), self.at("<Q", place + 8)
            if index == wanted:
                return bytes(self.raw[place + 16 : place + 16 + size])
            if not index:
                break
            place += 16 + -(-size // 8) * 8
        raise ValueError("a text that is not in its heap")

    def values(self, messages: list[tuple[int, bytes]]) -> tuple[NumericType, tuple[int, ...], bytes]:
        """Sample type, shape and little-endian samples of a dataset."""
        told = {k: b for k, b in messages if k != _ATTRIBUTE}
        shape, element, layout = _shape(told[_DATASPACE]), Element.parse(told[_DATATYPE]), told[_LAYOUT]
        kind = numeric_type(element.kind, element.size, element.signed)
        n = math.prod(shape) * element.size
        if layout[0] not in (3, 4):
            raise Unsupported(f"layout version {layout[0]}")
        if layout[1] == 0:
            raw = layout[4 : 4 + n]
        elif layout[1] == 1:
            where = struct.unpack_from("<Q", layout, 2)[0]
            raw = bytes(n) if where == NOWHERE else bytes(self.raw[where : where + n])
        elif layout[1] == 2 and layout[0] == 3:
            raw = self._chunked(layout, shape, element, told.get(_FILTERS))
        else:
            raise Unsupported(f"layout {layout[0]}.{layout[1]}")
        if len(raw) < n:
            raise ValueError("a dataset that reaches over the end of its file")
        return kind, shape, np.frombuffer(raw, element.dtype).astype(kind.dtype).tobytes()

    def _chunked(self, layout: bytes, shape: tuple[int, ...], element: Element, pipeline: bytes | None) -> bytes:
        rank, tree = len(shape), struct.unpack_from("<Q", layout, 3)[0]
        chunk = struct.unpack_from(f"<{rank}I", layout, 11)
        filters, out = _filters(pipeline), np.zeros(shape, element.dtype)
        for where, size, mask, start in self._chunks(tree, rank) if tree != NOWHERE else ():
            raw = bytes(self.raw[where : where + size])
            for i in reversed(range(len(filters))):
                if mask >> i & 1:
                    continue
                raw = zlib.decompress(raw) if filters[i] == 1 else np.frombuffer(raw, np.uint8).reshape(element.size, -1).T.tobytes()
            within = tuple(slice(s, min(s + c, n)) for s, c, n in zip(start, chunk, shape, strict=True))
            out[within] = np.frombuffer(raw, element.dtype).reshape(chunk)[tuple(slice(0, x.stop - x.start) for x in within)]
        return out.tobytes()

    def _chunks(self, node: int, rank: int) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        level, used, step = self.raw[node + 5], self.at("<H", node + 6), 8 + 8 * (rank + 1)
        for i in range(used):
            key = node + 24 + i * (step + 8)
            child = self.at("<Q", key + step)
            if level:
                yield from self._chunks(child, rank)
            else:
                yield child, self.at("<I", key), self.at("<I", key + 4), struct.unpack_from(f"<{rank}Q", self.raw, key + 8)

    def datasets(self) -> list[tuple[int, int]]:
        """(number, header) of the members of /data, in order."""
        group = self.members(self.root).get("data")
        if group is None:
            raise ValueError("the file has no group /data")
        return sorted((int(name), where) for name, where in self.members(group).items())


def _filters(pipeline: bytes | None) -> list[int]:
    """Numbers of the filters that a dataset's chunks went through."""
    out: list[int] = []
    if pipeline:
        place = 8 if pipeline[0] == 1 else 2
        for _ in range(pipeline[1]):
            number = struct.unpack_from("<H", pipeline, place)[0]
            named = pipeline[0] == 1 or number >= 256
            name = struct.unpack_from("<H", pipeline, place + 2)[0] if named else 0
            place += 4 if named else 2
            values = struct.unpack_from("<H", pipeline, place + 2)[0]
            place += 4 + name + 4 * (values + (values % 2 if pipeline[0] == 1 else 0))
            if number not in (1, 2):
                raise Unsupported(f"filter {number}")
            out.append(number)
    return out


def captures(raw, name: str, start: int = 0, end: int | None = None, numeric_unit: str = "ms") -> Iterator[dict]:
    """Captures of the datasets start ... end - 1 of a file."""
    file = File(raw)
    for number, header in file.datasets()[start:end]:
        messages = file.messages(header)
        told = file.attributes(messages)
        kind, shape, payload = file.values(messages)
        yield {
            "capture_id": f"{name}:{number}", "ts_ms": parse_timestamp(str(told["timestamp"]), numeric_unit), "lat": float(told["Latitude"]), "lon": float(told["Longitude"]),
            "dimensions": list(shape), "payload_type": kind.name, "metadata": None, "payload": payload,
        }


def parse_timestamp(text: str, numeric_unit: str = "ms") -> int:
    """The grammar of functions.timestamps.parse_millis, for readers that run outside a plan."""
    import re
    from datetime import datetime, timedelta

    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return round(float(text) * (1000 if numeric_unit == "s" else 1))
    found = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:'?T'?| )(\d{2}:\d{2}:\d{2})(?:\.(\d{1,6}))?(?: (?:[A-Z]+)?([+-])(\d{2})(\d{2}))?", text)
    if not found:
        raise ValueError(f"no timestamp: {text}")
    day, clock, fraction, sign, hours, minutes = found.groups()
    since = datetime.fromisoformat(f"{day}T{clock}") - datetime(1970, 1, 1)
    shift = (int(hours) * 60 + int(minutes)) * 60000 if sign else 0
    return since // timedelta(milliseconds=1) + int((fraction or "0").ljust(6, "0")) // 1000 - (-shift if sign == "-" else shift)


@dataclass
class Split(InputPartition):
    path: str
    index: int


def splits(length: int, n: int, split_bytes: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Ranges of a file's n datasets, one per split_bytes of file; the last takes the remainder."""
    parts = max(1, min(n, -(-length // split_bytes)))
    step = n // parts
    return [(i * step, n if i == parts - 1 else (i + 1) * step) for i in range(parts)] if n else []


class Hdf5Reader(DataSourceReader):
    """Splits follow from the sizes of the files alone; which datasets a split has is found when it is read."""

    def __init__(self, path: str, numeric_unit: str, split_bytes: int):
        self.path, self.numeric_unit, self.split_bytes = path, numeric_unit, split_bytes

    def partitions(self) -> list[Split]:
        out = []
        with os.scandir(self.path) as found:
            for entry in sorted(found, key=lambda e: e.name):
                if entry.name.lower().endswith(SUFFIX):
                    parts = max(1, -(-entry.stat().st_size // self.split_bytes))
                    out += [Split(entry.path, i) for i in range(parts)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        schema, held = to_arrow_schema(CAPTURE), []
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
            mine = splits(len(raw), len(File(raw).datasets()), self.split_bytes)[partition.index : partition.index + 1]
            for start, end in mine:
                for row in captures(raw, os.path.basename(partition.path), start, end, self.numeric_unit):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class Hdf5Writer(FolderWriter):
    """Array files of up to `limit` bytes of payload and MAX_DATASETS captures. Metadata has no place in this format."""

    suffix, stem = SUFFIX, "file"

    def __init__(self, uri: str, limit: int, overwrite: bool):
        super().__init__(uri, overwrite)
        self.limit = limit

    def files(self, rows: Iterator[dict]) -> Iterator[tuple[list[dict], bytes]]:
        held, size = [], 0
        for row in rows:
            row = row | {"payload": row["payload"] or b"", "dimensions": row["dimensions"] or []}
            if held and (size + len(row["payload"]) > self.limit or len(held) == MAX_DATASETS):
                yield held, file_bytes(held)
                held, size = [], 0
            held.append(row)
            size += len(row["payload"])
        if held:
            yield held, file_bytes(held)


class CapturesHdf5(DataSource):
    """spark.read.format("captures_hdf5").load(folder); options numericUnit (ms or s) and splitBytes. Write with .save(folder),
    option fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "captures_hdf5"

    def schema(self):
        return CAPTURE

    def reader(self, schema) -> Hdf5Reader:
        return Hdf5Reader(local_path(self.options["path"]), self.options.get("numericunit", "ms"), int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> Hdf5Writer:
        return Hdf5Writer(self.options["path"], int(self.options.get("filebytes", SPLIT_BYTES)), overwrite)


def file_bytes(rows: Iterable[dict]) -> bytes:
    """A file of captures: a superblock of version 0, symbol-table groups and contiguous datasets."""
    out = bytearray(96)

    def put(raw: bytes) -> int:
        place = len(out)
        out.extend(raw + bytes(-len(raw) % 8))
        return place

    def message(kind: int, body: bytes) -> bytes:
        body += bytes(-len(body) % 8)
        return struct.pack("<HHB3x", kind, len(body), 0) + body

    def header(*messages: bytes) -> int:
        body = b"".join(messages)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def element(kind: NumericType) -> bytes:
        dtype = np.dtype(kind.dtype)
        if dtype.kind == "f":
            size = dtype.itemsize
            rest = struct.pack("<HHBBBBI", 0, 8 * size, *((23, 8, 0, 23, 127) if size == 4 else (52, 11, 0, 52, 1023)))
            return struct.pack("<BBBBI", 0x11, 0x20, 8 * size - 1, 0, size) + rest
        return struct.pack("<BBBBIHH", 0x10, 8 * (dtype.kind == "i"), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)

    def attribute(name: str, kind: bytes, value: bytes) -> bytes:
        space = struct.pack("<BBBB4x", 1, 0, 0, 0)
        parts = [name.encode() + b"\0", kind, space]
        return message(_ATTRIBUTE, struct.pack("<BxHHH", 1, *map(len, parts)) + b"".join(p + bytes(-len(p) % 8) for p in parts) + value)

    def group(entries: dict[str, int]) -> bytes:
        names = sorted(entries, key=str.encode)
        data, offsets = bytearray(8), []
        for name in names:
            offsets.append(len(data))
            raw = name.encode() + b"\0"
            data.extend(raw + bytes(-len(raw) % 8))
        heap = put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(data), 1, len(out) + 32) + bytes(data))
        node = struct.pack("<4sBxH", b"SNOD", 1, len(names)) + b"".join(struct.pack("<QQ24x", o, entries[x]) for o, x in zip(offsets, names, strict=True))
        leaf = put(node.ljust(8 + 40 * 2 * leaf_k, b"\0"))
        tree = struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, NOWHERE, NOWHERE, 0, leaf, offsets[-1] if offsets else 0)
        return message(_SYMBOLS, struct.pack("<QQ", put(tree.ljust(24 + 8 * (2 * 32 + 1), b"\0")), heap))

    rows = list(rows)
    leaf_k = max(4, -(-len(rows) // 2))
    if len(rows) > MAX_DATASETS:
        raise ValueError(f"a file holds up to {MAX_DATASETS} captures")
    places = {}
    for i, row in enumerate(rows):
        kind, shape = BY_NAME[row["payload_type"]], row["dimensions"]
        data, stamp = put(row["payload"]), str(row["ts_ms"]).encode() + b"\0"
        space = struct.pack(f"<BBBB4x{len(shape)}Q", 1, len(shape), 0, 0, *shape)
        places[str(i)] = header(
            message(_DATASPACE, space), message(_DATATYPE, element(kind)), message(_LAYOUT, struct.pack("<BBQQ", 3, 1, data, len(row["payload"]))),
            attribute("timestamp", struct.pack("<BBBBI", 0x13, 0, 0, 0, len(stamp)), stamp),
            *(attribute(n, element(BY_NAME["DOUBLE"]), struct.pack("<d", row[c])) for n, c in (("Latitude", "lat"), ("Longitude", "lon"))),
        )
    root = header(group({"data": header(group(places))}))
    out[:96] = struct.pack("<8s8B2HIQQQQQQ24x", b"\x89HDF\r\n\x1a\n", 0, 0, 0, 0, 0, 8, 8, 0, leaf_k, 32, 0, 0, NOWHERE, len(out), NOWHERE, 0, root)
    return bytes(out)
