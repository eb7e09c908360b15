"""Files of captures that tasks write into one folder, of any store that pyarrow opens (file, hdfs, s3, gs).

A task writes its files under names that no reader lists. On commit the driver gives them their final names, each with the write's own
id, so that no write can replace another's files; the files that an overwrite replaces go after that, and the manifest of the new
ones comes last. Files of failed attempts go with the write's staging folder.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from sensorgrid.schema import MANIFEST

#: Folder of the manifest beside the files.
ZONES = "zones"
_BOUNDS = (("ts_ms", "ts"), ("lat", "lat"), ("lon", "lon"))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def files_in(uri: str, suffix: str) -> list[fs.FileInfo]:
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.lower().endswith(suffix)), key=lambda f: f.base_name)


def zone_of(name: str, size: int, rows: list[dict]) -> dict:
    """The manifest entry of a file of captures; nulls and what is not a number take no part."""
    out = {"file": name, "n": len(rows), "size": size}
    for column, zone in _BOUNDS:
        known = [r[column] for r in rows if r[column] is not None and r[column] == r[column]]
        out |= {f"{zone}_min": min(known, default=None), f"{zone}_max": max(known, default=None)}
    return out


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict]


class FolderWriter(DataSourceArrowWriter):
    """Subclasses say how rows are cut into files."""

    suffix, stem = "", ""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.id = uri, overwrite, uuid.uuid4().hex[:12]

    def files(self, rows: Iterator[dict]) -> Iterable[tuple[list[dict], bytes]]:
        """The rows of each file, and its bytes."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = opened(self.uri)
        part, entries = TaskContext.get().partitionId(), []
        rows = (row for batch in iterator for row in batch.to_pylist())
        for k, (held, raw) in enumerate(self.files(rows)):
            if not k:
                system.create_dir(f"{path}/_staged-{self.id}", recursive=True)
            name = f"part-{part:06d}_{self.stem}{k:03d}-{self.id}{self.suffix}"
            staged = f"_staged-{self.id}/{uuid.uuid4().hex}"
            with system.open_output_stream(f"{path}/{staged}") as out:
                out.write(raw)
            entries.append(zone_of(name, len(raw), held) | {"staged": staged})
        return Written(entries)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.uri)
        system.create_dir(path, recursive=True)
        old = [f.path for f in files_in(self.uri, self.suffix)] if self.overwrite else []
        told = system.get_file_info(fs.FileSelector(f"{path}/{ZONES}", allow_not_found=True)) if self.overwrite else []
        entries = [e for m in messages if m for e in m.entries]
        for e in entries:
            system.move(f"{path}/{e['staged']}", f"{path}/{e['file']}")
        for name in [*old, *(f.path for f in told if f.is_file)]:
            system.delete_file(name)
        if entries:
            system.create_dir(f"{path}/{ZONES}", recursive=True)
            out = io.BytesIO()
            pq.write_table(pa.Table.from_pylist([{f.name: e[f.name] for f in MANIFEST} for e in entries], to_arrow_schema(MANIFEST)), out)
            with system.open_output_stream(f"{path}/{ZONES}/{self.id}.parquet") as target:
                target.write(out.getvalue())
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.uri))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        staged = f"{path}/_staged-{self.id}"
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)
