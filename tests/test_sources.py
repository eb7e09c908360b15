"""Block files, array files and the jobs: what is written is read again."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorgrid.jobs import main
from sensorgrid.operators import naive
from sensorgrid.query import RangeQuery
from sensorgrid.schema import BY_NAME, NUMERIC_TYPES, numeric_type
from sensorgrid.sources import block, hdf5
from sensorgrid.sources.dispatch import block_files, format_of, open_captures, read_blocks, register, save_captures
from sensorgrid.sources.folder import Written
from sensorgrid.streaming import arriving


def made(n, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        kind, shape = r.choice(NUMERIC_TYPES), [r.randint(1, 4) for _ in range(r.randint(1, 3))]
        payload = np.arange(int(np.prod(shape))).astype(kind.dtype).tobytes()
        rows.append({"capture_id": "", "ts_ms": 1527856200250 + i, "lat": 52.0 + i, "lon": -106.5, "dimensions": shape, "payload_type": kind.name, "metadata": None, "payload": payload})
    return rows


FIELDS = ("ts_ms", "lat", "lon", "dimensions", "payload_type", "payload")


def only(rows):
    return [tuple(r[f] for f in FIELDS) for r in rows]


@given(st.lists(st.tuples(st.integers(-(2**62), 2**62), st.floats(allow_nan=False), st.sampled_from([t.name for t in NUMERIC_TYPES]), st.lists(st.integers(0, 5), max_size=3), st.none() | st.dictionaries(st.text(max_size=5), st.none() | st.text(max_size=9), max_size=3), st.binary(max_size=40)), max_size=5), st.binary(max_size=7))
@settings(max_examples=60, deadline=None)
def test_block_codec(rows, stale):
    told = [{"ts_ms": t, "lat": x, "lon": -x, "payload_type": k, "dimensions": d, "metadata": m, "payload": p} for t, x, k, d, m, p in rows]
    body = b"".join(map(block.encode, told))
    found = list(block.decode(struct.pack("<i", 4 + len(body)) + body + stale, "b"))
    assert only(found) == only(told)
    assert [None if r["metadata"] is None else dict(r["metadata"]) for r in found] == [r["metadata"] for r in told]


def test_block_errors():
    for raw in (b"", b"\1\0", struct.pack("<i", 99), struct.pack("<iB", 5, 9)):
        with pytest.raises((ValueError, struct.error)):
            list(block.decode(raw, "b"))
    assert list(block.decode(struct.pack("<i", 4), "b")) == []


def test_array_file():
    rows = made(300)
    assert only(hdf5.captures(hdf5.file_bytes(rows), "f")) == only(rows)
    assert only(hdf5.captures(hdf5.file_bytes(rows), "f", 10, 12)) == only(rows[10:12])
    assert list(hdf5.captures(hdf5.file_bytes([]), "f")) == []
    with pytest.raises(hdf5.Unsupported):
        hdf5.File(b"something else entirely")


def test_splits_cover_all_datasets():
    assert hdf5.splits(10, 7, 100) == [(0, 7)]
    assert hdf5.splits(300, 7, 100) == [(0, 2), (2, 4), (4, 7)]
    assert hdf5.splits(300, 0, 100) == []


def test_numeric_types():
    assert numeric_type("integer", 2, True).name == "INT16" and numeric_type("integer", 8).name == "UINT64" and numeric_type("float", 4).name == "FLOAT"
    with pytest.raises(ValueError):
        numeric_type("enum", 4)
    assert [t.name for t in BY_NAME.values()][:3] == ["UINT8", "INT8", "UINT16"]


@pytest.fixture
def folders(tmp_path):
    for name, n in (("a", 30), ("b", 7)):
        os.makedirs(tmp_path / "in" / name)
        (tmp_path / "in" / name / "one.hdf5").write_bytes(hdf5.file_bytes(made(n)))
    return tmp_path


def test_jobs(spark, folders):
    for name, n in (("a", 30), ("b", 7)):
        assert main(["ingest", f"{folders}/in/{name}", f"{folders}/pq/{name}"]) == n
    assert main(["ingest", f"{folders}/pq/a", f"{folders}/blk", "--format", "block"]) == 30
    assert main(["count", f"{folders}/blk"]) == 30
    times = ["--time-gte", "1527856200255", "--time-lte", "1527856200260"]
    assert main(["filter", f"{folders}/pq/a", *times]) == main(["filter", f"{folders}/pq/a", "--no-manifest", *times]) == main(["filter", f"{folders}/blk", *times]) == 6
    assert main(["threshold", f"{folders}/pq/a", f"{folders}/thr", "--longitude-gte=-107.5", "--longitude-lte=-100"]) == 30
    assert main(["coregister", f"{folders}/pq", f"{folders}/co", "a", "b", "--time-gte", "0", "--time-lte", "2000000000000"]) == 7


def test_blocks_are_cut_and_overwritten(spark, folders):
    rows = open_captures(spark, f"{folders}/in/a")
    register(spark)
    target = f"{folders}/cut"
    rows.coalesce(1).write.format("captures_block").option("blockBytes", "300").mode("append").save(target)
    names = sorted(os.listdir(target))
    assert len(names) > 5 and names[0].startswith("part-000000_block000-") and names[0].endswith(block.SUFFIX)
    (folders / "cut" / "part-000009_block000.p2irc.bin").write_bytes(struct.pack("<i", 4))
    by_source = spark.read.format("captures_block").load(target)
    assert sorted(only(r.asDict() for r in by_source.collect())) == sorted(only(r.asDict() for r in read_blocks(spark, target).collect()))
    save_captures(rows.limit(3), target, "block", "overwrite")
    assert read_blocks(spark, target).count() == 3


@pytest.mark.parametrize("kind", ["block", "hdf5", "parquet"])
def test_no_mode_loses_rows(spark, folders, kind):
    rows, target = open_captures(spark, f"{folders}/in/a"), f"{folders}/out"
    save_captures(rows, target, kind)
    with pytest.raises(FileExistsError):
        save_captures(rows.limit(3), target, kind)
    assert open_captures(spark, target).count() == 30
    for n in (35, 40):
        save_captures(rows.limit(5), target, kind, "append")
        assert open_captures(spark, target).count() == n
    save_captures(rows.limit(7), target, kind, "overwrite")
    assert open_captures(spark, target).count() == 7
    with pytest.raises(FileExistsError):
        save_captures(rows, target, "parquet" if kind == "block" else "block", "overwrite")
    with pytest.raises(ValueError):
        save_captures(rows, target, kind, "ignore")


def test_failed_writes_leave_all_as_it_was(spark, folders):
    rows, target = open_captures(spark, f"{folders}/in/a"), f"{folders}/out"
    save_captures(rows, target, "block")
    before = sorted(os.listdir(target))
    bad = rows.withColumn("payload_type", F.when(F.col("ts_ms") % 2 == 0, F.col("payload_type")).otherwise("NONE"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            save_captures(bad, target, "block", mode)
        assert sorted(os.listdir(target)) == before
    writer = block.BlockWriter(target, 100, True)  # a commit that fails when files are renamed leaves the old ones
    with pytest.raises(FileNotFoundError):
        writer.commit([Written([{"staged": "_staged-none/x", "file": "y" + block.SUFFIX}])])
    assert open_captures(spark, target).count() == 30


def test_array_files_keep_what_they_hold(spark, folders):
    rows = open_captures(spark, f"{folders}/in/a")
    save_captures(rows, f"file://{folders}/h", "hdf5")
    assert sorted(only(r.asDict() for r in open_captures(spark, f"{folders}/h").collect())) == sorted(only(r.asDict() for r in rows.collect()))


def test_block_files_are_pruned(spark, folders):
    rows, target = open_captures(spark, f"{folders}/in/a"), f"{folders}/z"
    save_captures(rows.repartitionByRange(6, "ts_ms"), target, "block")
    query = RangeQuery(time=(1527856200255, 1527856200260))
    files = block_files(spark, target, query)
    assert 0 < len(files) < 6
    (folders / "z" / "unlisted.p2irc.bin").write_bytes((folders / "z" / files[0].rpartition("/")[2]).read_bytes())
    told = sorted(r.ts_ms for r in open_captures(spark, target, query).collect())
    assert told == sorted(r.ts_ms for r in open_captures(spark, target, query, use_manifest=False).collect()) and len(told) > 6
    assert open_captures(spark, target, RangeQuery(time=(1, 2))).count() == 0


def test_arriving_files_are_read_once(spark, folders):
    rows, target = open_captures(spark, f"{folders}/in/a"), f"{folders}/s"
    save_captures(rows, target, "block")

    def drain():
        arriving(spark, target, RangeQuery(latitude=(60.0, 100.0))).select("ts_ms").writeStream.format("parquet").option("checkpointLocation", f"{folders}/cp").trigger(availableNow=True).start(f"{folders}/got").awaitTermination(60)
        return spark.read.parquet(f"{folders}/got").count()

    assert drain() == 22
    save_captures(rows.where("lat = 70"), target, "block", "append")
    assert drain() == 23


def test_plain_loop_takes_the_same_rows(spark, folders):
    rows, query = open_captures(spark, f"{folders}/in/a"), RangeQuery(time=(1527856200255, 1527856200270), latitude=(60.0, 100.0))
    assert {r.ts_ms for r in naive.kept(rows, query).collect()} == {r.ts_ms for r in query.apply(rows).collect()} != set()


def test_formats_are_told_apart(spark, folders):
    assert format_of(spark, f"{folders}/in/a") == "hdf5"
    os.makedirs(folders / "none")
    with pytest.raises(ValueError):
        format_of(spark, f"{folders}/none")


def test_range_options():
    with pytest.raises(ValueError):
        RangeQuery()
    with pytest.raises(ValueError):
        RangeQuery(time=(1, None))
    with pytest.raises(ValueError):
        main(["filter", "/none", "--latitude-lte", "5"])
