from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import names, ranges
from sensorgrid.functions.payload import samples, threshold16
from sensorgrid.functions.timestamps import parse_millis
from sensorgrid.operators.captures import spread, tagged_union
from sensorgrid.sources.hdf5 import parse_timestamp

TIMES = {
    "2018-06-01T12:30:00.250": 1527856200250,
    "2018-06-01T12:30:00": 1527856200000,
    "2018-06-01'T'12:30:00.250": 1527856200250,
    "2018-06-01'T'12:30:00": 1527856200000,
    "2018-06-01 12:30:00.250000 CST-0600": 1527877800250,
    "2018-06-01 12:30:00.250": 1527856200250,
    "2018-06-01 12:30:00": 1527856200000,
    "1527856200250": 1527856200250,
    "noon": None,
    "2018-13-01 00:00:00": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in [*TIMES, None]], "t string")
        assert {r.t: r.m for r in df.select("t", parse_millis(F.col("t")).alias("m")).collect()} == TIMES | {None: None}
        assert df.where("t = '1527856200250'").select(parse_millis(F.substr("t", F.lit(1), F.lit(10)), "s")).first()[0] == 1527856200000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_reader_has_the_same_timestamps():
    for text, ms in TIMES.items():
        if ms is None:
            with pytest.raises(ValueError):
                parse_timestamp(text)
        else:
            assert parse_timestamp(text) == ms


def test_threshold_of_payloads(spark):
    raw = bytes.fromhex("0100ffff0080050105")
    df = spark.createDataFrame([(raw,), (None,), (b"",)], "p binary")
    found = df.select(threshold16("p").alias("s"), threshold16("p", 4, signed=False).alias("u"), samples("p", "UINT16").alias("v")).collect()
    assert bytes(found[0].s) == bytes.fromhex("010000000000050100") and bytes(found[0].u) == bytes.fromhex("0000ffff0080050100")
    assert found[0].v == [1, 65535, 32768, 261] and found[1].s is None and found[2].v == []


def test_range_algebra(spark):
    def of(a, b, x=True, y=True):
        return ranges.range_of(F.lit(a), F.lit(b), x, y)

    cases = [(of(0, 9), of(1, 8), True), (of(0, 9), of(0, 9), True), (of(0, 9, False), of(0, 9), False), (of(0, 9), of(1, 9, True, False), True), (of(0, 9, True, False), of(1, 9), False), (of(0, 9), of(1, 10), False)]
    row = spark.range(1).select(*(ranges.contains(a, b).alias(str(i)) for i, (a, b, _) in enumerate(cases))).first()
    assert list(row) == [x for _, _, x in cases]
    none = F.array().cast("array<struct<key:string,range:struct<min:int,max:int,min_inclusive:boolean,max_inclusive:boolean>>>")
    one = F.array(F.struct(F.lit("lat").alias("key"), of(1, 2).alias("range")))
    hosts = F.array().cast("array<string>")
    row = spark.range(1).select(ranges.partitioning_compatible(none, none), ranges.partitioning_compatible(none, one), ranges.location_compatible(hosts, hosts), ranges.location_compatible(hosts, F.array(F.lit("a")))).first()
    assert list(row) == [True, False, True, False]


def test_prefix_is_a_folder(spark):
    df = spark.createDataFrame([("/a/b/f",), ("/a/b2/f",), ("/a/b",)], "f string")
    assert [r[0] for r in df.select(names.in_dataset(F.col("f"), "/a/b/")).collect()] == [True, False, False]
    assert df.select(names.without_prefix(F.col("f"), "/a/b")).first()[0] == "f"


def test_spread_and_union(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df, 3).rdd.getNumPartitions() == 3 and spread(spark.range(0, 10, 1, 8), 3).rdd.getNumPartitions() == 8
    assert tagged_union([df, df]).where("instrument = 1").count() == 10
    with pytest.raises(ValueError):
        tagged_union([])


def test_streams_take_the_same_query(spark, tmp_path):
    from sensorgrid.query import RangeQuery

    spark.range(10).selectExpr("id as ts_ms").write.parquet(f"{tmp_path}/in")
    stream = RangeQuery(time=(2, 4)).apply(spark.readStream.schema("ts_ms long").parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("kept").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("kept").count() == 3
