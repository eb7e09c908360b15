"""The registered queries of the capture engine and the SQL that states the same results."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.functions import names, ranges
from sensorgrid.functions.distance import distance
from sensorgrid.functions.payload import as_bytes, as_longs, as_shorts, mapped, n_samples, packed, threshold16, threshold_samples
from sensorgrid.functions.timestamps import millis, parse_millis
from sensorgrid.operators.captures import edges, first_rows, host_frequency, host_load, least_loaded, tagged_union
from sensorgrid.operators import naive
from sensorgrid.operators.coregister import coregister, nested, per_primary
from sensorgrid.plans import manifest
from sensorgrid.query import RangeQuery
from sensorgrid.sources import block, hdf5
from sensorgrid.sources.dispatch import CAPTURE_DDL, open_captures, save_captures
from sensorgrid.storage import checkpoint_dir
from sensorgrid.testdata import captures, samples, table, tied_captures

TIME = (1704500000000, 1705500000000)
BOX = RangeQuery(time=TIME, latitude=(5.0, 50.0), longitude=(10.0, 120.0))

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The capture view in SQL.
_CAP = """cap as (
  select event_id as capture_id, epoch_us(ts) // 1000 as ts_ms, value as lat, cast(user_id as double) as lon,
         cast(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) - 1 as integer) as instrument, props from events)"""
_TIED = """cap as (
  select o_orderkey as capture_id, epoch_us(o_orderdate) // 1000 as ts_ms, cast(o_custkey % 20 as double) as lat, cast(o_custkey % 7 as double) as lon,
         cast(o_orderkey % 4 as integer) as instrument from orders)"""
_BOX = "ts_ms between 1704500000000 and 1705500000000 and lat between 5 and 50 and lon between 10 and 120"


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _position(df: DataFrame) -> DataFrame:
    return df.select("capture_id", "ts_ms", "lat", "lon", "instrument")


# Scans, filters and counts


@_query(f"with {_CAP} select instrument, count(*) as n, min(ts_ms) as ts_min, max(ts_ms) as ts_max from cap where ts_ms between 1704500000000 and 1705500000000 and lat between 5 and 50 group by instrument")
def filter_count_by_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = RangeQuery(time=TIME, latitude=(5.0, 50.0)).apply(captures(spark, sf_dir))
    return kept.groupBy("instrument").agg(F.count("*").alias("n"), F.min("ts_ms").alias("ts_min"), F.max("ts_ms").alias("ts_max"))


@_query("select count(*) as n from events")
def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).agg(F.count("*").alias("n"))


def _filtered(name: str, query: RangeQuery, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _position(query.apply(captures(spark, sf_dir)))

    run.__name__ = name
    _query(f"with {_CAP} select capture_id, ts_ms, lat, lon, instrument from cap where {sql}")(run)


_filtered("filter_time", RangeQuery(time=TIME), "ts_ms between 1704500000000 and 1705500000000")
_filtered("filter_lat", RangeQuery(latitude=(5.0, 50.0)), "lat between 5 and 50")
_filtered("filter_lon", RangeQuery(longitude=(10.0, 120.0)), "lon between 10 and 120")
_filtered("filter_box", BOX, _BOX)


def _dataset(spark: SparkSession, sf_dir: str) -> str:
    """The captures as a clustered dataset with its manifest, in the shared folder."""
    uri = _folder(spark)
    manifest.ingest(captures(spark, sf_dir), uri, files=8)
    return uri


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/captures-{uuid.uuid4().hex}"


@_query(_SQL["filter_box"])
def filter_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _position(manifest.read(spark, _dataset(spark, sf_dir), BOX))


@_query(_SQL["filter_box"])
def filter_unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _position(manifest.read(spark, _dataset(spark, sf_dir), BOX, use_manifest=False))


@_query(f"with {_CAP} select ts_ms // 86400000 as day, count(*) as n, min(ts_ms) as ts_min, max(ts_ms) as ts_max, min(lat) as lat_min, max(lat) as lat_max, min(lon) as lon_min, max(lon) as lon_max from cap group by 1")
def manifest_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.zones(captures(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / 86400000)), "day")


@_query("select (select count(*) from events) as n_rows, 8 as n_files")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = manifest.manifest(spark, _dataset(spark, sf_dir))
    return told.agg(F.sum("n").alias("n_rows"), F.count("*").cast("int").alias("n_files"))


@_query("""with z as (select p_partkey as id, p_size as lo, p_size + p_partkey % 10 as hi from part) select id, lo, hi from z where hi >= 20 and lo <= 25""")
def zone_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 10).alias("hi"))
    return z.where(ranges.intersects(F.col("lo"), F.col("hi"), F.lit(20), F.lit(25)))


@_query("select page_id, url from pages where starts_with(url, 'http://ththre.example.com/')")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").where(names.in_dataset(F.col("url"), "http://ththre.example.com/"))


@_query(f"""with {_CAP}, z as (select ts_ms // 86400000 as day, min(ts_ms) as a, max(ts_ms) as b, min(lat) as c, max(lat) as d from cap group by 1)
select day from z where b >= 1704500000000 and a <= 1705500000000 and d >= 5 and c <= 50""")
def spec_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = manifest.zones(captures(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / 86400000)), "day")
    entries = manifest.index_entry(told.withColumn("file", F.col("day").cast("string")))
    kept = entries.where(RangeQuery(time=TIME, latitude=(5.0, 50.0)).specs_predicate())
    return kept.select(F.col("blocks")[0]["file_name"].cast("long").alias("day"))


@_query("select i as instrument, count(*) as n, cast(sum(id) as bigint) as ids from (select 0 as i, o_orderkey as id from orders union all select 1, l_orderkey from lineitem) group by i")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return tagged_union([a, b]).groupBy("instrument").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# Payloads

_SAMPLES = "s as (select vec_id as capture_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 32767) as smallint)) as samples from embeddings)"


@_query(f"with {_SAMPLES} select capture_id, array_to_string(list_transform(samples, lambda x: case when x > 0 then x else 0 end), ',') as samples from s")
def threshold16_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("capture_id", F.array_join(threshold_samples("samples"), ",").alias("samples"))


@_query(f"with {_SAMPLES} select capture_id, array_to_string(list_transform(samples, lambda x: case when x > 100 then x else 0 end), ',') as samples from s")
def threshold16_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = samples(spark, sf_dir).select("capture_id", threshold16(packed("samples", "INT16"), 100).alias("payload"))
    return raw.select("capture_id", F.array_join(as_shorts("payload"), ",").alias("samples"))


@_query(f"with {_SAMPLES} select count(*) as n, cast(sum(list_sum(list_transform(samples, lambda x: case when x > 0 then x else 0 end))) as bigint) as total from s")
def threshold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(threshold_samples("samples"), F.lit(0).cast("long"), lambda a, x: a + x)
    return samples(spark, sf_dir).select(total.alias("t")).agg(F.count("*").alias("n"), F.sum("t").alias("total"))


@_query("select o_orderkey as id, len(cast(o_orderkey as varchar)) * 1 as n_bytes, ascii(o_orderstatus) as first_byte from orders")
def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), as_bytes(F.concat(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).cast("binary")).alias("b"))
    return raw.select("id", (F.size("b") - 1).cast("long").alias("n_bytes"), F.col("b")[0].cast("int").alias("first_byte"))


@_query("select o_orderkey as id, o_orderkey as first, o_custkey as second from orders")
def payload_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), as_longs(packed(F.array("o_orderkey", "o_custkey"), "INT64")).alias("v"))
    return raw.select("id", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


@_query("select n_nationkey as id, reverse(n_name) as payload from nation")
def payload_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), mapped(F.col("n_name").cast("binary"), lambda b: b[::-1]).alias("payload"))
    return raw.select("id", F.col("payload").cast("string").alias("payload"))


@_query("select p_partkey as id, cast(p_size as bigint) * (p_partkey % 7) * 2 as n from part")
def shape_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 7).cast("int"), F.lit(2))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), n_samples(shape).alias("n"))


# Metadata and documents


@_query("select event_id as capture_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.absent') as absent from events")
def metadata_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("capture_id", F.try_element_at("metadata", F.lit("k")).alias("k"), F.try_element_at("metadata", F.lit("absent")).alias("absent"))


@_query(f"""with {_CAP}, z as (select ts_ms // 86400000 as day, min(ts_ms) as ts_min, max(ts_ms) as ts_max, min(lat) as lat_min, max(lat) as lat_max from cap group by 1)
select cast(day as varchar) as file, ts_min, ts_max, lat_min, lat_max from z""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = manifest.zones(captures(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / 86400000)), "day").withColumn("file", F.col("day").cast("string"))
    back = manifest.from_json(manifest.to_json(manifest.index_entry(told)))
    return back.select(
        F.col("blocks")[0]["file_name"].alias("file"), F.col("specs")[0]["date_range"]["gte"].alias("ts_min"), F.col("specs")[0]["date_range"]["lte"].alias("ts_max"),
        F.col("specs")[1]["geo_range"]["gte"].alias("lat_min"), F.col("specs")[1]["geo_range"]["lte"].alias("lat_max"),
    )


@_query("""select event_id as capture_id, '@' || (epoch_us(ts) // 1000) || ' (' || printf('%.6f', value) || ', ' || printf('%.6f', cast(user_id as double)) || ') {k=' || json_extract_string(props, '$.k') || '}' as text from events""")
def rendered_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("capture_id", names.rendered().alias("text"))


# Aggregates, orders and sets


@_query(f"with {_CAP} select count(*) filter (where {_BOX}) as n, count(*) as total from cap")
def conditional_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).agg(F.count_if(BOX.predicate()).alias("n"), F.count("*").alias("total"))


_BLOCKS = "b as (select l_orderkey as id, cast(l_quantity as bigint) as size, ['host' || (l_suppkey % 7), 'host' || (7 + l_partkey % 5)] as locations from lineitem)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = lambda n: F.concat(F.lit("host"), n.cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("long").alias("size"), F.array(host(F.col("l_suppkey") % 7), host(7 + F.col("l_partkey") % 5)).alias("locations")
    )


@_query(f"with {_BLOCKS} select host, count(*) as n from (select unnest(locations) as host from b) group by host")
def host_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_frequency(_blocks(spark, sf_dir))


@_query(f"with {_BLOCKS} select host, cast(sum(size) as bigint) as bytes from (select unnest(locations) as host, size from b) group by host")
def size_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_load(_blocks(spark, sf_dir))


@_query(f"with {_BLOCKS}, s as (select host, cast(sum(size) as bigint) as bytes from (select unnest(locations) as host, size from b) group by host) select host, bytes from s order by bytes, host limit 1")
def least_loaded_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return least_loaded(_blocks(spark, sf_dir))


@_query(f"""with {_CAP}, o as (select *, row_number() over (partition by instrument order by ts_ms, lat, lon, capture_id) as f, row_number() over (partition by instrument order by ts_ms desc, lat desc, lon desc, capture_id desc) as l from cap)
select instrument, max(capture_id) filter (where f = 1) as first_id, max(capture_id) filter (where l = 1) as last_id from o group by instrument""")
def group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(captures(spark, sf_dir), "instrument")
    return found.select("instrument", F.col("first.capture_id").alias("first_id"), F.col("last.capture_id").alias("last_id"))


@_query(f"with {_CAP} select capture_id, ts_ms, lat, lon, instrument from cap order by ts_ms, lat, lon, capture_id limit 10")
def lex_sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _position(first_rows(captures(spark, sf_dir)))


@_query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def size_desc_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@_query(f"with {_BLOCKS} select distinct unnest(locations) as host from b")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select(F.explode("locations").alias("host")).distinct()


@_query("select o_orderkey as id, array_to_string(list_concat([o_orderkey, o_custkey], list_filter([o_custkey, o_orderkey % 5], lambda x: x > 2)), ',') as ids from orders")
def concat_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.array(F.col("o_custkey"), F.col("o_orderkey") % 5), lambda x: x > 2)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.concat(F.array("o_orderkey", "o_custkey"), kept), ",").alias("ids"))


# Scalar functions


@_query("""with t as (select event_id, cast(ts as timestamp) as ts, epoch_us(ts) // 1000 as ms from events)
select event_id, case event_id % 6 when 1 then (ms // 1000) * 1000 when 5 then null when 3 then (ms // 1000) * 1000 + 21600000 else ms end as ms from t""")
def ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, k = F.col("ts"), F.col("event_id") % 6
    at = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
    text = (
        F.when(k == 0, F.replace(at, F.lit(" "), F.lit("T"))).when(k == 1, F.replace(F.substr(at, F.lit(1), F.lit(19)), F.lit(" "), F.lit("'T'"))).when(k == 2, at)
        .when(k == 3, F.concat(F.substr(at, F.lit(1), F.lit(19)), F.lit(".000000 CST-0600"))).when(k == 4, millis("ts").cast("string")).otherwise(F.lit("n/a"))
    )
    return table(spark, sf_dir, "events").select("event_id", parse_millis(text).alias("ms"))


@_query("""select p_partkey as id, p_name like '%widget' as is_widget, split_part('file:' || p_size || ':' || p_partkey, ':', 2) as start_at,
  'part-' || lpad(cast(p_partkey as varchar), 6, '0') || '_block' || lpad(cast(p_size as varchar), 3, '0') || '.p2irc.bin' as file,
  'data/' || p_partkey as inner_name, regexp_extract('hdfs://x/' || p_brand, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) as scheme, '/root/' || p_partkey as clean from part""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), names.has_suffix(F.col("p_name"), "Widget").alias("is_widget"), names.block_part(F.concat_ws(":", F.lit("file"), "p_size", "p_partkey"), 2).alias("start_at"),
        names.block_file_name(F.col("p_partkey"), F.col("p_size")).alias("file"), names.without_prefix(F.concat(F.lit("/root/data/"), key), "/root").alias("inner_name"),
        names.scheme(F.concat(F.lit("hdfs://x/"), F.col("p_brand"))).alias("scheme"), names.without_slash(F.concat(F.lit("/root/"), key, F.lit("//"))).alias("clean"),
    )


@_query(f"with {_CAP} select capture_id, sqrt(cast(ts_ms - 1704500000000 as double) * cast(ts_ms - 1704500000000 as double) + (lat - 5) * (lat - 5) + (lon - 10) * (lon - 10)) as d from cap")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = F.lit(TIME[0]), F.lit(5.0), F.lit(10.0)
    return captures(spark, sf_dir).select("capture_id", distance(F.col("ts_ms"), F.col("lat"), F.col("lon"), *here).alias("d"))


@_query("""with p as (select p_partkey as id, cast(floor(p_retailprice) as bigint) as length, p_size as n from part),
q as (select *, greatest(1, least(n, (length + 127) // 128)) as parts from p), r as (select *, unnest(range(parts)) as i from q)
select id, i as part, i * (n // parts) as start_at, case when i = parts - 1 then n else (i + 1) * (n // parts) end as end_at from r""")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits that the array-file reader makes of a file of so many bytes and datasets."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("long").alias("length"), F.col("p_size").cast("long").alias("n"))

    def plan(read: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in read:
            yield pd.DataFrame([(r.id, i, a, b) for r in batch.itertuples() for i, (a, b) in enumerate(hdf5.splits(r.length, r.n, 128))], columns=["id", "part", "start_at", "end_at"])

    return files.mapInPandas(plan, "id long, part long, start_at long, end_at long")


# Range algebra

_PAIRS = """r as (select l_orderkey as k, l_linenumber as l, l_linenumber as a0, l_linenumber + l_suppkey % 5 as a1, l_partkey % 2 = 0 as ai, 1 + l_suppkey % 3 as b0, 4 + l_partkey % 4 as b1, l_suppkey % 2 = 0 as bi from lineitem)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, p = (F.col(f"l_{c}").cast("long") for c in ("linenumber", "suppkey", "partkey"))
    a = ranges.range_of(n, n + s % 5, p % 2 == 0, p % 2 == 0)
    b = ranges.range_of(1 + s % 3, 4 + p % 4, s % 2 == 0, s % 2 == 0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), a.alias("a"), b.alias("b"))


_IN = "({1}0 < {0}0 or {1}0 = {0}0 and ({1}i or not {0}i)) and ({1}1 > {0}1 or {1}1 = {0}1 and ({1}i or not {0}i))".format


@_query(f"with {_PAIRS} select k, l, {_IN('a', 'b')} as inside from r")
def range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("k", "l", ranges.contains(F.col("b"), F.col("a")).alias("inside"))


@_query(f"with {_PAIRS}, q as (select k, l, {_IN('a', 'b')} as x, {_IN('b', 'a')} as y, a0, b0 from r) select k, l, x as a_in_b, case when x then b0 when y then a0 end as wider, x or y as compatible from q")
def range_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.array(F.struct(F.lit("timestamp").alias("key"), F.col(c).alias("range")))
    a, b = one("a"), one("b")
    return _pairs(spark, sf_dir).select("k", "l", ranges.is_subset(a, b).alias("a_in_b"), ranges.combine(a, b)[0]["range"]["min"].alias("wider"), ranges.partitioning_compatible(a, b).alias("compatible"))


@_query(f"with {_BLOCKS} select id, locations[1] = 'host3' or locations[2] = 'host3' as on_host, list_has_any(locations, ['host1', 'host8']) as shares from b")
def location_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.array(F.lit("host1"), F.lit("host8"))
    return _blocks(spark, sf_dir).select("id", ranges.on_host(F.col("locations"), "host3").alias("on_host"), ranges.location_compatible(F.col("locations"), other).alias("shares"))



# Co-registration

_D = "sqrt(cast({0}ts_ms - {1}ts_ms as double) * cast({0}ts_ms - {1}ts_ms as double) + ({0}lat - {1}lat) * ({0}lat - {1}lat) + ({0}lon - {1}lon) * ({0}lon - {1}lon))".format
_NUMBERED = """o as (select *, cast(sum(case when instrument = 0 then 1 else 0 end) over (order by ts_ms, lat, lon, capture_id) as bigint) as k from cap),
p as (select capture_id as primary_id, ts_ms, lat, lon, k as j from o where instrument = 0),
s as (select capture_id, instrument, ts_ms, lat, lon, k from o where instrument <> 0)"""
_WALK = f"""pp as (select p.*, n.ts_ms as n_ts, n.lat as n_lat, n.lon as n_lon from p left join p n on n.j = p.j + 1),
c as (select s.capture_id, s.instrument, min(pp.j) as j from s join pp on pp.j >= greatest(s.k, 1) where pp.n_ts is null or {_D('s.', 'pp.')} < {_D('s.', 'pp.n_').replace('pp.n_ts_ms', 'pp.n_ts')} group by all),
a as (select c.capture_id, c.instrument, p.primary_id from c join p using (j))"""


@_query(f"with {_CAP}, {_NUMBERED}, {_WALK} select capture_id, instrument, primary_id from a")
def coregister_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coregister(captures(spark, sf_dir), "walk")


@_query(f"""with {_CAP}, {_NUMBERED}, a as (select s.*, b.primary_id as b_id, n.primary_id as n_id, {_D('s.', 'b.')} as db, {_D('s.', 'n.')} as dn from s left join p b on b.j = s.k left join p n on n.j = s.k + 1)
select capture_id, instrument, case when n_id is null or db < dn then b_id else n_id end as primary_id from a where b_id is not null or n_id is not null""")
def coregister_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coregister(captures(spark, sf_dir), "adjacent")


@_query(f"""with {_CAP}, {_NUMBERED} select s.capture_id, s.instrument, arg_min(p.primary_id, {{'d': {_D('s.', 'p.')}, 'j': p.j}}) as primary_id from s, p group by all""")
def coregister_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coregister(captures(spark, sf_dir), "nearest")


@_query(f"with {_CAP}, {_NUMBERED}, {_WALK} select primary_id, instrument, count(*) as n from a group by all")
def coregister_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_primary(coregister(captures(spark, sf_dir), "walk"))


@_query(f"with {_TIED}, {_NUMBERED}, {_WALK} select capture_id, instrument, primary_id from a")
def coregister_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coregister(tied_captures(spark, sf_dir), "walk")


@_query(f"""with {_CAP}, {_NUMBERED}, {_WALK}, m as (select primary_id, instrument, array_to_string(list(cast(capture_id as varchar) order by capture_id), ',') as ids from a group by all),
n as (select primary_id, string_agg(instrument || '=' || ids, ';' order by instrument) as associated from m group by all)
select p.primary_id as capture_id, coalesce(n.associated, '') as associated from p left join n using (primary_id)""")
def nested_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every primary with the captures associated with it, by instrument."""
    rows = captures(spark, sf_dir)
    every = nested(coregister(rows, "walk"), rows.where("instrument = 0").select("capture_id"))
    entry = lambda e: F.concat_ws("=", e["key"].cast("string"), F.array_join(e["value"], ","))
    return every.select("capture_id", F.array_join(F.transform(F.array_sort(F.map_entries("associated")), entry), ";").alias("associated"))


# Formats: what is written and read again is what was there


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_payload(captures(spark, sf_dir))


def _with_payload(rows: DataFrame) -> DataFrame:
    """Captures with all that the formats hold; the payload is the id."""
    told = F.col("capture_id").cast("string")
    return rows.select(
        told.alias("capture_id"), "ts_ms", "lat", "lon", F.array(F.length(told)).alias("dimensions"), F.lit("UINT8").alias("payload_type"), "metadata", told.cast("binary").alias("payload")
    )


def _read_back(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("payload").cast("string").cast("long").alias("capture_id"), "ts_ms", "lat", "lon", F.col("dimensions")[0].cast("long").alias("n"), F.try_element_at("metadata", F.lit("k")).alias("k"))


_KEPT = "capture_id, ts_ms, lat, lon, cast(length(cast(capture_id as varchar)) as bigint) as n"


@_query(f"with {_CAP} select {_KEPT}, json_extract_string(props, '$.k') as k from cap")
def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures through block files of a folder: a part of them appended to the rest."""
    rows, uri = _whole(spark, sf_dir), _folder(spark)
    part = F.col("capture_id").cast("long") % 3 == 0
    save_captures(rows.where(~part), uri, "block")
    save_captures(rows.where(part), uri, "block", "append")
    return _read_back(open_captures(spark, uri))


@_query(f"with {_CAP} select {_KEPT}, json_extract_string(props, '$.k') as k from cap where {_BOX}")
def block_files_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of a box, from those block files whose zones meet it."""
    uri = _folder(spark)
    save_captures(_whole(spark, sf_dir).repartitionByRange(16, "ts_ms", "lat", "lon"), uri, "block")
    return _read_back(open_captures(spark, uri, BOX))


@_query(f"with {_CAP} select {_KEPT}, cast(null as varchar) as k from cap")
def array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures through array files of a folder, which hold no metadata."""
    uri = _folder(spark)
    save_captures(_whole(spark, sf_dir), uri, "hdf5")
    return _read_back(open_captures(spark, uri))


@_query(f"with {_CAP} select ts_ms // 86400000 as day, count(*) as n from cap where {_BOX} group by 1")
def array_files_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of a box in array files, counted by day."""
    uri = _folder(spark)
    save_captures(_whole(spark, sf_dir), uri, "hdf5")
    return open_captures(spark, uri, BOX).groupBy(F.floor(F.col("ts_ms") / 86400000).alias("day")).agg(F.count("*").alias("n"))


@_query(_SQL["filter_box"].replace(", instrument from", " from"))
def naive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box over array files by a plain loop in each task, without the engine's predicate."""
    uri = _folder(spark)
    save_captures(_whole(spark, sf_dir), uri, "hdf5")
    kept = naive.kept(open_captures(spark, uri).select("payload", "ts_ms", "lat", "lon"), BOX)
    return kept.select(F.col("payload").cast("string").cast("long").alias("capture_id"), "ts_ms", "lat", "lon")


@_query(f"with {_CAP} select {_KEPT}, json_extract_string(props, '$.k') as k from cap where {_BOX}")
def block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures encoded as blocks and decoded within their task; then those of a box."""
    return _read_back(BOX.apply(_through_blocks(captures(spark, sf_dir))))


def _through_blocks(rows: DataFrame) -> DataFrame:
    """Captures as blocks give them back, a block for each Arrow batch."""

    def run(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read:
            records = b"".join(map(block.encode, batch.to_pylist()))
            yield from block.batches(struct.pack("<i", 4 + len(records)) + records, "block")

    return _with_payload(rows).mapInArrow(run, CAPTURE_DDL)
