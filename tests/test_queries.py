"""Every registered query with SQL gives what the SQL gives, at the smallest size."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from sensorgrid import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def told(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(sql).df()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        return "null" if v is None or v is pd.NA or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)

    return sorted("|".join(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    expected = told(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_counts_by_instrument(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pruned_read_touches_fewer_files(spark):
    from sensorgrid.plans import manifest
    from sensorgrid.query import RangeQuery

    uri = catalogue._dataset(spark, SF)
    query = RangeQuery(time=(1704500000000, 1704600000000))
    pruned, whole = (manifest.read(spark, uri, query, use_manifest=x) for x in (True, False))
    assert pruned.count() == whole.count()
    assert len(pruned.inputFiles()) < len(whole.inputFiles()) == 8
    nothing = RangeQuery(latitude=(-90.0, -89.0))
    assert manifest.read(spark, uri, nothing).count() == 0


def test_filters_and_columns_reach_the_scan(spark):
    from sensorgrid.query import RangeQuery
    from sensorgrid.testdata import captures

    kept = RangeQuery(latitude=(5.0, 50.0)).apply(captures(spark, SF)).select("capture_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,5.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_every_capture_passes_through_blocks(spark):
    from sensorgrid.testdata import captures

    rows = captures(spark, SF)
    back = catalogue._through_blocks(rows).selectExpr("cast(cast(payload as string) as long) as capture_id", "ts_ms", "lat", "lon", "metadata")
    plain = lambda df: sorted((x.capture_id, x.ts_ms, x.lat, x.lon, sorted((x.metadata or {}).items())) for x in df.collect())
    assert plain(back) == plain(rows) and rows.count() > catalogue.BOX.apply(rows).count() > 0


def test_block_roundtrip_filters_only_what_was_decoded(spark):
    plan = catalogue.block_roundtrip(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow")
    assert "Filter" in above and "Filter" not in below
