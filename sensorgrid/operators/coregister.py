"""Co-registration: each capture of a secondary instrument is associated with one of the primary instrument.

Captures are put in the order of (time, latitude, longitude, id). Modes:

* walk: a secondary goes on from the last primary before it (the first if there is none) to the first primary that is
  strictly nearer than the one after it; the last primary takes the rest.
* adjacent: the nearer of the primaries right before and right after it; of equals the later.
* nearest: the primary at the least distance; of equals the first in order.

The result does not depend on how the data are partitioned. Positions alone are shuffled, never payloads. The order is
made by a range partitioning over the whole sort key, so that many captures of one time are split too; it is written down,
numbered within each range, and the ranges' few totals carry the numbers over. Primaries of one position are a run: as the
walk stops only where the next primary is farther, it goes from run to run, and any number of equal positions is one step.
Secondaries meet blocks of consecutive runs in an equi-join, which Spark may split where very many secondaries follow
one primary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.functions.distance import between
from sensorgrid.operators.captures import ORDER
from sensorgrid.storage import stored

MODES = ("walk", "adjacent", "nearest")
#: Runs that a walking secondary is offered at first, how many times more in each further round, and the most.
AHEAD, GROWTH, MAX_AHEAD = 8, 8, 4096


def numbered(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows with `j`, the number (from 0) of the last primary up to the row in order, and `r`, that of its run; -1 if there is none."""
    spark = captures.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.select("capture_id", "instrument", "ts_ms", "lat", "lon").repartitionByRange(ranges, *ORDER).withColumn("range", F.spark_partition_id())
    rows = stored(rows, "ordered")
    within = Window.partitionBy("range").orderBy(*ORDER)
    primary = F.coalesce(F.col("instrument") == 0, F.lit(False))
    before = F.last(F.when(primary, _point()), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("starts", (primary & ~F.col("before").eqNullSafe(_point())).cast("long"))
    rows = rows.withColumns({"j": F.sum(primary.cast("long")).over(within), "r": F.sum("starts").over(within)}).drop("before", "starts")
    rows = stored(rows, "numbered")
    place = F.struct(*ORDER)
    totals = rows.groupBy("range").agg(F.max("j").alias("n"), F.max("r").alias("runs"), F.min_by(F.when(primary, _point()), F.when(primary, place)).alias("first"), F.max_by(F.when(primary, _point()), F.when(primary, place)).alias("last"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    told = totals.withColumn("goes_on", (F.col("first").isNotNull() & F.col("first").eqNullSafe(F.last("last", ignorenulls=True).over(earlier))).cast("long"))
    told = told.select("range", "goes_on", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.col("runs") - F.col("goes_on")).over(earlier), F.lit(0)).alias("r0"))
    joined = rows.join(F.broadcast(told), "range")
    run = F.col("r0") + F.col("r") - 1 - F.when(F.col("r") > 0, F.col("goes_on")).otherwise(0)
    return joined.withColumns({"r": run, "j": F.col("n0") + F.col("j") - 1}).drop("n0", "r0", "goes_on", "range")


def _point() -> Column:
    return F.struct("ts_ms", "lat", "lon").alias("p")


def coregister(captures: DataFrame, mode: str = "walk", ranges: int | None = None, ahead: int = AHEAD) -> DataFrame:
    """Rows (capture_id, instrument, primary_id) for the secondaries of captures (capture_id, instrument, ts_ms, lat, lon).

    Instrument 0 is the primary; without a primary the result is empty.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    rows = numbered(captures, ranges)
    primaries = rows.where("instrument = 0").select("j", "r", F.col("capture_id").alias("primary_id"), _point())
    secondaries = rows.where("instrument <> 0").select("capture_id", "instrument", "j", "r", _point().alias("s"))
    if mode == "walk":
        return _walk(primaries, secondaries, ahead)
    adjacent = _adjacent(primaries, secondaries)
    return adjacent.select("capture_id", "instrument", "primary_id") if mode == "adjacent" else _nearest(primaries, adjacent)


def _walk(primaries: DataFrame, secondaries: DataFrame, ahead: int) -> DataFrame:
    # Where a walk stops in a run, it stops at the run's last primary.
    runs = stored(primaries.groupBy("r").agg(F.max_by("primary_id", "j").alias("primary_id"), F.any_value("p").alias("p")), "runs")
    last = runs.agg(F.max("r")).first()[0]
    if last is None:
        return secondaries.where(F.lit(False)).select("capture_id", "instrument", F.col("capture_id").alias("primary_id"))
    pending, done = secondaries.select("capture_id", "instrument", "s", F.greatest("r", F.lit(0)).alias("k")), None
    while True:
        # A block has its own runs and as many of the next: who is offered it sees at least `ahead` and one more.
        own = F.floor(F.col("r") / ahead)
        member = runs.select(F.explode(F.array_distinct(F.array(own, F.greatest(own - 1, F.lit(0))))).alias("block"), F.struct("r", "primary_id", "p").alias("c"))
        at = pending.withColumn("block", F.floor(F.col("k") / ahead))
        if done is not None:  # few are left, and few blocks are needed
            member = member.join(at.select("block").distinct(), "block", "left_semi")
        blocks = member.groupBy("block").agg(F.array_sort(F.collect_list("c")).alias("offered"))  # 2 * ahead at most
        following = F.filter("offered", lambda c: c["r"] >= F.col("k"))
        met = at.join(blocks, "block").withColumn("following", following)
        later = F.slice("following", 2, F.greatest(F.size("following"), F.lit(1)))
        stop = F.filter(F.zip_with("following", later, lambda a, b: F.when(between(F.col("s"), a["p"]) < between(F.col("s"), b["p"]), a)), lambda c: c.isNotNull())
        final = F.element_at("following", -1)
        found = F.coalesce(F.get(stop, 0), F.when(final["r"] == last, final))
        told = met.select("capture_id", "instrument", "s", found["primary_id"].alias("primary_id"), found.isNotNull().alias("met"), final["r"].alias("k"))
        told = stored(told, "walked")
        part = told.where("met").select("capture_id", "instrument", "primary_id")
        done = part if done is None else done.union(part)
        pending = told.where("not met").select("capture_id", "instrument", "s", "k")
        if pending.isEmpty():
            return done
        ahead = max(ahead, min(ahead * GROWTH, MAX_AHEAD))


def _adjacent(primaries: DataFrame, secondaries: DataFrame) -> DataFrame:
    """Rows (capture_id, instrument, s, primary_id, d)."""
    before = primaries.select("j", F.struct("primary_id", "p").alias("before"))
    after = primaries.select((F.col("j") - 1).alias("j"), F.struct("primary_id", "p").alias("after"))
    pairs = before.join(after, "j", "full")
    met = secondaries.join(pairs, "j")
    d1, d2 = between(F.col("s"), F.col("before.p")), between(F.col("s"), F.col("after.p"))
    first = F.col("after").isNull() | (F.col("before").isNotNull() & (d1 < d2))
    return met.select("capture_id", "instrument", "s", F.when(first, F.col("before.primary_id")).otherwise(F.col("after.primary_id")).alias("primary_id"), F.when(first, d1).otherwise(d2).alias("d"))


def _nearest(primaries: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Only distinct positions matter: those of secondaries, and the first primary of each run.

    The adjacent primary's distance bounds how far a nearer one can be in time, latitude and longitude. That span has a level, the
    power of two that covers it, and meets at most two cells of that level in each dimension; a run is in one cell of each
    level that occurs (64 at most).
    """
    bounded = stored(adjacent.withColumn("span", F.ceil("d")).withColumn("level", F.ceil(F.log2(2 * F.col("span") + 1)).cast("int")), "bounded")
    levels = bounded.select("level").distinct()
    width = F.pow(F.lit(2.0), F.col("level"))
    axes = ("ts_ms", "lat", "lon")
    cells = bounded.groupBy("s").agg(F.any_value("span").alias("span"), F.any_value("level").alias("level"))
    for axis in axes:
        ends = F.array(*(F.floor((F.col(f"s.{axis}") + side * F.col("span")) / width) for side in (-1, 1)))
        cells = cells.withColumn(f"cell_{axis}", F.explode(F.array_distinct(ends)))
    runs = primaries.groupBy("r").agg(F.min_by("primary_id", "j").alias("other_id"), F.any_value("p").alias("p"))
    spread = runs.join(F.broadcast(levels))  # levels: 64 rows at most
    spread = spread.withColumns({f"cell_{axis}": F.floor(F.col(f"p.{axis}") / width) for axis in axes})
    met = cells.join(spread, ["level", *(f"cell_{axis}" for axis in axes)]).where(F.abs(F.col("s.ts_ms") - F.col("p.ts_ms")) <= F.col("span"))
    best = met.groupBy("s").agg(F.min_by("other_id", F.struct(between(F.col("s"), F.col("p")), F.col("r"))).alias("primary_id"))
    return bounded.drop("primary_id").join(best, "s").select("capture_id", "instrument", "primary_id")


def per_primary(associations: DataFrame) -> DataFrame:
    """Number of associated captures by primary and instrument."""
    return associations.groupBy("primary_id", "instrument").agg(F.count("*").alias("n"))


def nested(associations: DataFrame, primaries: DataFrame) -> DataFrame:
    """Primaries with `associated`, a map from instrument to the ids associated with each."""
    one = associations.groupBy("primary_id", "instrument").agg(F.array_sort(F.collect_list("capture_id")).alias("ids"))
    every = one.groupBy("primary_id").agg(F.map_from_entries(F.collect_list(F.struct("instrument", "ids"))).alias("associated"))
    joined = primaries.join(every, primaries["capture_id"] == every["primary_id"], "left").drop("primary_id")
    return joined.withColumn("associated", F.coalesce("associated", F.create_map().cast(every.schema["associated"].dataType)))
