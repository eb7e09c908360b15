"""Views of the driver's tables as captures and what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.functions.timestamps import millis

#: Event types in the order of their instrument number; the first is the primary.
INSTRUMENTS = ("signup", "view", "click", "purchase", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: value is the latitude, the user the longitude, the type the instrument."""
    instrument = F.array_position(F.array(*map(F.lit, INSTRUMENTS)), F.col("event_type")).cast("int") - 1
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("capture_id"),
        millis("ts").alias("ts_ms"),
        F.col("value").alias("lat"),
        F.col("user_id").cast("double").alias("lon"),
        instrument.alias("instrument"),
        F.from_json("props", "map<string,string>").alias("metadata"),
    )


def tied_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures with few distinct times and places."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("capture_id"),
        millis("o_orderdate").alias("ts_ms"),
        (F.col("o_custkey") % 20).cast("double").alias("lat"),
        (F.col("o_custkey") % 7).cast("double").alias("lon"),
        (F.col("o_orderkey") % 4).cast("int").alias("instrument"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 16-bit samples."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767).cast("smallint"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), scaled.alias("samples"))
