"""Adapters from the given tables to the readings model.

A reading row: id BIGINT (unique, the final tie-break key), sensor_id, sensor_type, value,
unit, timestamp (event time), location, metadata MAP<STRING,STRING>.
All are projections, so Catalyst prunes the scan to the columns used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.sources.tables import table


def readings_from_events(events: DataFrame) -> DataFrame:
    zone = (F.col("user_id") % fixed.EVENT_ZONES).cast("string")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit("_"), zone).alias("sensor_id"),
        F.col("event_type").alias("sensor_type"),
        F.col("value").cast("double").alias("value"),
        F.lit("u").alias("unit"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("zone_"), zone).alias("location"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"),
    )


def readings_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Second, larger series: sensor = supplier, value = quantity, time = ship date.

    (orderkey, linenumber) is not unique, so the id is a 64-bit hash of the full ordering
    key; the series order is (timestamp, orderkey, linenumber, value) and remaining ties
    carry equal values, so every order-dependent feature is well defined.
    """
    return lineitem.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                   "l_extendedprice", "l_shipdate").alias("id"),
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("sensor_id"),
        F.lit("lineitem").alias("sensor_type"),
        F.col("l_quantity").alias("value"),
        F.lit("units").alias("unit"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("location"),
        F.create_map(F.lit("orderkey"), F.col("l_orderkey").cast("string"),
                     F.lit("linenumber"), F.col("l_linenumber").cast("string")).alias("metadata"),
        F.col("l_orderkey").alias("ord1"),
        F.col("l_linenumber").alias("ord2"),
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(table(spark, sf_dir, "events"))


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_lineitem(table(spark, sf_dir, "lineitem"))


def events_sensor_filter(sensor_id: str):
    """Predicate on the raw ``events`` columns equivalent to ``sensor_id = <id>``.

    ``sensor_id`` is derived (type || '_' || zone), so a filter on it cannot reach the
    Parquet reader; this form can: ``event_type = <type>`` is pushed into the scan
    (row-group pruning), the zone test runs right after it."""
    etype, _, zone = sensor_id.rpartition("_")
    if not etype or not zone.isdigit():
        return F.lit(False)
    zone_of = (F.col("user_id") % fixed.EVENT_ZONES).cast("string")  # same expression as the adapter
    return (F.col("event_type") == F.lit(etype)) & (zone_of == F.lit(zone))
