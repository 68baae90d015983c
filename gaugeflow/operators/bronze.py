"""Bronze envelope: readings nested per ingestion batch, and the inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed

READING_FIELDS = ["id", "sensor_id", "sensor_type", "value", "unit", "timestamp", "location", "metadata"]


# Largest envelope array; a bigger batch is split over several envelope rows.
MAX_ENVELOPE_READINGS = 100_000


def nest_batches(readings: DataFrame, batch_id: Column, ingestion_ts: Column | None = None,
                 max_readings: int = MAX_ENVELOPE_READINGS) -> DataFrame:
    """One envelope row per batch: id, sensor_readings ARRAY<STRUCT>, ingestion_timestamp,
    source, batch_id, part, first_pos. Readings are sorted by id inside an envelope.

    No array holds an unbounded group: one partial count finds the batches with more than
    ``max_readings`` readings (a small table, broadcast only behind a size check); only their
    readings get a position in the batch, counted piece by piece, and are cut by it into envelopes of
    ``max_readings``. ``first_pos`` is the position of an envelope's first reading (0 for every ordinary batch)."""
    from gaugeflow.operators.blocked import ordered_positions
    from gaugeflow.operators.joins import lookup_join
    from gaugeflow.session import materialize
    fields = [c for c in READING_FIELDS if c in readings.columns]
    r = readings.withColumn("batch_id", batch_id).select("batch_id", *fields)
    big = (r.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > max_readings).select("batch_id", F.lit(True).alias("_big")))
    big = materialize(big, "oversized-batches")  # usually empty; check and join read it
    flagged = lookup_join(r, big, "batch_id", "left")
    ordinary = flagged.where(F.col("_big").isNull()).drop("_big").withColumn("part", F.lit(0))
    if not big.isEmpty():
        placed = ordered_positions(flagged.where(F.col("_big")).drop("_big"), "batch_id", ["id"])
        cut = placed.withColumn("part", F.floor((F.col("pos") - 1) / F.lit(max_readings)).cast("int")).drop("pos")
        ordinary = ordinary.unionByName(cut)
    env = (ordinary.groupBy("batch_id", "part")
           .agg(F.array_sort(F.collect_list(F.struct(*fields)),
                             lambda l, r: F.when(l["id"] < r["id"], -1).when(l["id"] > r["id"], 1)
                             .otherwise(0)).alias("sensor_readings")))
    key = F.when(F.col("part") == 0, F.col("batch_id").cast("string")).otherwise(
        F.concat(F.col("batch_id").cast("string"), F.lit("/"), F.col("part").cast("string")))
    return env.select(
        F.sha2(key, 256).substr(1, 32).alias("id"),
        "sensor_readings",
        (ingestion_ts if ingestion_ts is not None else F.current_timestamp()).alias("ingestion_timestamp"),
        F.lit(fixed.SOURCE_NAME).alias("source"),
        "batch_id", "part", (F.col("part") * F.lit(max_readings)).cast("long").alias("first_pos"))


def unnest_batches(envelopes: DataFrame) -> DataFrame:
    """Flat readings back from envelopes, with batch_id and position in the whole batch."""
    first = F.col("first_pos") if "first_pos" in envelopes.columns else F.lit(0).cast("long")
    ex = envelopes.select("batch_id", first.alias("_first"), F.posexplode("sensor_readings").alias("_at", "r"))
    return ex.select("batch_id", (F.col("_first") + F.col("_at")).alias("pos"), "r.*")
