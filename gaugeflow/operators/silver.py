"""Bronze -> Silver: dimension lookup, range rules, quality score, enrichment.

Two rule sets:
* range rules (per-sensor normal range, multiplicative quality score), and
* sentinel rules (not null and -999 < v < 999, quality 1/0).
All rules are narrow column expressions; the only exchange is the dimension lookup,
which is a broadcast of a size-bounded configuration table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.operators.joins import lookup_join


def _rule(cond: Column) -> Column:
    """Null-safe rule: a NULL comparison (unknown sensor, NULL value) never fires."""
    return F.coalesce(cond, F.lit(False))


def range_rule_columns(value: Column, lo: Column, hi: Column) -> dict[str, Column]:
    """is_valid, quality_score and cleaned_value under the range rules.

    NaN: every comparison with NaN is false in the original rules (Python floats), while
    Spark orders NaN above all numbers, so each rule is guarded with ``NOT isnan``.
    The score is built in the original multiplication order 1.0*0.5*0.1*0.7 so doubles
    match bit for bit.
    """
    not_nan = ~F.isnan(value)
    extended = _rule(not_nan & ((value < lo * F.lit(fixed.EXTENDED_LOW)) |
                                (value > hi * F.lit(fixed.EXTENDED_HIGH))))
    extreme = _rule(not_nan & ((value < lo * F.lit(fixed.EXTREME_LOW)) |
                               (value > hi * F.lit(fixed.EXTREME_HIGH))))
    magnitude = _rule(not_nan & (F.abs(value) > F.lit(fixed.MAGNITUDE_LIMIT)))
    q1 = F.when(extended, F.lit(1.0) * F.lit(fixed.EXTENDED_FACTOR)).otherwise(F.lit(1.0))
    q2 = F.when(extreme, q1 * F.lit(fixed.EXTREME_FACTOR)).otherwise(q1)
    q3 = F.when(magnitude, q2 * F.lit(fixed.MAGNITUDE_FACTOR)).otherwise(q2)
    # The magnitude rule's "median of (value, value)" leaves the value unchanged.
    return {"is_valid": ~extreme, "quality_score": q3, "cleaned_value": value}


def silver_range(readings: DataFrame, dimension: DataFrame, dim_rows: int | None = None,
                 processed_ts: Column | None = None, passthrough: tuple[str, ...] = ()) -> DataFrame:
    """Range-rule Silver table (one row per reading).

    Output: id, sensor_id, sensor_type, cleaned_value, original_value, is_valid,
    quality_score, enriched_data{location, unit, metadata}, event_timestamp,
    processed_timestamp.
    """
    dim = dimension.select("sensor_id", F.col("normal_range.min").alias("_lo"),
                           F.col("normal_range.max").alias("_hi"))
    joined = lookup_join(readings, dim, "sensor_id", "left", dim_rows=dim_rows)
    rules = range_rule_columns(F.col("value"), F.col("_lo"), F.col("_hi"))
    metadata = (F.col("metadata") if "metadata" in readings.columns
                else F.create_map().cast("map<string,string>"))
    return joined.select(
        F.col("id"),
        F.col("sensor_id"),
        F.col("sensor_type"),
        rules["cleaned_value"].alias("cleaned_value"),
        F.col("value").alias("original_value"),
        rules["is_valid"].alias("is_valid"),
        rules["quality_score"].alias("quality_score"),
        F.struct(F.col("location").alias("location"), F.col("unit").alias("unit"),
                 metadata.alias("metadata")).alias("enriched_data"),
        F.col("timestamp").alias("event_timestamp"),
        (processed_ts if processed_ts is not None else F.current_timestamp()).alias("processed_timestamp"),
        *[F.col(c) for c in passthrough],
    )


def silver_sentinel(bronze: DataFrame, processed_ts: Column | None = None) -> DataFrame:
    """Sentinel-rule Silver table: bronze columns + is_valid, cleaned_value, quality_score,
    processed_timestamp."""
    v = F.col("value")
    valid = F.coalesce(v.isNotNull() & (v > F.lit(fixed.SENTINEL_LOW)) & (v < F.lit(fixed.SENTINEL_HIGH)),
                       F.lit(False))
    return (bronze
            .withColumn("is_valid", F.when(valid, F.lit(True)).otherwise(F.lit(False)))
            .withColumn("cleaned_value", F.when(F.col("is_valid"), v).otherwise(F.lit(0.0)))
            .withColumn("quality_score", F.when(F.col("is_valid"), F.lit(1.0)).otherwise(F.lit(0.0)))
            .withColumn("processed_timestamp",
                        processed_ts if processed_ts is not None else F.current_timestamp()))


def add_ingestion_metadata(readings: DataFrame, ingestion_ts: Column | None = None) -> DataFrame:
    """Bronze metadata: ingestion time and source name."""
    return (readings
            .withColumn("ingestion_timestamp",
                        ingestion_ts if ingestion_ts is not None else F.current_timestamp())
            .withColumn("source", F.lit(fixed.SOURCE_NAME)))


def valid_only(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("is_valid"))
