"""Read queries of the service API as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions import scalar as X
from gaugeflow.operators.blocked import group_limit, newest_per_key
from gaugeflow.operators.joins import latest_per_key


def health(spark: SparkSession, model_path: str | None = None, model_ready: bool | None = None) -> dict:
    """status, pipeline_initialized, pipeline_health, model_version, streaming (active queries), timestamp.

    The pipeline is initialized once a model is published under ``model_path`` (``iforest.current``); without a folder the
    caller says so by ``model_ready``."""
    import datetime as _dt
    from gaugeflow.operators import iforest
    served = iforest.current(spark, model_path) if model_path else None
    ready = served is not None if model_path else bool(model_ready)
    return {"status": "healthy", "pipeline_initialized": ready, "pipeline_health": "healthy" if ready else "initializing",
            "model_version": served and served["model_version"], "streaming": len(spark.streams.active) > 0,
            "timestamp": _dt.datetime.now(_dt.timezone.utc)}


def dashboard_stats(bronze: DataFrame, silver: DataFrame, features: DataFrame, anomalies: DataFrame,
                    dimension: DataFrame, model_ready: bool = True, model_path: str | None = None) -> DataFrame:
    """One row of pipeline counters: batches ingested (distinct ``batch_id``, however many
    envelopes hold a batch), rows per stage, configured sensors, and health. Each table
    contributes a one-row partial aggregate; one global aggregate folds them (no cross join).

    ``bronze`` is either the envelope table or flat readings with their batch_id; health follows from the
    models published under ``model_path``, or from ``model_ready`` where there is no folder."""
    if model_path:
        model_ready = health(silver.sparkSession, model_path)["pipeline_initialized"]
    zero = F.lit(0).cast("long")
    readings = F.sum(F.size("sensor_readings")).cast("long") if "sensor_readings" in bronze.columns else F.count(F.lit(1))
    parts = {
        "total_ingested": bronze.select("batch_id").distinct().agg(F.count(F.lit(1))),
        "total_readings": bronze.agg(readings),
        "total_processed": silver.agg(F.count(F.lit(1))),
        "total_features": features.agg(F.count(F.lit(1))),
        "total_anomalies": anomalies.agg(F.count_if(F.col("is_anomaly"))),
        "active_sensors": dimension.agg(F.count(F.lit(1))),
    }
    cols = list(parts)
    rows = [df.toDF(name).select(*[F.col(c) if c == name else zero.alias(c) for c in cols])
            for name, df in parts.items()]
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    return u.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in cols]).withColumn(
        "pipeline_health", X.health_label(model_ready))


def list_sensors(silver: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every configured sensor with its type, location, unit and normal range, and how many
    readings of it there are (0 and no last_seen without any). Unknown sensors are not listed."""
    seen = silver.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("readings"),
                                           F.max("event_timestamp").alias("last_seen"))
    dim = dimension.select("sensor_id", "type", "location", "unit",
                           F.col("normal_range.min").alias("range_min"),
                           F.col("normal_range.max").alias("range_max"))
    return dim.join(seen, "sensor_id", "left").withColumn("readings", F.coalesce("readings", F.lit(0).cast("long")))


def recent_readings(silver: DataFrame, sensor_id: str, limit: int = 50,
                    order_cols: tuple[str, ...] = ("event_timestamp", "id")) -> DataFrame:
    """Newest ``limit`` Silver rows of one sensor (point filter pushed to the scan,
    TakeOrderedAndProject for the top-k)."""
    return (silver.where(F.col("sensor_id") == F.lit(sensor_id))
            .orderBy(*[F.col(c).desc() for c in order_cols]).limit(limit))


def recent_per_sensor(silver: DataFrame, limit: int = 50,
                      order_cols: tuple[str, ...] = ("event_timestamp", "id")) -> DataFrame:
    """Newest ``limit`` rows of every sensor with their position (WindowGroupLimit; beyond its threshold piece by
    piece, see ``blocked.newest_per_key``)."""
    if limit > group_limit(silver):
        return newest_per_key(silver, "sensor_id", list(order_cols), order_cols[0], limit, out="position")
    w = Window.partitionBy("sensor_id").orderBy(*[F.col(c).desc() for c in order_cols])
    return silver.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def recent_anomalies(anomalies: DataFrame, limit: int = 20,
                     order_cols: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    return (anomalies.where(F.col("is_anomaly"))
            .orderBy(*[F.col(c).desc() for c in order_cols]).limit(limit))


def latest_features(features: DataFrame, sensor_id: str | None = None,
                    order_cols: tuple[str, ...] = ("event_timestamp", "id")) -> DataFrame:
    """Newest feature row per sensor (optionally one sensor)."""
    df = features if sensor_id is None else features.where(F.col("sensor_id") == F.lit(sensor_id))
    return latest_per_key(df, "sensor_id", list(order_cols))


def sensor_card(silver: DataFrame, order_cols: tuple[str, ...] = ("event_timestamp", "id")) -> DataFrame:
    """Per sensor: latest value with unit, quality %, validity label, corrected flag, count."""
    order = F.struct(*[F.col(c) for c in order_cols])
    latest = F.max_by(F.struct(F.col("cleaned_value").alias("v"),
                               F.col("original_value").alias("o"),
                               F.col("quality_score").alias("q"),
                               F.col("is_valid").alias("ok"),
                               F.col("enriched_data.unit").alias("unit")), order)
    g = silver.groupBy("sensor_id").agg(latest.alias("l"), F.count(F.lit(1)).alias("record_count"))
    return g.select(
        "sensor_id",
        X.format_value(F.col("l.v"), F.col("l.unit")).alias("latest_value"),
        X.quality_percent(F.col("l.q")).alias("quality"),
        X.validity_label(F.col("l.ok")).alias("status"),
        X.was_corrected(F.col("l.v"), F.col("l.o")).alias("was_corrected"),
        "record_count")


def alerts(anomalies: DataFrame) -> DataFrame:
    """Warning rows for anomalous predictions."""
    return (anomalies.where(F.col("is_anomaly"))
            .withColumn("message", F.format_string("ANOMALY DETECTED - Sensor: %s, Score: %.3f",
                                                   F.col("sensor_id"), F.col("anomaly_score"))))
