"""Gap filling, clipping, correlation, rates, latency, detector metrics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.scan import PIECE, carry, carry_many, time_bucket, with_pieces


def _epoch_seconds(c: Column) -> Column:
    # Works for TIMESTAMP and TIMESTAMP_NTZ (session time zone is UTC).
    return F.unix_micros(c.cast("timestamp")).cast("double") / F.lit(1e6)


def forward_fill(series: DataFrame, key: str = "sensor_id", time_col: str = "event_timestamp",
                 order_cols: tuple[str, ...] = ("event_timestamp", "id"),
                 value_col: str = "value", out_col: str = "filled_value",
                 bucket_unit: str = "hour", pieces: str = "auto") -> DataFrame:
    """Each NULL value replaced by the last non-NULL value of its key (leading NULLs stay).

    ``pieces``: how a key's series is cut for the scan (``scan.with_pieces``)."""
    df = with_pieces(series, key, list(order_cols), time_bucket(time_col, bucket_unit), pieces)
    return carry(df, key, list(order_cols), F.col(value_col), out_col, PIECE).drop(PIECE)


def interpolate(series: DataFrame, key: str = "sensor_id", time_col: str = "event_timestamp",
                order_cols: tuple[str, ...] = ("event_timestamp", "id"),
                value_col: str = "value", out_col: str = "interpolated_value",
                bucket_unit: str = "hour", pieces: str = "auto") -> DataFrame:
    """Linear interpolation in time between the nearest non-NULL neighbours of a NULL.

    Gaps at either end of a series stay NULL; a known value is kept as is. Both scans
    share one piece assignment (``scan.with_pieces``) and one pass (``scan.carry_many``).
    """
    point = F.when(F.col(value_col).isNotNull(),
                   F.struct(_epoch_seconds(F.col(time_col)).alias("t"), F.col(value_col).alias("v")))
    df = with_pieces(series, key, list(order_cols), time_bucket(time_col, bucket_unit), pieces)
    df = carry_many(df, key, list(order_cols), PIECE,
                    [(point, "_prev", False), (point, "_next", True)]).drop(PIECE)
    t = _epoch_seconds(F.col(time_col))
    p, n = F.col("_prev"), F.col("_next")
    span = n["t"] - p["t"]
    est = F.when(span == 0, p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / span)
    return (df.withColumn(out_col, F.when(F.col(value_col).isNotNull(), F.col(value_col)).otherwise(est))
            .drop("_prev", "_next"))


def clip_to_range(silver_with_range: DataFrame, value_col: str = "cleaned_value",
                  lo_col: str = "range_min", hi_col: str = "range_max",
                  low_factor: float = 0.5, high_factor: float = 1.5,
                  out_col: str = "clipped_value") -> DataFrame:
    """Clip values into the extended range [min*0.5, max*1.5]; unknown sensors unchanged."""
    v, lo, hi = F.col(value_col), F.col(lo_col) * low_factor, F.col(hi_col) * high_factor
    clipped = F.when(lo.isNull() | hi.isNull(), v).otherwise(F.least(F.greatest(v, lo), hi))
    return silver_with_range.withColumn(out_col, clipped)


def correlation_to_group(series: DataFrame, key: str = "sensor_id", group: str = "sensor_type",
                         time_col: str = "event_timestamp", value_col: str = "cleaned_value",
                         bucket_unit: str = "hour", min_points: int = 3) -> DataFrame:
    """Pearson correlation of each sensor's resampled series with its group's series.

    Linear in the data: the group series is an aggregate joined back on (group, bucket);
    no sensor pairs are enumerated. Both sides are pre-aggregated per bucket.
    """
    b = time_bucket(time_col, bucket_unit).alias("bucket")
    per_sensor = series.groupBy(key, group, b).agg(F.avg(value_col).alias("x"))
    per_group = series.groupBy(group, b).agg(F.avg(value_col).alias("y"))
    j = per_sensor.join(per_group, [group, "bucket"], "inner")
    g = j.groupBy(key, group).agg(F.corr("x", "y").alias("corr_to_group"),
                                   F.count(F.lit(1)).alias("points"))
    return g.where(F.col("points") >= min_points)


def pair_correlation(series: DataFrame, pairs: DataFrame, key: str = "sensor_id",
                     time_col: str = "event_timestamp", value_col: str = "cleaned_value",
                     bucket_unit: str = "hour") -> DataFrame:
    """Correlation for an explicit list of (sensor_a, sensor_b) pairs on shared buckets."""
    b = time_bucket(time_col, bucket_unit).alias("bucket")
    s = series.groupBy(key, b).agg(F.avg(value_col).alias("x"))
    a = pairs.join(s.withColumnRenamed(key, "sensor_a").withColumnRenamed("x", "xa"), "sensor_a")
    ab = a.join(s.withColumnRenamed(key, "sensor_b").withColumnRenamed("x", "xb"), ["sensor_b", "bucket"])
    return ab.groupBy("sensor_a", "sensor_b").agg(F.corr("xa", "xb").alias("corr"),
                                                   F.count(F.lit(1)).alias("points"))


def anomaly_history(anomalies: DataFrame, key: str = "sensor_id", time_col: str = "timestamp",
                    unit: str = "day") -> DataFrame:
    """Per sensor and day: predictions, anomalies and the anomaly rate."""
    day = F.date_trunc(unit, F.col(time_col)).alias("period")
    g = anomalies.groupBy(key, day).agg(F.count(F.lit(1)).alias("predictions"),
                                         F.count_if(F.col("is_anomaly")).alias("anomalies"))
    return g.withColumn("anomaly_rate", F.col("anomalies") / F.col("predictions"))


def confusion(df: DataFrame, predicted: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision and recall of a boolean prediction vs a boolean label."""
    p, a = F.col(predicted), F.col(actual)
    g = df.groupBy(*(by or [])).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (g.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)))
             .withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn))))


def retain_recent(df: DataFrame, time_col: str, days: int) -> DataFrame:
    """Rows within ``days`` of the newest time in the table.

    The newest time is one scalar aggregate (answered from Parquet footers' statistics
    when possible); it becomes a literal so the filter is pushed into the scan.
    """
    newest = df.agg(F.max(time_col)).first()[0]
    if newest is None:
        return df.limit(0)
    return df.where(F.col(time_col) >= F.lit(newest) - F.expr(f"INTERVAL {int(days)} DAYS"))
