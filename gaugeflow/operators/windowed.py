"""Event-time sliding-window features (batch and streaming share one definition)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.session import compiled_methods

# Panes of a window up to which windows are put together from panes side by side; wider ones are grouped by window.
MOST_PANES = 12


def interval_micros(interval: str) -> int:
    """Length of an interval of fixed length ("5 minutes") in microseconds."""
    spark = SparkSession.active()
    return spark.sql(f"SELECT unix_micros(TIMESTAMP_MICROS(0) + INTERVAL {interval}) AS us").first()["us"]


def _merged(parts: Column) -> Column:
    """Count, mean and sum of squared deviations of several panes together (structs n, mean, m2)."""
    def add(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * (b["n"] / n)).alias("mean"),
                        (a["m2"] + b["m2"] + d * d * (a["n"] * b["n"] / n)).alias("m2"))

    full = F.filter(parts, lambda p: p["n"] > 0)
    return F.when(F.size(full) > 0, F.aggregate(F.slice(full, 2, F.size(full)), full[0], add))


def window_aggregate(silver: DataFrame, time_col: str = "event_timestamp",
                     duration: str = fixed.WINDOW_DURATION, slide: str = fixed.WINDOW_SLIDE,
                     value_col: str = "cleaned_value", key: str = "sensor_id",
                     suffix: str = "5min", valid_only: bool = True,
                     watermark: str | None = None, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """mean, sample std, min, max, count, range per (sensor, sliding window); the window
    start becomes ``timestamp``.

    In batch, rows are aggregated once, per pane (the common divisor of duration and slide), with a
    partial (map-side) aggregate, so a hot sensor is pre-combined before the shuffle and no row is copied; the panes
    of a sensor (bounded by its time, not by its rows) are then merged with those that follow them as counts, means and sums
    of squared deviations, so that no window is shuffled. Windows of more than ``MOST_PANES`` panes are grouped
    instead. A stream keeps one aggregate per window, which the watermark
    bounds: each row is expanded into its duration/slide windows.
    """
    df = silver.where(F.col("is_valid")) if valid_only else silver
    if watermark:
        df = df.withWatermark(time_col, watermark)
    keys, v = [key, *extra_keys], F.col(value_col)
    if df.isStreaming:
        g = df.groupBy(*keys, F.window(F.col(time_col), duration, slide)).agg(
            F.avg(v).alias(f"mean_{suffix}"), F.stddev_samp(v).alias(f"std_{suffix}"), F.min(v).alias(f"min_{suffix}"),
            F.max(v).alias(f"max_{suffix}"), F.count(v).alias(f"count_{suffix}"))
    else:
        g = _from_panes(df, keys, time_col, duration, slide, v, suffix)
    return (g.withColumn(f"range_{suffix}", F.col(f"max_{suffix}") - F.col(f"min_{suffix}"))
            .withColumn("timestamp", F.col("window.start"))
            .drop("window"))


def _from_panes(df: DataFrame, keys: list[str], time_col: str, duration: str, slide: str, v: Column, suffix: str) -> DataFrame:
    pane = math.gcd(interval_micros(duration), interval_micros(slide))
    n = F.count(v)
    panes = df.groupBy(*keys, F.window(F.col(time_col), f"{pane} microseconds").alias("_pane")).agg(
        n.alias("_n"), F.struct(n.cast("double").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2")).alias("_part"),
        F.min(v).alias("_min"), F.max(v).alias("_max"))
    # a window holds a pane exactly if it holds the pane's start
    panes = panes.withColumn("_at", F.col("_pane.start")).drop("_pane")
    most = interval_micros(duration) // pane
    g = _by_next_panes(panes, keys, duration, slide, most) if most <= MOST_PANES else _by_windows(panes, keys, duration, slide)
    std = F.when(F.col("_all.n") > 1, F.sqrt(F.col("_all.m2") / (F.col("_all.n") - 1)))
    return g.select(*keys, "window", F.col("_all.mean").alias(f"mean_{suffix}"), std.alias(f"std_{suffix}"),
                    F.col("_min").alias(f"min_{suffix}"), F.col("_max").alias(f"max_{suffix}"), F.col("_n").alias(f"count_{suffix}"))


def _by_next_panes(panes: DataFrame, keys: list[str], duration: str, slide: str, most: int) -> DataFrame:
    """Windows from their first pane and the at most ``most`` - 1 panes behind it; panes are shuffled once, windows never."""
    compiled_methods(panes.sparkSession)
    w = Window.partitionBy(*keys).orderBy("_at")
    looks = [F.lead(F.struct("_at", "_n", "_part", "_min", "_max"), i).over(w).alias(f"_p{i}") for i in range(1, most)]
    row = panes.select(*keys, "_at", F.struct("_at", "_n", "_part", "_min", "_max").alias("_p0"), F.lag("_at").over(w).alias("_before"), *looks)
    row = row.withColumn("window", F.window("_at", duration, slide))
    # every window once: with the pane that no other pane of the window comes before
    row = row.where(F.col("_before").isNull() | (F.col("_before") < F.col("window.start")))
    row = row.select(*keys, "window", *[F.when(F.col(f"_p{i}._at") < F.col("window.end"), F.col(f"_p{i}")).alias(f"_p{i}") for i in range(most)])

    def each(name: str) -> list[Column]:
        return [F.col(f"_p{i}.{name}") for i in range(most)]

    def total(parts: list[Column]) -> Column:
        return sum((F.coalesce(c, F.lit(0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0)))

    def pick(f: Callable[..., Column], parts: list[Column]) -> Column:
        return f(*parts) if len(parts) > 1 else parts[0]

    ns, means, devs = each("_part.n"), each("_part.mean"), each("_part.m2")
    row = row.select("*", total(ns).alias("_all_n"), F.coalesce(*means).alias("_first"), total(each("_n")).alias("_n"),
                     pick(F.least, each("_min")).alias("_min"), pick(F.greatest, each("_max")).alias("_max"))
    row = row.withColumn("_all_mean", F.col("_first") + total([n * (m - F.col("_first")) for n, m in zip(ns, means)]) / F.col("_all_n"))
    m2 = total([d + n * (m - F.col("_all_mean")) * (m - F.col("_all_mean")) for n, m, d in zip(ns, means, devs)])
    return row.select(*keys, "window", "_n", "_min", "_max", F.when(F.col("_all_n") > 0, F.struct(
        F.col("_all_n").alias("n"), F.col("_all_mean").alias("mean"), m2.alias("m2"))).alias("_all"))


def _by_windows(panes: DataFrame, keys: list[str], duration: str, slide: str) -> DataFrame:
    return panes.groupBy(*keys, F.window("_at", duration, slide)).agg(
        F.sum("_n").alias("_n"), _merged(F.sort_array(F.collect_list("_part"))).alias("_all"),
        F.min("_min").alias("_min"), F.max("_max").alias("_max"))


def tumbling_counts(df: DataFrame, time_col: str, every: str = "1 hour",
                    by: list[str] | None = None) -> DataFrame:
    """Rows per tumbling interval (ingestion rate)."""
    keys = [F.window(F.col(time_col), every)] + [F.col(c) for c in (by or [])]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("readings"))
    return g.withColumn("interval_start", F.col("window.start")).drop("window")
