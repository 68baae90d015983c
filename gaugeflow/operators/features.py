"""Time-series features per sensor.

* ``snapshot_features``: one 30-feature vector per sensor over its newest ``max_history``
  valid rows (one ranking window + one grouped aggregation of conditional aggregates).
* ``history_features``: per-row lags, rolling statistics and changes.
* ``expanding_features``: one full vector per prefix of each sensor's series (the
  training matrix), all as window aggregates over growing/sliding frames.

Conventions: ``v`` is the value column; the series of a sensor is ordered by
``order_cols`` ascending (event time, then a unique id). Statistics follow the original
definitions: population std (ddof 0), bias-adjusted skewness/kurtosis (0 for a
constant series), OLS slope against the position 0..n-1, change_rate divides by n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.functions.scalar import sample_kurtosis, sample_skewness
from gaugeflow.session import compiled_methods

# Above this many rows in one sensor, per-sensor windows switch to the blocked plan
# (bounded pieces per task). Checked with one partial aggregation over the series. Both plans
# give the same rows; sums are taken in another order, so values agree within about 1e-9.
SINGLE_TASK_ROWS = 2_000_000


def _use_blocked(df: DataFrame, key: str, method: str) -> bool:
    if method == "blocked":
        return True
    if method == "window":
        return False
    from gaugeflow.operators.blocked import max_rows_per_key
    return max_rows_per_key(df, key) > SINGLE_TASK_ROWS


def _series(silver: DataFrame, value_col: str, valid_only: bool, key: str, time_col: str) -> DataFrame:
    """Rows of the series, as ``v``; a row without sensor, time or value is part of no series."""
    df = silver.where(F.col("is_valid")) if valid_only and "is_valid" in silver.columns else silver
    df = df.withColumn("v", F.col(value_col))
    return df.where(F.col("v").isNotNull() & F.col(key).isNotNull() & F.col(time_col).isNotNull())


# Below this size a rolling window is computed from its rows; larger ones are put together from smaller ones.
BASE_WINDOW = 10


def with_rolling(df: DataFrame, w, windows, pos: Column, v: str = "v") -> DataFrame:
    """``df`` with rolling_mean/std/max/min_<n> of ``v`` over the last n rows for each n of ``windows``, null before
    position n.

    Only the smallest window goes over its rows for every row. A larger one is made of smaller ones further back
    (50 = 20 + 20 behind 20 + 10 behind 40), as means and sums of squared deviations, so a row costs a few
    look-backs instead of all rows of all windows. ``w`` is the ordered window of the series; no further exchange or sort."""
    sizes = sorted(set(windows))
    if sizes[0] > BASE_WINDOW:
        sizes = [BASE_WINDOW, *sizes]
    keep = df.columns
    frame = w.rowsBetween(-(sizes[0] - 1), Window.currentRow)
    out = df.select("*", F.avg(v).over(frame).alias(f"_mean{sizes[0]}"), (F.var_pop(v).over(frame) * sizes[0]).alias(f"_dev{sizes[0]}"),
                    F.max(v).over(frame).alias(f"_max{sizes[0]}"), F.min(v).over(frame).alias(f"_min{sizes[0]}"))
    for i, size in enumerate(sizes[1:], 1):
        parts, rest = [], size
        for smaller in [*reversed(sizes[:i]), 1]:
            while rest >= smaller:
                parts.append((smaller, size - rest))
                rest -= smaller

        def back(stat: str, n: int, by: int) -> Column:
            c = F.col(f"_{stat}{n}") if n > 1 or sizes[0] == 1 else F.lit(0.0) if stat == "dev" else F.col(v)
            return F.lag(c, by).over(w) if by and not (stat == "dev" and n == 1 and sizes[0] > 1) else c

        means = [(n, back("mean", n, by)) for n, by in parts]
        first = means[0][1]
        mean = first + sum((n * (m - first) for n, m in means[1:]), F.lit(0.0)) / size
        out = out.select("*", mean.alias(f"_mean{size}"), *[
            f(*[back(stat, n, by) for n, by in parts]).alias(f"_{stat}{size}") for stat, f in (("max", F.greatest), ("min", F.least))])
        dev = sum((back("dev", n, by) + n * (back("mean", n, by) - F.col(f"_mean{size}")) * (back("mean", n, by) - F.col(f"_mean{size}"))
                   for n, by in parts), F.lit(0.0))
        out = out.withColumn(f"_dev{size}", dev)
    cols = []
    for n in windows:
        gate = pos >= n
        cols += [F.when(gate, F.col(f"_mean{n}")).alias(f"rolling_mean_{n}"),
                 F.when(gate, F.sqrt(F.col(f"_dev{n}") / n)).alias(f"rolling_std_{n}"),
                 F.when(gate, F.col(f"_max{n}")).alias(f"rolling_max_{n}"), F.when(gate, F.col(f"_min{n}")).alias(f"rolling_min_{n}")]
    return out.select(*keep, *cols)


def snapshot_features(silver: DataFrame, max_history: int | None = fixed.MAX_HISTORY,
                      min_rows: int = fixed.MIN_ROWS_FEATURES, valid_only: bool = True,
                      order_cols: tuple[str, ...] = ("event_timestamp", "id"),
                      value_col: str = "cleaned_value", key: str = "sensor_id",
                      windows=tuple(fixed.ROLLING_WINDOWS), lags=tuple(fixed.LAGS),
                      trend_min: int = fixed.MIN_ROWS_TREND, pieces: str = "auto") -> DataFrame:
    """Wide feature row per sensor: key, n, and the 30 features (NULL = not computable).

    The ranking window is ``row_number() <= max_history`` which Spark plans as a
    WindowGroupLimit on both sides of the shuffle: each map task keeps at most
    ``max_history`` rows per sensor, so a hot sensor never lands whole in one task.
    A ``max_history`` above that operator's threshold is ranked piece by piece (``blocked.newest_per_key``), and
    ``max_history=None`` uses the whole history, ranked from skew-proof positions.
    """
    from gaugeflow.operators.blocked import group_limit, newest_per_key
    df = _series(silver, value_col, valid_only, key, order_cols[0])
    if max_history and max_history > group_limit(df):
        newest = newest_per_key(df.select(key, *order_cols, "v"), key, list(order_cols), order_cols[0], max_history, pieces=pieces)
        ranked = newest.select(key, "v", "rn")
    elif max_history:
        w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_cols])
        ranked = df.select(key, "v", F.row_number().over(w).alias("rn"))
        ranked = ranked.where(F.col("rn") <= max_history)
    else:
        # Whole history: rank from skew-proof global positions (bounded pieces), then the
        # aggregation below is partial (map-side), so no task holds a whole sensor.
        from gaugeflow.operators.blocked import global_positions
        from gaugeflow.operators.joins import lookup_join
        from gaugeflow.session import materialize
        pos = global_positions(df.select(key, *order_cols, "v"), key, list(order_cols), order_cols[0],
                               pieces=pieces)
        # series lengths from the input (not from the position plan), written once: the
        # size check and the join both read the small table
        counts = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "snapshot-lengths")
        ranked = lookup_join(pos, counts, key, "inner").select(
            key, "v", (F.col("_n") - F.col("pos") + 1).alias("rn"))
    v, rn = F.col("v"), F.col("rn")
    aggs = [
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.skewness("v").alias("_g1"),
        F.kurtosis("v").alias("_g2"),
        F.regr_slope(v, -rn.cast("double")).alias("_slope"),
        F.max(F.when(rn == 1, v)).alias("_last"),
        F.max_by(v, rn).alias("_first"),
    ]
    for k in lags:
        aggs.append(F.max(F.when(rn == k + 1, v)).alias(f"lag_{k}"))
    for win in windows:
        in_win = rn <= win
        aggs += [
            F.avg(F.when(in_win, v)).alias(f"_rmean_{win}"),
            F.stddev_pop(F.when(in_win, v)).alias(f"_rstd_{win}"),
            F.max(F.when(in_win, v)).alias(f"_rmax_{win}"),
            F.min(F.when(in_win, v)).alias(f"_rmin_{win}"),
        ]
    g = ranked.groupBy(key).agg(*aggs).where(F.col("n") >= min_rows)
    n = F.col("n")
    cols = [F.col(key), n,
            F.col("mean"), F.col("std"), F.col("min"), F.col("max"),
            (F.col("max") - F.col("min")).alias("range"),
            sample_skewness(F.col("_g1"), n).alias("skewness"),
            sample_kurtosis(F.col("_g2"), n).alias("kurtosis")]
    cols += [F.col(f"lag_{k}") for k in lags]
    for win in windows:
        gate = n >= win
        cols += [F.when(gate, F.col(f"_rmean_{win}")).alias(f"rolling_mean_{win}"),
                 F.when(gate, F.col(f"_rstd_{win}")).alias(f"rolling_std_{win}"),
                 F.when(gate, F.col(f"_rmax_{win}")).alias(f"rolling_max_{win}"),
                 F.when(gate, F.col(f"_rmin_{win}")).alias(f"rolling_min_{win}")]
    cols += [F.when(n >= trend_min, F.col("_slope")).alias("trend_slope"),
             F.when(n > 1, F.col("_last") - F.col("lag_1")).alias("last_change"),
             F.when(n > 1, (F.col("_last") - F.col("_first")) / n).alias("change_rate")]
    return g.select(*cols)


def history_features(silver: DataFrame, valid_only: bool = True,
                     order_cols: tuple[str, ...] = ("event_timestamp", "id"),
                     value_col: str = "cleaned_value", key: str = "sensor_id",
                     windows=tuple(fixed.ROLLING_WINDOWS), lags=tuple(fixed.LAGS),
                     method: str = "auto", block_rows: int | None = None,
                     pieces: str = "auto") -> DataFrame:
    """Per-row lags, rolling mean/std/max/min over the last w rows (present once w rows
    exist), last_change and position in the series.

    ``method``: "window" (one window per sensor), "blocked" (bounded pieces, see
    ``blocked``), or "auto" (blocked when some sensor exceeds SINGLE_TASK_ROWS, with values that agree
    within about 1e-9, not bit for bit);
    ``pieces``: how the blocked plan cuts a series for positions (``scan.with_pieces``)."""
    df = _series(silver, value_col, valid_only, key, order_cols[0])
    if _use_blocked(df, key, method):
        from gaugeflow.operators import blocked as B
        return B.history_features_blocked(df.select(key, *order_cols, "v"), key, list(order_cols),
                                          order_cols[0], windows, lags,
                                          block_rows=block_rows or B.BLOCK_ROWS, pieces=pieces)
    order = [F.col(c) for c in order_cols]
    w = Window.partitionBy(key).orderBy(*order)
    pos = F.row_number().over(w)
    out = df.select(key, *order_cols, "v", pos.alias("pos"))
    cols = [F.col(key), *[F.col(c) for c in order_cols], F.col("pos"), F.col("v").alias("value")]
    for k in lags:
        cols.append(F.lag("v", k).over(w).alias(f"lag_{k}"))
    out = with_rolling(out, w, windows, F.col("pos"))
    cols += [F.col(f"rolling_{stat}_{win}") for win in windows for stat in ("mean", "std", "max", "min")]
    cols.append((F.col("v") - F.lag("v", 1).over(w)).alias("last_change"))
    return out.select(*cols)


def expanding_features(series: DataFrame, min_prefix: int = fixed.MIN_ROWS_FEATURES + 1,
                       min_sensor_rows: int = fixed.MIN_ROWS_TRAIN_SENSOR,
                       order_cols: tuple[str, ...] = ("event_timestamp", "id"),
                       value_col: str = "cleaned_value", key: str = "sensor_id",
                       windows=tuple(fixed.ROLLING_WINDOWS), lags=tuple(fixed.LAGS),
                       trend_min: int = fixed.MIN_ROWS_TREND,
                       valid_only: bool = False, method: str = "auto",
                       block_rows: int | None = None, pieces: str = "auto") -> DataFrame:
    """One feature vector per prefix (length >= ``min_prefix``) of each sensor's series,
    for sensors with at least ``min_sensor_rows`` rows.

    All features are window aggregates over ``rowsBetween(unboundedPreceding, 0)``
    (incremental running frames) or ``rowsBetween(-(w-1), 0)``: one shuffle by sensor
    and one sort, instead of recomputing each prefix. When a sensor is too large for one
    task (``method="auto"`` checks, one more pass over the input) the blocked plan computes the same columns from
    bounded (sensor, block) pieces; the two agree within about 1e-9, not bit for bit.
    """
    compiled_methods(series.sparkSession)
    df = _series(series, value_col, valid_only, key, order_cols[0])
    if _use_blocked(df, key, method):
        from gaugeflow.operators import blocked as B
        return B.expanding_features_blocked(
            df.select(key, *order_cols, "v"), key, list(order_cols), order_cols[0], min_prefix,
            min_sensor_rows, windows, lags, trend_min, block_rows=block_rows or B.BLOCK_ROWS,
            pieces=pieces)
    order = [F.col(c) for c in order_cols]
    w = Window.partitionBy(key).orderBy(*order)
    grow = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    pos = F.row_number().over(w)
    base = df.select(key, *order_cols, "v", pos.alias("pos"), F.count("v").over(whole).alias("_len"))
    base = base.where(F.col("_len") >= min_sensor_rows)
    n = F.col("pos")
    x = F.col("pos").cast("double")
    cols = [F.col(key), *[F.col(c) for c in order_cols], n.alias("n"),
            F.avg("v").over(grow).alias("mean"),
            F.stddev_pop("v").over(grow).alias("std"),
            F.min("v").over(grow).alias("min"),
            F.max("v").over(grow).alias("max"),
            F.skewness("v").over(grow).alias("_g1"),
            F.kurtosis("v").over(grow).alias("_g2"),
            F.regr_slope(F.col("v"), x).over(grow).alias("_slope"),
            F.first("v").over(grow).alias("_first"),
            F.col("v").alias("_last")]
    for k in lags:
        cols.append(F.lag("v", k).over(w).alias(f"lag_{k}"))
    base = with_rolling(base, w, windows, n)
    cols += [F.col(f"rolling_{stat}_{win}") for win in windows for stat in ("mean", "std", "max", "min")]
    wide = base.select(*cols).where(n >= min_prefix)
    nn = F.col("n")
    final = [F.col(key), *[F.col(c) for c in order_cols], nn,
             F.col("mean"), F.col("std"), F.col("min"), F.col("max"),
             (F.col("max") - F.col("min")).alias("range"),
             sample_skewness(F.col("_g1"), nn).alias("skewness"),
             sample_kurtosis(F.col("_g2"), nn).alias("kurtosis")]
    final += [F.col(f"lag_{k}") for k in lags]
    for win in windows:
        final += [F.col(f"rolling_{s}_{win}") for s in ("mean", "std", "max", "min")]
    final += [F.when(nn >= trend_min, F.col("_slope")).alias("trend_slope"),
              F.when(nn > 1, F.col("_last") - F.col("lag_1")).alias("last_change"),
              F.when(nn > 1, (F.col("_last") - F.col("_first")) / nn).alias("change_rate")]
    return wide.select(*final)


def feature_rows(wide: DataFrame, timestamp: Column | None = None, key: str = "sensor_id") -> DataFrame:
    """Feature table rows: id, sensor_id, timestamp, features (map of those present), feature_version."""
    at = timestamp if timestamp is not None else F.current_timestamp()
    packed = features_to_map(wide, keep=(key,)).withColumn("timestamp", at)
    name = F.sha2(F.concat_ws("/", F.col(key), F.col("timestamp").cast("string"), F.lit(fixed.FEATURE_VERSION)), 256).substr(1, 32)
    return packed.select(name.alias("id"), F.col(key).alias("sensor_id"), "timestamp", "features",
                         F.lit(fixed.FEATURE_VERSION).alias("feature_version"))


def features_to_map(wide: DataFrame, names: list[str] | None = None,
                    keep: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """Pack present (non-NULL) features into MAP<STRING,DOUBLE> (absent = not computable)."""
    names = names or fixed.feature_names()
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in names]),
                          F.array(*[F.col(c).cast("double") for c in names]))
    return wide.select(*[F.col(c) for c in keep],
                       F.map_filter(m, lambda k, val: val.isNotNull()).alias("features"))


def feature_complete(names: list[str] | None = None) -> Column:
    """True when every feature of the layout is present."""
    names = names or fixed.feature_names()
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(c).isNotNull()
    return cond
