"""Registered queries over the given tables, each with its DuckDB oracle SQL.

Every query reads whole tables (``events`` through the readings adapter unless stated)
and returns a DataFrame whose computed columns carry the same names as the oracle's.
Doubles built from accumulations are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import fixed
from gaugeflow.functions import scalar as X
from gaugeflow.operators import bronze as brz
from gaugeflow.operators import correlation as CR
from gaugeflow.operators import features as feat
from gaugeflow.operators import iforest as IF
from gaugeflow.operators import kmeans as KM
from gaugeflow.operators import joins as J
from gaugeflow.operators import quality as Q
from gaugeflow.operators import retention as RT
from gaugeflow.operators import silver as silv
from gaugeflow.operators import training as TR
from gaugeflow.operators import windowed as WF
from gaugeflow.plans import serving as SV
from gaugeflow.plans import sqlparts as S
from gaugeflow.session import scratch_path, utc
from gaugeflow.streaming import deadletters as DL
from gaugeflow.streaming import pipeline as SP
from gaugeflow.sources.adapters import (event_readings, events_sensor_filter, lineitem_readings,
                                        readings_from_events)
from gaugeflow.sources.tables import sensor_dimension, table, type_ranges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def r6(c, places: int = 6):
    """Round for comparison, the same way on both sides (``sqlparts.r6`` is the SQL form):
    ``floor(x * 10^places + 0.501) / 10^places`` for |x| < 1e9, else x unchanged.

    Plain IEEE steps (multiply, add, floor, divide), so Spark and DuckDB produce the same
    bits from the same input, inside whole-stage codegen (``round`` on doubles goes through
    BigDecimal per value). Exact ties at the next decimal are common here (two-decimal
    inputs averaged over n = 2^a 5^b rows), and at a tie the last bit of accumulation noise
    would decide the direction; the 0.001 (1e-9 at six places) sends every tie up."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** places)
    return F.when(F.abs(c) < F.lit(1e9),
                  F.floor(c * F.lit(scale) + F.lit(0.501)) / F.lit(scale)).otherwise(c)


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[r6(f.name, places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def events_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    dim, n = sensor_dimension(spark)
    return silv.silver_range(event_readings(spark, sf_dir), dim, dim_rows=n,
                             processed_ts=F.col("timestamp"))


SNAPSHOT_COLS = ["sensor_id", "n"] + [
    "mean", "std", "min", "max", "range", "skewness", "kurtosis",
    *[f"lag_{k}" for k in fixed.LAGS],
    *[f"rolling_{s}_{w}" for w in fixed.ROLLING_WINDOWS for s in ("mean", "std", "max", "min")],
    "trend_slope", "last_change", "change_rate"]
SNAPSHOT_DOUBLES = set(SNAPSHOT_COLS) - {"sensor_id", "n"}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- Silver (range rules)
SILVER_OUT = ["id", "sensor_id", "sensor_type", "cleaned_value", "original_value", "is_valid",
              "quality_score", "location", "unit", "meta_k", "event_timestamp"]


@register("silver_range", _with(S.silver_sql()) + f"SELECT {', '.join(SILVER_OUT)} FROM silver")
def q_silver_range(spark, sf_dir):
    s = events_silver(spark, sf_dir)
    return s.select("id", "sensor_id", "sensor_type", "cleaned_value", "original_value", "is_valid",
                    "quality_score", F.col("enriched_data.location").alias("location"),
                    F.col("enriched_data.unit").alias("unit"),
                    F.col("enriched_data.metadata")["k"].alias("meta_k"), "event_timestamp")


# ---------------------------------------------------------------- snapshot features
@register("features_snapshot",
          _with(S.silver_sql(), S.snapshot_sql())
          + f"SELECT {S.rounded_select(SNAPSHOT_COLS, SNAPSHOT_DOUBLES)} FROM snap")
def q_features_snapshot(spark, sf_dir):
    return round_doubles(feat.snapshot_features(events_silver(spark, sf_dir)).select(*SNAPSHOT_COLS))


@register("features_snapshot_full_history",
          _with(S.silver_sql(), S.snapshot_sql(max_history=None))
          + f"SELECT {S.rounded_select(SNAPSHOT_COLS, SNAPSHOT_DOUBLES)} FROM snap")
def q_features_snapshot_full_history(spark, sf_dir):
    """The 30 snapshot features over each sensor's whole valid history (``max_history=None``,
    the option that removes the train/serve skew of the 100-row cap): ranks come from
    skew-proof global positions, and the aggregation is partial, so no task holds a sensor."""
    f = feat.snapshot_features(events_silver(spark, sf_dir), max_history=None)
    return round_doubles(f.select(*SNAPSHOT_COLS))


def _ntz(c):
    return F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz")


def _long(c: str):
    return F.col(c).cast("long").alias(c)


def rule_anomalies(silver: DataFrame) -> DataFrame:
    """Anomaly-table stand-in with known values: the extreme rule's verdict as the flag."""
    score = F.col("quality_score") - F.lit(1.0)
    return silver.select("id", "sensor_id", F.col("event_timestamp").alias("timestamp"),
                         (~F.col("is_valid")).alias("is_anomaly"), score.alias("anomaly_score"),
                         X.confidence(score).alias("confidence"))


# ---------------------------------------------------------------- Silver (sentinel rules)
SENTINEL_SQL = _with(S.READINGS_SQL) + """SELECT id, sensor_id, sensor_type, value, unit,
  event_timestamp AS "timestamp", location, 'iot_sensors' AS source,
  coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) AS is_valid,
  CASE WHEN coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) THEN value ELSE CAST(0.0 AS DOUBLE) END AS cleaned_value,
  CASE WHEN coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS quality_score
FROM readings"""


@register("silver_sentinel", SENTINEL_SQL)
def q_silver_sentinel(spark, sf_dir):
    bronze = silv.add_ingestion_metadata(event_readings(spark, sf_dir).drop("metadata"))
    s = silv.silver_sentinel(bronze)
    return s.select("id", "sensor_id", "sensor_type", "value", "unit", "timestamp", "location", "source",
                    "is_valid", "cleaned_value", "quality_score")


# ---------------------------------------------------------------- Bronze envelope round trip
@register("bronze_envelope_roundtrip", _with(S.READINGS_SQL) + """SELECT id // 10 AS batch_id,
  row_number() OVER (PARTITION BY id // 10 ORDER BY id) - 1 AS pos,
  count(*) OVER (PARTITION BY id // 10) AS batch_size,
  id, sensor_id, sensor_type, value, unit, event_timestamp, location, meta_k
FROM readings""")
def q_bronze_roundtrip(spark, sf_dir):
    r = event_readings(spark, sf_dir)
    env = brz.nest_batches(r, F.floor(F.col("id") / 10))
    env = env.withColumn("batch_size", F.size("sensor_readings").cast("long"))
    flat = env.select("batch_id", "batch_size", F.posexplode("sensor_readings").alias("pos", "r"))
    return flat.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("pos").cast("long").alias("pos"),
                       "batch_size", "r.id", "r.sensor_id", "r.sensor_type", "r.value", "r.unit",
                       F.col("r.timestamp").alias("event_timestamp"), "r.location",
                       F.col("r.metadata")["k"].alias("meta_k"))


@register("bronze_envelope_split", _with(S.READINGS_SQL) + """SELECT id // 1000 AS batch_id,
  row_number() OVER (PARTITION BY id // 1000 ORDER BY id) - 1 AS pos, id, sensor_id, value
FROM readings""")
def q_bronze_split(spark, sf_dir):
    """Batches of 1,000 readings in envelopes of 64: positions run over the whole batch."""
    env = brz.nest_batches(event_readings(spark, sf_dir), F.floor(F.col("id") / 1000), max_readings=64)
    return brz.unnest_batches(env).select(_long("batch_id"), _long("pos"), "id", "sensor_id", "value")


# ---------------------------------------------------------------- union of batches
@register("batch_union", """WITH u AS (
  SELECT event_type AS sensor_type, 'u' AS unit, CAST(value AS DOUBLE) AS value FROM events
  UNION ALL SELECT 'lineitem' AS sensor_type, 'units' AS unit, l_quantity AS value FROM lineitem)
SELECT sensor_type, unit, count(*) AS readings, CASE WHEN abs(sum(value)) < 1e9 THEN floor((sum(value)) * 1e6 + 501e-3) / 1e6 ELSE (sum(value)) END AS total_value,
       min(value) AS min_value, max(value) AS max_value FROM u GROUP BY sensor_type, unit""")
def q_batch_union(spark, sf_dir):
    cols = ["sensor_type", "unit", "value"]
    u = event_readings(spark, sf_dir).select(*cols).unionByName(lineitem_readings(spark, sf_dir).select(*cols))
    return u.groupBy("sensor_type", "unit").agg(
        F.count(F.lit(1)).alias("readings"), r6(F.sum("value")).alias("total_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@register("distinct_sensors", _with(S.READINGS_SQL) + "SELECT DISTINCT sensor_id FROM readings")
def q_distinct_sensors(spark, sf_dir):
    return event_readings(spark, sf_dir).select("sensor_id").distinct()


@register("valid_only", _with(S.silver_sql())
          + "SELECT id, sensor_id, cleaned_value, quality_score FROM silver WHERE is_valid")
def q_valid_only(spark, sf_dir):
    return silv.valid_only(events_silver(spark, sf_dir)).select("id", "sensor_id", "cleaned_value", "quality_score")


# ---------------------------------------------------------------- read queries
RECENT_SENSOR = "click_3"


@register("recent_readings", _with(S.silver_sql()) + f"""SELECT id, sensor_id, cleaned_value, quality_score,
  is_valid, event_timestamp FROM silver WHERE sensor_id = '{RECENT_SENSOR}'
  ORDER BY event_timestamp DESC, id DESC LIMIT 50""")
def q_recent_readings(spark, sf_dir):
    dim, n = sensor_dimension(spark)
    events = table(spark, sf_dir, "events").where(events_sensor_filter(RECENT_SENSOR))
    silver = silv.silver_range(readings_from_events(events), dim, dim_rows=n, processed_ts=F.col("timestamp"))
    r = SV.recent_readings(silver, RECENT_SENSOR, 50)
    return r.select("id", "sensor_id", "cleaned_value", "quality_score", "is_valid", "event_timestamp")


@register("recent_readings_per_sensor", _with(S.silver_sql()) + """SELECT id, sensor_id, cleaned_value,
  event_timestamp, row_number() OVER (PARTITION BY sensor_id ORDER BY event_timestamp DESC, id DESC) AS position
FROM silver QUALIFY position <= 10""")
def q_recent_per_sensor(spark, sf_dir):
    r = SV.recent_per_sensor(events_silver(spark, sf_dir), 10)
    return r.select("id", "sensor_id", "cleaned_value", "event_timestamp", _long("position"))


@register("sensor_card", _with(S.silver_sql()) + """SELECT sensor_id,
  printf('%.3f %s', cleaned_value, unit) AS latest_value,
  printf('%.1f%%', quality_score * 100) AS quality,
  CASE WHEN is_valid THEN 'Valid' ELSE 'Invalid' END AS status,
  cleaned_value IS DISTINCT FROM original_value AS was_corrected,
  count(*) OVER (PARTITION BY sensor_id) AS record_count
FROM silver QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY event_timestamp DESC, id DESC) = 1""")
def q_sensor_card(spark, sf_dir):
    return SV.sensor_card(events_silver(spark, sf_dir))


@register("list_sensors", _with(S.silver_sql()) + """SELECT d.sensor_id, coalesce(s.readings, 0) AS readings,
  s.last_seen, d.type, d.location, d.unit, d.lo AS range_min, d.hi AS range_max
FROM dim d LEFT JOIN
(SELECT sensor_id, count(*) AS readings, max(event_timestamp) AS last_seen FROM silver GROUP BY sensor_id) s
  ON s.sensor_id = d.sensor_id""")
def q_list_sensors(spark, sf_dir):
    dim, _ = sensor_dimension(spark)
    return SV.list_sensors(events_silver(spark, sf_dir), dim)


@register("dashboard_stats", _with(S.silver_sql(), S.snapshot_sql()) + """SELECT
  (SELECT count(DISTINCT id // 10) FROM readings) AS total_ingested,
  (SELECT count(*) FROM readings) AS total_readings,
  (SELECT count(*) FROM silver) AS total_processed,
  (SELECT count(*) FROM snap) AS total_features,
  (SELECT count(*) FILTER (WHERE NOT is_valid) FROM silver) AS total_anomalies,
  (SELECT count(*) FROM dim) AS active_sensors,
  'healthy' AS pipeline_health""")
def q_dashboard_stats(spark, sf_dir):
    s = events_silver(spark, sf_dir)
    bronze = event_readings(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("batch_id"))
    dim, _ = sensor_dimension(spark)
    models = scratch_path(spark, "models")
    IF.retrain(spark, TR.training_matrix(s), models, n_trees=5)  # health follows from what is published there
    return SV.dashboard_stats(bronze, s, feat.snapshot_features(s), rule_anomalies(s), dim, model_path=models)


FEATURE_ROWS_SQL = _with(S.silver_sql(), S.snapshot_sql()) + " UNION ALL ".join(
    f"""SELECT sensor_id, '{c}' AS feature, {S.r6(f'"{c}"')} AS value, '{fixed.FEATURE_VERSION}' AS feature_version
FROM snap WHERE "{c}" IS NOT NULL""" for c in fixed.feature_names())


@register("feature_rows", FEATURE_ROWS_SQL)
def q_feature_rows(spark, sf_dir):
    """The feature table's rows (map of the features present, with their version), one row per entry."""
    rows = feat.feature_rows(feat.snapshot_features(events_silver(spark, sf_dir)))
    return round_doubles(rows.select("sensor_id", F.explode("features").alias("feature", "value"), "feature_version"))


# ---------------------------------------------------------------- per-row history features
HIST_COLS = (["sensor_id", "event_timestamp", "id", "pos", "value"] + [f"lag_{k}" for k in fixed.LAGS]
             + [f"rolling_{s}_{w}" for w in fixed.ROLLING_WINDOWS for s in ("mean", "std", "max", "min")]
             + ["last_change"])
HIST_DOUBLES = set(HIST_COLS) - {"sensor_id", "event_timestamp", "id", "pos"}


def events_history(spark, sf_dir):
    h = feat.history_features(events_silver(spark, sf_dir))
    return h.withColumn("pos", F.col("pos").cast("long"))


@register("features_history", _with(S.silver_sql(), S.history_sql())
          + f"SELECT {S.rounded_select(HIST_COLS, HIST_DOUBLES)} FROM hist")
def q_features_history(spark, sf_dir):
    return round_doubles(events_history(spark, sf_dir).select(*HIST_COLS))


@register("latest_features", _with(S.silver_sql(), S.history_sql())
          + f"""SELECT {S.rounded_select(HIST_COLS, HIST_DOUBLES)} FROM hist
QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY event_timestamp DESC, id DESC) = 1""")
def q_latest_features(spark, sf_dir):
    return round_doubles(SV.latest_features(events_history(spark, sf_dir)).select(*HIST_COLS))


LOOKUP_OUT = ["id", "sensor_id", "is_valid", "f_event_timestamp", "f_id", "f_value", "f_rolling_mean_5",
              "f_rolling_std_20"]


@register("score_lookup", _with(S.silver_sql(), S.history_sql()) + """, latest AS (
  SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY event_timestamp DESC, id DESC) = 1)
SELECT s.id, s.sensor_id, s.is_valid, l.event_timestamp AS f_event_timestamp, l.id AS f_id,
  CASE WHEN abs(l.value) < 1e9 THEN floor((l.value) * 1e6 + 501e-3) / 1e6 ELSE (l.value) END AS f_value, CASE WHEN abs(l.rolling_mean_5) < 1e9 THEN floor((l.rolling_mean_5) * 1e6 + 501e-3) / 1e6 ELSE (l.rolling_mean_5) END AS f_rolling_mean_5,
  CASE WHEN abs(l.rolling_std_20) < 1e9 THEN floor((l.rolling_std_20) * 1e6 + 501e-3) / 1e6 ELSE (l.rolling_std_20) END AS f_rolling_std_20
FROM silver s JOIN latest l USING (sensor_id)""")
def q_score_lookup(spark, sf_dir):
    s = events_silver(spark, sf_dir).select("id", "sensor_id", "is_valid")
    h = events_history(spark, sf_dir).select("sensor_id", "event_timestamp", "id", "value",
                                             "rolling_mean_5", "rolling_std_20")
    out = J.latest_lookup(s, h, order_cols=("event_timestamp", "id"))
    return round_doubles(out.select(*LOOKUP_OUT))


@register("score_lookup_asof", _with(S.silver_sql(), S.history_sql()) + """
SELECT s.id, s.sensor_id, s.is_valid, h.event_timestamp AS f_event_timestamp, h.id AS f_id,
  CASE WHEN abs(h.value) < 1e9 THEN floor((h.value) * 1e6 + 501e-3) / 1e6 ELSE (h.value) END AS f_value, CASE WHEN abs(h.rolling_mean_5) < 1e9 THEN floor((h.rolling_mean_5) * 1e6 + 501e-3) / 1e6 ELSE (h.rolling_mean_5) END AS f_rolling_mean_5,
  CASE WHEN abs(h.rolling_std_20) < 1e9 THEN floor((h.rolling_std_20) * 1e6 + 501e-3) / 1e6 ELSE (h.rolling_std_20) END AS f_rolling_std_20
FROM silver s ASOF JOIN hist h ON s.sensor_id = h.sensor_id AND s.event_timestamp >= h.event_timestamp""")
def q_score_lookup_asof(spark, sf_dir):
    s = events_silver(spark, sf_dir).select("id", "sensor_id", "is_valid", "event_timestamp")
    h = events_history(spark, sf_dir)
    out = J.asof_lookup(s, h, "sensor_id", "event_timestamp", "event_timestamp",
                        ["event_timestamp", "id", "value", "rolling_mean_5", "rolling_std_20"],
                        rec_order="id", feat_order="id")
    return round_doubles(out.select(*LOOKUP_OUT))


@register("score_lookup_asof_count_pieces", ORACLES["score_lookup_asof"])
def q_score_lookup_asof_count_pieces(spark, sf_dir):
    """``score_lookup_asof`` on count-balanced range pieces."""
    s = events_silver(spark, sf_dir).select("id", "sensor_id", "is_valid", "event_timestamp")
    h = events_history(spark, sf_dir)
    out = J.asof_lookup(s, h, "sensor_id", "event_timestamp", "event_timestamp",
                        ["event_timestamp", "id", "value", "rolling_mean_5", "rolling_std_20"],
                        rec_order="id", feat_order="id", pieces="rows")
    return round_doubles(out.select(*LOOKUP_OUT))


@register("confidence", _with(S.silver_sql()) + """SELECT id, sensor_id, quality_score - 0.5 AS score,
  least(1.0, greatest(0.0, (abs(quality_score - 0.5) + 0.5) / 1.5)) AS confidence FROM silver""")
def q_confidence(spark, sf_dir):
    s = events_silver(spark, sf_dir).withColumn("score", F.col("quality_score") - F.lit(0.5))
    return s.select("id", "sensor_id", "score", X.confidence("score").alias("confidence"))


# ---------------------------------------------------------------- expanding prefixes / training matrix
NAMES = fixed.feature_names()
EXP_COLS = ["sensor_id", "event_timestamp", "id", "n"] + NAMES


def events_expanding(spark, sf_dir):
    e = feat.expanding_features(events_silver(spark, sf_dir))
    return e.withColumn("n", F.col("n").cast("long"))


@register("features_expanding", _with(S.silver_sql(), S.expanding_sql())
          + f"SELECT {S.rounded_select(EXP_COLS, set(NAMES))} FROM expd")
def q_features_expanding(spark, sf_dir):
    return round_doubles(events_expanding(spark, sf_dir).select(*EXP_COLS))


# The skew-proof plan, forced on with small blocks so every sensor spans several blocks.
@register("features_expanding_blocked", _with(S.silver_sql(), S.expanding_sql())
          + f"SELECT {S.rounded_select(EXP_COLS, set(NAMES))} FROM expd")
def q_features_expanding_blocked(spark, sf_dir):
    e = feat.expanding_features(events_silver(spark, sf_dir), method="blocked", block_rows=64)
    return round_doubles(e.withColumn("n", F.col("n").cast("long")).select(*EXP_COLS))


@register("features_history_blocked", _with(S.silver_sql(), S.history_sql())
          + f"SELECT {S.rounded_select(HIST_COLS, HIST_DOUBLES)} FROM hist")
def q_features_history_blocked(spark, sf_dir):
    h = feat.history_features(events_silver(spark, sf_dir), method="blocked", block_rows=64)
    return round_doubles(h.withColumn("pos", F.col("pos").cast("long")).select(*HIST_COLS))


def _matrix_sql() -> str:
    filled = ", ".join(f'{S.nan_to_num_sql(c)} AS "{c}"' for c in NAMES)
    return f"mat AS (SELECT sensor_id, event_timestamp, id, n, {filled} FROM expd)"


@register("training_matrix", _with(S.silver_sql(), S.expanding_sql(), _matrix_sql())
          + f"SELECT {S.rounded_select(EXP_COLS, set(NAMES))} FROM mat")
def q_training_matrix(spark, sf_dir):
    m = TR.training_matrix(events_silver(spark, sf_dir))
    return round_doubles(m.withColumn("n", F.col("n").cast("long")).select(*EXP_COLS))


def _std_sql() -> str:
    cols = ", ".join(f'("{c}" - avg("{c}") OVER ()) / coalesce(nullif(stddev_pop("{c}") OVER (), 0), 1) AS "{c}"'
                     for c in NAMES)
    return f"stdz AS (SELECT sensor_id, event_timestamp, id, n, {cols} FROM mat)"


@register("standardized", _with(S.silver_sql(), S.expanding_sql(), _matrix_sql(), _std_sql())
          + f"SELECT {S.rounded_select(EXP_COLS, set(NAMES))} FROM stdz")
def q_standardized(spark, sf_dir):
    m = TR.training_matrix(events_silver(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))
    return round_doubles(TR.standardize_columns(m, NAMES).select(*EXP_COLS))


@register("threshold_percentile", _with(S.silver_sql(), S.expanding_sql(), _matrix_sql()) + """SELECT
  CAST(0.1 AS DOUBLE) AS contamination, CASE WHEN abs(quantile_cont(change_rate, 0.1)) < 1e9 THEN floor((quantile_cont(change_rate, 0.1)) * 1e6 + 501e-3) / 1e6 ELSE (quantile_cont(change_rate, 0.1)) END AS threshold,
  CASE WHEN abs(quantile_cont(change_rate, 0.5)) < 1e9 THEN floor((quantile_cont(change_rate, 0.5)) * 1e6 + 501e-3) / 1e6 ELSE (quantile_cont(change_rate, 0.5)) END AS median FROM mat""")
def q_threshold_percentile(spark, sf_dir):
    m = TR.training_matrix(events_silver(spark, sf_dir))
    q10, q50 = TR.exact_quantiles(m, "change_rate", [fixed.CONTAMINATION, 0.5])
    return round_doubles(spark.createDataFrame([(fixed.CONTAMINATION, q10, q50)],
                                               "contamination DOUBLE, threshold DOUBLE, median DOUBLE"))


# ---------------------------------------------------------------- sliding event-time windows
WIN_COLS = ["sensor_id", "timestamp"] + [f"{s}_5min" for s in ("mean", "std", "min", "max", "count", "range")]


@register("sliding_window_features", _with(S.silver_sql(), S.sliding_sql("silver", 5, "minute", "5min"))
          + f"SELECT {S.rounded_select(WIN_COLS, set(WIN_COLS) - {'sensor_id', 'timestamp', 'count_5min'})} FROM slid")
def q_sliding(spark, sf_dir):
    w = WF.window_aggregate(events_silver(spark, sf_dir))
    return round_doubles(w.withColumn("timestamp", _ntz("timestamp")).select(*WIN_COLS))


WIDE_COLS = ["sensor_id", "timestamp"] + [f"{s}_6h" for s in ("mean", "std", "min", "max", "count", "range")]


@register("sliding_window_features_wide", _with(S.silver_sql(), S.sliding_sql("silver", 6, "hour", "6h"))
          + f"SELECT {S.rounded_select(WIDE_COLS, set(WIDE_COLS) - {'sensor_id', 'timestamp', 'count_6h'})} FROM slid")
def q_sliding_wide(spark, sf_dir):
    w = WF.window_aggregate(events_silver(spark, sf_dir), duration="6 hours", slide="1 hour", suffix="6h")
    return round_doubles(w.withColumn("timestamp", _ntz("timestamp")).select(*WIDE_COLS))


# ---------------------------------------------------------------- anomaly-table queries (rule-flagged)
@register("alerts", _with(S.silver_sql(), S.ANOMS_SQL) + """SELECT id, sensor_id, "timestamp", anomaly_score,
  printf('ANOMALY DETECTED - Sensor: %s, Score: %.3f', sensor_id, anomaly_score) AS message
FROM anoms WHERE is_anomaly""")
def q_alerts(spark, sf_dir):
    a = SV.alerts(rule_anomalies(events_silver(spark, sf_dir)))
    return a.select("id", "sensor_id", "timestamp", "anomaly_score", "message")


@register("recent_anomalies", _with(S.silver_sql(), S.ANOMS_SQL) + """SELECT id, sensor_id, "timestamp",
  anomaly_score, confidence FROM anoms WHERE is_anomaly ORDER BY "timestamp" DESC, id DESC LIMIT 20""")
def q_recent_anomalies(spark, sf_dir):
    a = SV.recent_anomalies(rule_anomalies(events_silver(spark, sf_dir)), 20)
    return a.select("id", "sensor_id", "timestamp", "anomaly_score", "confidence")


@register("anomaly_history", _with(S.silver_sql(), S.ANOMS_SQL) + """SELECT sensor_id,
  date_trunc('day', "timestamp") AS period, count(*) AS predictions,
  count(*) FILTER (WHERE is_anomaly) AS anomalies,
  CASE WHEN abs(count(*) FILTER (WHERE is_anomaly) / count(*)) < 1e9 THEN floor((count(*) FILTER (WHERE is_anomaly) / count(*)) * 1e6 + 501e-3) / 1e6 ELSE (count(*) FILTER (WHERE is_anomaly) / count(*)) END AS anomaly_rate
FROM anoms GROUP BY sensor_id, date_trunc('day', "timestamp")""")
def q_anomaly_history(spark, sf_dir):
    h = Q.anomaly_history(rule_anomalies(events_silver(spark, sf_dir)))
    return round_doubles(h.withColumn("period", _ntz("period")))


@register("confusion", _with(S.silver_sql()) + """, lab AS (
  SELECT s.sensor_type, NOT s.is_valid AS predicted,
         (s.cleaned_value < d.lo OR s.cleaned_value > d.hi) AS actual
  FROM silver s JOIN dim d USING (sensor_id))
SELECT sensor_type, count(*) FILTER (WHERE predicted AND actual) AS tp,
  count(*) FILTER (WHERE predicted AND NOT actual) AS fp,
  count(*) FILTER (WHERE NOT predicted AND actual) AS fn,
  count(*) FILTER (WHERE NOT predicted AND NOT actual) AS tn,
  CASE WHEN abs(CASE WHEN count(*) FILTER (WHERE predicted) > 0
    THEN count(*) FILTER (WHERE predicted AND actual) / count(*) FILTER (WHERE predicted) END) < 1e9 THEN floor((CASE WHEN count(*) FILTER (WHERE predicted) > 0
    THEN count(*) FILTER (WHERE predicted AND actual) / count(*) FILTER (WHERE predicted) END) * 1e6 + 501e-3) / 1e6 ELSE (CASE WHEN count(*) FILTER (WHERE predicted) > 0
    THEN count(*) FILTER (WHERE predicted AND actual) / count(*) FILTER (WHERE predicted) END) END AS "precision",
  CASE WHEN abs(CASE WHEN count(*) FILTER (WHERE actual) > 0
    THEN count(*) FILTER (WHERE predicted AND actual) / count(*) FILTER (WHERE actual) END) < 1e9 THEN floor((CASE WHEN count(*) FILTER (WHERE actual) > 0
    THEN count(*) FILTER (WHERE predicted AND actual) / count(*) FILTER (WHERE actual) END) * 1e6 + 501e-3) / 1e6 ELSE (CASE WHEN count(*) FILTER (WHERE actual) > 0
    THEN count(*) FILTER (WHERE predicted AND actual) / count(*) FILTER (WHERE actual) END) END AS recall
FROM lab GROUP BY sensor_type""")
def q_confusion(spark, sf_dir):
    s = events_silver(spark, sf_dir)
    r = type_ranges(spark)
    lab = J.lookup_join(s, r, s.sensor_type == r.type, "inner", dim_rows=len(fixed.EVENT_TYPE_RANGES)).select(
        "sensor_type", (~F.col("is_valid")).alias("predicted"),
        ((F.col("cleaned_value") < F.col("range_min")) | (F.col("cleaned_value") > F.col("range_max"))).alias("actual"))
    return round_doubles(Q.confusion(lab, "predicted", "actual", by=["sensor_type"]))


# ---------------------------------------------------------------- README-declared operators
def _gappy(spark, sf_dir):
    s = events_silver(spark, sf_dir)
    return s.select("id", "sensor_id", "event_timestamp",
                    F.when(F.col("is_valid"), F.col("cleaned_value")).alias("value"))


GAPPY_SQL = "gappy AS (SELECT id, sensor_id, event_timestamp, CASE WHEN is_valid THEN cleaned_value END AS value FROM silver)"


@register("forward_fill", _with(S.silver_sql(), GAPPY_SQL) + """SELECT id, sensor_id, event_timestamp, value,
  last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY event_timestamp, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_value FROM gappy""")
def q_forward_fill(spark, sf_dir):
    return Q.forward_fill(_gappy(spark, sf_dir)).select("id", "sensor_id", "event_timestamp", "value", "filled_value")


@register("interpolate", _with(S.silver_sql(), GAPPY_SQL) + """, pts AS (
  SELECT *, epoch_us(event_timestamp) / 1e6 AS t,
    last_value(CASE WHEN value IS NOT NULL THEN epoch_us(event_timestamp) / 1e6 END IGNORE NULLS)
      OVER (PARTITION BY sensor_id ORDER BY event_timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    last_value(value IGNORE NULLS)
      OVER (PARTITION BY sensor_id ORDER BY event_timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN epoch_us(event_timestamp) / 1e6 END IGNORE NULLS)
      OVER (PARTITION BY sensor_id ORDER BY event_timestamp, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
    first_value(value IGNORE NULLS)
      OVER (PARTITION BY sensor_id ORDER BY event_timestamp, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM gappy)
SELECT id, sensor_id, event_timestamp, value,
  CASE WHEN abs(CASE WHEN value IS NOT NULL THEN value WHEN nt - pt = 0 THEN pv
        ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END) < 1e9 THEN floor((CASE WHEN value IS NOT NULL THEN value WHEN nt - pt = 0 THEN pv
        ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END) * 1e6 + 501e-3) / 1e6 ELSE (CASE WHEN value IS NOT NULL THEN value WHEN nt - pt = 0 THEN pv
        ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END) END AS interpolated_value
FROM pts""")
def q_interpolate(spark, sf_dir):
    out = Q.interpolate(_gappy(spark, sf_dir))
    return round_doubles(out.select("id", "sensor_id", "event_timestamp", "value", "interpolated_value"))


@register("interpolate_count_pieces", ORACLES["interpolate"])
def q_interpolate_count_pieces(spark, sf_dir):
    """``interpolate`` with every series cut into count-balanced range pieces (the plan a
    hot sensor-hour switches to), checked against the same whole-table oracle."""
    out = Q.interpolate(_gappy(spark, sf_dir), pieces="rows")
    return round_doubles(out.select("id", "sensor_id", "event_timestamp", "value", "interpolated_value"))


@register("clip_outliers", _with(S.silver_sql()) + """SELECT s.id, s.sensor_id, s.cleaned_value,
  CASE WHEN d.lo IS NULL THEN s.cleaned_value
       ELSE least(greatest(s.cleaned_value, d.lo * 0.5), d.hi * 1.5) END AS clipped_value
FROM silver s LEFT JOIN dim d USING (sensor_id)""")
def q_clip_outliers(spark, sf_dir):
    dim, n = sensor_dimension(spark)
    d = dim.select("sensor_id", F.col("normal_range.min").alias("range_min"),
                   F.col("normal_range.max").alias("range_max"))
    s = J.lookup_join(events_silver(spark, sf_dir), d, "sensor_id", "left", dim_rows=n)
    return Q.clip_to_range(s).select("id", "sensor_id", "cleaned_value", "clipped_value")


@register("sensor_correlation", _with(S.silver_sql()) + """, ps AS (
  SELECT sensor_id, sensor_type, date_trunc('hour', event_timestamp) AS bucket, avg(cleaned_value) AS x
  FROM silver WHERE is_valid GROUP BY ALL),
pg AS (SELECT sensor_type, date_trunc('hour', event_timestamp) AS bucket, avg(cleaned_value) AS y
  FROM silver WHERE is_valid GROUP BY ALL)
SELECT sensor_id, sensor_type, CASE WHEN abs(corr(x, y)) < 1e9 THEN floor((corr(x, y)) * 1e6 + 501e-3) / 1e6 ELSE (corr(x, y)) END AS corr_to_group, count(*) AS points
FROM ps JOIN pg USING (sensor_type, bucket) GROUP BY sensor_id, sensor_type HAVING count(*) >= 3""")
def q_sensor_correlation(spark, sf_dir):
    s = silv.valid_only(events_silver(spark, sf_dir))
    return round_doubles(Q.correlation_to_group(s))


MIN_CORR = 0.5


@register("correlated_sensors", _with(S.silver_sql(S.LINEITEM_READINGS_SQL)) + f""", pts AS (
  SELECT sensor_id AS sensor, date_trunc('quarter', event_timestamp) AS bucket, avg(cleaned_value) AS x FROM silver GROUP BY ALL),
cls AS (SELECT sensor, min(sensor) OVER (PARTITION BY s) AS class
  FROM (SELECT sensor, list((bucket, x) ORDER BY bucket) AS s FROM pts GROUP BY sensor)),
own AS (SELECT pts.* FROM pts JOIN cls USING (sensor) WHERE sensor = class),
found AS (
  SELECT a.sensor AS sensor_a, b.sensor AS sensor_b, corr(a.x, b.x) AS corr, count(*) AS points
  FROM own a JOIN own b ON a.bucket = b.bucket AND a.sensor < b.sensor GROUP BY ALL HAVING count(*) >= 3
  UNION ALL
  SELECT class, sensor, 1.0, count(*) FROM cls JOIN pts USING (sensor) WHERE sensor <> class GROUP BY ALL HAVING count(*) >= 3)
SELECT sensor_a, sensor_b, {S.r6('corr')} AS corr, points FROM found WHERE isfinite(corr) AND corr >= {MIN_CORR}""")
def q_correlated_sensors(spark, sf_dir):
    """Suppliers whose quarterly mean quantities correlate, from all pairs (the exact route)."""
    return round_doubles(CR.correlated_pairs(lineitem_silver(spark, sf_dir), MIN_CORR, "exact", bucket_unit="quarter"))


@register("correlated_sensors_sketch")
def q_correlated_sensors_sketch(spark, sf_dir):
    """The same pairs from sign sketches: those that share a band of signs."""
    return round_doubles(CR.correlated_pairs(lineitem_silver(spark, sf_dir), MIN_CORR, "sketch", bucket_unit="quarter"))


@register("ingest_rate", """SELECT date_trunc('hour', ts) AS interval_start, count(*) AS readings
FROM events GROUP BY 1""")
def q_ingest_rate(spark, sf_dir):
    r = WF.tumbling_counts(event_readings(spark, sf_dir), "timestamp", "1 hour")
    return r.select(_ntz("interval_start").alias("interval_start"), "readings")


@register("latency_percentiles", """WITH lat AS (
  SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS latency_hours
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS pairs, CASE WHEN abs(quantile_cont(latency_hours, 0.5)) < 1e9 THEN floor((quantile_cont(latency_hours, 0.5)) * 1e6 + 501e-3) / 1e6 ELSE (quantile_cont(latency_hours, 0.5)) END AS p50_hours,
  CASE WHEN abs(quantile_cont(latency_hours, 0.95)) < 1e9 THEN floor((quantile_cont(latency_hours, 0.95)) * 1e6 + 501e-3) / 1e6 ELSE (quantile_cont(latency_hours, 0.95)) END AS p95_hours FROM lat""")
def q_latency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lat = li.join(od, li.l_orderkey == od.o_orderkey).select(
        ((F.unix_micros(F.col("l_shipdate").cast("timestamp"))
          - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(3.6e9)).alias("latency_hours"))
    lat = lat.checkpoint(eager=True)  # reused by the count and both quantiles
    n = lat.count()
    p50, p95 = TR.exact_quantiles(lat, "latency_hours", [0.5, 0.95])
    return round_doubles(spark.createDataFrame([(n, p50, p95)], "pairs BIGINT, p50_hours DOUBLE, p95_hours DOUBLE"))


QUARTILES = [0.1, 0.5, 0.95]


def _percentiles_sql(group: str, value: str, source: str) -> str:
    cols = ", ".join(f"{S.r6(f'quantile_cont({value}, {q})')} AS q{i}" for i, q in enumerate(QUARTILES))
    return f"SELECT {group}, count(*) AS n, {cols} FROM {source} GROUP BY {group}"


@register("sensor_percentiles", _with(S.silver_sql()) + _percentiles_sql("sensor_id", "cleaned_value", "silver"))
def q_sensor_percentiles(spark, sf_dir):
    return round_doubles(TR.exact_quantiles_by(events_silver(spark, sf_dir), ["sensor_id"], "cleaned_value", QUARTILES))


@register("price_percentiles_hot", _percentiles_sql("l_returnflag", "l_extendedprice", "lineitem"))
def q_price_percentiles_hot(spark, sf_dir):
    """Exact percentiles where each key holds a third of the table."""
    return round_doubles(TR.exact_quantiles_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", QUARTILES))


@register("retention", _with(S.READINGS_SQL) + """SELECT id, sensor_id, event_timestamp FROM readings
WHERE event_timestamp >= (SELECT max(event_timestamp) FROM readings) - INTERVAL 7 DAY""")
def q_retention(spark, sf_dir):
    r = event_readings(spark, sf_dir).withColumnRenamed("timestamp", "event_timestamp")
    return Q.retain_recent(r, "event_timestamp", 7).select("id", "sensor_id", "event_timestamp")


@register("retention_rewrite", ORACLES["retention"])
def q_retention_rewrite(spark, sf_dir):
    """``retention`` carried out on a table of date partitions: old ones dropped, the one at the limit rewritten."""
    r = event_readings(spark, sf_dir).select("id", "sensor_id", F.col("timestamp").cast("timestamp").alias("event_timestamp"))
    path = scratch_path(spark, "retained")
    dated = r.withColumn("event_date", F.to_date("event_timestamp"))
    dated.repartition("event_date").write.partitionBy("event_date").parquet(path)
    RT.apply_retention(spark, path, "event_timestamp", 7)
    kept = RT.read_table(spark, path, dated.schema)
    return kept.select("id", "sensor_id", _ntz("event_timestamp").alias("event_timestamp"))


CUSTOM_WINDOWS, CUSTOM_LAGS, CUSTOM_HISTORY = (3, 7, 15), (1, 4), 30
CUSTOM_COLS = ["sensor_id", "n", "mean", "std", "min", "max", "range", "skewness", "kurtosis",
               *[f"lag_{k}" for k in CUSTOM_LAGS],
               *[f"rolling_{s}_{w}" for w in CUSTOM_WINDOWS for s in ("mean", "std", "max", "min")],
               "trend_slope", "last_change", "change_rate"]


@register("features_custom_windows",
          _with(S.silver_sql(), S.snapshot_sql(max_history=CUSTOM_HISTORY, windows=CUSTOM_WINDOWS, lags=CUSTOM_LAGS))
          + f"SELECT {S.rounded_select(CUSTOM_COLS, set(CUSTOM_COLS) - {'sensor_id', 'n'})} FROM snap")
def q_features_custom(spark, sf_dir):
    f = feat.snapshot_features(events_silver(spark, sf_dir), max_history=CUSTOM_HISTORY,
                               windows=CUSTOM_WINDOWS, lags=CUSTOM_LAGS)
    return round_doubles(f.select(*CUSTOM_COLS))


# ---------------------------------------------------------------- detectors
def forest_predictions(spark, sf_dir):
    """Train on expanding prefixes of all Silver rows, score each sensor's latest snapshot,
    one prediction per Silver record (records of sensors without complete features drop)."""
    silver = events_silver(spark, sf_dir)
    model = IF.train(spark, TR.training_matrix(silver))
    if model is None:
        return None, None
    scored = IF.predict(spark, feat.snapshot_features(silver), model)
    preds = J.latest_lookup(silver.select("id", "sensor_id", "event_timestamp"),
                            scored.select("sensor_id", F.lit(0).alias("timestamp"), F.lit(0).alias("id"),
                                          "is_anomaly", "anomaly_score", "confidence", "model_version"))
    return model, preds.select("id", "sensor_id", F.col("event_timestamp").alias("timestamp"),
                               F.col("f_is_anomaly").alias("is_anomaly"),
                               F.col("f_anomaly_score").alias("anomaly_score"),
                               F.col("f_confidence").alias("confidence"),
                               F.col("f_model_version").alias("model_version"))


SCORED_COLS = f"""decision < 0 AS is_anomaly, {S.r6('decision')} AS anomaly_score,
  {S.r6('least(1.0, greatest(0.0, (abs(decision) + 0.5) / 1.5))')} AS confidence, '{fixed.MODEL_VERSION}' AS model_version"""


@register("iforest_scores", _with(S.silver_sql(), S.expanding_sql(), _matrix_sql(), S.snapshot_sql(),
                                  S.forest_sql(NAMES, "(SELECT sensor_id AS vid, * FROM snap)")).replace("WITH", "WITH RECURSIVE", 1)
          + f"""SELECT id, sensor_id, event_timestamp AS "timestamp", {SCORED_COLS} FROM silver JOIN fscored ON vid = sensor_id""")
def q_iforest_scores(spark, sf_dir):
    _model, preds = forest_predictions(spark, sf_dir)
    return round_doubles(preds)


@register("kmeans_anomalies")
def q_kmeans(spark, sf_dir):
    w = WF.window_aggregate(events_silver(spark, sf_dir))
    model = KM.fit(w)
    out = KM.predict(w, model, detection_ts=F.col("timestamp"))
    return out.select("sensor_id", _ntz("timestamp").alias("timestamp"), "cluster", "is_anomaly",
                      "anomaly_score", *fixed.KMEANS_COLUMNS)


CENTROID_SQL = _with(S.silver_sql(), S.sliding_sql("silver", 6, "hour", "6h")) + """, f AS (
  SELECT s.*, coalesce(std_6h, 0.0) AS std0, t.sensor_type
  FROM slid s JOIN (SELECT DISTINCT sensor_id, sensor_type FROM silver) t USING (sensor_id)),
c AS (SELECT sensor_type AS label, avg(mean_6h) AS cm, avg(std0) AS cs, avg(range_6h) AS cr,
             avg(CAST(count_6h AS DOUBLE)) AS cc FROM f GROUP BY sensor_type),
d AS (SELECT f.sensor_id, f."timestamp", c.label,
        sqrt((mean_6h - cm) * (mean_6h - cm) + (std0 - cs) * (std0 - cs)
             + (range_6h - cr) * (range_6h - cr) + (count_6h - cc) * (count_6h - cc)) AS distance
      FROM f, c)
SELECT sensor_id, "timestamp", label AS nearest, CASE WHEN abs(distance) < 1e9 THEN floor((distance) * 1e6 + 501e-3) / 1e6 ELSE (distance) END AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY sensor_id, "timestamp" ORDER BY distance, label) = 1"""


@register("centroid_distance", CENTROID_SQL)
def q_centroid_distance(spark, sf_dir):
    w = WF.window_aggregate(events_silver(spark, sf_dir), duration="6 hours", slide="1 hour",
                            suffix="6h", extra_keys=("sensor_type",))
    cols = ["mean_6h", "std_6h", "range_6h", "count_6h"]
    w = KM.prepare(w, cols)
    centers = w.groupBy("sensor_type").agg(*[F.avg(c).alias(c) for c in cols])
    out = KM.nearest_center(w, cols, centers, "sensor_type")
    return round_doubles(out.select("sensor_id", _ntz("timestamp").alias("timestamp"), "nearest", "distance"))


# ---------------------------------------------------------------- streaming (availableNow replays)
STREAM_OUT = ["sensor_id", "sensor_type", "value", "unit", "timestamp", "location", "source",
              "is_valid", "cleaned_value", "quality_score"]


def _replayed(spark, sf_dir, name: str) -> SP.PipelinePaths:
    paths = SP.PipelinePaths.under(scratch_path(spark, name))
    SP.write_replay(event_readings(spark, sf_dir), paths.input_path)
    return paths


@register("stream_silver", _with(S.READINGS_SQL) + """SELECT sensor_id, sensor_type, value, unit,
  event_timestamp AS "timestamp", location, 'iot_sensors' AS source,
  coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) AS is_valid,
  CASE WHEN coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) THEN value ELSE CAST(0.0 AS DOUBLE) END AS cleaned_value,
  CASE WHEN coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS quality_score
FROM readings""")
def q_stream_silver(spark, sf_dir):
    paths = _replayed(spark, sf_dir, "stream_silver")
    SP.ingest_to_bronze(spark, paths).awaitTermination()
    SP.process_to_silver(spark, paths).awaitTermination()
    out = spark.read.parquet(paths.silver_path)
    return out.select(*[_ntz(c).alias(c) if c == "timestamp" else F.col(c) for c in STREAM_OUT])


STREAM_WIN_SQL = _with(S.READINGS_SQL) + """, silver AS (
  SELECT sensor_id, value AS cleaned_value, event_timestamp,
         coalesce(value IS NOT NULL AND value > -999.0 AND value < 999.0, false) AS is_valid FROM readings),
""" + S.sliding_sql("silver", 5, "minute", "5min") + f"""
SELECT {S.rounded_select(WIN_COLS, set(WIN_COLS) - {'sensor_id', 'timestamp', 'count_5min'})} FROM slid
WHERE "timestamp" + INTERVAL 5 MINUTE <= (SELECT max(event_timestamp) FROM readings) - INTERVAL 10 MINUTE"""


@register("stream_window_features", STREAM_WIN_SQL)
def q_stream_window_features(spark, sf_dir):
    paths = _replayed(spark, sf_dir, "stream_windows")
    SP.ingest_to_bronze(spark, paths).awaitTermination()
    SP.process_to_silver(spark, paths).awaitTermination()
    SP.generate_features(spark, paths).awaitTermination()
    out = spark.read.parquet(paths.features_path)
    return round_doubles(out.withColumn("timestamp", _ntz("timestamp")).select(*WIN_COLS))


@register("stream_kmeans")
def q_stream_kmeans(spark, sf_dir):
    paths = _replayed(spark, sf_dir, "stream_kmeans")
    SP.run_pipeline(spark, paths)
    out = spark.read.parquet(paths.anomalies_path)
    return out.select("sensor_id", _ntz("timestamp").alias("timestamp"), "cluster", "is_anomaly",
                      "anomaly_score", *fixed.KMEANS_COLUMNS)


@register("stream_pipeline")
def q_stream_pipeline(spark, sf_dir):
    paths = _replayed(spark, sf_dir, "stream_pipeline")
    stats = SP.run_pipeline(spark, paths)
    rows = [(k, v["batches"], v["rows"], v["dropped_by_watermark"]) for k, v in stats.items()]
    tables = {"bronze": paths.bronze_path, "silver": paths.silver_path,
              "features": paths.features_path, "anomalies": paths.anomalies_path}
    counts = None
    for stage, path in tables.items():
        c = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("table_rows")).withColumn("stage", F.lit(stage))
        counts = c if counts is None else counts.unionByName(c)
    prog = spark.createDataFrame(rows, "stage STRING, batches INT, input_rows BIGINT, dropped_by_watermark BIGINT")
    return prog.join(counts, "stage")


# Replays are cut into time slots, one micro-batch each; the same rows are in a batch in every run.
SLOT, SLOT_US = "7 days", 7 * 86_400_000_000


def _slots_sql(source: str, time: str) -> str:
    return f"SELECT *, dense_rank() OVER (ORDER BY epoch_us({time}) // {SLOT_US}) - 1 AS batch FROM {source}"


MICRO_SQL = _with(
    S.silver_sql(), S.expanding_sql(), _matrix_sql(), f"sb AS ({_slots_sql('silver', 'event_timestamp')})",
    """bhist AS (
  SELECT b.batch || '|' || s.sensor_id AS sensor_id, cleaned_value, is_valid, event_timestamp, id
  FROM (SELECT DISTINCT batch, sensor_id FROM sb) b JOIN sb s ON s.sensor_id = b.sensor_id AND s.batch <= b.batch)""",
    S.snapshot_sql("bhist"), S.forest_sql(NAMES, "(SELECT sensor_id AS vid, * FROM snap)")).replace("WITH", "WITH RECURSIVE", 1) + f"""
SELECT CAST(batch AS BIGINT) AS batch_id, id, sensor_id, event_timestamp AS "timestamp", {SCORED_COLS}
FROM sb JOIN fscored ON vid = batch || '|' || sensor_id"""
PREDICTIONS = ("id BIGINT, sensor_id STRING, timestamp TIMESTAMP_NTZ, is_anomaly BOOLEAN, anomaly_score DOUBLE, confidence DOUBLE, "
               "model_version STRING, batch_id BIGINT")
MICRO_OUT = ["batch_id", "id", "sensor_id", "timestamp", "is_anomaly", "anomaly_score", "confidence", "model_version"]


def _slot_replay(spark, sf_dir, name: str):
    """The readings as time slots, the forest of the full Silver table, and a folder for the outputs."""
    root, r = scratch_path(spark, name), event_readings(spark, sf_dir)
    SP.write_slots(r, f"{root}/replay", SLOT)
    model = IF.train(spark, TR.training_matrix(events_silver(spark, sf_dir)))
    return root, SP.slot_stream(spark, f"{root}/replay", r.schema), model


@register("micro_batch", MICRO_SQL)
def q_micro_batch(spark, sf_dir):
    """Replay the readings as weekly micro-batches through the foreachBatch service form with a
    forest trained on the full Silver table; returns one prediction per scored record."""
    root, stream, model = _slot_replay(spark, sf_dir, "micro_batch")
    dim, n = sensor_dimension(spark)
    SP.process_batches(spark, stream, dim, n, root,
                       scorer=lambda f: IF.predict(spark, f, model)).awaitTermination()
    return round_doubles(spark.read.schema(PREDICTIONS).parquet(f"{root}/anomalies").select(_long("batch_id"), *MICRO_OUT[1:]))


@register("micro_batch_stateful", MICRO_SQL)
def q_micro_batch_stateful(spark, sf_dir):
    """``micro_batch`` on bounded per-sensor state (applyInPandasWithState keeps the newest
    100 valid rows of each sensor) instead of re-reading the Silver history every batch."""
    root, stream, model = _slot_replay(spark, sf_dir, "micro_batch_stateful")
    dim, n = sensor_dimension(spark)
    for q in SP.process_batches_stateful(spark, stream, dim, n, root,
                                         scorer=lambda f: IF.predict(spark, f, model)):
        q.awaitTermination()
    return round_doubles(spark.read.schema(PREDICTIONS).parquet(f"{root}/anomalies").select(_long("batch_id"), *MICRO_OUT[1:]))


# ---------------------------------------------------------------- late rows: dead letters and the windows of the rest
def _late_arrivals(spark, sf_dir):
    """Readings of the zones 3 and 7 reach the service twelve hours after their time."""
    r = event_readings(spark, sf_dir).select("sensor_id", "sensor_type", "value", "unit", F.col("timestamp").cast("timestamp").alias("timestamp"), "location")
    wait = F.when(F.col("location").isin("zone_3", "zone_7"), F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    return r.withColumn("arrival", F.col("timestamp") + wait)


LATE_SQL = _with(S.READINGS_SQL, f"""arrivals AS (
  SELECT *, event_timestamp + CASE WHEN location IN ('zone_3', 'zone_7') THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS arrival
  FROM readings),
ab AS ({_slots_sql('arrivals', 'arrival')}),
newest AS (SELECT batch, max(max(event_timestamp)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t
  FROM ab GROUP BY batch),
judged AS (
  SELECT a.*, value AS cleaned_value, CASE WHEN NOT coalesce(value > -999.0 AND value < 999.0, false) THEN 'invalid'
    WHEN event_timestamp < n.t - INTERVAL 10 MINUTE THEN 'late' END AS reason,
    true AS is_valid FROM ab a JOIN newest n USING (batch))""")


def _split_late(spark, sf_dir, name: str):
    root, rows = scratch_path(spark, name), _late_arrivals(spark, sf_dir)
    SP.write_slots(rows, f"{root}/replay", SLOT, by="arrival")
    bronze = silv.add_ingestion_metadata(SP.slot_stream(spark, f"{root}/replay", rows.drop("arrival").schema))
    silver = silv.silver_sentinel(bronze).withColumn("event_date", F.to_date("timestamp"))
    DL.split_dead_letters(spark, silver, f"{root}/split").awaitTermination()
    return root


@register("stream_dead_letters", LATE_SQL + """
SELECT CAST(batch AS BIGINT) AS batch_id, sensor_id, event_timestamp AS "timestamp", value, reason FROM judged WHERE reason IS NOT NULL""")
def q_stream_dead_letters(spark, sf_dir):
    root = _split_late(spark, sf_dir, "dead_letters")
    out = DL.dead_letters(spark, f"{root}/split", SP.SILVER_FLAT)
    return out.select(F.col("epoch").alias("batch_id"), "sensor_id", _ntz("timestamp").alias("timestamp"), "value", "reason")


@register("stream_batch_counts", LATE_SQL + """
SELECT CAST(batch AS BIGINT) AS batch_id, count(*) AS "input", count(*) FILTER (reason IS NULL) AS accepted,
  count(*) FILTER (reason = 'invalid') AS invalid, count(*) FILTER (reason = 'late') AS late FROM judged GROUP BY batch""")
def q_stream_batch_counts(spark, sf_dir):
    root = _split_late(spark, sf_dir, "batch_counts")
    return DL.batch_counts(spark, f"{root}/split").select(F.col("epoch").alias("batch_id"), "input", "accepted", "invalid", "late")


@register("stream_accepted_windows", LATE_SQL + ", " + S.sliding_sql("(SELECT * FROM judged WHERE reason IS NULL)", 5, "minute", "5min") + f"""
SELECT {S.rounded_select(WIN_COLS, set(WIN_COLS) - {'sensor_id', 'timestamp', 'count_5min'})} FROM slid
WHERE "timestamp" + INTERVAL 5 MINUTE <= (SELECT max(event_timestamp) FROM judged WHERE reason IS NULL) - INTERVAL 10 MINUTE""")
def q_stream_accepted_windows(spark, sf_dir):
    root = _split_late(spark, sf_dir, "accepted_windows")
    paths = SP.PipelinePaths.under(f"{root}/stages")
    SP.generate_features(spark, paths, accepted_root=f"{root}/split").awaitTermination()
    out = spark.read.parquet(paths.features_path)
    return round_doubles(out.withColumn("timestamp", _ntz("timestamp")).select(*WIN_COLS))


# ---------------------------------------------------------------- lineitem series (timing scale)
LI_ORDER = ("event_timestamp", "ord1", "ord2", "cleaned_value", "id")


def lineitem_silver(spark, sf_dir):
    dim, n = sensor_dimension(spark)
    return silv.silver_range(lineitem_readings(spark, sf_dir), dim, dim_rows=n,
                             processed_ts=F.col("timestamp"), passthrough=("ord1", "ord2"))


@register("features_snapshot_lineitem",
          _with(S.silver_sql(S.LINEITEM_READINGS_SQL),
                S.snapshot_sql(order_desc="event_timestamp DESC, ord1 DESC, ord2 DESC, cleaned_value DESC"))
          + f"SELECT {S.rounded_select(SNAPSHOT_COLS, SNAPSHOT_DOUBLES)} FROM snap")
def q_features_snapshot_lineitem(spark, sf_dir):
    f = feat.snapshot_features(lineitem_silver(spark, sf_dir), order_cols=LI_ORDER)
    return round_doubles(f.select(*SNAPSHOT_COLS))


LI_EXP_COLS = ["sensor_id", "event_timestamp", "ord1", "ord2", "n"] + NAMES


@register("features_expanding_lineitem",
          _with(S.silver_sql(S.LINEITEM_READINGS_SQL),
                S.expanding_sql(order="event_timestamp, ord1, ord2, v",
                                keep="event_timestamp, ord1, ord2"))
          + f"SELECT {S.rounded_select(LI_EXP_COLS, set(NAMES))} FROM expd")
def q_features_expanding_lineitem(spark, sf_dir):
    e = feat.expanding_features(lineitem_silver(spark, sf_dir), order_cols=LI_ORDER)
    return round_doubles(e.withColumn("n", F.col("n").cast("long")).select(*LI_EXP_COLS))


@register("sliding_window_features_lineitem",
          _with(S.silver_sql(S.LINEITEM_READINGS_SQL), S.sliding_sql("silver", 6, "hour", "6h"))
          + f"SELECT {S.rounded_select(WIDE_COLS, set(WIDE_COLS) - {'sensor_id', 'timestamp', 'count_6h'})} FROM slid")
def q_sliding_lineitem(spark, sf_dir):
    w = WF.window_aggregate(lineitem_silver(spark, sf_dir), duration="6 hours", slide="1 hour", suffix="6h")
    return round_doubles(w.withColumn("timestamp", _ntz("timestamp")).select(*WIDE_COLS))


# ---------------------------------------------------------------- hot keys: a third of all rows per key
HOT_BLOCK_ROWS = 16384


def lineitem_by_flag_silver(spark, sf_dir):
    """lineitem keyed by return flag: three sensors, each holding a third of all rows."""
    dim, n = sensor_dimension(spark)
    r = lineitem_readings(spark, sf_dir).withColumn("sensor_id", F.concat(F.lit("flag_"), F.col("location")))
    return silv.silver_range(r, dim, dim_rows=n, processed_ts=F.col("timestamp"), passthrough=("ord1", "ord2"))


@register("features_expanding_hot",
          _with(S.silver_sql(S.lineitem_readings_sql("'flag_' || l_returnflag")),
                S.expanding_sql(order="event_timestamp, ord1, ord2, v", keep="event_timestamp, ord1, ord2"))
          + f"SELECT {S.rounded_select(LI_EXP_COLS, set(NAMES))} FROM expd")
def q_features_expanding_hot(spark, sf_dir):
    """Expanding prefixes where each key holds a third of the table, on the blocked plan:
    every task sees one (key, block) piece of at most HOT_BLOCK_ROWS rows plus a halo."""
    e = feat.expanding_features(lineitem_by_flag_silver(spark, sf_dir), order_cols=LI_ORDER,
                                method="blocked", block_rows=HOT_BLOCK_ROWS)
    return round_doubles(e.withColumn("n", F.col("n").cast("long")).select(*LI_EXP_COLS))


@register("features_snapshot_hot",
          _with(S.silver_sql(S.lineitem_readings_sql("'flag_' || l_returnflag")),
                S.snapshot_sql(order_desc="event_timestamp DESC, ord1 DESC, ord2 DESC, cleaned_value DESC"))
          + f"SELECT {S.rounded_select(SNAPSHOT_COLS, SNAPSHOT_DOUBLES)} FROM snap")
def q_features_snapshot_hot(spark, sf_dir):
    f = feat.snapshot_features(lineitem_by_flag_silver(spark, sf_dir), order_cols=LI_ORDER)
    return round_doubles(f.select(*SNAPSHOT_COLS))


DEEP_READINGS, DEEP_HISTORY = 2000, 5000


@register("recent_readings_hot", _with(S.silver_sql(S.lineitem_readings_sql("'flag_' || l_returnflag"))) + f"""SELECT
  sensor_id, event_timestamp, ord1, ord2, cleaned_value,
  row_number() OVER (PARTITION BY sensor_id ORDER BY event_timestamp DESC, ord1 DESC, ord2 DESC, cleaned_value DESC) AS position
FROM silver QUALIFY position <= {DEEP_READINGS}""")
def q_recent_hot(spark, sf_dir):
    """Newest 2,000 rows of keys that hold a third of the table each: beyond Spark's group limit."""
    r = SV.recent_per_sensor(lineitem_by_flag_silver(spark, sf_dir), DEEP_READINGS, order_cols=LI_ORDER)
    return r.select("sensor_id", "event_timestamp", "ord1", "ord2", "cleaned_value", _long("position"))


@register("features_snapshot_deep",
          _with(S.silver_sql(S.lineitem_readings_sql("'flag_' || l_returnflag")),
                S.snapshot_sql(max_history=DEEP_HISTORY, order_desc="event_timestamp DESC, ord1 DESC, ord2 DESC, cleaned_value DESC"))
          + f"SELECT {S.rounded_select(SNAPSHOT_COLS, SNAPSHOT_DOUBLES)} FROM snap")
def q_features_snapshot_deep(spark, sf_dir):
    f = feat.snapshot_features(lineitem_by_flag_silver(spark, sf_dir), max_history=DEEP_HISTORY, order_cols=LI_ORDER)
    return round_doubles(f.select(*SNAPSHOT_COLS))
