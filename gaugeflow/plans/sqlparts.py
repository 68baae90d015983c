"""DuckDB SQL fragments for the oracle side of the checked queries.

These restate the same semantics in plain SQL over the pre-registered tables; they are
the independent second implementation the Spark queries are compared against.
"""

from __future__ import annotations

from gaugeflow import fixed


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def dim_values_sql() -> str:
    ref = ", ".join(f"('{s}', '{t}', '{loc}', '{u}', {_d(lo)}, {_d(hi)})"
                    for s, t, loc, lo, hi, u in fixed.SERVICE_SENSORS)
    types = ", ".join(f"('{t}', {_d(lo)}, {_d(hi)})" for t, lo, hi in fixed.EVENT_TYPE_RANGES)
    return (
        "dim AS (\n"
        "  SELECT t.type || '_' || CAST(z.range AS VARCHAR) AS sensor_id, t.type AS type,\n"
        "         'zone_' || CAST(z.range AS VARCHAR) AS location, 'u' AS unit, t.lo, t.hi\n"
        f"  FROM (VALUES {types}) t(type, lo, hi), range({fixed.EVENT_ZONES}) z\n"
        f"  UNION ALL SELECT * FROM (VALUES {ref}) r(sensor_id, type, location, unit, lo, hi))"
    )


READINGS_SQL = f"""readings AS (
  SELECT event_id AS id,
         event_type || '_' || CAST(user_id % {fixed.EVENT_ZONES} AS VARCHAR) AS sensor_id,
         event_type AS sensor_type, CAST(value AS DOUBLE) AS value, 'u' AS unit,
         ts AS event_timestamp,
         'zone_' || CAST(user_id % {fixed.EVENT_ZONES} AS VARCHAR) AS location,
         json_extract_string(props, '$.k') AS meta_k
  FROM events)"""


def lineitem_readings_sql(sensor_expr: str = "'supp_' || CAST(l_suppkey AS VARCHAR)") -> str:
    return f"""readings AS (
  SELECT {sensor_expr} AS sensor_id, 'lineitem' AS sensor_type,
         l_quantity AS value, 'units' AS unit, l_shipdate AS event_timestamp, l_returnflag AS location,
         CAST(l_orderkey AS VARCHAR) AS meta_k, l_orderkey AS ord1, l_linenumber AS ord2,
         CAST(0 AS BIGINT) AS id
  FROM lineitem)"""


LINEITEM_READINGS_SQL = lineitem_readings_sql()


def silver_sql(readings_sql: str = READINGS_SQL) -> str:
    """CTEs readings, dim, flags, silver (range rules)."""
    extra = ", ord1, ord2" if "ord1" in readings_sql else ""
    return f"""{readings_sql},
{dim_values_sql()},
flags AS (
  SELECT r.*,
    coalesce(NOT isnan(r.value) AND (r.value < d.lo * {_d(fixed.EXTENDED_LOW)}
                                     OR r.value > d.hi * {_d(fixed.EXTENDED_HIGH)}), false) AS r_ext,
    coalesce(NOT isnan(r.value) AND (r.value < d.lo * {_d(fixed.EXTREME_LOW)}
                                     OR r.value > d.hi * {_d(fixed.EXTREME_HIGH)}), false) AS r_xtr,
    coalesce(NOT isnan(r.value) AND abs(r.value) > {_d(fixed.MAGNITUDE_LIMIT)}, false) AS r_mag
  FROM readings r LEFT JOIN (SELECT sensor_id, lo, hi FROM dim) d USING (sensor_id)),
q1 AS (SELECT *, CASE WHEN r_ext THEN {_d(1.0)} * {_d(fixed.EXTENDED_FACTOR)} ELSE {_d(1.0)} END AS q1 FROM flags),
q2 AS (SELECT *, CASE WHEN r_xtr THEN q1 * {_d(fixed.EXTREME_FACTOR)} ELSE q1 END AS q2 FROM q1),
silver AS (
  SELECT id, sensor_id, sensor_type, value AS cleaned_value, value AS original_value,
         NOT r_xtr AS is_valid,
         CASE WHEN r_mag THEN q2 * {_d(fixed.MAGNITUDE_FACTOR)} ELSE q2 END AS quality_score,
         location, unit, meta_k, event_timestamp{extra}
  FROM q2)"""


def snapshot_sql(source: str = "silver", max_history: int = fixed.MAX_HISTORY,
                 valid_only: bool = True, windows=fixed.ROLLING_WINDOWS, lags=fixed.LAGS,
                 order_desc: str = "event_timestamp DESC, id DESC") -> str:
    """CTEs ranked, capped, snap: the 30 snapshot features per sensor (unrounded)."""
    where = "WHERE is_valid" if valid_only else ""
    lag_cols = ",\n    ".join(f"max(CASE WHEN rn = {k + 1} THEN v END) AS lag_{k}" for k in lags)
    roll = []
    for w in windows:
        roll += [f"CASE WHEN count(v) >= {w} THEN avg(CASE WHEN rn <= {w} THEN v END) END AS rolling_mean_{w}",
                 f"CASE WHEN count(v) >= {w} THEN stddev_pop(CASE WHEN rn <= {w} THEN v END) END AS rolling_std_{w}",
                 f"CASE WHEN count(v) >= {w} THEN max(CASE WHEN rn <= {w} THEN v END) END AS rolling_max_{w}",
                 f"CASE WHEN count(v) >= {w} THEN min(CASE WHEN rn <= {w} THEN v END) END AS rolling_min_{w}"]
    roll_cols = ",\n    ".join(roll)
    cap = f"WHERE rn <= {max_history}" if max_history else ""
    return f"""ranked AS (
  SELECT sensor_id, cleaned_value AS v,
         row_number() OVER (PARTITION BY sensor_id ORDER BY {order_desc}) AS rn
  FROM {source} {where}),
capped AS (SELECT * FROM ranked {cap}),
snap AS (
  SELECT sensor_id, count(v) AS n, avg(v) AS "mean", stddev_pop(v) AS std,
    min(v) AS "min", max(v) AS "max", max(v) - min(v) AS "range",
    coalesce(skewness(v), 0.0) AS skewness, coalesce(kurtosis(v), 0.0) AS kurtosis,
    {lag_cols},
    {roll_cols},
    CASE WHEN count(v) >= {fixed.MIN_ROWS_TREND} THEN regr_slope(v, -CAST(rn AS DOUBLE)) END AS trend_slope,
    max(CASE WHEN rn = 1 THEN v END) - max(CASE WHEN rn = 2 THEN v END) AS last_change,
    (max(CASE WHEN rn = 1 THEN v END) - arg_max(v, rn)) / count(v) AS change_rate
  FROM capped GROUP BY sensor_id HAVING count(v) >= {fixed.MIN_ROWS_FEATURES})"""


def r6(expr: str, places: int = 6) -> str:
    """SQL form of ``checked.r6``: floor(x * 10^places + 0.501) / 10^places for |x| < 1e9."""
    scale = f"1e{places}"
    return f"CASE WHEN abs({expr}) < 1e9 THEN floor(({expr}) * {scale} + 501e-3) / {scale} ELSE ({expr}) END"


def rounded_select(cols: list[str], doubles: set[str], places: int = 6) -> str:
    out = []
    for c in cols:
        q = f'"{c}"'
        out.append(f"{r6(q, places)} AS {q}" if c in doubles else q)
    return ", ".join(out)


def over(partition: str, order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {partition} ORDER BY {order} {frame})"


def history_sql(source: str = "silver", valid_only: bool = True, windows=fixed.ROLLING_WINDOWS,
                lags=fixed.LAGS, order: str = "event_timestamp, id") -> str:
    """CTE hist: per-row lags, rolling stats (gated on position >= w), last_change."""
    where = "WHERE is_valid" if valid_only else ""
    o = over("sensor_id", order)
    cols = [f"lag(v, {k}) {o} AS lag_{k}" for k in lags]
    for w in windows:
        fr = over("sensor_id", order, f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW")
        for fn, nm in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min")):
            cols.append(f"CASE WHEN pos >= {w} THEN {fn}(v) {fr} END AS rolling_{nm}_{w}")
    cols.append(f"v - lag(v, 1) {o} AS last_change")
    return f"""hbase AS (
  SELECT sensor_id, event_timestamp, id, cleaned_value AS v, row_number() {o} AS pos
  FROM {source} {where}),
hist AS (
  SELECT sensor_id, event_timestamp, id, pos, v AS value,
    {(','+chr(10)+'    ').join(cols)}
  FROM hbase)"""


def expanding_sql(source: str = "silver", windows=fixed.ROLLING_WINDOWS, lags=fixed.LAGS,
                  order: str = "event_timestamp, id", min_prefix: int = fixed.MIN_ROWS_FEATURES + 1,
                  min_rows: int = fixed.MIN_ROWS_TRAIN_SENSOR, keep: str = "event_timestamp, id") -> str:
    """CTE expd: one feature vector per prefix (all rows kept, invalid included)."""
    o = over("sensor_id", order)
    g = over("sensor_id", order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    cols = [f"avg(v) {g} AS \"mean\"", f"stddev_pop(v) {g} AS std", f"min(v) {g} AS \"min\"",
            f"max(v) {g} AS \"max\"", f"max(v) {g} - min(v) {g} AS \"range\"",
            f"coalesce(skewness(v) {g}, 0.0) AS skewness", f"coalesce(kurtosis(v) {g}, 0.0) AS kurtosis"]
    cols += [f"lag(v, {k}) {o} AS lag_{k}" for k in lags]
    for w in windows:
        fr = over("sensor_id", order, f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW")
        for fn, nm in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min")):
            cols.append(f"CASE WHEN pos >= {w} THEN {fn}(v) {fr} END AS rolling_{nm}_{w}")
    cols += [f"CASE WHEN pos >= {fixed.MIN_ROWS_TREND} THEN regr_slope(v, CAST(pos AS DOUBLE)) {g} END AS trend_slope",
             f"v - lag(v, 1) {o} AS last_change",
             f"(v - first_value(v) {g}) / pos AS change_rate"]
    return f"""ebase AS (
  SELECT sensor_id, {keep}, v, row_number() {o} AS pos,
         count(*) OVER (PARTITION BY sensor_id) AS len
  FROM (SELECT *, cleaned_value AS v FROM {source})),
expd_all AS (
  SELECT sensor_id, {keep}, pos AS n,
    {(','+chr(10)+'    ').join(cols)}
  FROM ebase WHERE len >= {min_rows}),
expd AS (SELECT * FROM expd_all WHERE n >= {min_prefix})"""


def nan_to_num_sql(c: str) -> str:
    q = f'"{c}"'
    return (f"CASE WHEN {q} IS NULL OR isnan({q}) THEN 0.0 WHEN {q} = 'inf'::DOUBLE THEN {fixed.DOUBLE_MAX!r} "
            f"WHEN {q} = '-inf'::DOUBLE THEN -{fixed.DOUBLE_MAX!r} ELSE {q} END")


def sliding_sql(source: str, duration_units: int, unit: str, suffix: str) -> str:
    """CTE slid: sliding windows of duration_units x 1 unit, slide 1 unit."""
    to_fn = {"minute": "to_minutes", "hour": "to_hours"}[unit]
    return f"""wexp AS (
  SELECT s.sensor_id, s.cleaned_value AS v,
         time_bucket(INTERVAL 1 {unit.upper()}, s.event_timestamp) - {to_fn}(CAST(k.range AS INTEGER)) AS wstart
  FROM {source} s, range({duration_units}) k WHERE s.is_valid),
slid AS (
  SELECT sensor_id, avg(v) AS mean_{suffix}, stddev_samp(v) AS std_{suffix}, min(v) AS min_{suffix},
         max(v) AS max_{suffix}, count(v) AS count_{suffix}, max(v) - min(v) AS range_{suffix},
         wstart AS "timestamp"
  FROM wexp GROUP BY sensor_id, wstart)"""


ANOMS_SQL = """anoms AS (
  SELECT id, sensor_id, event_timestamp AS "timestamp", NOT is_valid AS is_anomaly,
         quality_score - 1.0 AS anomaly_score,
         least(1.0, greatest(0.0, (abs(quality_score - 1.0) + 0.5) / 1.5)) AS confidence
  FROM silver)"""


def _fraction(text: str, part: int = 0) -> str:
    return f"CAST(CAST('0x' || substr(md5({text}), {1 + part * 13}, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0"


def _draw_cols(n_dims: int, seed: int) -> str:
    """f (1-based feature, NULL for a leaf) and thr of a node from tree, node, size, depth, lo, hi."""
    name = f"'{seed}/' || tree || '/' || node"
    return f"""vary[1 + CAST(floor({_fraction(name)} * len(vary)) AS INT)] AS f,
      lo[f] + {_fraction(name, 1)} * (hi[f] - lo[f]) AS thr
    FROM (SELECT *, CASE WHEN size > 1 AND depth < (SELECT levels FROM fpar)
                 THEN list_filter(range(1, {n_dims + 1}), lambda i: hi[i] > lo[i]) ELSE [] END AS vary"""


def forest_sql(names: list[str], to_score: str, matrix: str = "mat", trees: int = fixed.FOREST_TREES,
               psi: int = fixed.FOREST_SAMPLE, seed: int = fixed.FOREST_SEED, share: float = fixed.CONTAMINATION) -> str:
    """CTEs up to ``fscored`` (vid, decision): a hash-drawn isolation forest trained on ``matrix`` scores the complete
    rows of ``to_score`` (vid and the features). Needs WITH RECURSIVE."""
    dims = range(1, len(names) + 1)
    grid = "[" + ", ".join(r6(f'"{c}"') for c in names) + "]"
    complete = " AND ".join(f'"{c}" IS NOT NULL' for c in names)
    scaled = "[" + ", ".join(f"(x[{i}] - mu[{i}]) / sd[{i}]" for i in dims) + "]"

    def spans(over_clause: str) -> str:
        return ", ".join(f"[{', '.join(f'{fn}(x[{i}]){over_clause}' for i in dims)}] AS {nm}"
                         for fn, nm in (("min", "lo"), ("max", "hi")))

    return f"""frows AS (SELECT md5('{seed}/' || sensor_id || '/' || id) AS k, {grid} AS x FROM {matrix}),
fstat AS (SELECT count(*) AS n, least({psi}, count(*)) AS psi, [{', '.join(f'avg(x[{i}])' for i in dims)}] AS mu,
    [{', '.join(f'coalesce(nullif(stddev_pop(x[{i}]), 0), 1)' for i in dims)}] AS sd FROM frows),
fpar0 AS (SELECT *, 15e-1 * psi + 32e0 AS wanted, CAST(ceil(log2(greatest(psi, 2))) AS INT) AS levels FROM fstat),
fpar AS (SELECT *, greatest(1, least({trees}, CAST(floor(n / wanted) AS BIGINT))) AS team,
    least(1e0, wanted * team / greatest(n, 1)) AS share FROM fpar0),
fmat AS MATERIALIZED (SELECT k, {scaled} AS x FROM frows, fstat),
fbags AS MATERIALIZED (
  SELECT CAST(range * team + floor(spot) AS BIGINT) AS tree, x, spot - floor(spot) AS draw
  FROM (SELECT k, x, range, team, share, {_fraction("range || '/' || k")} * team AS spot
        FROM fmat, fpar, range({trees}) WHERE range * team < {trees})
  WHERE spot - floor(spot) < share AND tree < {trees}
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, k) <= (SELECT psi FROM fpar)),
fgrow AS (
  SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, x FROM fbags
  UNION ALL
  SELECT tree, CASE WHEN x[f] <= thr THEN 2 * node ELSE 2 * node + 1 END, depth + 1, x FROM (
    SELECT *, {_draw_cols(len(names), seed)} FROM (
      SELECT tree, node, depth, x, count(*) OVER w AS size, {spans(' OVER w')}
      FROM fgrow WINDOW w AS (PARTITION BY tree, node)))) WHERE f IS NOT NULL),
fnodes AS MATERIALIZED (
  SELECT tree, node, depth, size, f, thr,
    depth + CASE WHEN size > 2 THEN 2 * (ln(size - 1) + 0.5772156649015329e0) - 2e0 * (size - 1) / size
                 WHEN size = 2 THEN 1 ELSE 0 END AS path
  FROM (SELECT *, {_draw_cols(len(names), seed)} FROM (
    SELECT tree, node, any_value(depth) AS depth, count(*) AS size, {spans('')} FROM fgrow GROUP BY tree, node)))),
fsnap AS (SELECT CAST(vid AS VARCHAR) AS vid, {grid} AS x FROM {to_score} WHERE {complete}),
fvec AS MATERIALIZED (
  SELECT 't' || k AS vid, x FROM fmat UNION ALL SELECT 's' || vid, {scaled} FROM fsnap, fstat),
fwalk AS (
  SELECT vid, x, CAST(range AS BIGINT) AS tree, CAST(1 AS BIGINT) AS node FROM fvec, range({trees})
  UNION ALL
  SELECT w.vid, w.x, w.tree, CASE WHEN w.x[n.f] <= n.thr THEN 2 * w.node ELSE 2 * w.node + 1 END
  FROM fwalk w JOIN fnodes n ON n.tree = w.tree AND n.node = w.node WHERE n.f IS NOT NULL),
fscore AS MATERIALIZED (
  SELECT vid, -pow(2e0, -(sum(path) / {trees}) / coalesce(nullif(any_value(c), 0), 1)) AS s0,
         {r6('s0', 9)} AS s
  FROM fwalk w JOIN fnodes n ON n.tree = w.tree AND n.node = w.node AND n.f IS NULL,
    (SELECT CASE WHEN psi > 2 THEN 2 * (ln(psi - 1) + 0.5772156649015329e0) - 2e0 * (psi - 1) / psi
                 WHEN psi = 2 THEN 1 ELSE 0 END AS c FROM fpar)
  GROUP BY vid),
fscored AS (
  SELECT substr(vid, 2) AS vid, s - (SELECT quantile_cont(s, {share}) FROM fscore WHERE vid[1] = 't') AS decision
  FROM fscore WHERE vid[1] = 's')"""
