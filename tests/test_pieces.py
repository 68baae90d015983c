"""Ordered pieces: a hot (key, time slot) is cut by count, and every scan built on pieces
gives the same answer whichever way a series was cut."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import blocked as B
from gaugeflow.operators import features as feat
from gaugeflow.operators import joins as J
from gaugeflow.operators import quality as Q
from gaugeflow.operators import scan


def _burst(spark, n_hot=240, n_cold=30, seed=4):
    """Sensor 'hot' has all its rows inside one hour (a burst); 'cold' is spread over days.
    Every third value of 'hot' is missing."""
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 3, 1, 12, 0, 0)
    rows = []
    for i in range(n_hot):
        v = None if i % 3 == 1 else float(rng.normal(10, 2))
        rows.append((i, "hot", base + dt.timedelta(seconds=7 * i), v))
    for i in range(n_cold):
        v = None if i % 4 == 2 else float(rng.normal(0, 1))
        rows.append((10_000 + i, "cold", base + dt.timedelta(hours=5 * i), v))
    return spark.createDataFrame(rows, "id BIGINT, sensor_id STRING, event_timestamp TIMESTAMP, value DOUBLE")


def test_auto_switches_to_count_pieces_for_a_hot_slot(spark):
    df = _burst(spark)
    bucket = scan.time_bucket("event_timestamp")
    n, biggest = scan.piece_sizes(df, ["sensor_id"], bucket)
    assert (n, biggest) == (270, 240)
    cut = scan.with_pieces(df, "sensor_id", ["event_timestamp", "id"], bucket, "auto", max_piece_rows=32)
    sizes = cut.groupBy("sensor_id", scan.PIECE).count().collect()
    assert max(r["count"] for r in sizes) <= 64                      # no piece holds the burst
    assert sum(1 for r in sizes if r.sensor_id == "hot") >= 4
    assert sum(r["count"] for r in sizes) == 270                      # nothing dropped or copied
    # pieces are contiguous and ordered like the series
    rows = cut.where("sensor_id = 'hot'").select("id", scan.PIECE).orderBy("id").collect()
    pieces = [r[scan.PIECE] for r in rows]
    assert pieces == sorted(pieces)
    # below the limit the time slot is kept as the piece
    kept = scan.with_pieces(df, "sensor_id", ["event_timestamp", "id"], bucket, "auto", max_piece_rows=1000)
    assert kept.select(scan.PIECE).distinct().count() == df.select(bucket).distinct().count()


def test_positions_on_count_pieces(spark):
    df = _burst(spark).withColumnRenamed("value", "v")
    pos = B.global_positions(df, "sensor_id", ["event_timestamp", "id"], "event_timestamp", pieces="rows")
    got = pos.orderBy("sensor_id", "id").collect()
    for sid in ("hot", "cold"):
        ps = [r.pos for r in got if r.sensor_id == sid]
        assert ps == list(range(1, len(ps) + 1))


@pytest.mark.parametrize("pieces", ["time", "rows"])
def test_fill_and_interpolate_agree_with_brute_force(spark, pieces):
    df = _burst(spark)
    ff = Q.forward_fill(df, pieces=pieces).orderBy("sensor_id", "id").collect()
    ip = Q.interpolate(df, pieces=pieces).orderBy("sensor_id", "id").collect()
    pdf = df.orderBy("sensor_id", "event_timestamp", "id").toPandas()
    for sid, g in pdf.groupby("sensor_id"):
        g = g.sort_values(["event_timestamp", "id"])
        want_ff = g["value"].ffill().tolist()
        t = g["event_timestamp"].astype("int64").to_numpy() / 1e9
        s = g.set_index(t)["value"]
        want_ip = s.interpolate(method="index", limit_area="inside").tolist()
        got_ff = [r.filled_value for r in ff if r.sensor_id == sid]
        got_ip = [r.interpolated_value for r in ip if r.sensor_id == sid]
        assert got_ff == pytest.approx(want_ff, nan_ok=True)
        assert got_ip == pytest.approx(want_ip, nan_ok=True)


def test_asof_on_count_pieces_matches_time_pieces(spark):
    df = _burst(spark)
    recs = df.select("id", "sensor_id", "event_timestamp")
    feats = df.where(F.col("value").isNotNull()).select(
        "sensor_id", F.col("event_timestamp").alias("ts"), F.col("id").alias("fid"), "value")
    args = ("sensor_id", "event_timestamp", "ts", ["ts", "fid", "value"])
    a = J.asof_lookup(recs, feats, *args, rec_order="id", feat_order="fid", pieces="time")
    b = J.asof_lookup(recs, feats, *args, rec_order="id", feat_order="fid", pieces="rows")
    c = J.asof_lookup(recs, feats, *args, rec_order="id", feat_order="fid", materialize_input=True)
    ka = sorted(tuple(r) for r in a.collect())
    kb = sorted(tuple(r) for r in b.collect())
    kc = sorted(tuple(r) for r in c.collect())
    assert ka == kb == kc and len(ka) == df.count() - _leading_missing(df)


def _leading_missing(df):
    # records before their sensor's first known value have no feature row yet
    pdf = df.orderBy("event_timestamp", "id").toPandas()
    out = 0
    for _, g in pdf.groupby("sensor_id"):
        vals = g.sort_values(["event_timestamp", "id"])["value"].tolist()
        for v in vals:
            if v is None or (isinstance(v, float) and np.isnan(v)):
                out += 1
            else:
                break
    return out


def test_blocked_expanding_on_count_pieces_matches_window_plan(spark):
    rng = np.random.default_rng(8)
    base = dt.datetime(2024, 5, 1)
    rows = [(i, "hot", base + dt.timedelta(seconds=i), float(rng.normal(5, 1))) for i in range(180)]
    df = spark.createDataFrame(rows, "id BIGINT, sensor_id STRING, event_timestamp TIMESTAMP, cleaned_value DOUBLE")
    want = feat.expanding_features(df, method="window").orderBy("n").collect()
    got = feat.expanding_features(df, method="blocked", block_rows=64, pieces="rows").orderBy("n").collect()
    assert len(got) == len(want) == 175
    for g, w in zip(got, want):
        for k, v in w.asDict().items():
            if isinstance(v, float):
                assert g[k] == pytest.approx(v, rel=1e-9, abs=1e-9), k
            else:
                assert g[k] == v, k


@pytest.mark.parametrize("pieces", ["time", "rows"])
def test_blocked_history_matches_window_plan(spark, pieces):
    rng = np.random.default_rng(13)
    base = dt.datetime(2024, 6, 1)
    rows = []
    for sid, n in (("a", 170), ("b", 40), ("c", 3)):
        rows += [(len(rows) + i, sid, base + dt.timedelta(seconds=i), float(np.round(rng.normal(7, 2), 2)))
                 for i in range(n)]
    df = spark.createDataFrame(rows, "id BIGINT, sensor_id STRING, event_timestamp TIMESTAMP, cleaned_value DOUBLE")
    want = sorted((r.asDict() for r in feat.history_features(df, method="window").collect()), key=lambda r: r["id"])
    got = sorted((r.asDict() for r in feat.history_features(df, method="blocked", block_rows=64,
                                                           pieces=pieces).collect()), key=lambda r: r["id"])
    assert len(got) == len(want) == 213
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        for k, v in w.items():
            if isinstance(v, float):
                assert g[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k
            else:
                assert g[k] == v, k


@pytest.mark.parametrize("build", [feat.expanding_features, feat.history_features])
def test_blocked_plan_equals_window_plan_on_hard_series(spark, build):
    """Missing time, sensor or value, NaN, a level shift and a constant: same rows, same values."""
    rng, t0, rows = np.random.default_rng(0), dt.datetime(2024, 1, 1), []
    nan = list(rng.normal(5, 1, 200))
    nan[149] = float("nan")
    gaps = [None if i in (20, 130) else float(x) for i, x in enumerate(rng.normal(5, 1, 200))]
    series = {"clean": list(rng.normal(10, 2, 200)), "nan": nan, "gaps": gaps, "flat": [20.1] * 150,
              "shift": [*(20 + rng.normal(0, 0.01, 100)), *(1e6 + rng.normal(0, 1, 100))]}
    for sensor, values in series.items():
        for i, v in enumerate(values):
            rows.append((len(rows), sensor, t0 + dt.timedelta(minutes=i), None if v is None else float(v)))
    rows += [(len(rows), None, t0, 1.0), (len(rows) + 1, "clean", None, 1.0)]
    df = spark.createDataFrame(rows, "id BIGINT, sensor_id STRING, event_timestamp TIMESTAMP, cleaned_value DOUBLE")
    one = build(df, method="window").toPandas().sort_values("id").reset_index(drop=True)
    cut = build(df, method="blocked", block_rows=64).toPandas().sort_values("id").reset_index(drop=True)[one.columns]
    assert one["id"].tolist() == cut["id"].tolist()
    for c in one.columns[3:]:
        np.testing.assert_allclose(cut[c].to_numpy(float), one[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)
