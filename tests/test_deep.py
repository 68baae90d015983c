"""Scans in levels, window panes, correlated pairs, limits beyond the group limit, envelope positions, exact quantiles per key."""

import datetime as dt
import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.operators import blocked as B
from gaugeflow.operators import bronze as brz
from gaugeflow.operators import correlation as CR
from gaugeflow.operators import features as feat
from gaugeflow.operators import joins as J
from gaugeflow.operators import training as TR
from gaugeflow.operators import windowed as WF
from gaugeflow.plans import checked
from gaugeflow.plans import serving as SV

T0 = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- moments in levels
@pytest.mark.parametrize("chunk", [1000, 7, 2])
def test_scan_moments_over_several_levels(spark, chunk):
    draw = np.random.default_rng(1)
    values = {"a": [draw.normal(1e6, 3, draw.integers(1, 6)) for _ in range(40)], "b": [np.array([5.0])] * 9, "c": [draw.normal(size=4)]}
    rows = []
    for key, blocks in values.items():
        start = 0
        for i, v in enumerate(blocks):
            x = np.arange(start + 1, start + 1 + len(v), dtype=float)
            d = v - v.mean()
            rows.append((key, i, (float(len(v)), v.mean(), x.mean(), (d ** 2).sum(), (d ** 3).sum(), (d ** 4).sum(),
                                  ((x - x.mean()) * d).sum(), v.min(), v.max(), v[0])))
            start += len(v)
    names = ", ".join(f"{c} double" for c in B.SCANNED)
    parts = spark.createDataFrame([(k, i, tuple(float(y) for y in m)) for k, i, m in rows], f"key string, idx long, m struct<{names.replace(' double', ': double')}>")
    got = {(r["key"], r["idx"]): r["before"] for r in B.scan_moments(parts, "key", 39, chunk).collect()}
    assert len(got) == 50
    for key, blocks in values.items():
        for i in range(len(blocks)):
            before = got[(key, i)]
            if i == 0:
                assert before["n"] == 0 and before["first"] is None
                continue
            v = np.concatenate(blocks[:i])
            d = v - v.mean()
            x = np.arange(1, len(v) + 1, dtype=float)
            want = [len(v), v.mean(), x.mean(), (d ** 2).sum(), (d ** 3).sum(), (d ** 4).sum(), ((x - x.mean()) * d).sum(), v.min(), v.max(), v[0]]
            scale = max(1.0, (d ** 4).sum())
            assert np.allclose([before[c] for c in B.SCANNED], want, rtol=1e-9, atol=1e-9 * scale)
            assert key != "b" or before["m2"] == 0  # a constant stays exactly constant


def test_blocked_plan_has_no_python(spark):
    assert "applyInPandas" not in inspect.getsource(B)
    rows = [(i, "s", T0 + dt.timedelta(minutes=i), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, sensor_id string, event_timestamp timestamp, cleaned_value double")
    out = feat.expanding_features(df, method="blocked", block_rows=64)
    assert "Python" not in _plan(out) and "Pandas" not in _plan(out)


def test_blocked_moments_after_an_outlier_and_a_level_shift(spark):
    draw = np.random.default_rng(2)
    v = np.r_[0.0, draw.normal(1e9, 1, 149), draw.normal(-1e6, 1e-3, 150)]
    rows = [(i, "s", T0 + dt.timedelta(minutes=i), float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, sensor_id string, event_timestamp timestamp, cleaned_value double")
    a, b = (feat.expanding_features(df, method=m, block_rows=64).orderBy("n").toPandas() for m in ("window", "blocked"))
    for c in ("mean", "std", "skewness", "kurtosis", "trend_slope"):
        assert np.allclose(a[c], b[c], rtol=1e-8, atol=1e-8, equal_nan=True), c


# ---------------------------------------------------------------- panes
@pytest.mark.parametrize("duration, slide", [("5 minutes", "1 minute"), ("10 minutes", "4 minutes"), ("3 minutes", "3 minutes"), ("1 hour", "25 minutes")])
def test_panes_equal_expanded_windows(spark, duration, slide):
    draw = np.random.default_rng(3)
    rows = [(f"s{i % 3}", T0 + dt.timedelta(seconds=int(t)), None if i % 11 == 0 else float(draw.normal(1e7, 1)), i % 13 != 0)
            for i, t in enumerate(draw.integers(0, 7200, 500))] + [("gap", T0, None, True), (None, T0, 1.0, True), ("s0", None, 1.0, True)]
    df = spark.createDataFrame(rows, "sensor_id string, event_timestamp timestamp, cleaned_value double, is_valid boolean")
    got = WF.window_aggregate(df, duration=duration, slide=slide, suffix="w")
    v = F.col("cleaned_value")
    want = df.where("is_valid").groupBy("sensor_id", F.window("event_timestamp", duration, slide).alias("w")).agg(
        F.avg(v).alias("mean_w"), F.stddev_samp(v).alias("std_w"), F.min(v).alias("min_w"), F.max(v).alias("max_w"), F.count(v).alias("count_w"))
    want = want.select("sensor_id", F.col("w.start").alias("timestamp"), "mean_w", "std_w", "min_w", "max_w", "count_w",
                       (F.col("max_w") - F.col("min_w")).alias("range_w"))
    a, b = (x.toPandas().sort_values(["sensor_id", "timestamp"]).reset_index(drop=True)[want.columns] for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, check_dtype=False)


def test_rows_are_aggregated_before_windows_are_dealt(spark):
    plan = _plan(checked.QUERIES["sliding_window_features"](spark, "/root/testdata/sf0.001")).splitlines()
    first_agg = max(i for i, line in enumerate(plan) if "HashAggregate" in line and "ObjectHash" not in line)
    copies = [i for i, line in enumerate(plan) if "Expand" in line or "Generate" in line]
    assert all(i < first_agg for i in copies)  # plans print from the result down: no copy below the first aggregate


# ---------------------------------------------------------------- correlated pairs
def _series(spark, table):
    rows = [(name, T0 + dt.timedelta(days=d), float(x)) for name, xs in table.items() for d, x in enumerate(xs) if x is not None]
    return spark.createDataFrame(rows, "sensor_id string, event_timestamp timestamp, cleaned_value double")


def _brute_pairs(table, min_corr, min_points=3):
    out = {}
    for a in table:
        for b in table:
            if a < b:
                both = [(x, y) for x, y in zip(table[a], table[b]) if x is not None and y is not None]
                x, y = np.array(both).T if both else (np.zeros(0), np.zeros(0))
                if len(both) >= min_points and np.ptp(x) > 0 and np.ptp(y) > 0:
                    r = np.corrcoef(x, y)[0, 1]
                    if r >= min_corr:
                        out[(a, b)] = (r, len(both))
    return out


def test_correlated_pairs(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(6, 60))
    table = {f"s{i:02d}": list(base[i % 6] + draw.normal(size=60) * 0.15 + 1e5) for i in range(48)}
    table |= {"n1": list(-base[0]), "flat": [7.0] * 60, "short": [1.0, 2.0] + [None] * 58,
              "holes": [x if d % 3 else None for d, x in enumerate(base[1])]}
    want = _brute_pairs(table, 0.8)
    exact = {(r[0], r[1]): (r[2], r[3]) for r in CR.correlated_pairs(_series(spark, table), 0.8, "exact", bucket_unit="day", block=10).collect()}
    assert set(exact) == set(want) and all(math.isclose(exact[k][0], want[k][0], rel_tol=1e-9) and exact[k][1] == want[k][1] for k in want)
    sketch = {(r[0], r[1]) for r in CR.correlated_pairs(_series(spark, table), 0.8, "sketch", bucket_unit="day").collect()}
    assert sketch <= set(want) and len(sketch) >= 0.95 * len(want)


def test_blocks_of_series_are_shuffled_as_one_row_each(spark):
    draw = np.random.default_rng(6)
    table = {f"s{i:02d}": list(draw.normal(size=40)) for i in range(30)}
    points = CR.resample(_series(spark, table), bucket_unit="day")
    series, blocks = CR.packed(points, 10)
    assert (series.count(), blocks) == (30, 3) and {len(r.xs) for r in series.collect()} == {40}
    assert CR.packed(points, 10_000)[1] == 1
    # points and sketches of points are not copied for every pair of blocks, band or candidate
    for method in ("exact", "sketch"):
        plan = _plan(CR.correlated_pairs(_series(spark, table), 0.8, method, bucket_unit="day"))
        assert "xs#" in plan and "band#" not in plan and "xa#" not in plan


def test_signs_are_bits_of_sparks_hash(spark):
    draw = np.random.default_rng(7)
    buckets, z = np.array([-5, 0, 7, 86_400_000_000 * 19_000]), draw.normal(size=(6, 4))
    rows = spark.createDataFrame([(int(b),) for b in buckets], "bucket long").selectExpr(
        "bucket", "explode(sequence(0, 8)) AS band").selectExpr("bucket", "band", "xxhash64(bucket, band) AS h").collect()
    h = {(r.bucket, r.band): r.h for r in rows}
    got = CR.sign_codes(z, buckets, np.arange(3, 9), 33)
    for k, band in enumerate(range(3, 9)):
        for i in range(6):
            want = sum(1 << j for j in range(33) if sum(z[i, b] * (1 if h[int(t), band] >> j & 1 else -1) for b, t in enumerate(buckets)) >= 0)
            assert int(got[k, i]) == want


def test_blocks_do_not_change_the_sketch(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(4, 50))
    table = {f"s{i:02d}": [x if draw.random() > 0.1 else None for x in base[i % 4] + draw.normal(size=50) * 0.4] for i in range(40)}
    got = [{(r[0], r[1], round(r[2], 9), r[3]) for r in CR.correlated_pairs(_series(spark, table), 0.7, "sketch", bucket_unit="day", block=b).collect()}
           for b in (2048, 4)]
    want = _brute_pairs(table, 0.7)
    assert got[0] == got[1] and {(a, b, round(want[a, b][0], 9), n) for a, b, _, n in got[0]} == got[0] and len(got[0]) >= 0.95 * len(want)


def _found(spark, monkeypatch, min_corr, bits):
    """What the sketch does with two blocks of series, as a function of this process."""
    monkeypatch.setattr(CR, "_block_pairs", lambda series, blocks, found: found)
    return CR._sketch_pairs(CR.resample(_series(spark, {"a": [1.0, 2.0, 4.0]}), bucket_unit="day"), min_corr, 3, 0.99, bits, 4)


def test_only_series_of_likely_pairs_are_sketched(spark, monkeypatch):
    draw = np.random.default_rng(9)
    x, y = draw.normal(size=(2, 1000, 40))
    y[5] = 3 * x[7] + draw.normal(size=40) * 0.05
    sketched = []
    for name in ("sign_codes", "sign_planes"):
        real = getattr(CR, name, None)
        monkeypatch.setattr(CR, name, lambda z, *rest, real=real: sketched.append(len(z)) or real(z, *rest), raising=False)
    one, two = (x, np.ones(x.shape)), (y, np.ones(y.shape))
    got = list(_found(spark, monkeypatch, 0.9, 10)(False, np.arange(40), one, two))
    assert sum(sketched) <= 10  # 2,000 and more when every series is sketched for each pair of blocks
    assert [(*i, *j, *n) for i, j, r, n in got] == [(7, 5, 40)]


@pytest.mark.parametrize("same", [False, True])
def test_either_order_of_the_tests_gives_the_same_pairs(spark, monkeypatch, same):
    draw = np.random.default_rng(10)

    def block(n):
        x, known = draw.normal(size=(n, 12)) + 1e4, np.ones((n, 12))
        known[::7] = draw.random((len(known[::7]), 12)) > 0.3
        x[3] = 5.0  # constant
        x[14, 4:], known[14, 4:], known[14, :4] = 0, 0, 1  # four points
        x[21] = [1e9, *draw.normal(size=11)]  # a variance that is one point's
        x[28], known[28], known[35] = x[21] + 1e-3 * draw.normal(size=12), 1, 1
        known[28, 0] = 0
        return x * known, known

    monkeypatch.setattr(CR, "TILE", 64)
    one = block(160)
    two = one if same else block(160)
    bits, buckets = 7, np.arange(12) * 86_400_000_000
    want, exact = set(), 0
    with np.errstate(invalid="ignore", divide="ignore"):
        (ra, za, _), (rb, zb, _) = CR._standard(*one), CR._standard(*two)
    at = np.arange(CR.bands_for(0.6, bits, 0.99))
    code_a, code_b = np.zeros((2, len(at), 160), np.int64)
    code_a[:, ra], code_b[:, rb] = CR.sign_codes(za, buckets, at, bits), CR.sign_codes(zb, buckets, at, bits)
    for i in ra:
        for j in rb:
            both = (one[1][i] * two[1][j]) > 0
            a, b = one[0][i][both], two[0][j][both]
            if (not same or i < j) and both.sum() >= 3 and np.ptp(a) > 0 and np.ptp(b) > 0:
                a, b = a - a.mean(), b - b.mean()
                if (a @ b) / math.sqrt((a @ a) * (b @ b)) >= 0.6:
                    exact += 1
                    if (code_a[:, i] == code_b[:, j]).any():
                        want.add((i, j, int(both.sum())))
    assert 300 < len(want) < exact and len(want) > 0.9 * exact
    for open_pairs in (CR.OPEN_PAIRS, 100):
        monkeypatch.setattr(CR, "OPEN_PAIRS", open_pairs)
        for bands_first in (False, True):
            monkeypatch.setattr(CR, "_bands_are_cheaper", lambda *a: bands_first)
            got = [(min(i, j), max(i, j), n) if same else (i, j, n) for f in _found(spark, monkeypatch, 0.6, bits)(same, buckets, one, two)
                   for i, j, r, n in zip(*f)]
            assert len(got) == len(want) and set(got) == want


def test_each_pair_of_blocks_is_one_task(spark):
    series = spark.createDataFrame([(f"s{i}", i % 4, [0], [1.0]) for i in range(8)], "sensor string, mine int, buckets array<long>, xs array<double>")

    def found(same, buckets, one, two):
        yield np.array([0]), np.array([0]), np.array([float(TaskContext.get().partitionId())]), np.array([len(one[0]) + len(two[0])])

    got = CR._block_pairs(series, 4, found).collect()
    assert sorted(r["corr"] for r in got) == list(range(10)) and {r["points"] for r in got} == {4}
    assert {(r["sensor_a"], r["sensor_b"]) for r in got} == {(f"s{i}", f"s{j}") for j in range(4) for i in range(j + 1)}
    assert {r["corr"] for r in got if r["sensor_a"] == r["sensor_b"]} == {6, 7, 8, 9}  # half the work, so the last


def test_signs_of_long_series_and_many_bands(monkeypatch):
    draw = np.random.default_rng(11)
    z, buckets, bands = draw.normal(size=(300, 50)), np.arange(50) * 3_600_000_000, np.arange(2, 203)
    want = CR.sign_codes(z, buckets, bands, 9)
    assert want.shape == (201, 300) and (want == np.concatenate([CR.sign_codes(z, buckets, b, 9) for b in np.array_split(bands, 5)])).all()
    monkeypatch.setattr(CR, "CELLS", 20_000)  # signs of seven buckets at once
    assert (CR.sign_codes(z, buckets, bands, 9) == want).all()


def test_copies_of_a_series_are_one_class(spark):
    draw = np.random.default_rng(5)
    one, two = list(draw.normal(size=30)), list(draw.normal(size=30))
    table = {f"c{i:03d}": one for i in range(200)} | {"z": list(np.array(one) * 2 + 1), "y": two}
    for method in ("exact", "sketch"):
        got = CR.correlated_pairs(_series(spark, table), 0.9, method, bucket_unit="day").collect()
        assert {(r[0], r[1]) for r in got} == {("c000", f"c{i:03d}") for i in range(1, 200)} | {("c000", "z")}


def test_correlated_pairs_of_nothing(spark):
    for method in ("exact", "sketch"):
        assert CR.correlated_pairs(_series(spark, {"a": [1.0]}).limit(0), 0.9, method, bucket_unit="day").count() == 0


def test_sketch_recall_on_suppliers(spark):
    s = checked.lineitem_silver(spark, "/root/testdata/sf0.1")
    exact, sketch = ({(r[0], r[1]) for r in CR.correlated_pairs(s, 0.6, m, bucket_unit="quarter").collect()} for m in ("exact", "sketch"))
    assert len(exact) > 100 and sketch <= exact and len(sketch) >= 0.9 * len(exact)


def test_bands_follow_from_the_recall():
    assert CR.bands_for(1.0, 10, 0.99) == 1
    p = (1 - math.acos(0.7) / math.pi) ** 12
    n = CR.bands_for(0.7, 12, 0.95)
    assert 1 - (1 - p) ** n >= 0.95 > 1 - (1 - p) ** (n - 1)


# ---------------------------------------------------------------- limits above the group limit
@pytest.mark.parametrize("pieces", ["time", "rows"])
def test_newest_per_key(spark, pieces):
    rows = [("hot", T0 + dt.timedelta(seconds=i), i) for i in range(5000)] + [("cold", T0 + dt.timedelta(hours=i), i) for i in range(20)]
    df = spark.createDataFrame(rows, "sensor_id string, event_timestamp timestamp, id long")
    got = B.newest_per_key(df, "sensor_id", ["event_timestamp", "id"], "event_timestamp", 1500, pieces=pieces, bucket_unit="minute").collect()
    assert sorted((r["sensor_id"], r["rn"], r["id"]) for r in got) == sorted(
        [("hot", k + 1, 4999 - k) for k in range(1500)] + [("cold", k + 1, 19 - k) for k in range(20)])


def test_deep_limits_do_not_window_a_whole_key(spark):
    q = checked.QUERIES["recent_readings_hot"](spark, "/root/testdata/sf0.001")
    windows = [line for line in _plan(q).splitlines() if " Window " in line and "row_number" in line]
    assert windows and all("_piece" in line for line in windows)
    assert SV.recent_per_sensor(spark.createDataFrame([("a", T0, 1)], "sensor_id string, event_timestamp timestamp, id long"), 5000).count() == 1


# ---------------------------------------------------------------- envelopes
def test_positions_run_over_the_whole_batch(spark):
    rows = [(i, "s", float(i)) for i in range(1000)] + [(2000 + i, "t", 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, sensor_id string, value double")
    env = brz.nest_batches(df, F.floor(F.col("id") / 1000), max_readings=30).cache()
    assert env.agg(F.max(F.size("sensor_readings"))).first()[0] == 30 and env.count() == 35
    assert env.select("id").distinct().count() == 35
    flat = brz.unnest_batches(env).collect()
    assert sorted((r["batch_id"], r["pos"], r["id"]) for r in flat) == [(0, i, i) for i in range(1000)] + [(2, i, 2000 + i) for i in range(5)]


def test_batch_of_another_column(spark):
    df = spark.createDataFrame([(1, "s", 1.0, "b"), (2, "s", 1.0, "b")], "id long, sensor_id string, value double, batch string")
    assert brz.unnest_batches(brz.nest_batches(df, F.col("batch"))).select("batch_id", "pos").collect() == [("b", 0), ("b", 1)]


# ---------------------------------------------------------------- quantiles
def test_several_quantiles_in_the_passes_of_one(spark, monkeypatch):
    draw = np.random.default_rng(6)
    x = np.r_[draw.normal(size=3000), np.full(2000, 0.25), np.full(500, 3.0)]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    monkeypatch.setattr(TR, "EXACT_DIRECT_LIMIT", 100)
    monkeypatch.setattr(TR, "APPROX_ACCURACY", 50)
    qs = [0.0, 0.01, 0.1, 0.5, 0.52, 0.95, 0.999, 1.0]
    passes = []
    real = TR.values_at_ranks
    monkeypatch.setattr(TR, "values_at_ranks", lambda rows, ranks: passes.append(len(ranks)) or real(rows, ranks))
    assert np.allclose(TR.exact_quantiles(df, "x", qs), np.quantile(x, qs), rtol=0, atol=1e-12) and len(passes) == 1


def test_quantiles_per_key(spark):
    draw = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in draw.normal(size=4000)] + [("tie", 2.5)] * 3000 + [("one", 1.0), (None, 4.0), (None, 6.0)]
    rows += [("hot", None), ("hot", math.nan), ("void", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["k"]: (r["n"], [r[f"q{i}"] for i in range(5)]) for r in TR.exact_quantiles_by(df, ["k"], "x", qs).collect()}
    assert set(got) == {"hot", "tie", "one", None}
    for k, (n, found) in got.items():
        v = [x for key, x in rows if key == k and x is not None and not math.isnan(x)]
        assert n == len(v) and np.allclose(found, np.quantile(v, qs), rtol=0, atol=1e-12)
    assert TR.exact_quantiles_by(df.limit(0), ["k"], "x", qs).count() == 0


# ---------------------------------------------------------------- broadcast bound, feature rows
def test_broadcast_is_bounded_by_bytes_too(spark):
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("t"))
    assert J.bounded_rows(wide, 100) == 50 and J.bounded_rows(wide, 100, max_bytes=100_000) is None
    assert J.bounded_rows(wide, 49) is None and J.bounded_rows(spark.range(50), 100, max_bytes=1000) == 50
    assert J.bounded_rows(wide.limit(0), 10) == 0


def test_feature_rows_carry_their_version(spark):
    rows = [(i, "s", T0 + dt.timedelta(minutes=i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, sensor_id string, event_timestamp timestamp, cleaned_value double")
    row = feat.feature_rows(feat.snapshot_features(df), F.lit(T0)).first()
    assert row["feature_version"] == fixed.FEATURE_VERSION and row["sensor_id"] == "s" and len(row["id"]) == 32
    assert row["features"]["mean"] == 5.5 and "rolling_mean_50" not in row["features"]


# ---------------------------------------------------------------- tasks of bounded rows, methods the JVM compiles
def test_blocks_are_dealt_out_by_rows():
    assert B.block_partitions(216_000_000, 13_200, 12) >= 864 and B.block_partitions(216_000_000, 13_200, 200) >= 864
    assert B.block_partitions(100, 3, 8) == 8 and B.block_partitions(100_000, 50, 8) == 64


def test_expanding_features_keep_methods_compilable(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        s = _series(spark, {"a": [float(i % 7) for i in range(30)]}).withColumn("id", F.monotonically_increasing_id())
        feat.expanding_features(s, valid_only=False)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")  # the caller's choice stays
        feat.expanding_features(s, valid_only=False)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


def test_windows_are_not_shuffled(spark):
    draw = np.random.default_rng(9)
    rows = [(f"s{draw.integers(3)}", T0 + dt.timedelta(minutes=int(m)), float(draw.normal(1e4, 2)) if m % 7 else None)
            for m in draw.integers(0, 6000, 400)]
    df = spark.createDataFrame(rows, "sensor_id string, event_timestamp timestamp, cleaned_value double")
    got = WF.window_aggregate(df, duration="6 hours", slide="1 hour", suffix="w", valid_only=False)
    top = next(x for x in _plan(got).splitlines() if "Exchange hashpartitioning" in x)
    assert "hashpartitioning(sensor_id#" in top and "window" not in top
    want = (df.groupBy("sensor_id", F.window("event_timestamp", "6 hours", "1 hour")).agg(
        F.avg("cleaned_value"), F.stddev_samp("cleaned_value"), F.min("cleaned_value"), F.max("cleaned_value"), F.count("cleaned_value")))
    want = {(r[0], r[1].start): r[2:] for r in want.collect()}
    found = {(r.sensor_id, r.timestamp): (r.mean_w, r.std_w, r.min_w, r.max_w, r.count_w) for r in got.collect()}
    assert set(found) == set(want)
    for k, v in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)) for a, b in zip(found[k], v)), (k, found[k], v)
