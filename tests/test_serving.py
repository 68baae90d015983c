import datetime as dt

from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.operators import features as feat
from gaugeflow.operators import joins as J
from gaugeflow.operators import kmeans as KM
from gaugeflow.plans import serving as SV


def test_asof_prefers_feature_row_at_equal_time_and_drops_unmatched(spark):
    t = dt.datetime(2024, 1, 1)
    rec = spark.createDataFrame([(1, "s", t), (2, "s", t + dt.timedelta(minutes=5)), (3, "s", t - dt.timedelta(hours=3)),
                                 (4, "z", t)], "id BIGINT, sensor_id STRING, ts TIMESTAMP")
    fea = spark.createDataFrame([(10, "s", t - dt.timedelta(minutes=1), 1.0), (11, "s", t, 2.0),
                                 (12, "s", t + dt.timedelta(minutes=9), 3.0)],
                                "id BIGINT, sensor_id STRING, ts TIMESTAMP, f DOUBLE")
    out = J.asof_lookup(rec, fea, "sensor_id", "ts", "ts", ["id", "f"], feat_order="id").orderBy("id").collect()
    assert [(r.id, r.f_id, r.f_f) for r in out] == [(1, 11, 2.0), (2, 11, 2.0)]


def test_features_to_map_keeps_present_features(spark):
    df = spark.createDataFrame([("s", 1.0, None)], "sensor_id STRING, mean DOUBLE, lag_5 DOUBLE")
    m = feat.features_to_map(df, names=["lag_5", "mean"]).first()["features"]
    assert m == {"mean": 1.0}


def test_kmeans_survives_one_row_windows(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 0, i), float(i % 7), None if i % 3 == 0 else 1.0, float(i % 5), 1 + i % 3)
            for i in range(60)]
    df = spark.createDataFrame(rows, "sensor_id STRING, timestamp TIMESTAMP, mean_5min DOUBLE, std_5min DOUBLE, "
                                     "range_5min DOUBLE, count_5min BIGINT")
    model = KM.fit(df)
    out = KM.predict(df, model).collect()
    assert len(out) == 60
    normal = sum(1 for r in out if not r.is_anomaly)
    assert normal == max(model.pipeline.stages[-1].summary.clusterSizes)
    assert all(r.anomaly_score >= 0 for r in out)


def test_health_and_alerts(spark):
    h = SV.health(spark, model_ready=True)
    assert h["status"] == "healthy" and h["pipeline_initialized"] is True and h["streaming"] is False
    a = spark.createDataFrame([(1, "TEMP_001", True, -0.1234), (2, "TEMP_002", False, 0.2)],
                              "id BIGINT, sensor_id STRING, is_anomaly BOOLEAN, anomaly_score DOUBLE")
    msgs = [r.message for r in SV.alerts(a).collect()]
    assert msgs == ["ANOMALY DETECTED - Sensor: TEMP_001, Score: -0.123"]


def test_feature_layout_has_thirty_sorted_names():
    names = fixed.feature_names()
    assert len(names) == 30 and names == sorted(names)
