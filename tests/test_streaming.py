import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from gaugeflow.streaming import pipeline as SP


def _write_json(path, name, rows, mtime):
    os.makedirs(path, exist_ok=True)
    p = os.path.join(path, name)
    with open(p, "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")
    os.utime(p, (mtime, mtime))


def _rows(start: dt.datetime, n: int, step_s: int = 30, sensor="s1", value=1.0):
    return [{"sensor_id": sensor, "sensor_type": "t", "value": value + i, "unit": "u",
             "timestamp": (start + dt.timedelta(seconds=step_s * i)).strftime("%Y-%m-%dT%H:%M:%S.000000Z"),
             "location": "l"} for i in range(n)]


def test_restart_from_checkpoint_no_duplicates(spark, tmp_path):
    paths = SP.PipelinePaths.under(str(tmp_path))
    t0 = dt.datetime(2024, 1, 1)
    now = time.time()
    _write_json(paths.input_path, "a.json", _rows(t0, 50), now - 100)
    SP.ingest_to_bronze(spark, paths).awaitTermination()
    SP.process_to_silver(spark, paths).awaitTermination()
    _write_json(paths.input_path, "b.json", _rows(t0 + dt.timedelta(hours=1), 30), now - 50)
    SP.ingest_to_bronze(spark, paths).awaitTermination()      # same checkpoint: only the new file
    SP.process_to_silver(spark, paths).awaitTermination()
    silver = spark.read.parquet(paths.silver_path)
    assert silver.count() == 80
    assert silver.select("timestamp").distinct().count() == 80
    assert silver.where(F.col("source") != "iot_sensors").count() == 0


def test_watermark_drops_late_rows_and_holds_open_windows(spark, tmp_path):
    paths = SP.PipelinePaths.under(str(tmp_path))
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    now = time.time()
    _write_json(paths.input_path, "1.json", _rows(t0, 60, step_s=60), now - 300)          # 12:00-12:59
    _write_json(paths.input_path, "2.json", _rows(t0 - dt.timedelta(hours=2), 5, sensor="late"), now - 200)
    q = SP.ingest_to_bronze(spark, paths, max_files_per_trigger=1)
    q.awaitTermination()
    SP.process_to_silver(spark, paths).awaitTermination()
    # one silver file per bronze batch; replay the features stage file by file
    q = SP.generate_features(spark, paths, trigger={"availableNow": True})
    q.awaitTermination()
    feats = spark.read.parquet(paths.features_path)
    # windows ending after max(ts) - 10 min are still open and not emitted
    newest = t0 + dt.timedelta(minutes=59)
    ends = [r.timestamp + dt.timedelta(minutes=5) for r in feats.select("timestamp").collect()]
    assert ends and max(ends) <= newest - dt.timedelta(minutes=10)
    assert feats.where(F.col("count_5min") > 5).count() == 0


def test_window_stream_equals_batch(spark, tmp_path):
    from gaugeflow.operators import windowed as WF
    paths = SP.PipelinePaths.under(str(tmp_path))
    t0 = dt.datetime(2024, 1, 1)
    _write_json(paths.input_path, "a.json", _rows(t0, 120, step_s=20), time.time() - 10)
    SP.ingest_to_bronze(spark, paths).awaitTermination()
    SP.process_to_silver(spark, paths).awaitTermination()
    SP.generate_features(spark, paths).awaitTermination()
    stream = spark.read.parquet(paths.features_path)
    batch = WF.window_aggregate(spark.read.parquet(paths.silver_path), time_col="timestamp")
    cutoff = t0 + dt.timedelta(seconds=20 * 119) - dt.timedelta(minutes=10)
    batch = batch.where(F.col("timestamp") + F.expr("INTERVAL 5 MINUTES") <= F.lit(cutoff))
    cols = ["sensor_id", "timestamp", "mean_5min", "count_5min"]
    assert sorted(stream.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_replay_files_stamped_in_time_order(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP")
    path = str(tmp_path / "replay")
    df.repartitionByRange(5, "ts").write.parquet(path)
    assert SP.stamp_in_name_order(spark, path) == 5
    files = sorted((os.path.getmtime(os.path.join(path, f)), f) for f in os.listdir(path) if f.startswith("part-"))
    firsts = [spark.read.parquet(os.path.join(path, f)).agg(F.min("ts")).first()[0] for _, f in files]
    assert firsts == sorted(firsts)                     # oldest file = earliest times


def test_live_run_trains_reaches_the_last_stage_and_stops(spark, tmp_path):
    paths = SP.PipelinePaths.under(str(tmp_path))
    _write_json(paths.input_path, "a.json", _rows(dt.datetime(2024, 1, 1), 400), time.time() - 10)
    began = time.time()

    def stop():
        done = os.path.isdir(paths.anomalies_path) and any(f.endswith(".parquet") for f in os.listdir(paths.anomalies_path))
        return done or time.time() - began > 120

    counts = SP.run_pipeline(spark, paths, trigger={"processingTime": "1 second"}, stop=stop, train_rows=20)
    assert not spark.streams.active
    assert counts["bronze"]["rows"] == 400 and counts["silver"]["rows"] == 400
    assert spark.read.parquet(paths.anomalies_path).count() > 0
