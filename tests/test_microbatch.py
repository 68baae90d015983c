"""Micro-batch service form: the bounded-state variant gives the same features and
predictions per batch as the variant that re-reads the whole Silver history."""

import glob
import os
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gaugeflow.sources.adapters import event_readings
from gaugeflow.sources.tables import sensor_dimension
from gaugeflow.streaming import pipeline as SP


def _replay(spark, path, files=4):
    """Readings as parquet files whose modification times follow event time, so the file
    source replays them in time order (one file per trigger)."""
    r = event_readings(spark, SF_SMALL)
    r.repartitionByRange(files, "timestamp").write.parquet(path)
    parts = glob.glob(os.path.join(path, "*.parquet"))
    first = {p: pq.read_table(p, columns=["timestamp"]).column(0).to_pylist()[0] for p in parts}
    base = time.time() - 1000
    for i, p in enumerate(sorted(parts, key=lambda p: first[p])):
        os.utime(p, (base + i, base + i))
    return r.schema


def _scorer(f):
    return f.select("sensor_id", (F.col("mean") > 50).alias("is_anomaly"), F.col("mean").alias("anomaly_score"),
                    F.lit(1.0).alias("confidence"), F.lit("t").alias("model_version"))


def test_stateful_micro_batches_equal_whole_history(spark, tmp_path):
    replay = str(tmp_path / "replay")
    schema = _replay(spark, replay)
    dim, n = sensor_dimension(spark)
    a, b = str(tmp_path / "history"), str(tmp_path / "state")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(replay)

    SP.process_batches(spark, stream(), dim, n, a, scorer=_scorer).awaitTermination()
    for q in SP.process_batches_stateful(spark, stream(), dim, n, b, scorer=_scorer):
        q.awaitTermination()

    feats_a = spark.read.parquet(f"{a}/features").drop("timestamp")
    feats_b = spark.read.parquet(f"{b}/features").drop("timestamp")
    cols = sorted(feats_a.columns)
    ra = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in feats_a.select(*cols).collect())
    rb = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in feats_b.select(*cols).collect())
    assert feats_a.select("batch_id").distinct().count() == 4
    assert ra == rb

    pcols = ["batch_id", "id", "sensor_id", "timestamp", "is_anomaly", "anomaly_score"]
    pa = sorted(tuple(r) for r in spark.read.parquet(f"{a}/anomalies").select(*pcols).collect())
    pb = sorted(tuple(r) for r in spark.read.parquet(f"{b}/anomalies").select(*pcols).collect())
    assert pa and pa == pb
    # Silver: every reading once
    assert spark.read.parquet(f"{b}/silver").count() == spark.read.parquet(replay).count()


def test_stateful_restart_resumes_from_checkpointed_state(spark, tmp_path):
    """Stop after half of the files, restart on the same checkpoints with the rest: the
    per-sensor state comes back from the checkpoint, so the outputs equal one run."""
    import shutil
    full = str(tmp_path / "full")
    schema = _replay(spark, full)
    parts = sorted(glob.glob(os.path.join(full, "*.parquet")), key=os.path.getmtime)
    half = str(tmp_path / "half")
    os.makedirs(half)
    for p in parts[:2]:
        shutil.copy2(p, half)
    dim, n = sensor_dimension(spark)
    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")

    def run(src, root):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        for q in SP.process_batches_stateful(spark, stream, dim, n, root, scorer=_scorer):
            q.awaitTermination()

    run(full, once)
    run(half, twice)                     # first two files, then stop
    for p in parts[2:]:
        shutil.copy2(p, half)            # later files arrive; same checkpoints
    run(half, twice)
    cols = ["batch_id", "sensor_id", "n", "mean", "lag_1", "rolling_mean_5", "change_rate"]
    fa = sorted(tuple(r) for r in spark.read.parquet(f"{once}/features").select(*cols).collect())
    fb = sorted(tuple(r) for r in spark.read.parquet(f"{twice}/features").select(*cols).collect())
    assert fa and fa == fb
    pcols = ["batch_id", "id", "is_anomaly", "anomaly_score"]
    pa = sorted(tuple(r) for r in spark.read.parquet(f"{once}/anomalies").select(*pcols).collect())
    pb = sorted(tuple(r) for r in spark.read.parquet(f"{twice}/anomalies").select(*pcols).collect())
    assert pa == pb
    assert spark.read.parquet(f"{twice}/silver").count() == spark.read.parquet(full).count()


def test_small_first_batch_gives_no_predictions_and_no_failure(spark, tmp_path):
    """Ten readings over six sensors: no sensor has enough history yet, in either form."""
    r = event_readings(spark, SF_SMALL).where("id <= 10000")
    six = [x.sensor_id for x in r.select("sensor_id").distinct().orderBy("sensor_id").limit(6).collect()]
    few = [r.where(F.col("sensor_id") == s).orderBy("id").limit(2 if i < 4 else 1) for i, s in enumerate(six)]
    batch = few[0]
    for f in few[1:]:
        batch = batch.unionByName(f)
    replay = str(tmp_path / "replay")
    batch.coalesce(1).write.parquet(replay)
    dim, n = sensor_dimension(spark)
    counts = SP.process_batch(spark, spark.read.parquet(replay), 0, dim, n, str(tmp_path / "one"), scorer=_scorer)
    assert counts == {"records": 10, "features": 0, "predictions": 0, "anomalies": 0}
    stream = spark.readStream.schema(r.schema).parquet(replay)
    SP.process_batches(spark, stream, dim, n, str(tmp_path / "a"), scorer=_scorer).awaitTermination()
    for q in SP.process_batches_stateful(spark, stream, dim, n, str(tmp_path / "b"), scorer=_scorer):
        q.awaitTermination()
        assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "a" / "silver")).count() == 10


def test_batches_read_the_newest_rows_of_earlier_batches_only(spark, tmp_path):
    dim, n = sensor_dimension(spark)
    r = event_readings(spark, SF_SMALL).orderBy("timestamp", "id").limit(900).localCheckpoint()
    cut = r.selectExpr("percentile(unix_micros(CAST(timestamp AS timestamp)), array(0.34, 0.67)) AS c").first()["c"]
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    batches = [r.where(at <= cut[0]), r.where((at > cut[0]) & (at <= cut[1])), r.where(at > cut[1])]
    roots = [str(tmp_path / x) for x in ("new", "old")]
    whole = None
    for epoch, rows in enumerate(batches):
        for root in roots:
            SP.process_batch(spark, rows, epoch, dim, n, root)
        whole = rows if whole is None else whole.unionByName(rows)
        # a root whose first batches were written before there was a table of newest rows
        if epoch == 0:
            os.rename(f"{roots[1]}/newest/batch_id=0", str(tmp_path / "moved"))
        want = SP.feat.snapshot_features(SP.silv.silver_range(whole, dim, dim_rows=n).join(
            rows.select("sensor_id").distinct(), "sensor_id", "left_semi"))
        want = {x["sensor_id"]: (x["n"], x["lag_5"], round(x["mean"], 9)) for x in want.collect()}
        for root in roots:
            got = spark.read.parquet(f"{root}/features").where(F.col("batch_id") == epoch)
            assert {x["sensor_id"]: (x["n"], x["lag_5"], round(x["mean"], 9)) for x in got.collect()} == want
    kept = spark.read.parquet(f"{roots[0]}/newest").groupBy("batch_id", "sensor_id").count().agg(F.max("count")).first()[0]
    assert kept <= 100
