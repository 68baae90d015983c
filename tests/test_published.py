"""Model registry, retention on disk, dead letters and slot replays."""

import datetime as dt
import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import iforest as IF
from gaugeflow.operators import quality as Q
from gaugeflow.operators import retention as RT
from gaugeflow.operators import silver as silv
from gaugeflow.plans import serving as SV
from gaugeflow.sources.published import Files
from gaugeflow.streaming import deadletters as DL
from gaugeflow.streaming import pipeline as SP


# ---------------------------------------------------------------- records
def test_records_are_replaced_and_claimed_once(spark, tmp_path):
    files = Files(spark, str(tmp_path / "root"))
    assert files.read("a.json") is None and files.names("none") == [] and files.files("none") == []
    files.write("a.json", {"x": 1})
    files.write("a.json", {"x": 2})
    assert files.read("a.json") == {"x": 2} and files.names() == ["a.json"]
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda _: files.claim("c/one"), range(16))) == [False] * 15 + [True]
    os.makedirs(tmp_path / "root" / "staged")
    assert files.publish("staged", "table/e=1") and not files.publish("staged", "table/e=1")


# ---------------------------------------------------------------- model registry
def _matrix(spark, n=200):
    x = pd.DataFrame(np.random.default_rng(0).normal(size=(n, 3)), columns=["f0", "f1", "f2"])
    x.insert(0, "id", range(n))
    x.insert(0, "sensor_id", "s")
    return spark.createDataFrame(x), ["f0", "f1", "f2"]


def test_health_follows_publication(spark, tmp_path):
    root = str(tmp_path / "models")
    before = SV.health(spark, root)
    assert before["pipeline_health"] == "initializing" and not before["pipeline_initialized"] and before["model_version"] is None
    with pytest.raises(FileNotFoundError):
        IF.load(spark, root)
    m, names = _matrix(spark)
    IF.retrain(spark, m, root, names=names, n_trees=3)
    after = SV.health(spark, root)
    assert after["pipeline_health"] == "healthy" and after["pipeline_initialized"] and after["model_version"] == "v1.0"


def test_concurrent_retrains_have_versions_of_their_own(spark, tmp_path):
    root = str(tmp_path / "models")
    m, names = _matrix(spark)
    m = m.cache()
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: IF.retrain(spark, m, root, names=names, n_trees=2 + k), range(4)))
    assert sorted(r["model_version"] for r in got) == ["v1.0", "v2.0", "v3.0", "v4.0"] == IF.list_versions(spark, root)
    assert IF.current(spark, root)["model_version"] == "v4.0" == IF.load(spark, root).version


def test_unfinished_model_is_not_served(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "models")
    m, names = _matrix(spark)
    IF.retrain(spark, m, root, names=names, n_trees=2)
    monkeypatch.setattr(Files, "write", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError):
        IF.retrain(spark, m, root, names=names, n_trees=3)
    monkeypatch.undo()
    assert IF.load(spark, root).version == "v1.0"
    assert IF.retrain(spark, m, root, names=names, n_trees=4)["model_version"] == "v3.0"
    assert IF.load(spark, root).version == "v3.0"


def test_forest_draws_do_not_depend_on_the_order_of_sums(spark):
    m, names = _matrix(spark)
    nudged = m.select("sensor_id", "id", *[(F.col(c) + F.when(F.col("id") % 2 == 0, 1e-13).otherwise(0.0)).alias(c) for c in names])
    a, b = (IF.train(spark, x, names=names, n_trees=8) for x in (m, nudged))
    assert a.nodes[["tree", "node", "feature", "size"]].equals(b.nodes[["tree", "node", "feature", "size"]])


def test_table_scores_equal_row_scores(spark):
    m, names = _matrix(spark, 500)
    model = IF.train(spark, m, names=names, n_trees=12)
    scaled = IF.apply_scaler(IF._gridded(m, names), model.scaler)
    rows = sorted(r["score_samples"] for r in IF.score_samples(spark, scaled, model).collect())
    assert rows == sorted(r["score_samples"] for r in IF.score_table(scaled, model).collect())
    plan = IF.score_table(scaled, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_bags_hold_psi_rows_of_their_own(spark):
    m, names = _matrix(spark, 1500)
    bags = IF.bag_rows(m, ["sensor_id", "id"], 1500, 20, 64, 1).toPandas()
    assert bags.groupby("tree").size().eq(64).all() and bags["tree"].nunique() == 20
    assert not bags.duplicated(["tree", "id"]).any()
    small = IF.bag_rows(m.limit(60), ["sensor_id", "id"], 60, 5, 60, 1).toPandas()
    assert small.groupby("tree").size().eq(60).all()


# ---------------------------------------------------------------- retention on disk
def _dated(spark, path, hours=24 * 12):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(hours)] + [(hours, None)]
    df = spark.createDataFrame(rows, "id LONG, t TIMESTAMP").withColumn("event_date", F.to_date("t"))
    df.repartition("event_date").write.partitionBy("event_date").parquet(path)
    return df


def test_retention_rewrites_and_frees(spark, tmp_path):
    path = str(tmp_path / "table")
    df = _dated(spark, path)
    got = RT.apply_retention(spark, path, "t", 4)
    want = {r["id"] for r in Q.retain_recent(df, "t", 4).collect()}
    assert {r["id"] for r in spark.read.parquet(path).collect()} == want == {r["id"] for r in RT.read_table(spark, path, df.schema).collect()}
    assert got["rewritten"] == "event_date=2024-01-08" and len(got["dropped"]) == 8
    assert len([n for n in os.listdir(path) if n.startswith("event_date=")]) == 5 and not os.path.exists(f"{path}/{RT.PLAN}")
    assert RT.apply_retention(spark, path, "t", 4)["dropped"] == []
    assert {r["id"] for r in spark.read.parquet(path).collect()} == want


@pytest.mark.parametrize("cut", range(12))
def test_retention_survives_a_kill_between_steps(spark, tmp_path, monkeypatch, cut):
    path = str(tmp_path / "table")
    df = _dated(spark, path, hours=24 * 5)
    old = {r["id"] for r in df.where("t IS NOT NULL").collect()}
    new = {r["id"] for r in Q.retain_recent(df, "t", 2).collect()}
    left, real = [cut], {n: getattr(Files, n) for n in ("delete", "publish", "write")}

    def limited(name):
        def step(self, *args):
            if left[0] == 0:
                raise KeyboardInterrupt
            left[0] -= 1
            return real[name](self, *args)
        return step

    for name in real:
        monkeypatch.setattr(Files, name, limited(name))
    done = False
    try:
        RT.apply_retention(spark, path, "t", 2)
        done = True
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    seen = [r["id"] for r in RT.read_table(spark, path, df.schema).where("t IS NOT NULL").collect()]
    assert len(seen) == len(set(seen)) and set(seen) in (old, new) and (not done or set(seen) == new)
    RT.apply_retention(spark, path, "t", 2)
    after = [r["id"] for r in spark.read.parquet(path).collect()]
    assert sorted(after) == sorted(new)


def test_retention_keeps_rows_that_streams_add_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    df = _dated(spark, path, hours=24 * 4)
    real = Files.write

    def write_and_append(self, name, record):
        late = spark.createDataFrame([(999, dt.datetime(2024, 1, 2, 23, 30))], "id LONG, t TIMESTAMP")
        late.write.mode("append").parquet(f"{path}/event_date=2024-01-02")
        real(self, name, record)

    monkeypatch.setattr(Files, "write", write_and_append)
    RT.apply_retention(spark, path, "t", 2)
    monkeypatch.undo()
    ids = {r["id"] for r in spark.read.parquet(path).collect()}
    assert ids == {r["id"] for r in Q.retain_recent(df, "t", 2).collect()} | {999}


def test_retention_of_an_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "table")
    assert RT.apply_retention(spark, str(tmp_path / "table"), "t", 2) == {"limit": None, "dropped": [], "rewritten": None}


# ---------------------------------------------------------------- dead letters
READINGS = "sensor_id STRING, sensor_type STRING, value DOUBLE, unit STRING, timestamp TIMESTAMP, location STRING"
T0 = dt.datetime(2024, 1, 1, 12)


def _at(minutes, sensor="s1", value=1.0):
    return (sensor, "t", value, "u", None if minutes is None else T0 + dt.timedelta(minutes=minutes), "l")


def _feed(spark, path, batches):
    """One file per batch, oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, READINGS).coalesce(1).write.parquet(f"{path}/b{i}")
    SP.stamp_in_name_order(spark, path)


def _silver_stream(spark, path):
    schema = spark.createDataFrame([], READINGS).schema
    bronze = silv.add_ingestion_metadata(SP.slot_stream(spark, path, schema))
    return silv.silver_sentinel(bronze).withColumn("event_date", F.to_date("timestamp"))


BATCHES = [
    [_at(m) for m in range(60)] + [_at(3, value=None), _at(4, value=5000.0)],
    # 12:59 less ten minutes is 12:49: 12:48 is late, 12:49 is not; nor is anything later
    [_at(48, "late"), _at(49, "edge"), _at(-600, "late"), _at(70), _at(None), _at(75, None)],
    [_at(61, "late"), _at(66, "in"), _at(200)],
]


def test_late_rows_reach_the_side_table_and_no_window(spark, tmp_path):
    _feed(spark, str(tmp_path / "in"), BATCHES)
    root = str(tmp_path / "split")
    DL.split_dead_letters(spark, _silver_stream(spark, str(tmp_path / "in")), root).awaitTermination()
    dead = DL.dead_letters(spark, root, SP.SILVER_FLAT).collect()
    assert sorted((r["epoch"], r["sensor_id"] or "", r["reason"]) for r in dead) == [
        (0, "s1", "invalid"), (0, "s1", "invalid"), (1, "", "no_sensor"), (1, "late", "late"), (1, "late", "late"), (1, "s1", "no_time"),
        (2, "late", "late")]
    counts = {r["epoch"]: r for r in DL.batch_counts(spark, root).collect()}
    assert [counts[e]["input"] for e in range(3)] == [len(b) for b in BATCHES]
    for r in counts.values():
        assert r["input"] == r["accepted"] + sum(r[reason] for reason in DL.REASONS)
    assert DL.accepted(spark, root, SP.SILVER_FLAT).count() == sum(r["accepted"] for r in counts.values())

    paths = SP.PipelinePaths.under(str(tmp_path / "stages"))
    SP.generate_features(spark, paths, accepted_root=root).awaitTermination()
    feats = spark.read.parquet(paths.features_path)
    assert {r["sensor_id"] for r in feats.select("sensor_id").distinct().collect()} == {"s1", "edge", "in"}
    # nothing accepted is lost: every accepted row older than the last watermark is in its five windows
    assert feats.where("sensor_id = 'edge'").count() == 5 and feats.where("sensor_id = 'in'").count() == 5


def test_window_stage_drops_nothing_that_was_accepted(spark, tmp_path):
    _feed(spark, str(tmp_path / "in"), BATCHES)
    root = str(tmp_path / "split")
    DL.split_dead_letters(spark, _silver_stream(spark, str(tmp_path / "in")), root).awaitTermination()
    stream = DL.accepted_stream(spark, root, SP.SILVER_FLAT)
    q = (SP.window_features_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start(str(tmp_path / "w")))
    q.awaitTermination()
    assert sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"]) == 0


@pytest.mark.parametrize("cut", ["publish", "write"])
def test_batch_run_again_adds_nothing_twice(spark, tmp_path, monkeypatch, cut):
    root = str(tmp_path / "split")
    schema = spark.createDataFrame([], READINGS).schema
    silver = [silv.silver_sentinel(silv.add_ingestion_metadata(spark.createDataFrame(b, schema))).withColumn(
        "event_date", F.to_date("timestamp")) for b in BATCHES]
    DL.split_batch(spark, silver[0], 0, root, 600_000_000, "timestamp")
    real, calls = getattr(Files, cut), []

    def once(self, *args):
        if not calls:
            calls.append(1)
            if cut == "publish":
                real(self, *args)
            raise KeyboardInterrupt
        return real(self, *args)

    monkeypatch.setattr(Files, cut, once)
    with pytest.raises(KeyboardInterrupt):
        DL.split_batch(spark, silver[1], 1, root, 600_000_000, "timestamp")
    monkeypatch.undo()
    first = DL.split_batch(spark, silver[1], 1, root, 600_000_000, "timestamp")
    again = DL.split_batch(spark, silver[1], 1, root, 600_000_000, "timestamp")
    assert first == again and first["input"] == 6
    assert DL.dead_letters(spark, root, SP.SILVER_FLAT).where("epoch = 1").count() == 4
    assert DL.accepted(spark, root, SP.SILVER_FLAT).where("epoch = 1").count() == 2


def test_dead_letters_before_the_first_batch(spark, tmp_path):
    assert DL.dead_letters(spark, str(tmp_path), SP.SILVER_FLAT).count() == 0
    assert DL.batch_counts(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- slots
def test_slots_are_cut_by_time_alone(spark, tmp_path):
    rows = [_at(m) for m in (0, 1, 2, 61, 62, 300)] + [_at(None)]
    df = spark.createDataFrame(rows, READINGS)
    for parts, name in ((1, "a"), (5, "b")):
        path = str(tmp_path / name)
        assert SP.write_slots(df.repartition(parts), path, "1 hour") == 4
        seen = []
        q = (SP.slot_stream(spark, path, df.schema).writeStream
             .foreachBatch(lambda b, e: seen.append((e, sorted(str(r["timestamp"]) for r in b.collect()))))
             .option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start())
        q.awaitTermination()
        assert [(e, len(t)) for e, t in sorted(seen)] == [(0, 3), (1, 2), (2, 1), (3, 1)]


def test_replay_files_follow_the_partitions(spark, tmp_path):
    df = spark.createDataFrame([_at(m) for m in range(500)], READINGS)
    SP.write_replay(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 500
    SP.write_replay(df, str(tmp_path / "three"), files=3)
    assert len([n for n in os.listdir(tmp_path / "three") if n.startswith("part-")]) == 3
    assert json.loads(open(tmp_path / "three" / sorted(n for n in os.listdir(tmp_path / "three") if n.startswith("part-"))[0]).readline())
    assert time.time() > os.path.getmtime(tmp_path / "three")
