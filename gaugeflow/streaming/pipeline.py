"""Streaming Bronze -> Silver -> Features -> Anomalies.

Four independent ``StreamingQuery``s coupled only through Parquet tables, each with its
own checkpoint (restartable, exactly-once file sinks). Triggers are a parameter:
``availableNow`` for replay/tests, ``processingTime`` for a live service.

``process_batches`` is the micro-batch form of the service pipeline (``foreachBatch``):
each batch appends Silver rows, recomputes snapshot features for the sensors it touched
from their newest Silver rows (kept for every batch), optionally scores them, and writes every output into a
``batch_id=<epoch>`` partition with dynamic overwrite, so a replayed epoch replaces its
own output instead of duplicating it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import fixed
from gaugeflow.operators import features as feat
from gaugeflow.operators import kmeans as KM
from gaugeflow.operators import silver as silv
from gaugeflow.operators import windowed as WF
from gaugeflow.sources.published import Files
from gaugeflow.sources.tables import readings_schema
from gaugeflow.streaming import deadletters as DL

# Lossless event times in JSON (the default format stops at milliseconds).
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

BRONZE_FLAT = T.StructType(readings_schema(with_metadata=False).fields + [
    T.StructField("ingestion_timestamp", T.TimestampType(), True),
    T.StructField("source", T.StringType(), True),
])


@dataclass
class PipelinePaths:
    input_path: str
    bronze_path: str
    silver_path: str
    features_path: str
    anomalies_path: str

    @staticmethod
    def under(root: str) -> "PipelinePaths":
        r = root.rstrip("/")
        return PipelinePaths(f"{r}/raw", f"{r}/bronze", f"{r}/silver", f"{r}/features", f"{r}/anomalies")


def _trigger(writer, trigger: dict | None):
    return writer.trigger(**(trigger or {"availableNow": True}))


def write_replay(readings: DataFrame, input_path: str, files: int | None = None) -> None:
    """Write readings as JSON files ordered by event time (file i holds the i-th time range).

    One Spark job; the file source then replays them. Without ``files`` their number is that of the session's
    shuffle partitions, which adaptive execution fits to the size of the data."""
    cols = [f.name for f in readings_schema(with_metadata=False).fields]
    rows = readings.select(*[F.col(c) for c in cols]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    cut = rows.repartitionByRange(files, "timestamp") if files else rows.repartitionByRange("timestamp")
    cut.write.mode("overwrite").option("timestampFormat", JSON_TS_FORMAT).json(input_path)
    stamp_in_name_order(readings.sparkSession, input_path)


def write_slots(readings: DataFrame, path: str, every: str = "1 day", by: str = "timestamp") -> int:
    """Write readings as Parquet, one file per time slot of ``by`` that has rows, and return the number of slots.

    The slots are fixed intervals since 1970, so the cut depends on the rows alone. Replayed with one file per trigger
    (``slot_stream``), every slot is a micro-batch of its own, the same one in each run. Slots are the unit
    of work of a batch: choose them by the size a batch should have. Rows without ``by`` are in the last slot."""
    spark = readings.sparkSession
    at, width = F.unix_micros(F.col(by).cast("timestamp")), F.lit(WF.interval_micros(every))
    start = at - F.pmod(at, width)
    slot = F.when(start.isNull(), "9" * 20).otherwise(F.format_string("%020d", start))
    readings.withColumn("slot", slot).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(path)
    return stamp_in_name_order(spark, path)


def slot_stream(spark: SparkSession, path: str, schema, slots: int = 1) -> DataFrame:
    """The stream over ``write_slots``: ``slots`` slots a micro-batch, oldest first."""
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", slots).parquet(path))


def stamp_in_name_order(spark: SparkSession, path: str, prefix: str = "part-") -> int:
    """Give the data files below ``path`` increasing modification times in the order of their paths.

    The file source replays files oldest first; files written by parallel tasks get
    arbitrary times, while their names follow the time order. Uses
    the Hadoop FileSystem API, so it works on any cluster file system that keeps times.
    Returns the number of files stamped (0 without a JVM handle, e.g. Spark Connect)."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no JVM handle: keep the write order
        return 0
    files = Files(spark, path)
    names = [n for n in files.files() if n.rsplit("/", 1)[-1].startswith(prefix)]
    jvm = sc._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration())
    start = int(time.time() * 1000) - 1000 * (len(names) + 10)
    for i, name in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(files.path(name)), start + 1000 * i, -1)
    return len(names)


def ingest_to_bronze(spark: SparkSession, paths: PipelinePaths, trigger: dict | None = None,
                     max_files_per_trigger: int | None = None):
    reader = (spark.readStream.schema(readings_schema(with_metadata=False))
              .option("timestampFormat", JSON_TS_FORMAT))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    bronze = silv.add_ingestion_metadata(reader.json(paths.input_path))
    w = (bronze.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{paths.bronze_path}/_checkpoints"))
    return _trigger(w, trigger).start(paths.bronze_path)


def process_to_silver(spark: SparkSession, paths: PipelinePaths, trigger: dict | None = None):
    """Sentinel-rule Silver, partitioned by event date: retention drops whole partitions and
    look-back reads prune to the dates they need."""
    bronze = spark.readStream.schema(BRONZE_FLAT).parquet(paths.bronze_path)
    silver = silv.silver_sentinel(bronze).withColumn("event_date", F.to_date("timestamp"))
    w = (silver.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
         .option("checkpointLocation", f"{paths.silver_path}/_checkpoints"))
    return _trigger(w, trigger).start(paths.silver_path)


SILVER_FLAT = T.StructType(BRONZE_FLAT.fields + [
    T.StructField("is_valid", T.BooleanType(), True),
    T.StructField("cleaned_value", T.DoubleType(), True),
    T.StructField("quality_score", T.DoubleType(), True),
    T.StructField("processed_timestamp", T.TimestampType(), True),
    T.StructField("event_date", T.DateType(), True),
])


def window_features_stream(silver_stream: DataFrame, time_col: str = "timestamp",
                           duration: str = fixed.WINDOW_DURATION, slide: str = fixed.WINDOW_SLIDE,
                           watermark: str = fixed.WATERMARK_DELAY) -> DataFrame:
    """Watermarked sliding-window features; append mode emits a window once the
    watermark passes its end, and rows behind the watermark are dropped."""
    return WF.window_aggregate(silver_stream, time_col=time_col, duration=duration, slide=slide,
                               watermark=watermark)


def generate_features(spark: SparkSession, paths: PipelinePaths, trigger: dict | None = None,
                      time_col: str = "timestamp", duration: str = fixed.WINDOW_DURATION,
                      slide: str = fixed.WINDOW_SLIDE, watermark: str = fixed.WATERMARK_DELAY,
                      accepted_root: str | None = None):
    """Window features of the Silver stream, or of the rows that ``deadletters.split_dead_letters`` accepted
    under ``accepted_root``."""
    if accepted_root:
        silver = DL.accepted_stream(spark, accepted_root, SILVER_FLAT)
    else:
        silver = spark.readStream.schema(SILVER_FLAT).parquet(paths.silver_path)
    out = window_features_stream(silver, time_col, duration, slide, watermark)
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{paths.features_path}/_checkpoints"))
    return _trigger(w, trigger).start(paths.features_path)


def train_detector(spark: SparkSession, paths: PipelinePaths) -> KM.ClusterModel:
    """Batch-train the k-means detector on the feature table written so far."""
    return KM.fit(spark.read.parquet(paths.features_path))


def detect_anomalies(spark: SparkSession, paths: PipelinePaths, model: KM.ClusterModel,
                     trigger: dict | None = None):
    # the features table may still be empty: its schema is that of the stage that writes it
    schema = window_features_stream(spark.readStream.schema(SILVER_FLAT).parquet(paths.silver_path)).schema
    stream = spark.readStream.schema(schema).parquet(paths.features_path)
    pred = KM.predict(stream, model).drop("features", "scaled_features")
    w = (pred.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{paths.anomalies_path}/_checkpoints"))
    return _trigger(w, trigger).start(paths.anomalies_path)


class _Progress:
    """Counters of one query. ``recentProgress`` keeps the last updates only, so it is
    polled while the query runs, and every update is counted once."""

    def __init__(self, query):
        self.query, self.last = query, ("", -1)
        self.counts = {"batches": 0, "rows": 0, "dropped_by_watermark": 0}

    def poll(self) -> None:
        for p in self.query.recentProgress:
            at = (p["timestamp"], p["batchId"])
            if at <= self.last:
                continue
            self.last = at
            self.counts["batches"] += 1
            self.counts["rows"] += p.get("numInputRows", 0) or 0
            self.counts["dropped_by_watermark"] += sum(
                op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))


def run_pipeline(spark: SparkSession, paths: PipelinePaths, trigger: dict | None = None,
                 time_col: str = "timestamp", model: KM.ClusterModel | None = None,
                 stop: Callable[[], bool] | None = None, train_rows: int = fixed.MIN_TRAIN_VECTORS,
                 poll_seconds: float = 1.0) -> dict:
    """Run the four stages. With ``availableNow`` the stages drain one after another (each
    consumes what the previous one wrote). With a processing-time trigger they run together
    until ``stop()`` is true or one of them ends; the others are stopped then, and a failure
    is raised. Without a given ``model`` a live run starts its last stage as soon as the
    feature table has ``train_rows`` rows to train on. Returns per-stage progress counters."""
    live = trigger is not None and "availableNow" not in trigger
    running: dict[str, _Progress] = {}

    def start(name: str, query) -> None:
        running[name] = _Progress(query)
        while not live and query.isActive:
            query.awaitTermination(poll_seconds)
            running[name].poll()

    try:
        start("bronze", ingest_to_bronze(spark, paths, trigger))
        start("silver", process_to_silver(spark, paths, trigger))
        start("features", generate_features(spark, paths, trigger, time_col=time_col))
        if not live:
            start("anomalies", detect_anomalies(spark, paths, model or train_detector(spark, paths), trigger))
        while live and all(p.query.isActive for p in running.values()) and not (stop and stop()):
            if "anomalies" not in running:
                model = model or _train_when_ready(spark, paths, train_rows)
                if model is not None:
                    start("anomalies", detect_anomalies(spark, paths, model, trigger))
            time.sleep(poll_seconds)
            for p in running.values():
                p.poll()
    finally:
        for p in running.values():
            if p.query.isActive:
                p.query.stop()
    for p in running.values():
        if p.query.exception() is not None:
            raise p.query.exception()
        p.poll()
    return {name: p.counts for name, p in running.items()}


def _train_when_ready(spark: SparkSession, paths: PipelinePaths, rows: int) -> KM.ClusterModel | None:
    """The detector, once the feature table holds ``rows`` rows; None before."""
    schema = window_features_stream(spark.readStream.schema(SILVER_FLAT).parquet(paths.silver_path)).schema
    written = spark.read.schema(schema).parquet(paths.features_path)
    return KM.fit(written) if written.limit(rows).count() >= rows else None


# ---------------------------------------------------------------- micro-batch service form
def process_batches(spark: SparkSession, readings_stream: DataFrame, dimension: DataFrame,
                    dim_rows: int, root: str, scorer=None, trigger: dict | None = None,
                    lookback_batches: int | None = None):
    """foreachBatch pipeline: Silver (range rules) -> features of touched sensors -> one
    prediction per Silver record of the batch.

    ``scorer(features_df) -> per-sensor predictions`` is optional (e.g. a trained forest);
    each record of the batch gets its sensor's prediction (records of sensors without a
    scorable feature row get none). ``lookback_batches`` bounds the Silver history read per
    batch (partition pruning on ``batch_id``); None reads the whole history."""
    def handle(batch: DataFrame, epoch: int) -> None:
        process_batch(spark, batch, epoch, dimension, dim_rows, root, scorer, lookback_batches)

    w = (readings_stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", f"{root}/_checkpoints"))
    return _trigger(w, trigger).start()


def _write_batch(df: DataFrame, path: str, epoch: int) -> DataFrame:
    """Write one batch's rows and return them as written (none, if ``df`` has none)."""
    out = df.withColumn("batch_id", F.lit(epoch).cast("long"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    # an explicit schema: an empty first batch leaves no file to infer it from
    return df.sparkSession.read.schema(out.schema).parquet(path).where(F.col("batch_id") == epoch).drop("batch_id")


def _write_predictions(records: DataFrame, features: DataFrame, scorer, path: str, epoch: int) -> DataFrame:
    """One prediction per record whose sensor has a scorable feature row, with that row's
    ``feature_values`` (map of the features present)."""
    per_sensor = scorer(features).select("sensor_id", "is_anomaly", "anomaly_score", "confidence", "model_version")
    values = feat.features_to_map(features).withColumnRenamed("features", "feature_values")
    return _write_batch(records.join(per_sensor.join(values, "sensor_id"), "sensor_id"), path, epoch)


def _history(spark: SparkSession, records: DataFrame, schema, root: str, epoch: int, lookback_batches: int | None) -> DataFrame:
    """Silver rows that hold the newest ``MAX_HISTORY`` valid rows of every sensor up to ``epoch``.

    Of every batch the newest valid rows of each sensor are kept in a table of their own: the newest of several
    batches are among the newest of each, so a batch reads some rows a sensor and batch, not all of Silver. Batches that
    are in Silver only (written before there was that table) are read from there."""
    newest = Window.partitionBy("sensor_id").orderBy(F.col("event_timestamp").desc(), F.col("id").desc())
    usable = records.where("is_valid AND sensor_id IS NOT NULL AND event_timestamp IS NOT NULL AND cleaned_value IS NOT NULL")
    own = usable.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= fixed.MAX_HISTORY).drop("rn")
    _write_batch(own, f"{root}/newest", epoch)
    files = Files(spark, root)
    kept = set(files.names("newest"))
    older = [int(n.split("=")[1]) for n in files.names("silver") if n.startswith("batch_id=") and n not in kept]

    def upto(name: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("batch_id") <= epoch)
        return rows if lookback_batches is None else rows.where(F.col("batch_id") > epoch - lookback_batches)

    history = upto("newest")
    return history.unionByName(upto("silver").where(F.col("batch_id").isin(older))) if older else history


def process_batch(spark: SparkSession, batch: DataFrame, epoch: int, dimension: DataFrame, dim_rows: int,
                  root: str, scorer=None, lookback_batches: int | None = None) -> dict[str, int]:
    """Process one batch of readings into the tables under ``root`` and count what came of it:
    records, sensors with features, predictions and anomalies. Sensors with too short a
    history get no feature row and no prediction; an empty batch gives four zeros."""
    silver = silv.silver_range(batch, dimension, dim_rows=dim_rows)
    history_schema = silver.withColumn("batch_id", F.lit(epoch).cast("long")).schema
    records = _write_batch(silver, f"{root}/silver", epoch)
    history = _history(spark, records, history_schema, root, epoch, lookback_batches)
    history = history.join(records.select("sensor_id").distinct(), "sensor_id", "left_semi")
    snap = feat.snapshot_features(history).withColumns(
        {"timestamp": F.current_timestamp(), "feature_version": F.lit(fixed.FEATURE_VERSION)})
    features = _write_batch(snap, f"{root}/features", epoch)
    counts = {"records": records.count(), "features": features.count(), "predictions": 0, "anomalies": 0}
    if scorer is not None:
        records = records.select("id", "sensor_id", F.col("event_timestamp").alias("timestamp"))
        preds = _write_predictions(records, features, scorer, f"{root}/anomalies", epoch)
        found = preds.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("bad")).first()
        counts |= {"predictions": found["n"], "anomalies": found["bad"]}
    return counts


# ---------------------------------------------------------------- stateful micro-batch form
# Output of the per-sensor state step: kind 0 = one of the sensor's newest valid rows after
# this batch, kind 1 = a record of this batch (to receive its sensor's prediction).
RECENT_ROWS = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("cleaned_value", T.DoubleType()),
])
RECENT_STATE = T.StructType([
    T.StructField("ts_us", T.ArrayType(T.LongType())),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("vals", T.ArrayType(T.DoubleType())),
])


def _keep_recent(max_history: int):
    """State per sensor: its newest ``max_history`` valid rows by (time, id), folded chunk
    by chunk, so a hot sensor's batch never sits whole in memory."""
    import numpy as np
    import pandas as pd

    def fn(key, pdfs, state):
        sid = key[0]
        if state.exists:
            ts, ids, vals = state.get
            cur = pd.DataFrame({"ts_us": np.asarray(ts, dtype="int64"), "id": np.asarray(ids, dtype="int64"),
                                "cleaned_value": np.asarray(vals, dtype="float64")})
        else:
            cur = pd.DataFrame({"ts_us": np.empty(0, "int64"), "id": np.empty(0, "int64"),
                                "cleaned_value": np.empty(0, "float64")})
        for pdf in pdfs:
            if not len(pdf):
                continue
            # a record carries no value here (0.0 keeps the column non-null for Arrow)
            yield pd.DataFrame({"sensor_id": sid, "kind": 1, "ts_us": pdf["ts_us"].to_numpy(),
                                "id": pdf["id"].to_numpy(), "cleaned_value": 0.0})
            ok = pdf.loc[pdf["is_valid"].fillna(False).astype(bool), ["ts_us", "id", "cleaned_value"]]
            if len(ok):
                both = pd.concat([cur, ok], ignore_index=True)
                cur = both.sort_values(["ts_us", "id"], ascending=False, kind="mergesort").head(max_history)
        state.update((cur["ts_us"].tolist(), cur["id"].tolist(), cur["cleaned_value"].tolist()))
        if len(cur):
            yield pd.DataFrame({"sensor_id": sid, "kind": 0, "ts_us": cur["ts_us"].to_numpy(),
                                "id": cur["id"].to_numpy(), "cleaned_value": cur["cleaned_value"].to_numpy()})

    return fn


def recent_rows_stream(silver_stream: DataFrame, max_history: int = fixed.MAX_HISTORY) -> DataFrame:
    """Streaming ``applyInPandasWithState`` keyed by sensor: after each micro-batch, the
    newest ``max_history`` valid rows of every sensor the batch touched (kind 0) and the
    batch's records (kind 1). State is bounded by ``max_history`` rows per sensor (state
    store, checkpointed), so a batch costs O(batch + touched sensors x max_history) however
    long the history is."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    rows = silver_stream.select(
        "sensor_id", F.unix_micros(F.col("event_timestamp").cast("timestamp")).alias("ts_us"),
        F.col("id").cast("long").alias("id"), "cleaned_value", "is_valid")
    return rows.groupBy("sensor_id").applyInPandasWithState(
        _keep_recent(max_history), RECENT_ROWS, RECENT_STATE, "update", GroupStateTimeout.NoTimeout)


def process_batches_stateful(spark: SparkSession, readings_stream: DataFrame, dimension: DataFrame,
                             dim_rows: int, root: str, scorer=None, trigger: dict | None = None,
                             max_history: int = fixed.MAX_HISTORY):
    """Micro-batch service form on bounded state (same outputs as ``process_batches``).

    Two queries on one source: Silver into an exactly-once, date-partitioned file sink,
    and the state step whose output ``foreachBatch`` turns into snapshot features of the
    touched sensors (the same SQL definition as batch) and one prediction per record.
    Every output lands in a ``batch_id=<epoch>`` partition with dynamic overwrite, so a
    replayed epoch replaces its own output. Returns (silver query, features query)."""
    silver_path, recent_path = f"{root}/silver", f"{root}/recent"
    features_path, anomalies_path = f"{root}/features", f"{root}/anomalies"
    silver = silv.silver_range(readings_stream, dimension, dim_rows=dim_rows)
    ts_type = silver.schema["event_timestamp"].dataType
    q_silver = _trigger(
        silver.withColumn("event_date", F.to_date("event_timestamp")).writeStream.format("parquet")
        .outputMode("append").partitionBy("event_date")
        .option("checkpointLocation", f"{root}/_checkpoints/silver"), trigger).start(silver_path)

    def handle(batch: DataFrame, epoch: int) -> None:
        # the state step's output is written once; both uses below read that table
        out = _write_batch(batch, recent_path, epoch)
        when = F.timestamp_micros(F.col("ts_us")).cast(ts_type)
        window = out.where(F.col("kind") == 0).select(
            "sensor_id", when.alias("event_timestamp"), "id", "cleaned_value", F.lit(True).alias("is_valid"))
        snap = feat.snapshot_features(window, max_history=max_history).withColumns(
            {"timestamp": F.current_timestamp(), "feature_version": F.lit(fixed.FEATURE_VERSION)})
        features = _write_batch(snap, features_path, epoch)
        if scorer is not None:
            records = out.where(F.col("kind") == 1).select("id", "sensor_id", when.alias("timestamp"))
            _write_predictions(records, features, scorer, anomalies_path, epoch)

    q_feat = _trigger(
        recent_rows_stream(silver, max_history).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", f"{root}/_checkpoints/features"), trigger).start()
    return q_silver, q_feat
