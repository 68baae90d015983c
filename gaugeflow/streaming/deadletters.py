"""Late and unusable rows to a side table, before the windows.

A stage between Silver and the window features: every batch is split by one rule per row (see ``reasons``) into accepted rows
and dead letters, which keep all columns and a ``reason``. A row is late if its time lies before the watermark of its
batch, that is the largest time of all earlier batches less the delay, as in Structured Streaming; accepted rows
are therefore in time for every window they belong to, and the window stage downstream drops none of them.

A batch is written once, to a staging folder; the dead letters and the accepted rows then appear in their
tables by one rename each, and last the record of the batch (its counts, from ``observe`` during the write, and the
largest time so far). A batch that is run again after a failure finds what is in place and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.operators.windowed import interval_micros
from gaugeflow.sources.published import Files

REASONS = ("no_time", "no_sensor", "invalid", "late")


def reasons(time_col: str, watermark_us: int | None, key: str = "sensor_id") -> Column:
    """The first reason for which a Silver row is no use to the windows; null for an accepted row."""
    late = F.lit(False) if watermark_us is None else F.unix_micros(F.col(time_col).cast("timestamp")) < F.lit(watermark_us)
    return (F.when(F.col(time_col).isNull(), "no_time").when(F.col(key).isNull(), "no_sensor")
            .when(~F.coalesce(F.col("is_valid"), F.lit(False)), "invalid").when(late, "late"))


def _name(epoch: int) -> str:
    return f"{epoch:012d}"


def split_batch(spark: SparkSession, batch: DataFrame, epoch: int, root: str, delay_us: int, time_col: str) -> dict:
    """Split one batch; returns its record."""
    files = Files(spark, root)
    record = files.read(f"epochs/{_name(epoch)}.json")
    if record is not None:
        return record
    before = files.read(f"epochs/{_name(epoch - 1)}.json") or {"newest_us": None}
    newest = before["newest_us"]
    watermark = None if newest is None else newest - delay_us
    counts = Observation()
    why = F.coalesce(F.col("reason"), F.lit(""))
    tagged = (batch.withColumn("reason", reasons(time_col, watermark)).withColumn("dead", F.col("reason").isNotNull())
              .observe(counts, F.count(F.lit(1)).alias("input"), F.count_if(why == "").alias("accepted"),
                       *[F.count_if(why == r).alias(r) for r in REASONS],
                       F.max(F.unix_micros(F.col(time_col).cast("timestamp"))).alias("newest_us")))
    staged = f"staging/{_name(epoch)}"
    tagged.write.mode("overwrite").partitionBy("dead").parquet(files.path(staged))
    for part, table in (("dead=true", "dead_letters"), ("dead=false", "accepted")):
        if files.exists(f"{staged}/{part}"):
            files.publish(f"{staged}/{part}", f"{table}/epoch={epoch}")
    found = counts.get
    times = [t for t in (newest, found["newest_us"]) if t is not None]
    record = {"epoch": epoch, "watermark_us": watermark} | found | {"newest_us": max(times) if times else None}
    files.write(f"epochs/{_name(epoch)}.json", record)
    files.delete(staged)
    return record


def split_dead_letters(spark: SparkSession, silver_stream: DataFrame, root: str, watermark: str = fixed.WATERMARK_DELAY,
                       time_col: str = "timestamp", trigger: dict | None = None):
    """Start the stage on a Silver stream. Tables under ``root``: accepted, dead_letters, epochs."""
    delay = interval_micros(watermark)

    def handle(batch: DataFrame, epoch: int) -> None:
        split_batch(spark, batch, epoch, root, delay, time_col)

    writer = silver_stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoints")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table of published batches with its ``epoch``; empty before the first batch."""
    whole = type(schema)([*schema.fields]).add("reason", "string").add("epoch", "long")
    if not Files(spark, root).exists(name):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{root}/{name}")


def dead_letters(spark: SparkSession, root: str, schema) -> DataFrame:
    """Rows that no window got, with reason and epoch."""
    return _table(spark, root, "dead_letters", schema)


def accepted(spark: SparkSession, root: str, schema) -> DataFrame:
    return _table(spark, root, "accepted", schema).drop("reason")


def accepted_stream(spark: SparkSession, root: str, schema) -> DataFrame:
    """The accepted rows as a stream, batch after batch; give it to the window stage."""
    files = Files(spark, root)
    files.make_folder("accepted")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/accepted")


def batch_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch: epoch, input, accepted, a count per reason, watermark_us, newest_us."""
    schema = "epoch long, input long, accepted long, " + ", ".join(f"{r} long" for r in REASONS) + ", watermark_us long, newest_us long"
    if not Files(spark, root).exists("epochs"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/epochs")
