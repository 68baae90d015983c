"""Session helpers: a tuned local session for tests/bench and shared-folder discovery.

On a cluster the caller owns the session; the library only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "gaugeflow") -> SparkSession:
    """Local session with AQE, UTC, Arrow and the UI off (tests and bench only)."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GAUGEFLOW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.schemaInference", "false")
        # window state off the JVM heap (many sensors x open windows at scale)
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    return spark


def ensure_shared_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests, the smoke driver) a fresh folder is
    created and registered; on a cluster the configured shared folder is always used.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: its executors cannot see a folder of this machine
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share") from None
        return current
    current = sc.getCheckpointDir()
    if not current:
        current = sc.getConf().get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="gaugeflow-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder (never machine-local
    unless the session itself had no shared folder configured)."""
    base = ensure_shared_dir(spark).rstrip("/")
    return f"{base}/gaugeflow/{name}-{uuid.uuid4().hex[:12]}"


def utc(spark: SparkSession) -> None:
    """Pin the session time zone; all event times are UTC wall clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def compiled_methods(spark: SparkSession) -> None:
    """Hold the methods Spark generates to the size that HotSpot compiles (8,000 bytes of bytecode, the value Spark's
    documentation gives for it), unless the caller chose a limit.

    Wide rows of features make longer methods, which the JVM only interprets, several times slower than Spark's plain
    operators that such a stage falls back to."""
    if spark.conf.get(HUGE_METHOD, "65535") == "65535":
        spark.conf.set(HUGE_METHOD, "8000")


def materialize(df, name: str):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the plan)
    and gives later passes a columnar, pushdown-capable scan. Never machine-local on a
    cluster: the folder is the one the session names in ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
