"""Shared helpers of the corpus operators: table access, folds, bounded samples, link components."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.session import materialize

__all__ = ["components", "fold", "id_sample", "join_by_count", "materialize", "read", "small_batches", "valid_vector",
           "workers_find_package"]

SHARE = 1024
#: rows and bytes of an Arrow batch of texts: (setting, Spark's own value, value taken here)
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
           ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"))


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package: from the same path as the driver, where it exists there
    (on a cluster the package is submitted with --py-files or installed)."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, PACKAGE_ROOT]))


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to 1,000 rows and 4 MB, unless the caller chose other limits.

    Spark's own limits let 64 MB of texts into a batch, of which the executor keeps an Arrow vector and a buffer and the
    worker two copies, for every task at once. Batches change no result: all rows pass, only more often."""
    for name, usual, small in BATCHES:
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(parts), F.lit(0)).cast("int")


def id_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of ``key`` (the same rows on every run).

    The cut is the ``rows``-th smallest hash, so the sample is bounded however large the
    input is; a smaller input is returned whole."""
    h = F.xxhash64(F.col(key), F.lit("sample"))
    cut = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("m"), F.count("h").alias("n")).first()
    if cut["n"] < rows:
        return df
    return df.where(h <= F.lit(cut["m"]))


def join_by_count(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``table``, which has one row per key and in column ``n`` the number of its rows.

    Keys of more than 1/``SHARE`` of all ``total`` rows are fewer than ``SHARE`` and are broadcast; the others
    meet their rows in a shuffle join, in which no key has more than that share."""
    hot = F.col(n) * SHARE > F.lit(total)
    few = table.where(hot)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(few), keys).unionByName(rest.join(table.where(~hot), keys))


def valid_vector(v: Column) -> Column:
    """True for a vector that is not null or empty, has no null or non-finite component and is not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): one row (node, comp) per linked
    node, ``comp`` being the smallest node reachable.

    Every round takes the smallest label among a node and its neighbours (partial
    aggregation, so a node with very many links does not gather them in one task) and then
    follows the label's own label; each round is written to the shared folder."""
    links = links.where("a <> b").select("a", "b")
    edges = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"),
                                                F.least("comp", "near").alias("comp"))
        hop = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        nxt = materialize(step.join(hop, "comp").select("node", "old", F.least("comp", "up").alias("comp")), "labels")
        if nxt.where("old <> comp").isEmpty():
            return nxt.select("node", "comp")
        labels = nxt.select("node", "comp")
