"""Retention that frees storage: old date partitions go, the partition at the limit is rewritten.

The table is a folder of ``<date_col>=YYYY-MM-DD`` partitions, as the streams write it. The rows to keep of the partition at the
limit are written beside the table first; then one record is put in place that says which partitions go and which
files the new ones replace. Until then the table is the old one, from then on it is the new one (``read_table``):
a run that is cut off leaves the one or the other, and the next run finishes what the record says.
Files that streams add meanwhile stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.sources.published import Files

PLAN, STAGED = "_retention/plan.json", "_retention/boundary"


def _partitions(files: Files, date_col: str) -> list[str]:
    return [n for n in files.names() if n.startswith(f"{date_col}=")]


def _data_files(files: Files, folder: str) -> list[str]:
    return [n for n in files.names(folder) if not n.startswith(("_", "."))]


def apply_retention(spark: SparkSession, path: str, time_col: str, days: int, date_col: str = "event_date") -> dict:
    """Keep the rows within ``days`` of the newest time; rows without a time go, as in ``quality.retain_recent``.

    The newest time is read from the newest partition only. Returns the limit and the names of the partitions
    dropped and rewritten (the latter None if the limit falls between partitions)."""
    files = Files(spark, path)
    _finish(files)
    dated = [n for n in _partitions(files, date_col) if not n.endswith("__HIVE_DEFAULT_PARTITION__")]
    if not dated:
        return {"limit": None, "dropped": [], "rewritten": None}
    newest = spark.read.parquet(files.path(dated[-1])).agg(F.max(time_col).alias("t")).select(
        (F.col("t") - F.expr(f"INTERVAL {int(days)} DAYS")).alias("limit"),
        F.date_format(F.col("t") - F.expr(f"INTERVAL {int(days)} DAYS"), "yyyy-MM-dd").alias("day")).first()
    boundary = f"{date_col}={newest['day']}"
    drop = [n for n in _partitions(files, date_col) if n < boundary or n not in dated]
    plan = {"limit": str(newest["limit"]), "drop": drop, "boundary": None, "replaced": []}
    if boundary in dated:
        plan |= {"boundary": boundary, "replaced": _data_files(files, boundary)}
        kept = spark.read.parquet(*[files.path(f"{boundary}/{n}") for n in plan["replaced"]])
        files.delete(STAGED)
        kept.where(F.col(time_col) >= F.lit(newest["limit"])).write.parquet(files.path(STAGED))
    files.write(PLAN, plan)
    _finish(files)
    return {"limit": newest["limit"], "dropped": drop, "rewritten": plan["boundary"]}


def _finish(files: Files) -> None:
    """Carry out the recorded plan; every step may have been done before."""
    plan = files.read(PLAN)
    if plan is None:
        return
    for name in plan["drop"]:
        files.delete(name)
    if plan["boundary"]:
        for name in _data_files(files, STAGED):
            files.publish(f"{STAGED}/{name}", f"{plan['boundary']}/{name}")
        for name in plan["replaced"]:
            files.delete(f"{plan['boundary']}/{name}")
    files.delete(PLAN)


def read_table(spark: SparkSession, path: str, schema, date_col: str = "event_date") -> DataFrame:
    """The table as it is after the last recorded retention, also while one is being carried out.

    ``schema`` includes the partition column, as the last one."""
    files = Files(spark, path)
    plan = files.read(PLAN)
    if plan is None:
        return spark.read.schema(schema).parquet(files.path(""))
    whole = [files.path(n) for n in _partitions(files, date_col) if n not in plan["drop"] and n != plan["boundary"]]
    rows = spark.read.schema(schema).option("basePath", files.path("")).parquet(*whole) if whole else spark.createDataFrame([], schema)
    if plan["boundary"]:
        there = [f"{plan['boundary']}/{n}" for n in _data_files(files, plan["boundary"]) if n not in plan["replaced"]]
        there += [f"{STAGED}/{n}" for n in _data_files(files, STAGED)]
        day = F.lit(plan["boundary"].split("=", 1)[1]).cast(rows.schema[date_col].dataType)
        plain = [f for f in rows.schema.fields if f.name != date_col]
        if there:
            part = spark.read.schema(type(rows.schema)(plain)).parquet(*[files.path(n) for n in there])
            rows = rows.unionByName(part.withColumn(date_col, day))
    return rows
