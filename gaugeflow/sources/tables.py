"""Parquet table access and the sensor dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import fixed

DIMENSION_SCHEMA = T.StructType([
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("normal_range", T.StructType([
        T.StructField("min", T.DoubleType(), False),
        T.StructField("max", T.DoubleType(), False),
    ]), False),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dimension_rows(include_service: bool = True, include_events: bool = True) -> list[tuple]:
    rows = []
    if include_service:
        rows += [(s, t, loc, unit, (lo, hi)) for s, t, loc, lo, hi, unit in fixed.SERVICE_SENSORS]
    if include_events:
        for etype, lo, hi in fixed.EVENT_TYPE_RANGES:
            for z in range(fixed.EVENT_ZONES):
                rows.append((f"{etype}_{z}", etype, f"zone_{z}", "u", (lo, hi)))
    return rows


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    if isinstance(v, tuple):
        return "(" + ", ".join(_sql_literal(x) for x in v) + ")"
    return "'" + str(v).replace("'", "''") + "'"


def values_df(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small configuration table as an inline VALUES relation (LocalTableScan: no Python
    round trip, size known to the optimizer)."""
    body = ", ".join("(" + ", ".join(_sql_literal(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def sensor_dimension(spark: SparkSession, include_service: bool = True,
                     include_events: bool = True) -> tuple[DataFrame, int]:
    """The sensor dimension and its row count (a configuration table of fixed size).

    The count is returned so joins can decide on broadcast with a proven bound.
    """
    rows = dimension_rows(include_service, include_events)
    flat = [(s, t, loc, u, lo, hi) for s, t, loc, u, (lo, hi) in rows]
    df = values_df(spark, flat, ["sensor_id", "type", "location", "unit", "range_min", "range_max"])
    df = df.select("sensor_id", "type", "location", "unit",
                   F.struct(F.col("range_min").alias("min"), F.col("range_max").alias("max")).alias("normal_range"))
    return df, len(rows)


def type_ranges(spark: SparkSession) -> DataFrame:
    return values_df(spark, fixed.EVENT_TYPE_RANGES, ["type", "range_min", "range_max"])


def readings_schema(with_metadata: bool = True) -> T.StructType:
    fields = [
        T.StructField("sensor_id", T.StringType(), True),
        T.StructField("sensor_type", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("unit", T.StringType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("location", T.StringType(), True),
    ]
    if with_metadata:
        fields.append(T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True))
    return T.StructType(fields)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def lit_null(dtype: T.DataType):
    return F.lit(None).cast(dtype)
