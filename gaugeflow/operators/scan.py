"""Skew-safe ordered scans per key ("last non-NULL value at or before this row").

A plain ``Window.partitionBy(key)`` puts a whole key in one task; with one sensor
holding a third of all rows that task holds a third of the data. Instead each key is
cut into ordered pieces (``with_pieces``):

* cheap case: a coarse time slot per row (one grouped count checks that no
  (key, slot) piece exceeds ``PIECE_ROWS``);
* hot case (one key *and* one time slot hold a large share of the rows, e.g. a burst):
  count-balanced pieces from ``repartitionByRange(key, order...)``, whose bounds Spark
  samples over the whole (key, order) sequence, so a hot key is spread over many
  partitions. The piece id is written with the rows (shared checkpoint folder), so
  every later pass sees one fixed assignment, also after a lost executor.

A scan then runs in four steps:

1. inside each piece, a running ``last(..., ignorenulls)`` window (pieces spread over
   many tasks);
2. per piece, its last non-NULL payload (a grouped ``max_by``: partial aggregation);
3. over the small piece table, the carry-in from earlier pieces of the same key
   (a window over #pieces rows per key, not #rows);
4. an equi-join back on (key, piece).

Backward scans (first non-NULL at or after) are the mirror image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = "hour"
PIECE = "_piece"
# Largest piece one task should sort; above it (after the check) pieces are cut by count.
PIECE_ROWS = 4_000_000


def time_bucket(ts_col: str, unit: str = DEFAULT_BUCKET) -> Column:
    return F.date_trunc(unit, F.col(ts_col))


def piece_sizes(df: DataFrame, keys: list[str], bucket: Column) -> tuple[int, int]:
    """(total rows, rows of the largest (key, bucket) piece): one partial aggregation."""
    per = df.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    r = per.agg(F.sum("_c").alias("n"), F.max("_c").alias("m")).first()
    return int(r["n"] or 0), int(r["m"] or 0)


def with_pieces(df: DataFrame, key: str | list[str], order_cols: list[str], bucket: Column,
                method: str = "auto", max_piece_rows: int = PIECE_ROWS,
                n_rows: int | None = None) -> DataFrame:
    """Add ``_piece``: ordered, contiguous pieces of every key's series.

    ``method``: "time" (the ``bucket`` column), "rows" (count-balanced range pieces), or
    "auto" (time unless the largest time piece exceeds ``max_piece_rows``). Pieces of one
    key are ordered like the series (piece values increase with ``order_cols``)."""
    keys = [key] if isinstance(key, str) else list(key)
    if method == "auto":
        n_rows, biggest = piece_sizes(df, keys, bucket)
        method = "time" if biggest <= max_piece_rows else "rows"
    if method == "time":
        return df.withColumn(PIECE, bucket)
    if method != "rows":
        raise ValueError(f"unknown piece method {method!r}")
    spark = df.sparkSession
    if n_rows is None:
        n_rows = df.count()
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(base, math.ceil(2 * n_rows / max(max_piece_rows, 1)))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in keys + list(order_cols)])
    ranged = ranged.withColumn(PIECE, F.spark_partition_id().cast("long"))
    from gaugeflow.session import materialize
    return materialize(ranged, "pieces")


def carry(df: DataFrame, key: str | list[str], order_cols: list[str], payload: Column,
          out_col: str, bucket: Column | str, backward: bool = False) -> DataFrame:
    """Add ``out_col``: the nearest non-NULL ``payload`` at or before (``backward``: at or
    after) each row in ``order_cols`` order within ``key``.

    ``bucket``: the name of a piece column already on ``df`` (see ``with_pieces``; it is
    kept), or a column expression used directly as the piece (e.g. a time bucket)."""
    return carry_many(df, key, order_cols, bucket, [(payload, out_col, backward)])


def carry_many(df: DataFrame, key: str | list[str], order_cols: list[str], bucket: Column | str,
               scans: list[tuple[Column, str, bool]]) -> DataFrame:
    """Several scans ``(payload, out_col, backward)`` over the same pieces in one pass: one
    exchange by (key, piece) for all running windows, one grouped aggregation for the piece
    edges, one window over the small piece table, one join back."""
    keys = [key] if isinstance(key, str) else list(key)
    if isinstance(bucket, str):
        b, base = bucket, df
    else:
        b, base = "_bucket", df.withColumn("_bucket", bucket)
    base = base.select("*", *[p.alias(f"_p{i}") for i, (p, _, _) in enumerate(scans)])
    up = [F.col(c) for c in order_cols]
    down = [F.col(c).desc() for c in order_cols]
    local, edges, carried = [], [], []
    rank = F.struct(*up)
    for i, (_, _, backward) in enumerate(scans):
        w = (Window.partitionBy(*keys, b).orderBy(*(down if backward else up))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        local.append(F.last(f"_p{i}", ignorenulls=True).over(w).alias(f"_l{i}"))
        pick = F.min_by if backward else F.max_by
        edges.append(pick(F.col(f"_p{i}"), F.when(F.col(f"_p{i}").isNotNull(), rank)).alias(f"_e{i}"))
        pw = (Window.partitionBy(*keys).orderBy(F.col(b).desc() if backward else F.col(b))
              .rowsBetween(Window.unboundedPreceding, -1))
        carried.append(F.last(f"_e{i}", ignorenulls=True).over(pw).alias(f"_c{i}"))
    with_local = base.select("*", *local)
    pieces = base.groupBy(*keys, b).agg(*edges).select(*keys, b, *carried)
    joined = with_local.join(pieces, [*keys, b], "left")
    tmp = [f"_{x}{i}" for i in range(len(scans)) for x in "plc"]
    out = joined.select("*", *[F.coalesce(F.col(f"_l{i}"), F.col(f"_c{i}")).alias(name)
                              for i, (_, name, _) in enumerate(scans)]).drop(*tmp)
    return out if isinstance(bucket, str) else out.drop(b)
