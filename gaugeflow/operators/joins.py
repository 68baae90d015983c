"""Joins: size-checked dimension lookup, latest-row lookup and its as-of form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a dimension we are willing to ship to every executor.
BROADCAST_ROW_LIMIT = 1_000_000
BROADCAST_BYTE_LIMIT = 256 * 1024 * 1024


def bounded_rows(df: DataFrame, limit: int, max_bytes: int = BROADCAST_BYTE_LIMIT) -> int | None:
    """Row count if there are at most ``limit`` rows of together at most ``max_bytes`` (as text), else None.

    Reads at most limit + 1 rows."""
    # nothing to convert for a row of plain numbers: 16 bytes a column are above what it takes
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    plain = 16 * (len(df.columns) - len(wide))
    text = F.octet_length(F.to_json(F.struct(*wide))) if wide else F.lit(0)
    found = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(text + F.lit(plain)).alias("bytes")).first()
    return found["n"] if found["n"] <= limit and (found["bytes"] or 0) <= max_bytes else None


def lookup_join(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                dim_rows: int | None = None, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join a fact table to a dimension; broadcast the dimension only with a proven bound.

    ``dim_rows`` is the known size of a configuration dimension; when it is not given the
    size is checked with a bounded count. Above the limit it is a plain shuffle join (AQE
    may still switch it at runtime from real statistics).
    """
    n = dim_rows if dim_rows is not None else bounded_rows(dim, limit)
    if n is not None and n <= limit:
        return fact.join(F.broadcast(dim), on, how)
    return fact.join(dim, on, how)


def latest_per_key(df: DataFrame, key: str | list[str], order_cols: list[str]) -> DataFrame:
    """Newest row per key by ``order_cols`` (descending), as a partial aggregation.

    ``max_by`` over a struct of the ordering columns is combined map-side, so a hot key
    costs one small partial row per map task, never a whole group in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def latest_lookup(records: DataFrame, features: DataFrame, key: str = "sensor_id",
                  order_cols: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Each record joined to the newest feature row of its key; records without one drop."""
    latest = latest_per_key(features, key, list(order_cols))
    renamed = latest.select(key, *[F.col(c).alias(f"f_{c}") for c in latest.columns if c != key])
    return records.join(renamed, key, "inner")


def asof_lookup(records: DataFrame, features: DataFrame, key: str, rec_time: str,
                feat_time: str, feat_cols: list[str], rec_order: str = "id",
                feat_order: str | None = None, bucket_unit: str = "hour",
                pieces: str = "auto", materialize_input: bool = False) -> DataFrame:
    """As-of join: each record gets the newest feature row with feat_time <= rec_time.

    Records and feature rows are unioned and ordered by (time, side, order key) with
    feature rows first at equal time; the newest feature struct is carried forward by the
    skew-safe scan over ordered pieces (no range join, no whole-key task; ``pieces`` as in
    ``scan.with_pieces``). Records with no earlier feature row are dropped.

    The scan reads its input in two branches (running window, piece edges);
    ``materialize_input`` writes the unioned input once to the shared checkpoint folder
    first, for inputs that are expensive to recompute (e.g. features derived inline).
    """
    from gaugeflow.operators.scan import PIECE, carry, with_pieces

    rec_cols = records.columns
    feat_struct = features.select(F.struct(*feat_cols).alias("s")).schema["s"].dataType
    rec_struct = records.select(F.struct(*rec_cols).alias("s")).schema["s"].dataType
    order_type = records.schema[rec_order].dataType
    rec = records.select(
        F.col(key), F.col(rec_time).alias("_t"), F.lit(1).alias("_side"),
        F.col(rec_order).cast(order_type).alias("_o"),
        F.struct(*[F.col(c) for c in rec_cols]).alias("_rec"),
        F.lit(None).cast(feat_struct).alias("_feat"))
    feat = features.select(
        F.col(key), F.col(feat_time).alias("_t"), F.lit(0).alias("_side"),
        (F.col(feat_order).cast(order_type) if feat_order else F.lit(None).cast(order_type)).alias("_o"),
        F.lit(None).cast(rec_struct).alias("_rec"),
        F.struct(*feat_cols).alias("_feat"))
    both = rec.unionByName(feat)
    if materialize_input:
        from gaugeflow.session import materialize
        both = materialize(both, "asof-input")
    order = ["_t", "_side", "_o"]
    both = with_pieces(both, key, order, F.date_trunc(bucket_unit, F.col("_t")), pieces)
    both = carry(both, key, order, F.col("_feat"), "_cur", PIECE)
    out = both.where((F.col("_side") == 1) & F.col("_cur").isNotNull())
    return out.select(*[F.col(f"_rec.{c}").alias(c) for c in rec_cols],
                      *[F.col(f"_cur.{c}").alias(f"f_{c}") for c in feat_cols])
