"""Skew-proof per-sensor series features: no task ever holds a whole sensor.

``Window.partitionBy(sensor)`` sends all rows of a sensor to one task; if one sensor holds
a third of the data that task holds a third of the data. Here every window is partitioned
by (sensor, piece) with bounded pieces:

1. Positions: pieces are (sensor, time bucket), or count-balanced range pieces when a
   bucket is hot (``scan.with_pieces`` checks); a row's 1-based position in its sensor's
   series is the row number inside its piece plus the sizes of the earlier pieces (a
   running sum over the small piece table).
2. Blocks: fixed-size position blocks of ``block_rows``; each block also receives the last
   ``halo`` rows of the previous block, so sliding frames (rolling windows, lags) near the
   block start see their full look-back.
3. Expanding statistics: central moments (count, means, M2, M3, M4, co-moment with the
   position) inside a block come from running sums of powers of the values' distance to the
   block's first value. That value belongs to the set, so the subtraction that turns the sums into
   central moments loses a factor of at most the rows of a block, and a constant block is exactly 0.
4. Moments of whole blocks are merged, never subtracted, in block order: a block starts from
   those of all earlier blocks of its sensor. The merge is a scan in levels of ``CHUNK``: within
   (sensor, chunk of blocks), then over the chunks' totals, and so on; no group holds more
   than ``CHUNK`` rows, whatever the length of the series. A NaN shows from its own row on, as in one
   window. min/max/first go along.

Series carry no NULL key, time or value (``features`` drops such rows for both plans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalar import sample_kurtosis, sample_skewness

BLOCK_ROWS = 1_000_000
CHUNK = 1000
TASK_ROWS = 250_000
POSITION_BUCKET = "hour"


def global_positions(df: DataFrame, key: str, order_cols: list[str], time_col: str,
                     bucket_unit: str = POSITION_BUCKET, pieces: str = "auto") -> DataFrame:
    """Add ``pos``: 1-based position of each row in its key's series (by ``order_cols``).

    Rows are ranked inside bounded, ordered pieces (``scan.with_pieces``: time slots, or
    count-balanced range pieces when a slot is hot); a piece's offset is the running sum
    of the sizes of the key's earlier pieces, over the small piece table."""
    from gaugeflow.operators.scan import with_pieces
    return _positions(with_pieces(df, key, order_cols, F.date_trunc(bucket_unit, F.col(time_col)), pieces), key, order_cols)


def ordered_positions(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """``global_positions`` for an order without time: pieces are count-balanced ranges."""
    from gaugeflow.operators.scan import with_pieces
    return _positions(with_pieces(df, key, order_cols, F.lit(0), "rows"), key, order_cols)


def _positions(cut: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    from gaugeflow.operators.scan import PIECE
    order = [F.col(c) for c in order_cols]
    ranked = cut.withColumn("_lp", F.row_number().over(Window.partitionBy(key, PIECE).orderBy(*order)))
    sizes = cut.groupBy(key, PIECE).agg(F.count(F.lit(1)).alias("_sz"))
    before = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, PIECE, F.coalesce(F.sum("_sz").over(before), F.lit(0)).alias("_off"))
    out = ranked.join(offsets, [key, PIECE], "inner")
    return out.withColumn("pos", (F.col("_off") + F.col("_lp")).cast("long")).drop(PIECE, "_lp", "_off")


def newest_per_key(df: DataFrame, key: str, order_cols: list[str], time_col: str, n: int, out: str = "rn",
                   bucket_unit: str = POSITION_BUCKET, pieces: str = "auto") -> DataFrame:
    """The newest ``n`` rows of each key with their rank from the newest (1) in ``out``, for any ``n``.

    Spark's own group limit ends at ``spark.sql.optimizer.windowGroupLimitThreshold`` rows; above it a window by key would
    sort a whole key in one task. Here the pieces of a key are counted, those behind its newest ``n`` rows
    are left out before any sorting, and the others are ranked piece by piece."""
    from gaugeflow.operators.joins import lookup_join
    from gaugeflow.operators.scan import PIECE, with_pieces
    from gaugeflow.session import materialize
    order = [F.col(c).desc() for c in order_cols]
    cut = with_pieces(df, key, order_cols, F.date_trunc(bucket_unit, F.col(time_col)), pieces)
    sizes = cut.groupBy(key, PIECE).agg(F.count(F.lit(1)).alias("_sz"))
    later = Window.partitionBy(key).orderBy(F.col(PIECE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, PIECE, F.coalesce(F.sum("_sz").over(later), F.lit(0)).alias("_off")).where(F.col("_off") < n)
    kept = lookup_join(cut, materialize(offsets, "newest-pieces"), [key, PIECE], "inner")
    place = F.row_number().over(Window.partitionBy(key, PIECE).orderBy(*order))
    ranked = kept.withColumn(out, (F.col("_off") + place).cast("int"))
    return ranked.where(F.col(out) <= n).drop(PIECE, "_off")


def group_limit(df: DataFrame) -> int:
    """Largest rank that Spark keeps per key on both sides of the shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def _with_halo(df: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Assign blocks; each of a block's last ``halo`` rows also goes to the next block as a
    halo copy. One pass (``explode`` of one or two block ids), no second scan of the input."""
    if halo > block_rows:
        raise ValueError("block_rows must be at least the halo")
    blk = F.floor((F.col("pos") - 1) / F.lit(block_rows)).cast("long")
    tail = ((F.col("pos") - 1) % F.lit(block_rows)) >= F.lit(block_rows - halo)
    own = F.struct(blk.alias("b"), F.lit(False).alias("h"))
    copy = F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))
    targets = F.when(tail & F.lit(halo > 0), F.array(own, copy)).otherwise(F.array(own))
    out = df.withColumn("_t", F.explode(targets))
    return out.withColumn("_blk", F.col("_t.b")).withColumn("_halo", F.col("_t.h")).drop("_t")


MOMENTS = ("n", "mean", "x", "m2", "m3", "m4", "cxy")


def merge_moments(a: dict, b: dict) -> dict:
    """Moments of two disjoint sets of (position, value) together; Columns or numbers.

    n, mean, x (mean position), m2..m4 (sums of powers of value - mean), cxy (co-moment)."""
    na, nb = a["n"], b["n"]
    n, d, dx = na + nb, b["mean"] - a["mean"], b["x"] - a["x"]
    share, d2 = na * nb / n, d * d
    return {
        "n": n, "mean": a["mean"] + d * (nb / n), "x": a["x"] + dx * (nb / n),
        "m2": a["m2"] + b["m2"] + d2 * share,
        "m3": a["m3"] + b["m3"] + d2 * d * share * (na - nb) / n + 3 * d * (na * b["m2"] - nb * a["m2"]) / n,
        "m4": (a["m4"] + b["m4"] + d2 * d2 * share * (na * na - na * nb + nb * nb) / (n * n)
               + 6 * d2 * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n)
               + 4 * d * (na * b["m3"] - nb * a["m3"]) / n),
        "cxy": a["cxy"] + b["cxy"] + dx * d * share,
    }


def _moments(p: str) -> dict[str, Column]:
    """Moments from Spark's count, mean, variance, skewness, kurtosis and covariance (``p`` + name)."""
    c, var = F.col(f"{p}c").cast("double"), F.col(f"{p}var")
    m2 = var * c
    # skewness and kurtosis are NULL for a constant set: its third and fourth moments are 0
    return {"n": c, "mean": F.col("_k") + F.col(f"{p}y"), "x": F.col(f"{p}x"), "m2": m2,
            "m3": F.coalesce(F.col(f"{p}skew") * var * F.sqrt(var) * c, F.lit(0.0)),
            "m4": F.coalesce((F.col(f"{p}kurt") + 3) * var * m2, F.lit(0.0)),
            "cxy": F.col(f"{p}cov") * c}


SCANNED = (*MOMENTS, "mn", "mx", "first")


def _nothing() -> Column:
    """Moments of no rows; ``first``, ``mn`` and ``mx`` are null."""
    return F.struct(*[F.lit(0.0).alias(m) for m in MOMENTS],
                    *[F.lit(None).cast("double").alias(c) for c in SCANNED if c not in MOMENTS])


def _plus(a: Column, b: Column) -> Column:
    """Moments of ``a`` followed by ``b`` (structs; ``b`` is not empty)."""
    both = merge_moments({m: a[m] for m in MOMENTS}, {m: b[m] for m in MOMENTS})
    return F.struct(*[both[m].alias(m) for m in MOMENTS], F.least(a["mn"], b["mn"]).alias("mn"),
                    F.greatest(a["mx"], b["mx"]).alias("mx"), F.when(a["n"] > 0, a["first"]).otherwise(b["first"]).alias("first"))


def scan_moments(parts: DataFrame, key: str, last: int, chunk: int = CHUNK) -> DataFrame:
    """(key, idx, before): for each part (key, idx, m) the merged moments of all parts of its key with a smaller idx.

    ``last`` is the largest idx. Parts are folded in groups of ``chunk``; above one group the totals of the groups
    are scanned in the same way, and each fold starts from what lies before its group."""
    from gaugeflow.session import materialize
    groups = parts.groupBy(key, F.floor(F.col("idx") / F.lit(chunk)).cast("long").alias("group")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("parts"))
    if last < chunk:
        groups = groups.withColumn("before", _nothing())
    else:
        groups = materialize(groups, "moment-groups")
        total = F.aggregate("parts", _nothing(), lambda a, p: _plus(a, p["m"]))
        above = scan_moments(groups.select(key, F.col("group").alias("idx"), total.alias("m")), key, last // chunk, chunk)
        groups = groups.join(above.withColumnRenamed("idx", "group"), [key, "group"])
    start = F.struct(F.col("before").alias("upto"), F.array(F.struct(F.lit(0).cast("long").alias("idx"), F.col("before").alias("before"))).alias("out"))
    folded = F.aggregate("parts", start, lambda s, p: F.struct(
        _plus(s["upto"], p["m"]).alias("upto"),
        F.concat(s["out"], F.array(F.struct(p["idx"].alias("idx"), s["upto"].alias("before")))).alias("out")),
        lambda s: F.slice(s["out"], 2, F.size(s["out"])))
    return groups.select(key, F.inline(folded))


def _running_moments(c: Column, start: Column) -> dict[str, Column]:
    """Moments of a block's first ``c`` rows from running sums over y = v - (first value) and the position in the block."""
    s1, s2, s3, s4, sxy = (F.col(f"_s{i}") for i in ("1", "2", "3", "4", "xy"))
    mean = s1 / c
    m2 = s2 - mean * s1
    return {"n": c, "mean": F.col("_k") + mean, "x": start + (c + 1) / 2, "m2": F.greatest(m2, F.lit(0.0)),
            "m3": s3 - 3 * mean * s2 + 2 * mean * mean * s1,
            "m4": s4 - 4 * mean * s3 + 6 * mean * mean * s2 - 3 * mean * mean * mean * s1,
            "cxy": sxy - s1 * (c + 1) / 2}


def block_partitions(rows: int, blocks: int, parts: int) -> int:
    """Partitions for ``blocks`` blocks: enough to spread few of them, and so many that the rows of one stay bounded."""
    return max(parts, min(2 * blocks, 8 * parts), -(-rows // TASK_ROWS))


def expanding_features_blocked(series: DataFrame, key: str, order_cols: list[str], time_col: str,
                               min_prefix: int, min_sensor_rows: int, windows, lags,
                               trend_min: int, block_rows: int = BLOCK_ROWS,
                               bucket_unit: str = POSITION_BUCKET,
                               materialize_blocks: bool = True, pieces: str = "auto") -> DataFrame:
    """Same output as ``features.expanding_features`` (series has key, order_cols, v)."""
    from gaugeflow.operators.features import with_rolling
    stats = series.groupBy(key).agg(F.count(F.lit(1)).alias("_len"))
    stats = stats.where(F.col("_len") >= min_sensor_rows)
    from gaugeflow.operators.joins import lookup_join
    from gaugeflow.session import materialize
    # one row per sensor, written once: the size check and the join both read it
    stats = materialize(stats, "expanding-stats")
    df = lookup_join(series, stats, key, "inner")  # broadcast if bounded
    df = global_positions(df, key, order_cols, time_col, bucket_unit, pieces)
    halo = max(max(windows) - 1, max(lags))
    df = _with_halo(df, block_rows, halo)
    if materialize_blocks:
        # Both the block windows and the block totals read this table: write it once
        # (shared checkpoint folder) instead of re-deriving positions twice; cuts lineage.
        df = materialize(df, "expanding-blocks")
    sizes = stats.agg(F.max("_len").alias("longest"), F.sum("_len").alias("rows"),
                      F.sum(F.ceil(F.col("_len") / F.lit(block_rows))).alias("blocks")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if sizes["blocks"]:
        # dealt out by number: fitted to its bytes, a partition would hold millions of rows, as these are few bytes but much work
        df = df.repartition(block_partitions(int(sizes["rows"]), int(sizes["blocks"]), parts), key, "_blk")
    own = ~F.col("_halo")
    w_blk = Window.partitionBy(key, "_blk").orderBy("pos")
    run = w_blk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = F.col("pos")
    # values relative to the block's first one: a constant block has moments of exactly 0
    df0, df = df, df.withColumn("_k", F.first(F.when(own, F.col("v")), ignorenulls=True).over(run))
    y, start = F.when(own, F.col("v") - F.col("_k")), (F.col("_blk") * F.lit(block_rows)).cast("double")
    c = pos - start
    sums = {"1": y, "2": y * y, "3": y * y * y, "4": y * y * y * y, "xy": y * c}
    local = [F.sum(e).over(run).alias(f"_s{i}") for i, e in sums.items()]
    local += [F.min(F.when(own, F.col("v"))).over(run).alias("_mn"),
              F.max(F.when(own, F.col("v"))).over(run).alias("_mx")]
    looks = [F.lag("v", k).over(w_blk).alias(f"lag_{k}") for k in lags]
    rows = df.select(key, *order_cols, "pos", "v", "_k", "_blk", "_halo", *local, *looks)
    rows = with_rolling(rows, w_blk, windows, pos)
    rows = rows.where(own & (pos >= min_prefix))
    # moments of whole blocks, then of all earlier blocks of the same sensor
    yb, x = F.col("v") - F.col("_k"), pos.cast("double")
    stats_of = {"c": F.count(yb), "y": F.avg(yb), "x": F.avg(x), "var": F.var_pop(yb),
                "skew": F.skewness(yb), "kurt": F.kurtosis(yb), "cov": F.covar_pop(x, yb)}
    # the first row of a block gives its shift: one row per block, and no window for the totals
    firsts = materialize(df0.where(own & ((pos - 1) % F.lit(block_rows) == 0)).select(key, "_blk", F.col("v").alias("_k")), "block-firsts")
    blocks = lookup_join(df0.where(own), firsts, [key, "_blk"], "inner").groupBy(key, "_blk").agg(
        *[e.alias(f"_l_{name}") for name, e in stats_of.items()], F.max("_k").alias("_k"),
        F.min("v").alias("mn"), F.max("v").alias("mx"))
    moments = [e.alias(m) for m, e in _moments("_l_").items()]
    totals = blocks.select(key, F.col("_blk").alias("idx"), F.struct(*moments, "mn", "mx", F.col("_k").alias("first")).alias("m"))
    carry = scan_moments(totals, key, max(0, (sizes["longest"] or 0) - 1) // block_rows).select(key, F.col("idx").alias("_blk"), F.col("before").alias("_c"))
    j = rows.join(carry, [key, "_blk"], "inner")
    n = pos.cast("double")
    total = merge_moments({m: F.col(f"_c.{m}") for m in MOMENTS}, _running_moments(pos - start, start))
    j = j.select("*", *[total[m].alias(f"_t_{m}") for m in MOMENTS])
    M2, M3, M4 = F.col("_t_m2"), F.col("_t_m3"), F.col("_t_m4")
    flat = M2 == 0
    g1 = F.when(flat, F.lit(None)).otherwise(F.sqrt(n) * M3 / F.pow(M2, 1.5))
    g2 = F.when(flat, F.lit(None)).otherwise(n * M4 / (M2 * M2) - 3)
    slope = F.col("_t_cxy") / (n * (n * n - 1) / 12.0)
    mn = F.least(F.col("_c.mn"), F.col("_mn"))
    mx = F.greatest(F.col("_c.mx"), F.col("_mx"))
    out = [F.col(key), *[F.col(c) for c in order_cols], pos.alias("n"),
           F.col("_t_mean").alias("mean"),
           F.sqrt(M2 / n).alias("std"), mn.alias("min"), mx.alias("max"), (mx - mn).alias("range"),
           sample_skewness(g1, pos).alias("skewness"), sample_kurtosis(g2, pos).alias("kurtosis")]
    out += [F.col(f"lag_{k}") for k in lags]
    for win in windows:
        out += [F.col(f"rolling_{s}_{win}") for s in ("mean", "std", "max", "min")]
    out += [F.when(pos >= trend_min, slope).alias("trend_slope"),
            F.when(pos > 1, F.col("v") - F.col("lag_1")).alias("last_change"),
            F.when(pos > 1, (F.col("v") - F.when(F.col("_c.n") > 0, F.col("_c.first")).otherwise(F.col("_k"))) / n).alias("change_rate")]
    return j.select(*out)


def history_features_blocked(series: DataFrame, key: str, order_cols: list[str], time_col: str,
                             windows, lags, block_rows: int = BLOCK_ROWS,
                             bucket_unit: str = POSITION_BUCKET, pieces: str = "auto") -> DataFrame:
    """Same output as ``features.history_features`` (series has key, order_cols, v)."""
    from gaugeflow.operators.features import with_rolling
    df = global_positions(series, key, order_cols, time_col, bucket_unit, pieces)
    halo = max(max(windows) - 1, max(lags))
    df = _with_halo(df, block_rows, halo)
    w_blk = Window.partitionBy(key, "_blk").orderBy("pos")
    pos = F.col("pos")
    df = with_rolling(df.select(key, *order_cols, "pos", "v", "_blk", "_halo"), w_blk, windows, pos)
    cols = [F.col(key), *[F.col(c) for c in order_cols], pos, F.col("v").alias("value"),
            *[F.lag("v", k).over(w_blk).alias(f"lag_{k}") for k in lags],
            *[F.col(f"rolling_{stat}_{win}") for win in windows for stat in ("mean", "std", "max", "min")],
            (F.col("v") - F.lag("v", 1).over(w_blk)).alias("last_change")]
    return df.select(*cols, "_halo").where(~F.col("_halo")).drop("_halo")


def max_rows_per_key(series: DataFrame, key: str) -> int:
    """Largest group size (one partial aggregation; answers the size check)."""
    r = series.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
    return int(r or 0)
