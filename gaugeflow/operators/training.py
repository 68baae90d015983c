"""Training matrix, standardisation and the exact contamination threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import fixed
from gaugeflow.functions.scalar import nan_to_num
from gaugeflow.operators.features import expanding_features

# Up to this many rows the exact percentile aggregate runs directly (one buffer).
EXACT_DIRECT_LIMIT = 2_000_000
APPROX_ACCURACY = 1_000_000


def training_matrix(silver: DataFrame, names: list[str] | None = None, **kw) -> DataFrame:
    """Expanding-prefix feature vectors (invalid rows kept), missing -> 0.0, nan_to_num,
    columns in the sorted feature layout. Keeps sensor_id, event_timestamp, id, n."""
    names = names or fixed.feature_names()
    wide = expanding_features(silver, **kw)
    keep = [c for c in wide.columns if c not in names]
    return wide.select(*keep, *[nan_to_num(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names])


def fit_scaler(matrix: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Per-column mean and population std (zero std -> 1): one aggregate, 2 values per column."""
    aggs = []
    for c in names:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = matrix.agg(*aggs).first()
    out = {}
    for c in names:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (float(m or 0.0), float(s) if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    cols = [((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) if c in scaler else F.col(c)
            for c, (m, s) in ((c, scaler.get(c, (0.0, 1.0))) for c in df.columns)]
    return df.select(*cols)


def standardize_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / std_pop with std 0 -> 1, as window-free column arithmetic."""
    return apply_scaler(df, fit_scaler(df, names))


def exact_quantiles(df: DataFrame, col: str, qs: list[float], n: int | None = None) -> list[float | None]:
    """Exact quantiles with linear interpolation (numpy 'linear', SQL percentile_cont).

    Small inputs: Spark's exact ``percentile``. Large inputs: a distributed selection —
    ``percentile_approx`` brackets all target ranks in one pass, one count fixes their offsets, and
    the order statistics are found in the brackets by running counts over distinct values, in one pass
    for all of them. No step holds the whole column, or all rows of a tie, in one task or on the driver.
    """
    x = F.col(col)
    base = df.select(x.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if n is None or n > EXACT_DIRECT_LIMIT:
        # Several passes follow (count, or bracket + counts + bracket sort): write the one
        # column once (shared folder) instead of recomputing the upstream plan per pass.
        from gaugeflow.session import materialize
        base = materialize(base, "quantile-input")
    if n is None:
        n = base.count()  # callers that know the (non-NULL) row count skip this pass
    if n == 0:
        return [None for _ in qs]
    if n <= EXACT_DIRECT_LIMIT:
        row = base.agg(F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")).first()
        return [float(v) for v in row["p"]]
    # (rank of the lower order statistic, weight of the next one) per quantile
    wanted = [(int(q * (n - 1)), q * (n - 1) - int(q * (n - 1))) for q in qs]
    width = [4.0 / APPROX_ACCURACY] * len(qs)
    while True:  # one pass for all brackets, one for their counts
        ends = [(max(0.0, q - w), min(1.0, q + w)) for q, w in zip(qs, width)]
        found = base.agg(F.percentile_approx("x", F.array(*[F.lit(e) for pair in ends for e in pair]), APPROX_ACCURACY).alias("b")).first()["b"]
        brackets = list(zip(found[::2], found[1::2]))
        stats = base.agg(*[c for i, (lo, hi) in enumerate(brackets) for c in (
            F.count_if(F.col("x") < lo).alias(f"below{i}"),
            F.count_if((F.col("x") >= lo) & (F.col("x") <= hi)).alias(f"inside{i}"))]).first()
        # both order statistics must lie in the bracket
        missed = [i for i, (rank, _) in enumerate(wanted) if ends[i] != (0.0, 1.0) and not (
            stats[f"below{i}"] <= rank and min(rank + 1, n - 1) < stats[f"below{i}"] + stats[f"inside{i}"])]
        if not missed:
            break
        for i in missed:
            width[i] *= 4
    # rows of all brackets, each tagged with those it lies in; a bracket of one value needs none
    open_ = [i for i, (lo, hi) in enumerate(brackets) if lo != hi]
    values = {}
    if open_:
        tags = F.array_compact(F.array(*[F.when((F.col("x") >= brackets[i][0]) & (F.col("x") <= brackets[i][1]), F.lit(i)) for i in open_]))
        tagged = base.select("x", F.explode(tags).alias("b"))
        first = {i: wanted[i][0] - stats[f"below{i}"] for i in open_}
        ranks = [(i, r) for i in open_ for r in (first[i], min(first[i] + 1, stats[f"inside{i}"] - 1))]
        values = dict(zip(ranks, values_at_ranks(tagged, ranks)))
    out = []
    for i, (_, share) in enumerate(wanted):
        if i not in open_:
            out.append(float(brackets[i][0]))
            continue
        lower, upper = (values[(i, r)] for r in (first[i], min(first[i] + 1, stats[f"inside{i}"] - 1)))
        out.append(lower + share * (upper - lower))
    return out


def _running_counts(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``counts`` (keys, x, c) with ``upto``: the rows of a key whose value is at most x.

    The distinct values are cut into ranges over (keys, x); counts run inside a range, on top of the sums of the
    key's earlier ranges, so no key meets in one task."""
    from gaugeflow.session import materialize
    counts = materialize(counts.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), name)
    # one row per key and range (shuffle partition)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(*keys, "part").agg(F.sum("c").alias("s")).select(
        *keys, "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    running = F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("run", running).join(starts, [*keys, "part"]).select(
        *keys, "x", "c", (F.col("start") + F.col("run")).alias("upto"))


def values_at_ranks(rows: DataFrame, ranks: list[tuple[int, int]]) -> list[float]:
    """Values of ``rows`` (b, x) at the given (b, 0-based rank) of each b's ascending order, in one pass for all.

    Ties are folded to (value, count) first, so neither a long tie nor a whole bracket meets in one task."""
    counts = rows.groupBy("b", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = _running_counts(counts, ["b"], "quantile-values")
    row = upto.agg(*[F.min(F.when((F.col("b") == b) & (F.col("upto") > r), F.col("x"))).alias(f"r{i}")
                     for i, (b, r) in enumerate(ranks)]).first()
    return [float(v) for v in row]


def exact_quantiles_by(df: DataFrame, keys: list[str], col: str, qs: list[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``col`` per key: keys, n, q0, q1, ... in the order of ``qs``.

    Rows without a value (NULL or NaN) do not count; a key without values has no row; rows with a NULL key form a key. All quantiles
    of all keys come from one fold to (key, value, count) and one running count, however large a key is."""
    from gaugeflow.session import materialize
    x = F.col(col).cast("double")
    named = [F.struct(F.col(k).alias("k")).alias(f"_k{i}") for i, k in enumerate(keys)]  # structs: a NULL key joins too
    tags = [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*named, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*tags, "x").agg(
        F.count(F.lit(1)).alias("c"))
    upto = materialize(_running_counts(counts, tags, "quantile-key-values"), "quantile-key-counts")
    sizes = upto.groupBy(*tags).agg(F.max("upto").alias("n"))
    ranked = upto.join(sizes, tags)
    at = [F.lit(q) * (F.col("n") - 1) for q in qs]
    picks = []
    for i, h in enumerate(at):
        picks += [F.min(F.when(F.col("upto") > F.floor(h), F.col("x"))).alias(f"lo{i}"),
                  F.min(F.when(F.col("upto") > F.least(F.floor(h) + 1, F.col("n") - 1), F.col("x"))).alias(f"hi{i}")]
    found = ranked.groupBy(*tags, "n").agg(*picks)
    return found.select(*[F.col(f"_k{i}.k").alias(k) for i, k in enumerate(keys)], "n", *[
        (F.col(f"lo{i}") + (h - F.floor(h)) * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(f"q{i}") for i, h in enumerate(at)])
