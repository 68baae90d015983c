"""Column-expression helpers (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow import fixed


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence(score) -> Column:
    """min(1, max(0, (|s| + 0.5) / 1.5))."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(col_(score)) + F.lit(0.5)) / F.lit(1.5)))


def nan_to_num(c) -> Column:
    """NaN/NULL -> 0.0, +inf -> max double, -inf -> -max double (numpy.nan_to_num)."""
    c = col_(c)
    return (F.when(c.isNull() | F.isnan(c), F.lit(0.0))
            .when(c == F.lit(float("inf")), F.lit(fixed.DOUBLE_MAX))
            .when(c == F.lit(float("-inf")), F.lit(-fixed.DOUBLE_MAX))
            .otherwise(c))


def sample_skewness(g1, n) -> Column:
    """Bias-adjusted skewness G1 from Spark's biased g1; zero variance or too few rows -> 0."""
    n = col_(n).cast("double")
    return F.coalesce(F.try_divide(F.sqrt(n * (n - 1)), n - 2) * col_(g1), F.lit(0.0))


def sample_kurtosis(g2, n) -> Column:
    """Bias-adjusted excess kurtosis G2 from Spark's biased excess g2; zero variance or too few rows -> 0."""
    n = col_(n).cast("double")
    return F.coalesce(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * col_(g2) + 6), F.lit(0.0))


def format_value(value, unit) -> Column:
    """'12.345 PSI': value with 3 decimals and the unit."""
    return F.format_string("%.3f %s", col_(value), col_(unit))


def quality_percent(q) -> Column:
    """Quality as a percentage with one decimal, e.g. '50.0%'."""
    return F.format_string("%.1f%%", col_(q) * 100)


def validity_label(is_valid) -> Column:
    return F.when(col_(is_valid), F.lit("Valid")).otherwise(F.lit("Invalid"))


def was_corrected(cleaned, original) -> Column:
    return ~col_(cleaned).eqNullSafe(col_(original))


def health_label(model_ready: bool) -> Column:
    return F.lit("healthy" if model_ready else "initializing")


def rounded(c, places: int = 6) -> Column:
    return F.round(col_(c), places)


def on_grid(c, places: int = 6) -> Column:
    """The value on a grid of 10^-places (``floor(x * 10^places + 0.501) / 10^places`` below 1e9, else as it is): values
    that differ only by the order of a summation become equal."""
    c, scale = col_(c), float(10 ** places)
    return F.when(F.abs(c) < F.lit(1e9), F.floor(c * F.lit(scale) + F.lit(0.501)) / F.lit(scale)).otherwise(c)
