import numpy as np
import pytest

from gaugeflow.operators import training as TR


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.95, 1.0])
def test_exact_quantile_selection_path_matches_numpy(spark, monkeypatch, q):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, 3000), np.full(500, 0.25)]   # ties around the middle
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    monkeypatch.setattr(TR, "EXACT_DIRECT_LIMIT", 10)          # force the distributed selection
    monkeypatch.setattr(TR, "APPROX_ACCURACY", 100)            # coarse brackets, exercises widening
    got = TR.exact_quantiles(df, "x", [q])[0]
    assert got == pytest.approx(float(np.quantile(x, q)), rel=0, abs=1e-12)


def test_exact_quantile_direct_path(spark):
    x = [3.0, 1.0, 2.0, 10.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "x DOUBLE")
    assert TR.exact_quantiles(df, "x", [0.1, 0.5]) == pytest.approx(
        [float(np.quantile([1, 2, 3, 10], 0.1)), 2.5])


def test_scaler_zero_std_becomes_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    sc = TR.fit_scaler(df, ["a", "b"])
    assert sc == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    out = TR.apply_scaler(df, sc).collect()
    assert [(r.a, r.b) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.99])
def test_exact_quantile_of_few_distinct_values(spark, monkeypatch, q):
    x = np.repeat([1.0, 2.0, 3.0, 4.0, 5.0], [700, 11, 900, 3, 400])
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    monkeypatch.setattr(TR, "EXACT_DIRECT_LIMIT", 10)
    assert TR.exact_quantiles(df, "x", [q])[0] == float(np.quantile(x, q))
