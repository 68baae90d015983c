import numpy as np
import pandas as pd

from gaugeflow.operators import iforest as IF


def _matrix(spark, n=2000, d=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, (n, d))
    X[0] = 8.0  # planted outlier
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(d)])
    pdf.insert(0, "id", np.arange(n))
    pdf.insert(0, "sensor_id", "s")
    return spark.createDataFrame(pdf), [f"f{i}" for i in range(d)]


def test_forest_invariants(spark):
    m, names = _matrix(spark)
    model = IF.train(spark, m, names=names, n_trees=50)
    assert model.psi == 256
    assert len(model.nodes) <= 50 * (2 * 256 - 1)
    assert model.nodes["depth"].max() <= 8
    scores = IF.score_samples(spark, IF.apply_scaler(m, model.scaler), model).toPandas()
    assert ((scores.score_samples < 0) & (scores.score_samples > -1)).all()
    assert scores.sort_values("score_samples").iloc[0]["id"] == 0       # planted outlier first
    pred = IF.predict(spark, m, model).toPandas()
    share = pred.is_anomaly.mean()
    assert 0.08 <= share <= 0.12                                         # ~ contamination
    assert pred.confidence.between(0, 1).all()


def test_forest_is_deterministic_and_partition_independent(spark):
    m, names = _matrix(spark, n=800)
    a = IF.train(spark, m, names=names, n_trees=20)
    b = IF.train(spark, m.repartition(7), names=names, n_trees=20)
    pd.testing.assert_frame_equal(a.nodes, b.nodes)
    assert a.offset == b.offset


def test_model_round_trip(spark, tmp_path):
    m, names = _matrix(spark, n=400)
    model = IF.train(spark, m, names=names, n_trees=10, version="v7")
    IF.save(spark, model, str(tmp_path / "forest"))
    back = IF.load(spark, str(tmp_path / "forest"))
    assert back.version == "v7" and back.offset == model.offset and back.names == names
    pd.testing.assert_frame_equal(back.nodes, model.nodes, check_dtype=False)


def test_small_training_set_gates(spark):
    m, names = _matrix(spark, n=40)
    assert IF.train(spark, m, names=names) is None     # needs more than 50 vectors


def test_contamination_parameter_sets_flagged_share(spark):
    m, names = _matrix(spark, n=1500, seed=3)
    model = IF.train(spark, m, names=names, n_trees=40, contamination=0.25)
    share = IF.predict(spark, m, model).toPandas().is_anomaly.mean()
    assert 0.22 <= share <= 0.28


def test_retrain_writes_new_version_and_load_picks_newest(spark, tmp_path):
    m, names = _matrix(spark, n=300)
    root = str(tmp_path / "models")
    IF.save(spark, IF.train(spark, m, names=names, n_trees=5, version="v1"), root)
    IF.save(spark, IF.train(spark, m, names=names, n_trees=7, version="v2"), root)
    assert IF.list_versions(spark, root) == ["v1", "v2"]
    latest = IF.load(spark, root)
    assert latest.version == "v2" and latest.n_trees == 7
    assert IF.load(spark, root, version="v1").n_trees == 5


def test_versions_compare_by_number(spark, tmp_path):
    from gaugeflow.operators import iforest as forest
    for v in ("v1.0", "v9", "v10", "v1.2"):
        (tmp_path / f"version={v}" / "params").mkdir(parents=True)
        (tmp_path / f"version={v}" / "params" / "_SUCCESS").touch()
    (tmp_path / "version=v11" / "nodes").mkdir(parents=True)      # still being written
    assert forest.list_versions(spark, str(tmp_path)) == ["v1.0", "v1.2", "v9", "v10"]


def test_moments_of_short_series(spark):
    from gaugeflow.functions import scalar
    from pyspark.sql import functions as F
    row = spark.range(1).select(scalar.sample_skewness(F.lit(0.5), F.lit(2)).alias("s"),
                                scalar.sample_kurtosis(F.lit(0.5), F.lit(3)).alias("k")).first()
    assert (row["s"], row["k"]) == (0.0, 0.0)


def test_retrain_publishes_the_next_version(spark, tmp_path):
    m, names = _matrix(spark, n=300)
    root = str(tmp_path / "models")
    first = IF.retrain(spark, m, root, names=names, n_trees=5)
    second = IF.retrain(spark, m, root, names=names, n_trees=6)
    assert first["trained"] and second["trained"] and IF.list_versions(spark, root) == [
        first["model_version"], second["model_version"]]
    assert IF.load(spark, root).version == second["model_version"] and IF.load(spark, root).n_trees == 6
    few = IF.retrain(spark, m.limit(3), root, names=names)
    assert few == {"trained": False, "model_version": second["model_version"], "trained_rows": 0, "model_ready": True}
