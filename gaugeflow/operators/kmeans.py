"""K-means detector on sliding-window features (MLlib pipeline).

Assembler + StandardScaler + KMeans(k=3) are fitted on the feature table; the "normal"
cluster is the largest one in training (a cluster id by itself carries no meaning), and
the anomaly score is the Euclidean distance to the assigned centre in scaled space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed


MAX_CENTERS = 10_000  # centres become plan literals: a proven bound on what is shipped


@dataclass
class ClusterModel:
    pipeline: PipelineModel
    columns: list[str]
    normal_cluster: int
    centers: list[list[float]]


def prepare(features: DataFrame, columns: list[str] = fixed.KMEANS_COLUMNS,
            fill_null_std: bool = True) -> DataFrame:
    """One-row windows have a NULL sample std; it becomes 0 so assembling never fails."""
    out = features
    for c in columns:
        if fill_null_std and c.startswith("std"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


def fit(features: DataFrame, columns: list[str] = fixed.KMEANS_COLUMNS, k: int = fixed.KMEANS_K,
        seed: int = fixed.FOREST_SEED, handle_invalid: str = "error",
        materialize_input: bool = True) -> ClusterModel:
    """Fit on the feature table. K-means makes ~20 passes over its input, so the (pruned)
    input is first written once as a Parquet table in the shared checkpoint folder and
    cached: iterations re-read compact columns instead of recomputing the window plan."""
    df = prepare(features, columns).select(*columns)
    if materialize_input:
        from gaugeflow.session import materialize
        df = materialize(df, "kmeans-train").persist()
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="features", handleInvalid=handle_invalid),
        StandardScaler(inputCol="features", outputCol="scaled_features"),
        KMeans(featuresCol="scaled_features", k=k, predictionCol="cluster", seed=seed),
    ])
    model = pipe.fit(df)
    if materialize_input:
        df.unpersist()
    summary = model.stages[-1].summary
    sizes = summary.clusterSizes  # computed during fit, k numbers
    normal = max(range(len(sizes)), key=lambda i: (sizes[i], -i))
    centers = [list(map(float, c)) for c in model.stages[-1].clusterCenters()]
    return ClusterModel(model, list(columns), normal, centers)


def distance_to_center(vec: Column, cluster: Column, centers: list[list[float]]) -> Column:
    """Euclidean distance of an array column to the centre selected by ``cluster``.

    The k centres (k x d numbers, bounded by the model) are literals in the plan."""
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])[cluster]
    sq = F.zip_with(vec, centre, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def predict(features: DataFrame, model: ClusterModel, detection_ts: Column | None = None) -> DataFrame:
    """cluster, is_anomaly (cluster != normal), anomaly_score (distance), detection time.
    Works on batch and streaming DataFrames alike."""
    pred = model.pipeline.transform(prepare(features, model.columns))
    arr = vector_to_array(F.col("scaled_features"))
    return (pred.withColumn("is_anomaly", F.col("cluster") != F.lit(model.normal_cluster))
            .withColumn("anomaly_score", distance_to_center(arr, F.col("cluster"), model.centers))
            .withColumn("detection_timestamp",
                        detection_ts if detection_ts is not None else F.current_timestamp()))


def nearest_center(df: DataFrame, columns: list[str], centers: DataFrame, label_col: str) -> DataFrame:
    """Assign each row to its nearest centre of a small, size-bounded centre table
    (label + the same columns) and return the distance. Centres are collected (k rows) and
    become literals; ties go to the first label in sorted order."""
    rows = centers.orderBy(label_col).limit(MAX_CENTERS + 1).collect()
    if len(rows) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centres; use a model, not literals")
    labels = [r[label_col] for r in rows]
    vecs = [[float(r[c]) for c in columns] for r in rows]
    x = F.array(*[F.col(c).cast("double") for c in columns])
    dists = [distance_to_center(x, F.lit(i), vecs) for i in range(len(vecs))]
    best = F.least(*dists) if len(dists) > 1 else dists[0]
    label = F.lit(None).cast("string")
    for i in reversed(range(len(vecs))):
        label = F.when(dists[i] == best, F.lit(labels[i])).otherwise(label)
    return df.withColumn("nearest", label).withColumn("distance", best)
