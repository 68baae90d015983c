"""Isolation Forest on Spark (Liu, Ting & Zhou, ICDM 2008), in SQL expressions only.

Every random choice is a hash (MD5 read as a fraction), so a model depends on its input rows, not on their
partitions, and another engine can redo it.

* Bagging: the trees of a group own equal intervals of one hash per row; a tree's candidates (about 1.5 psi) are the
  rows at the start of its interval, and the psi first of them form its bag (sampling without replacement). From
  about T * 1.5 psi rows on there is one group, so one hash per row. No n x T explosion, no driver-side sampling.
* Growing: a bag is one bounded array; level by level, a node draws one of the features that still
  vary in it and a threshold between that feature's least and largest value by the hash of (seed, tree, node).
  Node 1 is the root, 2k and 2k + 1 are the children of node k.
* Model: a node table of at most T * (2 psi - 1) rows (51,100 for 100 trees of 256), the
  only thing collected: its size is bounded by the parameters, not the data.
* Scoring: a walk of at most log2(psi) array lookups per tree; the node arrays are one literal. Either a fold inside each
  row (no shuffle, also on streams) or, for whole tables, one short-lived row per tree in generated code, summed
  up in the task that made it.
* Resolution: features are kept on a grid of 1e-6 and scores on one of 1e-9, so that values which differ only by the
  order in which some sum was taken neither split a node nor part tied scores.
* Threshold: exact 10th percentile of the training scores (distributed selection).
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import fixed
from gaugeflow.functions.scalar import confidence, on_grid
from gaugeflow.operators.training import apply_scaler, exact_quantiles, fit_scaler
from gaugeflow.session import materialize
from gaugeflow.sources.published import Files

EULER_GAMMA = 0.5772156649015329
CURRENT = "_current.json"
HASH_DIGITS = 13  # hexadecimal digits of a hash that make a fraction: 52 bits, exact in a double

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def average_path_length(n) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class ForestModel:
    names: list[str]
    scaler: dict[str, tuple[float, float]]
    nodes: pd.DataFrame
    psi: int
    n_trees: int
    offset: float = 0.0
    contamination: float = fixed.CONTAMINATION
    version: str = fixed.MODEL_VERSION
    trained_rows: int = 0
    extra: dict = field(default_factory=dict)


def fraction(text: Column, part: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of a text; ``part`` 0 and 1 are independent."""
    digits = F.substring(F.md5(text), 1 + part * HASH_DIGITS, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16 ** HASH_DIGITS))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bag_plan(n_rows: int, n_trees: int, psi: int) -> tuple[int, int, float]:
    """(trees in a group, groups, share of a tree's interval that is needed for about 1.5 psi + 32 candidates)."""
    wanted = 1.5 * psi + 32.0
    group = max(1, min(n_trees, int(n_rows / wanted)))
    return group, -(-n_trees // group), min(1.0, wanted * group / max(n_rows, 1))


def bag_rows(df: DataFrame, key_cols: list[str], n_rows: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """The bags: (tree, and the columns of ``df``), psi rows a tree, drawn by hashes of the key columns.

    The trees of a group share one hash of a row and own an interval of it each, so a row takes one hash per group (one in all
    when there are enough rows for every tree) and is in at most one bag of a group."""
    group, groups, share = bag_plan(n_rows, n_trees, psi)
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]))
    draws = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: _let(
        fraction(F.concat(g.cast("string"), F.lit("/"), F.col("_key"))) * F.lit(float(group)),
        lambda at: F.struct((g * F.lit(group) + F.floor(at).cast("int")).alias("tree"), (at - F.floor(at)).alias("draw"))))
    chosen = F.filter(draws, lambda d: (d["draw"] < F.lit(share)) & (d["tree"] < F.lit(n_trees)))
    rows = df.withColumn("_key", key).select("*", F.inline(chosen))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "_key"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= psi).drop("_rank", "draw", "_key")


def _split(group: Column, tree: Column, depth: int, dims: int, max_depth: int, seed: int) -> Column:
    """(feature, threshold) of a node, null for a leaf. ``group`` is (node, rows)."""
    rows = group["rows"]
    spans = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda f: F.struct(
        f.alias("f"), F.array_min(F.transform(rows, lambda r: r[f])).alias("lo"),
        F.array_max(F.transform(rows, lambda r: r[f])).alias("hi")))
    name = F.concat_ws("/", F.lit(str(seed)), tree.cast("string"), group["node"].cast("string"))

    def draw(vary: Column) -> Column:
        pick = F.floor(fraction(name) * F.size(vary)).cast("int")
        return F.when(F.size(vary) > 0, _let(F.get(vary, pick), lambda s: F.struct(
            s["f"].alias("f"), (s["lo"] + fraction(name, 1) * (s["hi"] - s["lo"])).alias("threshold"))))

    if depth >= max_depth:
        return F.lit(None).cast("struct<f:int,threshold:double>")
    return F.when(F.size(rows) > 1, _let(F.filter(spans, lambda s: s["hi"] > s["lo"]), draw))


def grow_forest(scaled: DataFrame, names: list[str], key_cols: list[str], n_rows: int,
                n_trees: int = fixed.FOREST_TREES, psi: int = fixed.FOREST_SAMPLE,
                seed: int = fixed.FOREST_SEED) -> pd.DataFrame:
    """Grow the forest on the executors and return the (bounded) node table."""
    psi = min(psi, n_rows)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    bags = bag_rows(scaled.select(*key_cols, F.array(*names).alias("x")), key_cols, n_rows, n_trees, psi, seed)
    tree = F.col("tree")
    root = F.struct(F.lit(1).alias("node"), F.collect_list("x").alias("rows"))
    level = bags.select("tree", "x").groupBy("tree").agg(root.alias("root")).select("tree", F.array("root").alias("groups"))
    for depth in range(max_depth + 1):
        cut = F.transform("groups", lambda g: F.struct(
            g["node"].alias("node"), g["rows"].alias("rows"),
            _split(g, tree, depth, len(names), max_depth, seed).alias("s")))
        level = level.withColumn("cut", cut).withColumn(f"nodes{depth}", F.transform("cut", lambda c: F.struct(
            c["node"].alias("node"), c["s"]["f"].alias("feature"), c["s"]["threshold"].alias("threshold"),
            F.size(c["rows"]).alias("size"), F.lit(depth).alias("depth"))))
        level = level.withColumn("groups", F.flatten(F.transform(F.filter("cut", lambda c: c["s"].isNotNull()), lambda c: F.array(
            F.struct((c["node"] * 2).alias("node"), F.filter(c["rows"], lambda r: r[c["s"]["f"]] <= c["s"]["threshold"]).alias("rows")),
            F.struct((c["node"] * 2 + 1).alias("node"), F.filter(c["rows"], lambda r: r[c["s"]["f"]] > c["s"]["threshold"]).alias("rows"))))))
    nodes = level.select("tree", F.inline(F.concat(*[F.col(f"nodes{d}") for d in range(max_depth + 1)])))
    leaf, none = F.col("feature").isNull(), F.lit(-1)
    nodes = nodes.select("tree", "node", F.when(leaf, none).otherwise(F.col("node") * 2).alias("left"),
                         F.when(leaf, none).otherwise(F.col("node") * 2 + 1).alias("right"),
                         F.coalesce("feature", none).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
                         "size", "depth")
    return nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)


def _forest_literal(nodes: pd.DataFrame) -> Column:
    """The trees as one constant: per tree, arrays over its nodes of feature, threshold, left, right and path length.

    A leaf leads back to itself, so a walk of max-depth steps ends in it."""
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        place = {int(n): i for i, n in enumerate(t["node"])}
        leaf = t["feature"].to_numpy() < 0
        path = np.where(leaf, t["depth"] + average_path_length(t["size"]), 0.0)
        trees.append({"f": [max(int(f), 0) for f in t["feature"]], "t": [float(x) for x in t["threshold"]],
                      "l": [place.get(int(c), i) for i, c in enumerate(t["left"])],
                      "r": [place.get(int(c), i) for i, c in enumerate(t["right"])], "p": path.tolist()})
    kind = "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,p:array<double>>>"
    return F.from_json(F.lit(json.dumps(trees)), kind)


def _score(total: Column, model: ForestModel) -> Column:
    cpsi = float(average_path_length(np.array([model.psi]))[0]) or 1.0
    return on_grid(-F.pow(F.lit(2.0), -(total / F.lit(float(model.nodes["tree"].nunique()))) / F.lit(cpsi)), 9)


def _vector(names: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in names])


def score_samples(spark: SparkSession, scaled: DataFrame, model: ForestModel,
                  out_col: str = "score_samples") -> DataFrame:
    """Append -2^(-E[h]/c(psi)) (higher = more normal), E[h] being the mean path length over the trees."""
    steps = F.sequence(F.lit(1), F.lit(max(1, int(model.nodes["depth"].max()))))

    def path(row: Column, tree: Column) -> Column:
        end = F.aggregate(steps, F.lit(0), lambda n, _: F.when(
            row[tree["f"][n]] <= tree["t"][n], tree["l"][n]).otherwise(tree["r"][n]))
        return tree["p"][end]

    total = _let(_vector(model.names),
                 lambda row: F.aggregate(_forest_literal(model.nodes), F.lit(0.0), lambda s, tree: s + path(row, tree)))
    return scaled.withColumn(out_col, _score(total, model))


def score_table(scaled: DataFrame, model: ForestModel, out_col: str = "score_samples") -> DataFrame:
    """The scores of ``score_samples`` alone, one row per row of a table, for many rows.

    Every (row, tree) is a row inside one stage of generated code, which adds up the path lengths of a row before
    anything is shuffled."""
    walk = scaled.select(F.monotonically_increasing_id().alias("rid"), _vector(model.names).alias("x"))
    walk = walk.select("rid", "x", F.inline(_forest_literal(model.nodes)), F.lit(0).alias("n"))
    for _ in range(max(1, int(model.nodes["depth"].max()))):
        go = F.when(F.col("x")[F.col("f")[F.col("n")]] <= F.col("t")[F.col("n")], F.col("l")[F.col("n")]).otherwise(F.col("r")[F.col("n")])
        walk = walk.withColumn("n", go)
    total = walk.groupBy("rid").agg(F.sum(F.col("p")[F.col("n")]).alias("total"))
    return total.select(_score(F.col("total"), model).alias(out_col))


def _gridded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[on_grid(F.col(c).cast("double")).alias(c) if c in names else F.col(c) for c in df.columns])


def train(spark: SparkSession, matrix: DataFrame, names: list[str] | None = None,
          key_cols: tuple[str, ...] = ("sensor_id", "id"), n_trees: int = fixed.FOREST_TREES,
          psi: int = fixed.FOREST_SAMPLE, seed: int = fixed.FOREST_SEED,
          contamination: float = fixed.CONTAMINATION, version: str = fixed.MODEL_VERSION,
          min_vectors: int = fixed.MIN_TRAIN_VECTORS, cut_lineage: bool = True) -> ForestModel | None:
    """Scaler + forest + offset from a training matrix; None with too few vectors.

    The matrix feeds four passes (count, scaler, bagging, training scores), so it is
    materialised once as a Parquet table in the session's shared checkpoint folder.
    """
    names = names or fixed.feature_names()
    matrix = _gridded(matrix.select(*key_cols, *names), names)
    if cut_lineage:
        matrix = materialize(matrix, "forest-train")
    n_rows = matrix.count()
    if n_rows < min_vectors:
        return None
    scaler = fit_scaler(matrix, names)
    scaled = apply_scaler(matrix, scaler)
    nodes = grow_forest(scaled, names, list(key_cols), n_rows, n_trees, psi, seed)
    model = ForestModel(names, scaler, nodes, min(psi, n_rows), n_trees,
                        contamination=contamination, version=version, trained_rows=n_rows)
    scores = score_table(scaled, model)
    model.offset = exact_quantiles(scores, "score_samples", [contamination], n=n_rows)[0]
    return model


def predict(spark: SparkSession, features: DataFrame, model: ForestModel,
            fill_missing: bool = False) -> DataFrame:
    """Score feature rows: anomaly_score (decision function), is_anomaly, confidence.

    Rows lacking any trained feature are not scored unless ``fill_missing`` (then 0.0,
    as in training)."""
    df = features
    if fill_missing:
        df = df.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in model.names else F.col(c)
                         for c in df.columns])
    else:
        cond = F.lit(True)
        for c in model.names:
            cond = cond & F.col(c).isNotNull()
        df = df.where(cond)
    scaled = apply_scaler(_gridded(df, model.names), model.scaler)
    scored = score_samples(spark, scaled, model)
    decision = F.col("score_samples") - F.lit(model.offset)
    return (scored.withColumn("anomaly_score", decision)
            .withColumn("is_anomaly", decision < 0)
            .withColumn("confidence", confidence(decision))
            .withColumn("model_version", F.lit(model.version))
            .drop("score_samples"))


def save(spark: SparkSession, model: ForestModel, path: str) -> None:
    """Persist as two Parquet tables under ``path/version=<v>/`` (nodes, params) and publish the version:
    its record is written once its tables are complete, and the current record moves to the newest published version."""
    root = f"{path.rstrip('/')}/version={model.version}"
    spark.createDataFrame(model.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{root}/nodes")
    params = [(i, c, model.scaler[c][0], model.scaler[c][1]) for i, c in enumerate(model.names)]
    (spark.createDataFrame(params, "idx INT, name STRING, mean DOUBLE, scale DOUBLE")
     .withColumn("psi", F.lit(model.psi)).withColumn("n_trees", F.lit(model.n_trees))
     .withColumn("offset", F.lit(model.offset)).withColumn("contamination", F.lit(model.contamination))
     .withColumn("trained_rows", F.lit(model.trained_rows))
     .write.mode("overwrite").parquet(f"{root}/params"))
    files = Files(spark, path)
    files.write(f"_published/{model.version}.json", {"model_version": model.version, "trained_rows": model.trained_rows})
    newest = None
    while newest != (newest := _published(files)[-1]):  # a newer version published meanwhile comes last
        files.write(CURRENT, files.read(f"_published/{newest}.json"))


def _published(files: Files) -> list[str]:
    return sorted((n.removesuffix(".json") for n in files.names("_published") if n.endswith(".json")), key=version_order)


def current(spark: SparkSession, path: str) -> dict | None:
    """The record of the model being served (model_version, trained_rows); None before the first publication."""
    return Files(spark, path).read(CURRENT)


def load(spark: SparkSession, path: str, version: str | None = None) -> ForestModel:
    """Load a version (default: the current one)."""
    base = path.rstrip("/")
    if version is None:
        record = current(spark, base)
        if record is None:
            raise FileNotFoundError(f"no model published under {path}")
        version = record["model_version"]
    root = f"{base}/version={version}"
    nodes = spark.read.parquet(f"{root}/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    p = spark.read.parquet(f"{root}/params").orderBy("idx").collect()
    names = [r["name"] for r in p]
    scaler = {r["name"]: (r["mean"], r["scale"]) for r in p}
    r0 = p[0]
    return ForestModel(names, scaler, nodes, int(r0["psi"]), int(r0["n_trees"]), offset=float(r0["offset"]),
                       contamination=float(r0["contamination"]), version=version,
                       trained_rows=int(r0["trained_rows"]))


def version_order(version: str) -> list[tuple]:
    """Sorting key: numbers inside a version compare as numbers, so v10 follows v9."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", version)]


def list_versions(spark: SparkSession, path: str) -> list[str]:
    """Complete model versions under ``path`` (any Hadoop-compatible file system), oldest first."""
    files = Files(spark, path)
    # a version counts once its last table is complete, so no reader sees half a model
    found = [n.split("=", 1)[1] for n in files.names() if n.startswith("version=") and files.exists(f"{n}/params/_SUCCESS")]
    return sorted(found, key=version_order)


def next_version(versions: list[str]) -> str:
    """The version after the newest: its leading number plus one ("v1.0" -> "v2.0")."""
    found = re.match(r"\D*(\d+)", versions[-1]) if versions else None
    return f"v{int(found.group(1)) + 1}.0" if found else fixed.MODEL_VERSION


def claim_version(spark: SparkSession, path: str) -> str:
    """The next version that no other training has claimed; of concurrent callers each gets one of its own."""
    files = Files(spark, path)
    while True:
        taken = list_versions(spark, path) + files.names("_claimed")
        version = next_version(sorted(taken, key=version_order))
        if files.claim(f"_claimed/{version}"):
            return version


def retrain(spark: SparkSession, matrix: DataFrame, path: str, **options) -> dict:
    """Train on ``matrix`` and publish the model as the next version under ``path``; readers
    that ``load`` without a version get it from then on. With too few vectors nothing is
    published and the served model stays."""
    model = train(spark, matrix, **options)
    if model is None:
        served = current(spark, path)
        return {"trained": False, "model_version": served and served["model_version"], "trained_rows": 0,
                "model_ready": served is not None}
    model.version = claim_version(spark, path)
    save(spark, model, path)
    return {"trained": True, "model_version": model.version, "trained_rows": model.trained_rows, "model_ready": True}
