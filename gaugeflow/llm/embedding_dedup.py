"""Embedding near-duplicates by lattice hashing on E8.

Unit vectors are projected to 8 dimensions per table by random directions, scaled, and decoded to
the nearest point of the E8 lattice, which is their cell. A vector is at home in its own cell of each of
``TABLES`` tables and probes the ``PROBES`` neighbouring cells that lie nearest to it (out of the
240 shortest lattice steps). Vectors of one label that meet in a cell are verified by cosine in double
precision (``LIMIT`` or more). The buckets are connected without listing all pairs of a bucket
(``linking``; large ones in blocks, of whose links a spanning forest is kept); links are then counted inside each component,
block against block, since two linked vectors are always in the same component.

There is one measure: ``similar``, the inner product of the vectors scaled by their largest component and then to length 1.
It decides links and counts alike, so a pair at the limit is in both or in neither, and no norm overflows.

An empty table gives an empty result; other columns are ignored. Labels never mix; a null label, or a vector that is null, empty, zero or holds null or non-finite
components links with nothing (0 links, a component of its own). Vectors of different lengths never
link. Exact copies are one point of the index, with their number as weight. Repeated vec_ids:
the rows of one id are one node each by content; every row gets a row. A null vec_id takes part, but is never a component's name; if no
row of its component has an id, component_id is null and kept is true.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import materialize, valid_vector
from gaugeflow.llm.linking import connect, spanning

LIMIT, TABLES, PROBES, SCALE, SEED = 0.98, 8, 8, 14.0, 5
BLOCK = 2048
_HALF = [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
_WHOLE = [tuple(s if i == a else t if i == b else 0 for i in range(8))
          for a, b in itertools.combinations(range(8), 2) for s in (-1, 1) for t in (-1, 1)]
STEPS = np.array(_HALF + _WHOLE, float)  # the 240 shortest lattice vectors


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled by their largest component, then to length 1."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    odd = near.sum(axis=1) % 2 != 0
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice points: D8 or D8 shifted by one half, whichever is nearer."""
    whole, half = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def cells(v: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cells of unit vectors: (rows, tables, 1 + probes) integers, the own cell first."""
    n, d = v.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    weights = np.random.default_rng(99).integers(1, 1 << 62, 8) | 1
    for t in range(tables):
        turn = np.random.default_rng([SEED, t, d]).normal(size=(d, 8)) / np.sqrt(d)
        x = (v @ turn) * scale
        own = decode_e8(x)
        rest = x - own
        gap = (STEPS ** 2).sum(axis=1) - 2 * rest @ STEPS.T  # distance to each neighbour, less a constant
        near = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None, :], own[:, None, :] + STEPS[near]], axis=1)
        code = (np.rint(points * 2).astype(np.int64) * weights).sum(axis=2)
        out[:, t] = (code ^ (code >> 29)) * np.int64(0x5851F42D4C957F2D) + t
    return out


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, tables: int = TABLES, probes: int = PROBES,
                    scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    usable = valid_vector(F.col("v")) & F.col("label").isNotNull()
    node = F.xxhash64("label", "v")
    rows = materialize(rows.withColumn("node", F.when(usable, node)), "vec_rows")
    points = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v"))
    points = materialize(points, "vec_points")

    def scaled(batches):
        for b in batches:
            sizes = b["v"].map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                yield pd.DataFrame({"node": b["node"].to_numpy()[at], "v": list(unit(np.array(b["v"].iloc[at].tolist(), float)))})

    vec = materialize(points.select("node", "v").mapInPandas(scaled, "node long, v array<double>"), "vec_units")
    points = points.drop("v")

    def index(batches):
        for b in batches:
            b["dim"] = b["v"].map(len)
            for dim, g in b.groupby("dim"):
                v = np.array(g["v"].tolist(), float)
                c = cells(v, tables, probes, scale)
                per = tables * (1 + probes)
                yield pd.DataFrame({"cell": c.ravel(), "label": np.repeat(g["label"].to_numpy(), per),
                                    "dim": int(dim), "id": np.repeat(g["node"].to_numpy(), per),
                                    "home": np.tile(np.arange(1 + probes) == 0, len(g) * tables)})

    labelled = points.select("node", F.xxhash64("label").alias("label")).join(vec, "node")
    members = labelled.mapInPandas(index, "cell long, label long, dim int, id long, home boolean")
    members = members.select(F.xxhash64("cell", "label", "dim").alias("key"), "id", "home")
    crowded = members.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("some")).where("n > 1 AND some")
    members = materialize(members.join(crowded.select("key"), "key"), "vec_members")
    # the vectors of a task are compared by ``similar``, here pair by pair
    def linked(batches):
        for t in batches:
            same = t["va"].map(len).to_numpy() == t["vb"].map(len).to_numpy()
            t = t[same]
            near = np.zeros(len(t), bool)
            sizes = t["va"].map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x, y = (np.array(t[c].iloc[at].tolist(), float) for c in ("va", "vb"))
                near[at] = np.einsum("ij,ij->i", x, y) >= limit
            yield t.loc[near, ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vec.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(
            vec.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
        return both.mapInPandas(linked, "a long, b long")

    def compare(clusters: DataFrame) -> DataFrame:
        """Links that join what is linked inside clusters, block against block, as a spanning forest."""
        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            la, lb = a["label"].to_numpy(), b["r_label"].to_numpy()
            if len(np.unique(np.concatenate([la, lb]))) < 2:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            i, j = np.nonzero(similar(a["v"], b["r_v"], limit))
            apart = la[i] != lb[j]
            i, j = i[apart], j[apart]
            few = spanning(la[i], lb[j])
            return pd.DataFrame({"a": a["node"].to_numpy()[i[few]], "b": b["r_node"].to_numpy()[j[few]]})

        left, right = _blocks(clusters.join(vec, "node"), ["node", "label", "v"], half=True)
        key = ["comp", "lb", "rb"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    _, comps = connect(members, verify, compare=compare)
    return _count_links(rows, points, vec, comps, limit)


def similar(a, b, limit: float) -> np.ndarray:
    """Which rows of two lists of vectors of length 1 have a cosine of ``limit`` or more.

    Every cosine is one sum over the components in their order, so it does not depend on the other rows."""
    out = np.zeros((len(a), len(b)), bool)
    dims_a, dims_b = (np.array([len(v) for v in side]) for side in (a, b))
    for dim in np.intersect1d(dims_a, dims_b):
        i, j = np.flatnonzero(dims_a == dim), np.flatnonzero(dims_b == dim)
        x, y = (np.array([side[k] for k in at], float) for side, at in ((list(a), i), (list(b), j)))
        dots = x @ y.T
        # a matrix product may sum in another order: within its error of the limit the pair is summed by itself
        close = np.argwhere(np.abs(dots - limit) <= 1e-12 * dim)
        near = dots >= limit
        if len(close):
            near[close[:, 0], close[:, 1]] = np.einsum("ij,ij->i", x[close[:, 0]], y[close[:, 1]]) >= limit
        out[np.ix_(i, j)] = near
    return out


def _blocks(rows: DataFrame, columns: list[str], half: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of each ``comp`` in blocks of about BLOCK, every pair of blocks (lb, rb) once (``half``) or both ways; the right
    side's columns are named r_..."""
    sizes = rows.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "comp").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(placed.select("comp", "blocks", "mine", *columns), "vec_blocks")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("comp", F.col("mine").alias("lb"), every.alias("rb"), *columns)
    right = placed.select(F.col("comp").alias("comp"), every.alias("lb"), F.col("mine").alias("rb"), *[F.col(c).alias(f"r_{c}") for c in columns])
    return tuple(side.where("lb <= rb") if half else side for side in (left, right))


def _count_links(rows: DataFrame, points: DataFrame, vec: DataFrame, comps: DataFrame, limit: float) -> DataFrame:
    """Links of each point inside its component: blocks of at most about BLOCK points, each pair of blocks one task."""
    linked = points.select("node", "copies").join(vec, "node").join(comps, "node")
    left, right = _blocks(linked, ["node", "copies", "v"])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near = similar(a["v"], b["r_v"], limit) & (a["node"].to_numpy()[:, None] != b["r_node"].to_numpy()[None, :])
        return pd.DataFrame({"node": a["node"].to_numpy(), "n": near @ b["r_copies"].to_numpy()})

    # many small components share a group of rows, which is split by component again
    def meet_all(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        right_of = dict(list(b.groupby(["comp", "lb", "rb"])))
        parts = [meet(g, right_of[k]) for k, g in a.groupby(["comp", "lb", "rb"]) if k in right_of]
        return pd.concat(parts) if parts else pd.DataFrame({"node": [], "n": []})

    size = comps.count()
    task = F.pmod(F.xxhash64("comp", "lb", "rb"), F.lit(max(32, size // 512))).cast("int")
    n = (left.withColumn("task", task).groupBy("task").cogroup(right.withColumn("task", task).groupBy("task"))
         .applyInPandas(meet_all, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")))
    names = points.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = names.groupBy("comp").agg(F.min("first").alias("component_id"))
    per = names.join(ids, "comp").join(n, "node", "left").select(
        "node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    out = rows.where("node IS NOT NULL").select("vec_id", "node").join(per, "node").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
