"""Hard negatives by angular triangle filtering and integer scores.

Every vector of whole numbers is stored with its norm and its angles to at most ``REFERENCES`` reference directions (chosen
far apart among a bounded sample of ``SAMPLE`` vectors), in the order of label, nearest reference and angle to it. A window
is a run of at most ``WINDOW`` stored vectors of one label. For an anchor, the triangle inequality of angles gives an interval
of the angle to any vector of the window, over all references; its cosines, times the norms, bound the
scores, widened by more than their rounding error. Only windows whose bounds overlap the wanted scores are scored, in whole
numbers: in floating point where every partial sum is below 2^53 and so exact, else with Python's integers.

Anchors are a stated query set against all rows, in blocks: rounds of about ``ROUND`` anchors, the only vectors that leave
the cluster's tables (a few MB a round), go to every task, and the stored vectors are read in place, never copied or
shuffled. A task keeps the best few rows per anchor; the task's own best and those in the sample raise the
score that a window has to reach. The first pass of a round finds the positives, the second one the
negatives between ``low`` and ``high`` percent of each positive's score. What the sample holds affects the speed only.

Vectors of different lengths never meet; an empty one has no partner but empty ones (score 0). Zero vectors score 0. Rows that are null
in vec_id, label or vector take no part, nor do those with a null, NaN or infinite component. Rows of the anchor's own vec_id are
not its partners; other repeated rows count each. Scores have to fit in 64 bits, else the job ends with an error. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import id_sample, materialize

REFERENCES, SAMPLE, WINDOW, ROUND = 16, 4096, 256, 8192
ANGLE_SLACK, SCORE_SLACK, NEVER = 1e-6, 1e-9, np.iinfo(np.int64).min
_STORED = "vec_id long, label long, q array<double>, dim int, norm double, angles array<double>, cell int, near double"
_PAIRS = ("anchor_id long, positive_id long, slot int, negative_id long, positive_score long, negative_score long")


def whole_numbers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component; null for a vector that is null or holds null, NaN or infinite components."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:  # from 2^53 on a double is whole, and ``floor`` may not fit its bigint
        return F.when(F.abs(x * factor) < 2.0 ** 53, F.floor(x * factor).cast("double")).otherwise(x * factor)

    return F.when(v.isNotNull() & ~bad, F.transform(v, whole))


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample that lie far apart: each next one has the smallest largest cosine to those chosen."""
    norm = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = (sample / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, closest = [unit[0]], unit @ unit[0]
    while len(chosen) < count and closest.min() < 1 - 1e-9:
        chosen.append(unit[closest.argmin()])
        closest = np.maximum(closest, unit @ chosen[-1])
    return np.array(chosen)


def angles_to(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(q, axis=1)
    unit = q / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(unit @ refs.T, -1, 1))


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(x)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2.0 ** 53:
        return (a @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    return np.array((big(a) @ big(x).T).tolist(), np.int64)  # OverflowError beyond 64 bits


class Anchors:
    """The anchors of one vector length in a round, as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.id, self.label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.q = np.array(rows["q"].tolist(), float).reshape(len(rows), -1)
        self.norm = rows["norm"].to_numpy()
        self.angles = np.array(rows["angles"].tolist(), float).reshape(len(rows), -1)

    def bounds(self, norm: np.ndarray, angles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score with the rows of each window; (anchors, windows) arrays."""
        low, high = np.minimum.reduceat(norm, starts), np.maximum.reduceat(norm, starts)
        near = np.zeros((len(self.id), len(starts)))
        far = np.full(near.shape, math.pi)
        for j in range(self.angles.shape[1]):
            a = self.angles[:, j, None]
            first, last = np.minimum.reduceat(angles[:, j], starts), np.maximum.reduceat(angles[:, j], starts)
            np.maximum(near, np.maximum(first - a, a - last), out=near)
            np.minimum(far, np.minimum(a + last, 2 * math.pi - a - first), out=far)
        most, least = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(far + ANGLE_SLACK, math.pi))
        slack = SCORE_SLACK * self.norm[:, None] * high + 1
        return (self.norm[:, None] * np.where(least >= 0, low, high) * least - slack,
                self.norm[:, None] * np.where(most >= 0, high, low) * most + slack)


class Best:
    """The ``k`` best (score, then smaller id) of each of ``n`` lists, with the score that a newcomer has to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.size = k, floor.copy(), 0
        self.parts = [(np.zeros(0, np.int64),) * 3]

    def add(self, which: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.parts.append((which, score, row))
        self.size += len(which)
        if self.size > 1_000_000:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which, score, row = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((row, -score, which))
        which, score, row = which[order], score[order], row[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        last = place == self.k - 1
        self.floor[which[last]] = np.maximum(self.floor[which[last]], score[last])
        self.parts, self.size = [(which[place < self.k], score[place < self.k], row[place < self.k])], 0
        return self.parts[0]


def windows_of(label: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows: runs of one label, cut after ``size`` rows."""
    runs = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    ends = np.r_[runs[1:], len(label)]
    return np.concatenate([np.arange(s, e, size) for s, e in zip(runs, ends)])


def _scan(batch: pd.DataFrame, a: Anchors, size: int, wanted, take) -> None:
    """Scores every window of a batch of stored rows that ``wanted(low, high, labels)`` selects, and hands the scores on."""
    label, rows = batch["label"].to_numpy(), batch["vec_id"].to_numpy()
    q = np.array(batch["q"].tolist(), float).reshape(len(batch), -1)
    angles = np.array(batch["angles"].tolist(), float).reshape(len(batch), -1)
    starts = windows_of(label, size)
    low, high = a.bounds(batch["norm"].to_numpy(), angles, starts)
    chosen = wanted(low, high, label[starts])
    for w in np.flatnonzero(chosen.any(axis=0)):
        span = slice(starts[w], starts[w + 1] if w + 1 < len(starts) else len(rows))
        who = np.flatnonzero(chosen[:, w])
        take(who, scores(a.q[who], q[span]), rows[span], a.id[who][:, None] != rows[span][None, :])


class Positives:
    """First pass: best rows of the anchor's own label."""

    def __init__(self, a: Anchors, k: int, floor: np.ndarray):
        self.a, self.best = a, Best(len(a.id), k, floor)

    def wanted(self, low, high, labels):
        return (high >= self.best.floor[:, None]) & (self.a.label[:, None] == labels[None, :])

    def take(self, who, score, rows, other):
        i, j = np.nonzero(other & (score >= self.best.floor[who][:, None]))
        self.best.add(who[i], score[i, j], rows[j])


class Negatives:
    """Second pass: best rows of other labels within the band below each positive."""

    def __init__(self, a: Anchors, positive: np.ndarray, known: np.ndarray, low: int, high: int, k: int, floor: np.ndarray):
        self.a, self.known, self.slots = a, known, positive.shape[1]
        exact = positive.astype(object)  # Python's integers: a score may fill 64 bits
        self.top = np.where(known, _long(exact * high // 100), NEVER)  # 100 s <= high p
        self.bottom = _long(-(-exact * low // 100))  # 100 s >= low p
        self.best = Best(len(a.id) * self.slots, k, floor)

    def wanted(self, low, high, labels):
        hit = np.zeros(low.shape, bool)
        floor = self.best.floor.reshape(-1, self.slots)
        for s in range(self.slots):
            least = np.maximum(self.bottom[:, s], floor[:, s])
            hit |= (self.known[:, s] & (self.bottom[:, s] <= self.top[:, s]))[:, None] & (high >= least[:, None]) & (low <= self.top[:, s, None])
        return hit & (self.a.label[:, None] != labels[None, :])

    def take(self, who, score, rows, other):
        floor = self.best.floor.reshape(-1, self.slots)
        for s in range(self.slots):
            least = np.maximum(self.bottom[who, s], floor[who, s])[:, None]
            i, j = np.nonzero(other & self.known[who, s][:, None] & (score >= least) & (score <= self.top[who, s][:, None]))
            self.best.add(who[i] * self.slots + s, score[i, j], rows[j])


def _long(x: np.ndarray) -> np.ndarray:
    info = np.iinfo(np.int64)
    return np.clip(x, info.min, info.max).astype(np.int64)


def _no_floor(n: int) -> np.ndarray:
    return np.full(n, NEVER, np.int64)


def store(rows: DataFrame, references: int = REFERENCES, sample: int = SAMPLE) -> tuple[DataFrame, pd.DataFrame]:
    """The stored table of angles, and the bounded sample that the reference directions come from."""
    picked = id_sample(rows, "vec_id", sample).limit(2 * sample).toPandas().sort_values("vec_id", kind="stable")
    refs = {int(d): directions(np.array(g["q"].tolist(), float).reshape(len(g), -1), references)
            for d, g in picked.groupby(picked["q"].map(len))}

    def angles(batches):
        for b in batches:
            for dim, g in b.groupby(b["q"].map(len)):
                q = np.array(g["q"].tolist(), float).reshape(len(g), -1)
                known = refs.get(int(dim), np.zeros((0, dim)))
                norm, to = angles_to(q, known)
                cell = to.argmin(axis=1) if to.shape[1] else np.zeros(len(g), int)
                near = to.min(axis=1) if to.shape[1] else np.zeros(len(g))
                yield pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "q": g["q"], "dim": int(dim), "norm": norm,
                                    "angles": list(to), "cell": cell, "near": near})

    order = ["dim", "label", "cell", "near", "vec_id"]  # the id cuts runs of equal vectors
    stored = rows.mapInPandas(angles, _STORED).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(stored, "mine_stored")
    known = stored.join(F.broadcast(rows.sparkSession.createDataFrame(  # a bounded sample
        [(int(i),) for i in picked["vec_id"].unique()], "vec_id long")), "vec_id", "left_semi")
    return stored, known.limit(2 * sample).toPandas()


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         references: int = REFERENCES, sample: int = SAMPLE, window: int = WINDOW, round_size: int = ROUND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are vec_id, label and q (array<double> of whole numbers), none of them null; ``is_anchor`` selects the anchors. For each
    anchor and each of its ``positives`` best rows of the same label: the best ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = rows.sparkSession
    rows = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                   F.col("q").cast("array<double>").alias("q")), "mine_rows")
    stored, sampled = store(rows, references, sample)
    anchors = materialize(stored.where(is_anchor), "mine_anchors")
    rounds = math.ceil(anchors.count() / round_size)
    found = []
    for r in range(rounds):
        mine_now = F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r
        group = anchors.where(mine_now).toPandas().sort_values(["dim", "label", "cell", "near", "vec_id"], kind="stable")
        if len(group):
            found.append(materialize(_mine_round(stored, sampled, group, positives, negatives, low, high, window), "mine_round"))
    if not found:
        return spark.createDataFrame([], _PAIRS.replace("slot", "rank"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _mine_round(stored: DataFrame, sampled: pd.DataFrame, group: pd.DataFrame, positives: int, negatives: int, low: int,
                high: int, window: int) -> DataFrame:
    sets = {int(d): Anchors(g) for d, g in group.groupby("dim")}
    samples = {int(d): g.sort_values(["label", "cell", "near"], kind="stable") for d, g in sampled.groupby("dim")}

    def first_pass(floors: dict) -> dict:
        return {d: Positives(a, positives, floors.get(d, _no_floor(len(a.id)))) for d, a in sets.items()}

    def run(job: dict, dim: int, part: pd.DataFrame) -> None:
        if dim in job:
            _scan(part, job[dim].a, window, job[dim].wanted, job[dim].take)
            job[dim].best.trim()

    def floors_of(job: dict) -> dict:
        """What the sample alone guarantees."""
        for d, part in samples.items():
            run(job, d, part)
        return {d: j.best.floor for d, j in job.items()}

    floors = floors_of(first_pass({}))

    def find_positives(batches):
        job = first_pass(floors)
        for b in batches:
            for dim, part in b.groupby("dim", sort=False):
                run(job, int(dim), part)
        for d, j in job.items():
            which, score, row = j.best.trim()
            yield pd.DataFrame({"dim": d, "anchor": which, "score": score, "row": row})

    best = Window.partitionBy("dim", "anchor").orderBy(F.col("score").desc(), "row")
    got = stored.mapInPandas(find_positives, "dim int, anchor int, score long, row long")
    # at most ``positives`` rows an anchor of this round
    got = got.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= positives).toPandas()
    tables = {}
    for d, a in sets.items():
        mine_rows = got[got["dim"] == d]
        at = (mine_rows["anchor"].to_numpy(), mine_rows["slot"].to_numpy() - 1)
        score, row, known = np.zeros((len(a.id), positives), np.int64), np.zeros((len(a.id), positives), np.int64), np.zeros((len(a.id), positives), bool)
        score[at], row[at], known[at] = mine_rows["score"].to_numpy(), mine_rows["row"].to_numpy(), True
        tables[d] = (score, row, known)

    def second_pass(floors: dict) -> dict:
        return {d: Negatives(a, tables[d][0], tables[d][2], low, high, negatives, floors.get(d, _no_floor(len(a.id) * positives)))
                for d, a in sets.items()}

    bands = floors_of(second_pass({}))

    def find_negatives(batches):
        job = second_pass(bands)
        for b in batches:
            for dim, part in b.groupby("dim", sort=False):
                run(job, int(dim), part)
        for d, j in job.items():
            which, score, row = j.best.trim()
            anchor, slot = which // positives, which % positives
            yield pd.DataFrame({"anchor_id": sets[d].id[anchor], "positive_id": tables[d][1][anchor, slot], "which": which, "dim": d,
                                "negative_id": row, "positive_score": tables[d][0][anchor, slot], "negative_score": score})

    pairs = stored.mapInPandas(find_negatives, "anchor_id long, positive_id long, which int, dim int, negative_id long, "
                                               "positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("dim", "which").orderBy(F.col("negative_score").desc(), "negative_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
