"""Approximate nearest neighbours by collision-counting hashing.

Nearness is the largest inner product. Vectors get one more component, sqrt(M² - |x|²) with M the
largest norm, and queries a 0 there, so that the nearest by distance are the largest by product.
The index is query-aware and distributed: every block of vectors keeps, for each of
``PROJECTIONS`` single random projections, its values sorted. A query opens a window centred on
its own value in every array and counts how often each vector falls into one; virtual rehashing widens
all windows by the factor ``WIDEN`` round after round, adding only what the wider windows gained.
Vectors that collide in at least ``SHARE`` of the projections are verified by the exact double
inner product on the original vectors. A block stops for a query when
12 k rows and ``CANDIDATES`` of its rows have been verified, or all have been; rows are never cut off
within a round.

Each query block meets each vector block once; blocks hold at most about ``BLOCK`` rows, so
no task grows with the table, and what leaves a block is at most k rows per query.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
queries nor as candidates. Queries with the same id and vector are one query; queries with the same id and
different vectors are each searched and each have k rows and ranks of their own. Vectors of different lengths never meet. Equal vectors have equal scores. An empty table gives an empty
result; other columns are ignored. A query's own row (every row with its id) is
no candidate; ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import materialize, valid_vector

PROJECTIONS, SHARE, WIDEN, FIRST, ROUNDS = 80, 0.75, 1.25, 1.0, 24
CANDIDATES, BLOCK, WINDOWS, SEED = 0.1, 16_384, 64, 11


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: float, k: int,
                 candidates: float = CANDIDATES) -> list[tuple[int, int, float]]:
    """(row of the query, vec_id, score) of the k best rows of one block found for each query."""
    n, d = x.shape
    draw = np.random.default_rng(SEED).normal(size=(d + 1, PROJECTIONS))
    draw /= np.linalg.norm(draw, axis=0)
    lift = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))
    values = x @ draw[:d] + lift[:, None] * draw[d]
    order = np.argsort(values, axis=0, kind="stable").T.copy()   # the index: one sorted array per projection
    values = np.take_along_axis(values.T, order, axis=1)
    centre = (q @ draw[:d]).T
    spread = float(values.std()) or 1.0
    need, enough = int(np.ceil(SHARE * PROJECTIONS)), min(n, 12 * k + int(candidates * n))
    rows = []
    for i in range(len(q)):
        if i % WINDOWS == 0:  # window ends of the next queries in all rounds, by binary search
            widths = spread * FIRST * WIDEN ** np.arange(ROUNDS)
            ends = [[np.searchsorted(values[j], (centre[j, i:i + WINDOWS, None] + sign * widths), side)
                     for j in range(PROJECTIONS)] for sign, side in ((-1, "left"), (1, "right"))]
            lows, highs = (np.stack(e, axis=2) for e in ends)
        low = lows[i % WINDOWS].tolist()
        high = highs[i % WINDOWS].tolist()
        count = np.zeros(n, np.int64)
        for r in range(ROUNDS + 1):
            if r == 0:
                reach = [order[j, a:b] for j, (a, b) in enumerate(zip(low[0], high[0]))]
            elif r < ROUNDS:
                reach = [order[j, a:b] for j, (a, b) in enumerate(zip(low[r], low[r - 1]))]
                reach += [order[j, a:b] for j, (a, b) in enumerate(zip(high[r - 1], high[r]))]
            else:  # windows without end
                hit = np.arange(n)
                break
            count += np.bincount(np.concatenate(reach), minlength=n)
            hit = np.flatnonzero(count >= need)
            if len(hit) >= enough:
                break
        score = products(x[hit], q[i])
        own = ids[hit] == query_ids[i]
        hit, score = hit[~own], score[~own]
        best = np.lexsort((ids[hit], -score))[:k] if len(hit) <= 4 * k else _best(ids[hit], score, k)
        rows += [(i, int(ids[hit[r]]), float(score[r])) for r in best]
    return rows


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a vector. Every row is summed by itself, so equal rows have equal products wherever
    they stand (those of a matrix product may differ in the last bit)."""
    return np.einsum("ij,j->i", x, q)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    bar = np.partition(score, len(score) - k)[len(score) - k]
    few = np.flatnonzero(score >= bar)  # with all ties
    return few[np.lexsort((ids[few], -score[few]))[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK,
            candidates: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for every row of
    ``queries`` (both vec_id, embedding)."""
    def usable(df):
        v = F.col("embedding").cast("array<double>")
        return df.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & valid_vector(F.col("v")))

    x = materialize(usable(vectors).withColumn("dim", F.size("v")), "ann_rows")
    asks = usable(queries).withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])
    # number of a query among those of its id
    q = materialize(asks.withColumn("ask", F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))), "ann_queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    size = x.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    asked = q.count()
    blocks, askers = max(1, -(-size["n"] // block)), max(1, -(-asked // block))
    top = size["top"] or 1.0
    place = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    xs = x.withColumn("xb", place(blocks, "x")).withColumn("qb", every(askers))
    qs = q.withColumn("qb", place(askers, "q")).withColumn("xb", every(blocks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            rows = search_block(left["vec_id"].to_numpy(), np.array(left["v"].tolist(), float),
                                right["vec_id"].to_numpy(), np.array(right["v"].tolist(), float), top, k, candidates)
            names = list(zip(right["vec_id"].tolist(), right["ask"].tolist()))
            rows = [(*names[i], vec_id, score) for i, vec_id, score in rows]
        return pd.DataFrame(rows, columns=["query_id", "ask", "vec_id", "score"])

    key = ["dim", "xb", "qb"]
    found = xs.groupBy(*key).cogroup(qs.groupBy(*key)).applyInPandas(
        meet, "query_id long, ask int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
