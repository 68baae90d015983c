"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every whole text becomes ``STATS`` numbers (lengths, shares of character kinds, repetition of
words and lines, line shapes). Standardised over the training rows, they go through ``FEATURES``
random Fourier features, which approximate a Gaussian kernel. Each partition of the training rows
sums its part of the normal equations; the sums are added up by matrix cell, and the ridge
solution is one small solve. Scores of training rows held back from the fit (one in four, by a
hash) calibrate it: pool-adjacent-violators, with linear steps between the pools.

Training reads labels.quality of rows whose crc32(doc_id) mod 5 is not 0, a bounded sample of
``SAMPLE_ROWS`` labelled documents. Null and empty texts have all statistics 0 and are scored
like any other; a very long text is taken whole, its distinct words and word pairs as sorted arrays of hashes. An empty table
gives an empty result. Without labelled rows every score is 0.5. Repeated rows score alike; labels, lang,
source and doc_id are never inputs of a score; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import fold, id_sample, materialize

SAMPLE_ROWS = 30_000
FEATURES, RIDGE, SEED = 300, 1e-3, 7
THRESHOLD = 0.3
PARTS = 8          # partitions of the (bounded) training features
CALIBRATE = 4      # one training row in so many calibrates

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"?-"])


def distinct(codes: np.ndarray) -> int:
    """Number of different values; sorts ``codes`` in place."""
    codes.sort()
    return len(codes[:1]) + int((codes[1:] != codes[:-1]).sum())


def stats(text: str | None) -> list[float]:
    """Statistics of a whole text; every byte, word and line counts.

    Adjacent word pairs are counted exactly at every length, over two whole numbers a word."""
    if not text:
        return [0.0] * STATS
    data = text.encode()
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds: dict[bytes, int] = {}
    at = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))  # word numbers
    same_next = int((at[1:] == at[:-1]).sum())
    ends: dict[bytes, int] = {}
    for w in words:
        e = w[-3:]
        ends[e] = ends.get(e, 0) + 1
    pairs = distinct(at[:-1] * len(kinds) + at[1:])  # two word numbers in one whole number
    top = int(np.bincount(at).max()) if words else 0
    marked = sum(v for k, v in ends.items() if not k[-1:].isalnum() and k[-1] < 128 and k[-1:] not in b".,;:?'\"")
    return [
        np.log1p(size), np.log1p(n), byte[_UPPER].sum() / size, byte[_LOWER].sum() / size, byte[_DIGIT].sum() / size,
        byte[_SPACE].sum() / size, byte[_HIGH].sum() / size, byte[_MARK & ~_STOP].sum() / size, byte[_STOP].sum() / size,
        byte[33] / size, byte[124] / size, float(lengths.mean()), float(lengths.std()), len(kinds) / n,
        len(kinds) / np.sqrt(n), top / n, same_next / n, pairs / n, len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)), marked / n, len(ends) / n, float(byte[byte > 0].size) / 256,
        float(-(byte[byte > 0] / size * np.log(byte[byte > 0] / size)).sum()),
    ]


STATS = 24


def statistics(text: Column) -> Column:
    """``stats`` of a text column as array<double>."""
    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([stats(t) for t in texts], index=texts.index, dtype=object)
    return numbers(text)


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features (with a constant) of standardised statistics, clipped at 6 deviations."""
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    f = np.sqrt(2 / FEATURES) * np.cos(z @ model["omega"] + model["phase"])
    return np.hstack([f, np.ones((len(x), 1))])


def pool(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: mean score and mean label of each pool, both ascending."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # label sum, score sum, rows
    for s, y in zip(score[order], label[order]):
        pools.append([float(y), float(s), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            y1, s1, n1 = pools.pop()
            pools[-1] = [pools[-1][0] + y1, pools[-1][1] + s1, pools[-1][2] + n1]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


def train(features: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """Model from ``features`` (doc_id, stats) and ``labels`` (doc_id, quality), training fold only."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(
        F.col("quality").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = id_sample(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", rows)
    side = (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0).alias("side")
    sample = materialize(features.join(F.broadcast(known), "doc_id").select("doc_id", "stats", "y", side)
                         .repartition(PARTS, "doc_id"), "quality_rows")
    moments = sample.select(F.count("*").alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(STATS)],
                            *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(STATS)]).first()
    if not moments["n"]:
        return None
    draw = np.random.default_rng(SEED)
    model = {"mean": np.array([moments[f"m{i}"] for i in range(STATS)]),
             "scale": np.maximum([moments[f"s{i}"] for i in range(STATS)], 1e-6),
             "omega": draw.normal(0, 1 / np.sqrt(STATS), (STATS, FEATURES)),
             "phase": draw.uniform(0, 2 * np.pi, FEATURES)}
    width = FEATURES + 1

    def normal_equations(batches):
        a, b = np.zeros((width, width)), np.zeros(width)
        for part in batches:
            if len(part):
                f, y = fourier(np.array(part["stats"].tolist(), float), model), part["y"].to_numpy()
                a += f.T @ f
                b += f.T @ y
        cells = np.hstack([a, b[:, None]])
        i, j = np.indices(cells.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": cells.ravel()})

    cells = (sample.where("NOT side").select("stats", "y").mapInPandas(normal_equations, "i int, j int, v double")
             .groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas())  # (FEATURES + 1) x (FEATURES + 2) cells
    sums = np.zeros((width, width + 1))
    sums[cells["i"], cells["j"]] = cells["v"]
    model["weight"] = np.linalg.solve(sums[:, :-1] + RIDGE * max(1.0, sums[-1, width - 1] ** 0.5) * np.eye(width), sums[:, -1])
    held = sample.where("side").select("stats", "y").toPandas()  # at most ``rows`` / CALIBRATE rows
    if not len(held):
        held = sample.select("stats", "y").toPandas()
    raw = fourier(np.array(held["stats"].tolist(), float), model) @ model["weight"]
    model["at"], model["to"] = pool(raw, held["y"].to_numpy())
    return model


def scorer(spark: SparkSession, model: dict | None):
    """A function from a statistics column to a score in 0..1 (higher: better quality)."""
    if model is None:
        return lambda stats: F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        m = shared.value
        raw = fourier(np.array(rows.tolist(), float).reshape(-1, STATS), m) @ m["weight"]
        return pd.Series(np.interp(raw, m["at"], m["to"]), index=rows.index)

    def apply(col: Column) -> Column:
        return score(col)
    return apply
