"""Toxicity by a subsequence string kernel support vector machine with Nyström landmarks.

Unit of scoring: a word of a sentence, lower-cased, with everything but letters and digits taken
out (``i.d.i.o.t`` is one word), and runs of single characters joined (``i d i o t``). Words over
``SPAN`` characters are scored in overlapping windows, all of them. Two units are alike by the
gap-weighted subsequence kernel of length 3 (each gap costs ``DECAY``), normalised, so inserted
characters and new endings lower the likeness a little instead of to nothing.

Training (labels.toxic, rows whose crc32(doc_id) mod 3 is not 1, a bounded sample of
``SAMPLE_ROWS`` labelled documents): the unit of a toxic document that speaks most clearly for its
class, by itself or by a part of it (document counts in both classes), is its witness. Units about
as clear as witnesses are positive examples, units of clean documents are negative ones, and the
clean units that a first machine likes most are added before the second fit. Positive units also
occur with one letter inserted. Landmarks
are the most frequent witnesses and a spread of clean units. The machine is linear in the Nyström
features, so it folds into one weight per character triple, and a word is scored from its own
triples alone. A document has the score of its highest unit, mapped to 0..1 by a logistic fit on
the training sample.

Bounds of the fit beside its sample of labelled documents: at most ``SIGNS`` telling units and parts, ``POSITIVES`` and
``NEGATIVES`` example units, ``HARD`` further clean ones and ``LANDMARKS`` landmarks; units over ``SPAN`` characters are not
learned from. All units of all texts are scored.

Null and empty texts have no unit: the lowest score, never toxic. Very long texts are scored whole. An empty table gives an empty
result; other columns are never read, whatever their names. No labelled toxic row: every
score is 0. Repeated rows score alike. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import fold, id_sample, materialize

SAMPLE_ROWS, SIGNS, LIFT, WITNESS = 8_000, 20_000, 20, 0.7
LANDMARKS, POSITIVES, NEGATIVES, HARD = 256, 600, 3_000, 600
DECAY, SPAN, ALPHABET = 0.6, 24, 64
THRESHOLD = 0.7
KNOWN = 150_000       # scored words kept per worker
BATCH_CHARS = 1 << 19
LOWEST = -10.0        # margin of a text without units
_OUT = re.compile(r"[\W_]+")


def units_of(text: str | None) -> list[str]:
    """Raw words of a text and joined runs of at least three single characters."""
    if not text:
        return []
    words = text.lower().split()
    ones = [i for i, w in enumerate(words) if len(w) == 1]
    if len(ones) > 2:
        run = [ones[0]]
        for i in [*ones[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
            else:
                if len(run) > 2:
                    words.append("".join(words[k] for k in run))
                run = [i]
    return words


def clean(word: str) -> str:
    return word if word.isalnum() else _OUT.sub("", word)


def whole_units(text: str | None) -> set[str]:
    return {u for u in map(clean, units_of(text)) if 2 < len(u) <= SPAN}


def inserted(unit: str) -> list[str]:
    """Two variants of a positive unit with one letter put in, so that the machine learns to bear it."""
    h = zlib.crc32(unit.encode())
    spots = (1 + h % (len(unit) - 1), 1 + (h >> 8) % (len(unit) - 1))
    return [unit[:i] + chr(97 + (h >> 16 + k) % 26) + unit[i:] for k, i in enumerate(spots)] if len(unit) < SPAN else []


def gist(text: Column) -> Column:
    """Smallest hash of the text's three-word runs, which copies and most near copies share."""
    @F.pandas_udf("long")
    def smallest(texts: pd.Series) -> pd.Series:
        def least(t):
            w = (t or "").encode().split()
            return min((zlib.crc32(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0)
        return texts.map(least).astype("int64")
    return smallest(text)


def grams(unit: str) -> list[str]:
    """The character 4- and 5-grams of a unit."""
    return [unit[i:i + n] for n in (4, 5) for i in range(len(unit) - n + 1)]


def codes(words: list[str], n: int) -> np.ndarray:
    """Character codes (words, n): a-z by themselves, other characters spread over the rest."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.int64)
    letter = (points >= 97) & (points <= 122)
    return np.where(letter, points - 96, 27 + points % (ALPHABET - 27))


_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Position triples of a word of n characters and their weights DECAY ** span."""
    if n not in _triples:
        at = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
        _triples[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _triples[n]


def keys_of(chars: np.ndarray) -> np.ndarray:
    at, _ = triples(chars.shape[1])
    return (chars[:, at[:, 0]] * ALPHABET + chars[:, at[:, 1]]) * ALPHABET + chars[:, at[:, 2]]


def norms(chars: np.ndarray) -> np.ndarray:
    """sqrt(K(s, s)) of words of one length: matched pairs, extended twice over gaps."""
    n = chars.shape[1]
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    carry = np.where(gap > 0, DECAY ** np.maximum(gap - 1, 0), 0).astype(np.float32)
    out = np.empty(len(chars), np.float32)
    for i in range(0, len(chars), 4096):
        c = chars[i:i + 4096]
        same = (c[:, :, None] == c[:, None, :]) * np.float32(DECAY ** 2)
        s = same
        for _ in range(2):
            s = same * (carry @ s @ carry.T)
        out[i:i + 4096] = np.sqrt(s.sum(axis=(1, 2)))
    return out


def windows(word: str) -> list[str]:
    if len(word) <= SPAN:
        return [word]
    return [word[i:i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def margins(words: list[str], weight: np.ndarray, bias: float) -> dict[str, float]:
    """Decision value of each distinct raw word."""
    by_length: dict[int, dict[str, None]] = {}
    parts = {w: windows(clean(w)) for w in words}
    for ps in parts.values():
        for p in ps:
            if len(p) > 2:
                by_length.setdefault(len(p), {})[p] = None
    value: dict[str, float] = {}
    for n, ps in by_length.items():
        names, weights = list(ps), triples(n)[1]
        step = max(1, 400_000 // len(weights))
        for i in range(0, len(names), step):
            chars = codes(names[i:i + step], n)
            f = (weight[keys_of(chars)] @ weights) / norms(chars) + bias
            value.update(zip(names[i:i + step], f.tolist()))
    return {w: max(value.get(p, bias) for p in ps) for w, ps in parts.items()}


def dense(words: list[str], cols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised triple features of words; columns are the triples in ``cols`` or those that occur."""
    rows = []
    for w in words:
        chars = codes([w], len(w))
        rows.append((keys_of(chars)[0], triples(len(w))[1] / norms(chars)[0]))
    if cols is None:
        cols = np.unique(np.concatenate([k for k, _ in rows]))
    out = np.zeros((len(words), len(cols)), np.float32)
    for i, (k, v) in enumerate(rows):
        spot = np.minimum(np.searchsorted(cols, k), len(cols) - 1)
        hit = cols[spot] == k
        np.add.at(out[i], spot[hit], v[hit])
    return out, cols


def fit_machine(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """Weight of every character triple and the bias of an L2-loss support vector machine."""
    share = LANDMARKS * 5 // 8
    marks = positive[:share] + negative[:LANDMARKS - share]
    basis, cols = dense(marks)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(float))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = positive + negative
    blocks = [dense(words[i:i + 256], cols)[0] @ basis.T for i in range(0, len(words), 256)]
    x = np.hstack([np.vstack(blocks) @ root, np.ones((len(words), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    cost = 10 * len(words) / 2 / np.where(y > 0, len(positive), len(negative))
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):  # Newton steps on the squared hinge
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    weight = np.zeros(ALPHABET ** 3, np.float32)
    weight[cols] = basis.T @ (root @ w[:-1])
    return weight, float(w[-1])


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic map of margins to the label's share (smoothed targets)."""
    up, down = label.sum(), len(label) - label.sum()
    t = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, x.T @ (p - t))
        w -= d * min(1.0, 5 / (np.abs(d).max() + 1e-9))
        if np.abs(d).max() < 1e-7:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """Model from the training fold of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    known = id_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # near copies would make their chance words look telling: they count once
    sample = materialize(sample.withColumn("gist", gist(F.col("text"))).dropDuplicates(["toxic", "gist"]), "toxic_sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return None

    def count_of(signs):
        def count(batches):
            total: Counter = Counter()
            for b in batches:
                for text, toxic in zip(b["text"], b["toxic"]):
                    total.update((u, toxic) for u in signs(text))
                    if len(total) > 500_000:
                        yield pd.DataFrame([(u, t, n) for (u, t), n in total.items()], columns=["sign", "toxic", "n"])
                        total.clear()
            yield pd.DataFrame([(u, t, n) for (u, t), n in total.items()], columns=["sign", "toxic", "n"])

        counts = (sample.select("text", "toxic").mapInPandas(count, "sign string, toxic int, n long")
                  .groupBy("sign").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"),
                                       F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q")))
        return materialize(counts, "toxic_signs")

    share = (F.col("p") + F.col("q") + 1) / (n_pos + n_neg + 2)
    clear = ((F.col("p") + 0.5) / (n_pos + 1) - (F.col("q") + 0.5) / (n_neg + 1)) / F.sqrt(
        share * (1 - share) * (1 / n_pos + 1 / n_neg))
    lift = (F.col("p") + 0.5) / (n_pos + 1) / ((F.col("q") + 0.5) / (n_neg + 1))

    def strongest(counts: DataFrame, least: int) -> dict[str, float]:
        rows = counts.withColumn("z", clear).where((F.col("p") >= least) & (lift >= LIFT))
        return {r["sign"]: r["z"] for r in rows.orderBy(F.desc("z"), "sign").limit(SIGNS).collect()}

    counts = count_of(whole_units)
    words = strongest(counts, 3)
    # parts of units count only where no telling unit explains them
    parts = strongest(
        count_of(lambda text: {g for u in whole_units(text) if u not in words for g in grams(u)}), 3)

    def strength(unit: str) -> float:
        return words.get(unit) or max((parts.get(g, 0.0) for g in grams(unit)), default=0.0)

    def witness(batches):
        for b in batches:
            tops = [max(map(strength, us), default=0.0) for us in map(whole_units, b["text"])]
            yield pd.DataFrame({"z": tops})

    toxic = sample.where("toxic = 1").select("text")
    # a positive unit speaks nearly as clearly as the witness of a hard document
    bar = WITNESS * float(np.quantile(toxic.mapInPandas(witness, "z double").toPandas()["z"], 0.1))

    def telling(batches):
        for b in batches:
            total = Counter(u for us in map(whole_units, b["text"]) for u in us if strength(u) >= max(bar, 1e-9))
            yield pd.DataFrame(list(total.items()), columns=["unit", "n"])

    positive = [r["unit"] for r in toxic.mapInPandas(telling, "unit string, n long").groupBy("unit")
                .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(POSITIVES).collect()]
    negative = [r["unit"] for r in counts.where("p <= q AND q > 0").select(F.col("sign").alias("unit"))
                .orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES).collect()]
    if not positive or not negative:
        return None
    positive += [v for u in positive for v in inserted(u) if v not in set(positive)]
    weight, bias = fit_machine(positive, negative)

    def best(batches):
        for b in batches:
            for text in b["text"]:
                value = margins(list(set(units_of(text))), weight, bias)
                if value:
                    u = max(value, key=lambda k: (value[k], k))
                    yield pd.DataFrame([(clean(u), value[u])], columns=["unit", "f"])

    hard = [r["unit"] for r in sample.where("toxic = 0").select("text").mapInPandas(best, "unit string, f double")
            .where(F.length("unit").between(3, SPAN)).groupBy("unit").agg(F.max("f").alias("f"))
            .orderBy(F.desc("f"), "unit").limit(HARD).collect()]
    mixed = set(positive)
    weight, bias = fit_machine(positive, [u for u in dict.fromkeys(hard + negative) if u not in mixed])
    model = {"weight": weight, "bias": bias, "slope": 1.0, "offset": 0.0}
    spark = docs.sparkSession
    fit = sample.select("toxic", margin_of(spark, model)(F.col("text")).alias("f")).toPandas()  # bounded by ``rows``
    model["slope"], model["offset"] = logistic(fit["f"].to_numpy(), fit["toxic"].to_numpy())
    return model


class _Words(dict):
    def __missing__(self, word):
        return LOWEST


def margin_of(spark: SparkSession, model: dict):
    """A function from a text column to the margin of its highest unit."""
    shared = spark.sparkContext.broadcast((model["weight"], model["bias"]))
    known = _Words()

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        weight, bias = shared.value
        out, group, size = [], [], 0

        def flush():
            if len(known) > KNOWN:
                known.clear()
            new = set().union(*group).difference(known) if group else set()
            known.update(margins(list(new), weight, bias))
            out.extend(max(map(known.__getitem__, g), default=LOWEST) for g in group)
            group.clear()

        for t in texts:
            group.append(units_of(t))
            size += len(t or "")
            if size > BATCH_CHARS:
                flush()
                size = 0
        flush()
        return pd.Series(out, index=texts.index, dtype=float)

    def apply(text: Column) -> Column:
        return margin(text)
    return apply


def scorer(spark: SparkSession, model: dict | None):
    """A function from a text column to its score (0..1)."""
    if model is None:
        return lambda text: F.lit(0.0)
    margin = margin_of(spark, model)
    return lambda text: 1 / (1 + F.exp(-(margin(text) * model["slope"] + model["offset"])))
