"""Language identification: word first, then shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen word is
scored by the mean log frequency of its known character 5-grams (word ends marked), or, if it
has none, of its 4-grams, and so on down to single characters; a word without any known
character says nothing. A document's languages are weighed by the sum over its words, and its
score is the posterior of the best one under equal priors. Ties go to the smaller name.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` documents chosen by a
hash of doc_id, whole texts), so its size does not grow with the corpus. Every word and n-gram of the
sample is kept, as a 64-bit hash in a sorted array beside its row of log frequencies (8 bytes and 4 per language
each); equality of words is equality of these hashes.

Null and empty texts and texts without a letter: ``und``, score 0. No labelled row at all: every
text is ``und``. Rows with a null lang are not learned from; repeated rows count as often as they
occur. Very long texts are scored in pieces of ``PIECE`` words, all of them. Other columns are never
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.common import fold, id_sample, materialize

SAMPLE_ROWS = 10_000
ORDERS = (5, 4, 3, 2, 1)
HASH_SEED = 42    # of Spark's xxhash64
SMOOTH = 0.5
KNOWN = 100_000   # scored words kept per worker
PIECE = 20_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Model from the training fold (crc32(doc_id) mod 5 is not 0) of ``docs`` (doc_id, text, lang)."""
    sample = id_sample(docs.select("doc_id", "text", "lang")
                       .where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 5) != 0)), "doc_id", rows)

    def count_words(batches):
        total: Counter = Counter()
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                total.update((lang, w) for w in words_of(text))
                if len(total) > 500_000:
                    yield _frame(total)
                    total.clear()
        yield _frame(total)

    def count_grams(batches):
        for b in batches:
            total: Counter = Counter()
            for lang, word, n in zip(b["lang"], b["gram"], b["n"]):
                for order in ORDERS:
                    for g in grams_of(word, order):
                        total[lang, order, g] += n
            yield pd.DataFrame([(lang, o, g, n) for (lang, o, g), n in total.items()],
                               columns=["lang", "ord", "gram", "n"])

    counted = sample.select("text", "lang").mapInPandas(count_words, "lang string, gram string, n long")
    words = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang_words")
    grams = (words.mapInPandas(count_grams, "lang string, ord int, gram string, n long")
             .groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")))
    every = words.select("lang", F.lit(0).alias("ord"), "gram", "n").unionByName(grams)
    every = materialize(every, "lang_grams")
    sums = {(r["lang"], r["ord"]): (r["s"], r["c"]) for r in every.groupBy("lang", "ord")
            .agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()}
    langs = sorted({lang for lang, _ in sums})
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) if langs else F.lit(0)
    counts = every.select("ord", (place - 1).cast("int").alias("at"), F.xxhash64("gram").alias("h"), "n")
    arrow = counts.toArrow()  # the grams of the bounded sample
    found = {name: arrow.column(name).to_numpy() for name in arrow.column_names}
    tables = {}
    for o in (0, *ORDERS):
        mine = found["ord"] == o
        keys, spot = np.unique(found["h"][mine], return_inverse=True)
        floor = [np.log(SMOOTH / (s + SMOOTH * c)) for s, c in (sums.get((x, o), (1, 1)) for x in langs)]
        logs = np.tile(np.array(floor, np.float32), (len(keys), 1))
        total = np.array([s + SMOOTH * c for s, c in (sums.get((x, o), (1, 1)) for x in langs)])
        at = found["at"][mine]
        logs[spot, at] = np.log((found["n"][mine] + SMOOTH) / total[at]) if langs else 0
        tables[o] = (keys, logs)
    return {"langs": langs, "tables": tables}


def _frame(total: Counter) -> pd.DataFrame:
    return pd.DataFrame([(lang, w, n) for (lang, w), n in total.items()], columns=["lang", "gram", "n"])


def hash_of(gram: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), HASH_SEED)
    return h - (1 << 64) if h >> 63 else h


def places(keys: np.ndarray, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``grams`` are in a table with sorted ``keys``, and where."""
    if not len(keys):
        return np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
    h = np.fromiter(map(hash_of, grams), np.int64, len(grams))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """Log frequencies (words, languages), with backoff: all words still unseen go down one order together."""
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    keys, rows = model["tables"][0]
    known, at = places(keys, words)
    out[known] = rows[at[known]]
    left = np.flatnonzero(~known)
    for order in ORDERS:
        keys, rows = model["tables"][order]
        grams = [grams_of(words[i], order) for i in left]
        known, at = places(keys, [g for gs in grams for g in gs])
        owner = np.repeat(np.arange(len(left)), [len(gs) for gs in grams])[known]
        n, found = np.bincount(owner, minlength=len(left)), rows[at[known]]
        has = n > 0
        for k in range(out.shape[1]):
            sums = np.bincount(owner, weights=found[:, k], minlength=len(left))
            out[left[has], k] = sums[has] / n[has]
        left = left[~has]
        if not len(left):
            break
    return out


class Scorer:
    """Scores texts in groups of about ``PIECE`` words; rows of up to ``KNOWN`` words are kept."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.rows = np.zeros((KNOWN + 2 * PIECE, max(1, len(self.langs))), np.float32)
        self.at: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.at) >= KNOWN:
            self.at.clear()
        new = list(words.difference(self.at))
        if new:
            start = len(self.at)
            self.rows[start:start + len(new)] = word_scores(self.model, new)
            self.at.update(zip(new, range(start, start + len(new))))

    def sums(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=float)

    def long_sums(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.rows.shape[1])
        for i in range(0, len(words), PIECE):
            self.learn(set(words[i:i + PIECE]))
            total += self.sums(words[i:i + PIECE])
        return total

    def _answer(self, total: np.ndarray) -> tuple[str, float]:
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def predict(self, texts) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        group: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            self.learn(set().union(*(words for _, words in group)))
            for i, words in group:
                out[i] = self._answer(self.sums(words))
            group.clear()

        for text in texts:
            words = words_of(text)
            out.append((UNDETERMINED, 0.0))
            if not self.langs or not (any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)):
                continue
            if len(words) >= PIECE:
                out[-1] = self._answer(self.long_sums(words))
                continue
            group.append((len(out) - 1, words))
            size += len(words)
            if size >= PIECE:
                flush()
                size = 0
        flush()
        return out


def predictor(spark: SparkSession, model: dict):
    """A function from a text column to struct<lang_pred, score>."""
    shared = spark.sparkContext.broadcast(model)
    held: list[Scorer] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Scorer(shared.value))
        return pd.DataFrame(held[0].predict(texts), columns=["lang_pred", "score"])

    def apply(text: Column) -> Column:
        return predict(text)
    return apply
