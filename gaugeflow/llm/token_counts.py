"""Token counts of whole texts by overlap resynchronisation.

Texts up to ``chunk`` characters are encoded whole. A longer text is cut into chunks of that
many characters; every chunk but the first begins ``overlap`` characters early. Each chunk is
encoded on its own, on any executor, and reports the word boundaries inside its two overlaps
with the number of tokens before them. Two neighbours are spliced at the first boundary that
both have.

Why that is exact: splitting into words looks only forward, so from a true word boundary on,
the split depends on nothing but the text after it; and merging never crosses a word. The
left chunk starts at a true boundary (the text's start or the last splice), so its boundaries
are true up to the few characters before its cut end that may look past it (``LOOK``, or the
longest added token). At a boundary common to both, the right chunk is therefore exact as well.
If two neighbours have no common boundary, that text is encoded again with a wider overlap
until they do; an overlap as wide as the chunk encodes the text whole.

Null and empty texts have 0 bytes and 0 tokens. An empty table gives an empty result; other columns are ignored, whatever
their names. Repeated rows are counted row by row: rows are
told apart by a key built here, not by doc_id, which may be null or repeated.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from gaugeflow.llm.bpe import load_vocabulary
from gaugeflow.llm.common import materialize, small_batches

CHUNK = 1 << 15    # characters
OVERLAP = 256      # characters, first attempt
LOOK = 16          # characters before a cut end that are never used for a splice
LIMIT = 1024
FLUSH = 1 << 18    # characters encoded at once
PART = ("n_tokens long, head array<struct<at:long,before:long>>, tail array<struct<at:long,before:long>>")

_loaded: dict[int, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    key = hash(shared.value)
    if key not in _loaded:
        # a task has one core; threads of its own would each keep freed memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = Tokenizer.from_buffer(shared.value)
        tok.no_truncation()
        tok.no_padding()
        tok.post_processor = processors.ByteLevel(trim_offsets=False)  # keeps the space of a word in its offsets
        _loaded.clear()
        _loaded[key] = tok
    return _loaded[key]


def _count(texts: pd.Series, shared) -> pd.Series:
    tok, out, batch, size = _tokenizer(shared), [], [], 0

    def flush():
        out.extend(len(e) for e in tok.encode_batch_fast(batch, add_special_tokens=False))
        batch.clear()

    for t in texts:
        batch.append(t or "")
        size += len(batch[-1])
        if size > FLUSH:  # bounded memory for the encodings
            flush()
            size = 0
    flush()
    return pd.Series(out, index=texts.index, dtype="int64")


def chunk_boundaries(tok: Tokenizer, text: str, start: int, last: bool, overlap: int, look: int = LOOK) -> tuple:
    """Token count of a chunk and its word boundaries (text position, tokens before it) in the
    overlap at its head and in the overlap at its tail."""
    enc = tok.encode(text, add_special_tokens=False)
    words, offsets, n = enc.word_ids, enc.offsets, len(text)
    head, tail, reach = [], [], n - overlap
    for i in range(1, len(words)):
        at = offsets[i][0]
        if at <= overlap or (not last and at >= reach):
            if words[i] != words[i - 1] and offsets[i][0] >= offsets[i - 1][1]:
                if at <= overlap and start > 0:
                    head.append((start + at, i))
                if not last and reach <= at <= n - look:
                    tail.append((start + at, i))
    return len(words), head, tail


def splice(parts: list[tuple[int, list, list]]) -> int | None:
    """Tokens of a text from its chunks in order, or None where two neighbours share no boundary."""
    total, begun = 0, 0
    for (n, _, tail), (_, head, _) in zip(parts, parts[1:]):
        there = dict(head)
        # a boundary before the chunk's own splice point is not proven
        hit = next(((before, there[at]) for at, before in tail if at in there and before >= begun), None)
        if hit is None:
            return None
        total += hit[0] - begun
        begun = hit[1]
    return total + parts[-1][0] - begun


def _long_counts(long: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens or null) of long texts with one overlap width."""
    starts = F.when(F.lit(overlap >= chunk), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("n_chars") - 1, F.lit(chunk)))
    cut = long.select("key", "n_chars", "text", F.posexplode(starts).alias("part", "at"))
    cut = cut.withColumn("last", (F.lit(overlap >= chunk)) | (F.col("at") + chunk >= F.col("n_chars")))
    cut = cut.select("key", "part", "last", F.greatest(F.col("at") - overlap, F.lit(0)).cast("long").alias("start"),
                     F.when(F.lit(overlap >= chunk), F.col("text")).otherwise(
                         F.expr(f"substring(text, greatest(at - {overlap}, 0) + 1, "
                                f"at + {chunk} - greatest(at - {overlap}, 0))")).alias("piece"))
    cut = cut.repartition("key", "part")  # the chunks of one text go to many tasks

    @F.pandas_udf(PART)
    def encode(piece: pd.Series, start: pd.Series, last: pd.Series) -> pd.DataFrame:
        tok = _tokenizer(shared)
        return pd.DataFrame([(n, [{"at": a, "before": b} for a, b in head], [{"at": a, "before": b} for a, b in tail])
                             for n, head, tail in (chunk_boundaries(tok, p, s, x, overlap)
                                                   for p, s, x in zip(piece, start, last))],
                            columns=["n_tokens", "head", "tail"])

    @F.pandas_udf("long")
    def spliced(rows: pd.Series) -> pd.Series:
        pairs = lambda xs: [(x["at"], x["before"]) for x in xs]
        return pd.Series([splice([(r["p"]["n_tokens"], pairs(r["p"]["head"]), pairs(r["p"]["tail"])) for r in rs])
                          for rs in rows], dtype="Int64")

    parts = cut.select("key", "part", encode("piece", "start", "last").alias("p"))
    # a chunk is summed up in a few dozen boundaries: what meets here is a small share of the text
    rows = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "p"))).alias("rows"))
    return rows.select("key", spliced("rows").alias("n_tokens"))


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    small_batches(spark)
    shared = load_vocabulary(spark, path)
    base = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("n_chars", F.char_length("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    count = _counter(shared)
    short = base.where(F.col("n_chars") <= chunk).select("doc_id", n_bytes, count("text").alias("n_tokens"))

    # equal texts have equal counts: rows share the key of their text
    key = F.concat_ws(":", F.sha2("text", 256), F.col("n_chars"))
    long = base.where(F.col("n_chars") > chunk).withColumn("key", key)
    ids = materialize(long.select("doc_id", n_bytes, "key"), "long_ids")
    todo = materialize(long.select("key", "n_chars", "text").dropDuplicates(["key"]), "long_texts")
    done = None
    while True:
        found = materialize(_long_counts(todo, shared, chunk, overlap), "long_counts")
        good = found.where("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        if overlap >= chunk or found.where("n_tokens IS NULL").isEmpty():
            break
        todo = todo.join(found.where("n_tokens IS NULL").select("key"), "key", "left_semi")
        overlap *= 8
    rows = short.unionByName(ids.join(done, "key").select("doc_id", "n_bytes", "n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def _counter(shared):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return _count(texts, shared)
    return count
