"""Corpus pipeline: language filter, toxicity filter, near-duplicate removal, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on every row its
predecessor kept, and its decisions take effect: rejected documents are gone from its result, and the
mix stage, which rejects none, gives each document its place in the mix (``mix_place``), in whose order the last stage
encodes and returns them.
All stages but the last return the columns of ``docs`` as they came, whatever other columns there are.
Models are fitted on the labelled tables in ``sf_dir``. Between stages ``run`` writes Parquet to the
shared folder and reads it again.

An empty table passes through as an empty table; null and empty texts have no letter and leave
at the first stage. Extra columns ride along untouched; the last stage returns its own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, lang_id, mixing, ngram_join, toxicity
from gaugeflow.llm.common import materialize, read, small_batches, workers_find_package

LEAST_LANGUAGE_SCORE = 0.5
VOCABULARY = "byte_bpe_50k.json"
PLACE = "mix_place"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language is less than even."""
    small_batches(spark)
    predict = lang_id.predictor(spark, lang_id.train(read(spark, sf_dir, "documents")))
    p = predict(F.col("text"))
    return docs.where((p["lang_pred"] != lang_id.UNDETERMINED) & (p["score"] >= LEAST_LANGUAGE_SCORE))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity machine scores at its threshold or above."""
    small_batches(spark)
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets with a Jaccard similarity of 0.8
    or more: the smallest doc_id (of equal ids one row). Documents without a word are kept."""
    workers_find_package(spark)
    small_batches(spark)
    found = ngram_join.jaccard_components(docs.select("doc_id", "text"), size=5, num=80, den=100)
    alone, linked = found.where("n_shingles = 0"), found.where("n_shingles > 0")
    first = linked.groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("k"))
    keep = first.select("k.doc_id", "k.text_hash").unionByName(alone.select("doc_id", "text_hash")).distinct()
    keep = materialize(keep.select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash")), "keep")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    kept = whole.join(keep, F.col("own_hash").eqNullSafe(F.col("keep_hash")) & F.col("own_id").eqNullSafe(F.col("keep_id")),
                      "left_semi")
    return kept.dropDuplicates(["own_hash", "own_id"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the Pfair mix; all of them stay.

    A source that has run out leaves the schedule: its slots fall away, and the others keep their weights among
    themselves. The result has the place in the mix as ``mix_place`` and is sorted by it, so every part file is a stretch of
    the mix. Copies of one row stand at the place of the first."""
    docs = docs.drop(PLACE)
    plan = mixing.mix(docs.select("doc_id", "text", "source"))
    places = plan.groupBy(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash"),
                          F.col("source").alias("mix_source")).agg(F.min("pos").alias("pos"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"),
                        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("own_hash"))
    same = (F.col("own_hash").eqNullSafe(F.col("mix_hash")) & F.col("own_id").eqNullSafe(F.col("mix_id"))
            & F.col("own_source").eqNullSafe(F.col("mix_source")))
    return whole.join(places, same).orderBy("pos").select("row.*", F.col("pos").alias(PLACE))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (token ids) and same (they decode to the text) of every document; after the mix
    stage also ``mix_place``, and sorted by it: part files read again are not in their order."""
    workers_find_package(spark)
    small_batches(spark)
    mixed = [PLACE] if PLACE in docs.columns else []
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    rows = docs.select("doc_id", *mixed, "text")
    return bpe.encode_rows(rows.orderBy(PLACE) if mixed else rows, vocabulary)


STAGES = [
    ("language ID", identify_language),
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # trained models, byte-pair merges and set joins are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage_" + name.split(" ")[0].lower())
    return docs
