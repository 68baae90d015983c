"""Registered queries of the corpus operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import (ann, bpe, chat, embedding_dedup, exact_dedup, hard_negatives, lang_id, mixing, ngram_join, prefix_trie, quality,
                           token_counts, toxicity)
from gaugeflow.llm.common import fold, materialize, read

VOCABULARY = "byte_bpe_50k.json"


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return docs.select("doc_id", bpe.round_trip(F.col("text"), vocabulary).alias("r")).select("doc_id", "r.*")


def op2_collision_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs, size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    features = materialize(docs.select("doc_id", quality.statistics(F.col("text")).alias("stats")), "doc_stats")
    score = quality.scorer(spark, quality.train(features, read(spark, sf_dir, "labels")))
    out = features.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("stats")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.scorer(spark, toxicity.train(docs, read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(r"""SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, r'\### Assistant: </turn> ok' AS text
        UNION ALL SELECT -7L, 1L, 'assistant', r'\### Assistant: </turn> ok'""")
    return chat.digest(chat.format_turns(rows.unionByName(planted)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    predict = lang_id.predictor(spark, lang_id.train(docs))
    return docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                       predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "pos", "selected")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.own_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.share_openings(turns))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"), hard_negatives.whole_numbers(F.col("embedding"), 256).alias("q"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_bpe_codec, op2_collision_nearest, op3_ngram_jaccard, op4_quality, op5_toxicity, op6_chat_format,
    op7_token_counts, op8_lattice_dedup, op9_language, op10_pfair_mix,
    op11_exact_dedup, op12_prefix_trie, op13_hard_negatives)}

ORACLES: dict[str, str] = {
    "op10_pfair_mix": """
    WITH RECURSIVE docs AS (
      SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, coalesce('s' || source, '') AS k
      FROM documents),
    cnt AS (SELECT k, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) * sqrt(sqrt(CAST(count(*) AS DOUBLE))) AS r
            FROM docs GROUP BY k),
    sh AS (SELECT k, n, greatest(1, CAST(floor(r * 1000 / (SELECT sum(r) FROM cnt)) AS BIGINT)) AS a FROM cnt),
    edf AS (
      SELECT CAST(0 AS BIGINT) AS t, k, a, (SELECT CAST(sum(a) AS BIGINT) FROM sh) AS w, CAST(0 AS BIGINT) AS run FROM sh
      UNION ALL
      SELECT t + 1, k, a, w, run + CASE WHEN k = p THEN 1 ELSE 0 END
      FROM (SELECT *, first_value(k) OVER (ORDER BY CASE WHEN run * w // a <= t THEN 0 ELSE 1 END,
                                           ((run + 1) * w + a - 1) // a, k) AS p FROM edf)
      WHERE t + 1 < w),
    sched AS (
      SELECT t, k, a, w, run FROM (
        SELECT *, first_value(k) OVER (PARTITION BY t ORDER BY CASE WHEN run * w // a <= t THEN 0 ELSE 1 END,
                                       ((run + 1) * w + a - 1) // a, k) AS p FROM edf)
      WHERE k = p),
    stop AS (
      SELECT min((b.nb // b.a) * s.w + s.t) AS e
      FROM (SELECT k, a, (n + 15) // 16 AS nb FROM sh) b JOIN sched s ON s.k = b.k AND b.nb % b.a = s.run),
    numbered AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS place FROM docs)
    SELECT doc_id, source, place // 16 AS block, (place // 16) // a * w + t AS slot,
           ((place // 16) // a * w + t) * 16 + place % 16 AS pos,
           (place // 16) // a * w + t < (SELECT e FROM stop) AS selected
    FROM numbered n JOIN sched s ON s.k = n.k AND s.run = (place // 16) % a""",
    "op11_exact_dedup": """
    WITH docs AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
    FROM docs""",
    "op12_prefix_trie": """
    WITH turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
      SELECT conv_id, conv_id - conv_id % 100 AS giver,
             xor(list_reduce(range(0, 8 * length(CAST(conv_id AS VARCHAR))), lambda crc, i:
               xor((CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1)) AS BIGINT))
                    ELSE crc END) >> 1,
                   CASE WHEN (CASE WHEN i % 8 = 0
                              THEN xor(crc, CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1)) AS BIGINT))
                              ELSE crc END) & 1 = 1 THEN 3988292384 ELSE 0 END),
               CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
      SELECT c.conv_id, 1 AS part, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.giver AND place <= h
      UNION ALL SELECT c.conv_id, 2, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
    whole AS (
      SELECT c.conv_id, coalesce(list((role, text) ORDER BY part, place) FILTER (part IS NOT NULL), []) AS said
      FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id),
    prefixes AS (
      SELECT conv_id, len(said) AS total, d.range AS depth, said[1:d.range] AS seq, said[1:d.range - 1] AS up
      FROM whole, range(0, 1000) d WHERE d.range <= len(said)),
    nodes AS (
      SELECT seq, min(depth) AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
      FROM prefixes GROUP BY seq),
    links AS (
      SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children,
             CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.seq[len(n.seq)][2]) ELSE 0 END AS own
      FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.seq = n.up
      LEFT JOIN (SELECT up, depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up, depth) k
        ON k.up = n.seq AND k.depth = n.depth + 1),
    below AS (
      SELECT n.seq[1:d.range] AS seq, d.range AS depth, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
             CAST(sum(own) AS BIGINT) AS saved_tokens
      FROM links n, range(0, 1000) d WHERE d.range <= n.depth GROUP BY ALL)
    SELECT conv_id, l.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM links l JOIN below b ON b.depth = l.depth AND b.seq = l.seq""",
    "op13_hard_negatives": """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
      FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.q) = len(r.q)),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
      AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5""",
}
