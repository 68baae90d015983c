"""Cases in which an operator did less than its whole job (review round 2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import ann, linking, mixing, quality
from gaugeflow.llm.common import workers_find_package


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    workers_find_package(spark)


def test_tiny_source_does_not_end_the_mix(spark, tmp_path):
    rows = [(i, f"t{i}", s) for i, s in enumerate(["a"] * 6000 + ["b"] * 3000 + ["c"] * 10 + [None] * 3)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mix"))
    parts = sorted((tmp_path / "mix").glob("part-*"))
    got = [r for p in parts for r in spark.read.parquet(str(p)).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted([*range(len(rows)), 0])
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.min("pos").alias("pos")).toPandas().set_index("doc_id")["pos"]
    at = [plan[r["doc_id"]] for r in got]
    assert at == sorted(at)
    # a and b keep their weights among themselves after the small sources have run out, until b ends
    share = {r["source"]: r["share"] for r in mixing.shares(docs.groupBy("source").agg(F.count("*").alias("n"))).collect()}
    order = [r["source"] for r in got if r["source"] in ("a", "b")]
    order = order[:len(order) - order[::-1].index("b")] if share["b"] / 3000 > share["a"] / 6001 else order[:len(order) - order[::-1].index("a")]
    ran = np.cumsum(np.array(order) == "b")
    want = share["b"] / (share["a"] + share["b"]) * np.arange(1, len(order) + 1)
    assert np.abs(ran - want).max() < 3 * mixing.BLOCK


def test_the_mix_decides_the_order_of_the_encoded_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "ab"[i % 3 == 0]) for i in range(600)], "doc_id long, text string, source string")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix")).repartition(5, "doc_id")  # as read again: in no order
    corpus_pipeline.encode(spark, mixed, "").write.parquet(str(tmp_path / "ids"))
    got = [r for p in sorted((tmp_path / "ids").glob("part-*")) for r in spark.read.parquet(str(p)).collect()]
    plan = {r["doc_id"]: r["pos"] for r in mixing.mix(docs).collect()}
    assert [r["doc_id"] for r in got] == sorted(plan, key=plan.get) and all(r["mix_place"] == plan[r["doc_id"]] and r["same"] for r in got)
    assert "mix_place" not in corpus_pipeline.encode(spark, docs, "").columns


def test_buckets_whose_head_fits_nobody_stay_open(spark):
    size = {0: 20, 1: 26, 2: 27}  # passage, and two texts around it of which 25 of 28 shingles are common

    def fits(left, right):
        return (left("n") * 100 >= right("n") * 85) & (right("n") * 100 >= left("n") * 85)

    def verify(pairs):
        return pairs.where("a % 10 = 1 AND b % 10 = 2")

    for start, narrow in ((0, None), (10, lambda open_: open_.select("key", "id", "home", "n")), (20, None)):
        rows = [(key, start + i, True, n) for key in (1, 2) for i, n in size.items()]
        members = spark.createDataFrame(rows, "key long, id long, home boolean, n long")
        _, comps = linking.connect(members, verify, fits, narrow)
        assert {tuple(r) for r in comps.collect()} == {(start + 1, start + 1), (start + 2, start + 1)}


def test_word_pairs_at_every_length():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 3000, (1 << 20) + 1000):
        words = draw.choice(["a", "b", "cc", "d", "é"], n).tolist()
        got = quality.stats(" ".join(words) or " ")
        assert got[17] == len(set(zip(words, words[1:]))) / max(1, n)
        assert got[16] == sum(a == b for a, b in zip(words, words[1:])) / max(1, n)
        assert got[13] == len(set(words)) / max(1, n)


def test_queries_with_one_id_are_all_searched(spark):
    schema = "vec_id long, embedding array<double>"
    x = np.random.default_rng(6).normal(size=(120, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)
    asked = [(500, x[3].tolist()), (500, x[70].tolist()), (500, x[3].tolist()), (7, x[7].tolist())]
    got = ann.nearest(vectors, spark.createDataFrame(asked, schema), k=4, block=50, candidates=1.0).collect()
    want = []
    for q, v, own in ((500, x[3], None), (500, x[70], None), (7, x[7], 7)):
        score = x @ v
        best = [int(i) for i in np.argsort(-score) if i != own][:4]
        want += [(q, r + 1, i, round(float(score[i]), 9)) for r, i in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
