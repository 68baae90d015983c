"""Memory of a task: what a batch of texts may hold (review round 3)."""

import os

import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from gaugeflow.llm import token_counts
from gaugeflow.llm.common import BATCHES, small_batches, workers_find_package

ROWS, BYTES = (name for name, _, _ in BATCHES)


@pytest.fixture
def usual(spark):
    workers_find_package(spark)
    for name, _, _ in BATCHES:
        spark.conf.unset(name)
    yield spark
    for name, _, _ in BATCHES:
        spark.conf.unset(name)


def batch_sizes(spark, n, chars):
    rows = spark.range(0, n, 1, 1).selectExpr("id", f"repeat('a', {chars}) AS text")
    sizes = rows.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long")
    return [r["n"] for r in sizes.collect()]


def test_batches_are_bounded_by_rows_and_bytes(usual):
    assert max(batch_sizes(usual, 3000, 10)) == 3000
    small_batches(usual)
    assert max(batch_sizes(usual, 3000, 10)) <= 1000
    sizes = batch_sizes(usual, 300, 100_000)
    assert sum(sizes) == 300 and max(sizes) <= 60  # 4 MB and the row that passes it


def test_callers_choice_of_batches_is_kept(usual):
    usual.conf.set(ROWS, "77")
    small_batches(usual)
    assert usual.conf.get(ROWS) == "77" and usual.conf.get(BYTES) == "4194304b"


def test_token_counts_hold_small_batches(usual):
    docs = usual.createDataFrame([(i, "one two " * i) for i in range(9)], "doc_id long, text string")
    got = token_counts.count_tokens(usual, docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert usual.conf.get(ROWS) == "1000"  # before the plan is run
    assert got.count() == 9


def test_every_stage_with_texts_in_python_holds_small_batches(usual, tmp_path):
    sf = str(tmp_path)
    rows = [(i, f"text number {i}", "en", "a") for i in range(20)]
    usual.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    usual.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = usual.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name.startswith("mixing"):  # no Python
            continue
        usual.conf.unset(ROWS)
        stage(usual, docs, sf)
        assert usual.conf.get(ROWS) == "1000", name


def test_encodings_of_a_group_of_texts_are_bounded(monkeypatch):
    sizes = []

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append(sum(map(len, texts)))
            return texts

    monkeypatch.setattr(token_counts, "_tokenizer", lambda shared: Library())
    texts = pd.Series(["a" * 30_000] * 100 + [None, ""])
    assert token_counts._count(texts, None).tolist() == [30_000] * 100 + [0, 0]
    assert sum(sizes) == 3_000_000 and max(sizes) <= (1 << 18) + 30_000


def test_one_thread_encodes_in_a_task(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    monkeypatch.setattr(token_counts, "_loaded", {})
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as fh:
        shared = type("Shared", (), {"value": fh.read()})
    token_counts._tokenizer(shared)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
