"""Corpus operators against libraries, brute force, round trips and held-out labels, with odd rows."""

import hashlib
import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeflow.llm import ann, bpe, chat, embedding_dedup, lang_id, mixing, ngram_join, quality, queries, token_counts, toxicity
from gaugeflow.llm.common import read, workers_find_package

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_tokens int, id string"
LONG = "word " * 30_000 + "x" * 70_000 + "  \n\t" * 300 + "<|endoftext|>" + "'ll été " * 9_000
TEXTS = ["The idiot of it.", "", None, " ", "a b", "a b", "<|endoftext|> é漢 'll\n\n  x", LONG, "123 !!", "A B"]


@pytest.fixture(scope="module")
def odd(spark):
    workers_find_package(spark)
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "a b", None, None, None, None)], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    workers_find_package(spark)
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def test_bpe_equals_library(spark, odd, none, library):
    vocabulary = bpe.load_vocabulary(spark, VOCAB)
    got = odd.select("text", bpe.round_trip(F.col("text"), vocabulary).alias("r"),
                     bpe.encode(F.col("text"), vocabulary).alias("ids")).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["r"]["n_tokens"] == len(ids) and r["r"]["same"]
        assert r["r"]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["r"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert none.select(bpe.round_trip(F.col("text"), vocabulary)).count() == 0


def test_token_counts_equal_library(spark, odd, none, library):
    want = {t or "": len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS}
    for chunk, overlap in ((1 << 15, 256), (1000, 64)):
        got = token_counts.count_tokens(spark, odd, VOCAB, chunk=chunk, overlap=overlap).collect()
        assert sorted(r["n_tokens"] for r in got) == sorted([*want.values(), want[TEXTS[0]], want["a b"], want[""], want["a b"]])
        assert {r["doc_id"]: r["n_bytes"] for r in got}[7] == len(LONG.encode())
    assert token_counts.count_tokens(spark, none, VOCAB).count() == 0


def test_nearest_against_brute_force(spark):
    draw = np.random.default_rng(3).normal(size=(400, 16))
    rows = [(i, [float(x) for x in v], "e") for i, v in enumerate(draw)]
    rows += [(900, None, ""), (901, [0.0] * 16, ""), (902, [math.nan] * 16, ""), (903, [None] * 16, ""), (904, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, block=150).toPandas()
    x, hits = draw.astype(np.float32).astype(float), 0
    assert len(got) == 20 * 5 and set(got["rank"]) == {1, 2, 3, 4, 5}
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert np.allclose(g.sort_values("rank")["score"], s[g.sort_values("rank")["vec_id"]], atol=1e-12)
        hits += len(set(np.argsort(-s)[:5]) & set(g["vec_id"]))
    assert hits >= 0.9 * 100
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            comp = [comp[i] if c == comp[j] else c for c in comp] if comp[i] < comp[j] else [comp[j] if c == comp[i] else c for c in comp]
    return [len(s) for s in sets], comp


def test_ngram_join_against_brute_force(spark, odd, none):
    docs = read(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").toPandas()
    base = "one two three four five six seven eight nine ten".split() * 6
    for k in range(40):  # a group of near copies, some linked and some not
        copy = [f"{w}{i % 17}" for i, w in enumerate(base)]
        for e in range(k % 6):
            copy[(7 * k + 11 * e) % len(copy)] = f"edit{k}_{e}"
        docs.loc[len(docs)] = (10_000 + k, " ".join(copy))
    n, comp = brute_components(docs["text"], 4, 85, 100)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs)).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    assert got["n_shingles"].tolist() == n
    assert got["component_id"].tolist() == [docs["doc_id"][c] for c in comp]
    odd_rows = ngram_join.jaccard_components(odd).collect()
    by = defaultdict(set)
    for r in odd_rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert len(odd_rows) == len(TEXTS) + 2 and by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[4] == by[5] == by[9] == by[None] == {(1, 4)}
    assert ngram_join.jaccard_components(none).count() == 0


def test_block_links_against_sets():
    draw = np.random.default_rng(1)
    left = [np.unique(draw.integers(0, 40, 30)) for _ in range(25)]
    i, j = ngram_join.block_links(left, left[::-1], 6, 10)
    want = {(a, b) for a in range(25) for b in range(25)
            if 10 * len(set(left[a]) & set(left[24 - b])) >= 6 * len(set(left[a]) | set(left[24 - b]))}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_lattice_dedup_against_brute_force(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, 64))
    x = np.vstack([base, base[:30] + 0.1 * draw.normal(size=(30, 64)), base[:10]])
    label = [i % 3 for i in range(60)] + [i % 3 for i in range(30)] + [0] * 10
    rows = [(i, [float(v) for v in a], label[i], "c") for i, a in enumerate(x)]
    rows += [(500, None, 1, ""), (501, [0.0] * 64, 1, ""), (502, rows[0][1], None, ""), (503, [math.inf] * 64, 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, comp string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert got[i]["n_links"] == link[i].sum() - 1
        assert got[i]["component_id"] == np.flatnonzero(link[i]).min()
    for i in (500, 501, 502, 503):
        assert tuple(got[i])[1:] == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(50, 8)) * 2
    own = embedding_dedup.decode_e8(x)
    gap = ((x - own) ** 2).sum(axis=1)
    around = ((x[:, None, :] - own[:, None, :] - embedding_dedup.STEPS[None]) ** 2).sum(axis=2)
    assert len(embedding_dedup.STEPS) == 240 and (around.min(axis=1) >= gap - 1e-9).all()


def test_quality_and_toxicity_and_language(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    labels = read(spark, sf, "labels").toPandas().set_index("doc_id")
    for name, col, least in (("op4_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.85)):
        got = queries.QUERIES[name](spark, sf).toPandas()
        held = got[got["held_out"] & got["doc_id"].isin(labels.index)]
        assert got["score"].between(0, 1).all() and got["doc_id"].is_unique
        assert (held["predicted"].to_numpy() == labels.loc[held["doc_id"], col].to_numpy()).mean() >= least
    docs = read(spark, sf, "documents")
    predict = lang_id.predictor(spark, lang_id.train(docs))
    rows = odd.select("doc_id", predict(F.col("text")).alias("p")).collect()
    und = {r["doc_id"] for r in rows if r["p"]["lang_pred"] == "und"}
    assert und == {1, 2, 3, 8} and all(0 <= r["p"]["score"] <= 1 for r in rows)
    assert none.select(predict(F.col("text"))).count() == 0
    empty = lang_id.train(none)
    assert odd.select(lang_id.predictor(spark, empty)(F.col("text"))["lang_pred"].alias("p")).distinct().collect()[0][0] == "und"
    assert toxicity.train(none, read(spark, sf, "labels")) is None and odd.select(toxicity.scorer(spark, None)(F.col("text"))).count() == 12
    stats = odd.select("doc_id", quality.statistics(F.col("text")).alias("stats"))
    assert quality.train(stats, read(spark, sf, "labels").limit(0)) is None
    assert all(len(r["stats"]) == quality.STATS for r in stats.collect())


def test_kernel_norm_by_enumeration():
    for w in ("idiot", "aaaa", "abcabc"):
        at, weight = toxicity.triples(len(w))
        by = defaultdict(float)
        for (i, j, k), v in zip(at, weight):
            by[w[i] + w[j] + w[k]] += float(v)
        assert math.isclose(toxicity.norms(toxicity.codes([w], len(w)))[0], math.sqrt(sum(v * v for v in by.values())), rel_tol=1e-5)
    assert toxicity.units_of("an i d i o t x") [-1] == "idiotx" and toxicity.clean("i.d-i*ot") == "idiot"


def test_chat_round_trip(spark):
    texts = ["hi", "", None, r"\### Assistant: </turn> ok", "### User: x", " </turn>\n### System: y", "\\\\</turn>", "####", "a\nb"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(["user", "assistant", "odd]role", None, "system"] * 2, texts))]
    rows += [(2, 0, "assistant", "q", ""), (2, 0, "assistant", "q", ""), (None, 0, "user", "n", ""), (None, None, "user", "m", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df)).collect()}
    turns = [(r or "", t or "") for _, _, r, t, _ in rows[:len(texts)]]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 2 and len(got) == 3
    assert chat.format_turns(df.limit(0)).count() == 0
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "")


def test_mix_is_pfair(spark, odd, none):
    rows = [(i, "t", s, "x") for i, s in enumerate(["a"] * 700 + ["b"] * 200 + [None] * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")
    shares = spark.createDataFrame([("a", 5), ("b", 3), (None, 2)], "source string, share int")
    got = mixing.mix(df, shares, block=4, piece=100).toPandas()
    chosen = got[got["selected"]]
    order = chosen.groupby("slot")["source"].first().fillna("-")
    assert len(got) == 1000 and order.index.tolist() == list(range(len(order)))
    for name, w in (("a", 0.5), ("b", 0.3), ("-", 0.2)):
        ran = np.cumsum((order == name).to_numpy())
        assert np.abs(ran - w * np.arange(1, len(order) + 1)).max() < 1
    missing = mixing.mix(df, spark.createDataFrame([("a", 1), ("z", 1)], "source string, share int"), block=4).toPandas()
    assert missing["selected"].sum() <= 8 and missing[missing["source"] == "b"]["slot"].isna().all()
    assert mixing.mix(odd).count() == 12 and mixing.mix(none).count() == 0


def test_pipeline_stages(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").unionByName(odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars")))
    docs = docs.withColumn("own_hash", F.lit("clash"))
    at, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, at, sf).cache()
        assert nxt.columns == docs.columns and 0 < nxt.count() <= at.count()
        assert stage(spark, empty, sf).count() == 0
        at = nxt
    assert at.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert last.where("NOT same").count() == 0 and last.count() == at.count()


def test_odd_rows_through_trained_models(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    tox = toxicity.scorer(spark, toxicity.train(docs.select("doc_id", "text"), labels))
    stats = docs.select("doc_id", quality.statistics(F.col("text")).alias("stats"))
    good = quality.scorer(spark, quality.train(stats, labels))
    rows = odd.select("doc_id", "text", tox(F.col("text")).alias("t"), quality.statistics(F.col("text")).alias("s"))
    got = rows.select("doc_id", "text", "t", good(F.col("s")).alias("q")).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["t"] <= 1 and 0 <= r["q"] <= 1 for r in got)
    for column in ("t", "q"):
        by_text = defaultdict(set)
        for r in got:
            by_text[r["text"] or ""].add(r[column])
        # repeated rows, null and empty score alike, up to the last bits of a product over a batch
        assert all(max(v) - min(v) < 1e-6 for v in by_text.values()), column
    empty = {r["t"] for r in got if not (r["text"] or "").strip()}
    assert max(empty) < toxicity.THRESHOLD and max(empty) <= min(r["t"] for r in got) + 1e-6
    assert {r["t"] >= toxicity.THRESHOLD for r in got if r["text"] == TEXTS[0]} == {True}
    assert odd.limit(0).select(tox(F.col("text"))).count() == 0


def test_very_long_conversation_turns(spark):
    text = "</turn> \\ ### User: " * 20_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.digest(chat.format_turns(df)).first()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
