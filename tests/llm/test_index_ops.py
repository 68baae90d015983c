"""Exact dedup, prefix trie and hard negatives against brute force, with odd rows, ties and forced collisions."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import exact_dedup, hard_negatives, prefix_trie
from gaugeflow.llm.common import join_by_count, workers_find_package

LONG = "Ärger " * 40_000 + "END"
UP = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


# ---------------------------------------------------------------- exact dedup
DOCS = "doc_id long, text string, h long, n long, top string, norm string"


def _docs(spark, rows):
    workers_find_package(spark)
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], DOCS)


def _brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = False
        for i in ids:
            out.append((i, top, len(ids), i == top and not kept, sha))
            kept |= i == top
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    rows = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, LONG), (8, LONG.lower()), (9, LONG.replace("Ärger", "ärger")),
            (10, "a b "), (10, "a b "), (None, "x"), (None, "x"), (None, "a b"), (11, "a\0b"), (12, "a\0B")]
    rows += [(100 + i, f"text {i % 17}") for i in range(300)] + [(1000 + i, "the same") for i in range(500)]
    got = exact_dedup.exact_duplicates(_docs(spark, rows), capacity=4, bits=bits)
    found = sorted([tuple(r)[:5] for r in got.collect()], key=str)
    assert found == _brute_dedup(rows)
    chains = {r["text_sha256"]: r["chain"] for r in got.collect()}
    assert (len(set(chains.values())) > 1) == (bits == 3)  # only colliding texts have a place of their own


def test_exact_duplicates_of_nothing(spark):
    got = exact_dedup.exact_duplicates(_docs(spark, [(1, "a")]).limit(0))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "chain"] and got.count() == 0


def test_directory_splits_overfull_buckets(spark):
    workers_find_package(spark)
    chains = spark.range(3000).select(F.xxhash64("id").alias("h"), F.lit(1).alias("n"), F.lit(0).alias("top"))
    cells = exact_dedup.directory(chains, capacity=100).collect()
    depth = cells[0]["global_depth"]
    assert sorted(r["cell"] for r in cells) == list(range(2 ** depth))  # the directory covers all prefixes once
    buckets = {(r["bucket"], r["depth"], r["n"]) for r in cells}
    assert sum(n for _, _, n in buckets) == 3000 and all(n <= 100 for _, _, n in buckets) and max(d for _, d, _ in buckets) == depth
    by_bucket = defaultdict(list)
    for r in cells:
        by_bucket[(r["bucket"], r["depth"])].append(r["cell"])
    for (_, d), of in by_bucket.items():  # a bucket is the run of cells that share its prefix
        assert len(of) == 2 ** (depth - d) and max(of) - min(of) == len(of) - 1
    index = exact_dedup.build_index(chains, capacity=100)
    where = {r["cell"]: r["bucket"] for r in cells}
    for r in index.collect():
        assert where[(r["h"] % 2 ** 64) >> (64 - depth)] == r["bucket"]


def test_join_by_count_splits_hot_keys(spark):
    rows = spark.createDataFrame([(0, i) for i in range(2000)] + [(i, i) for i in range(1, 50)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_by_count(rows, table, ["k"], "n", rows.count())
    assert got.count() == 2049 and got.agg(F.sum("n")).first()[0] == 2000 * 2000 + 49


# ---------------------------------------------------------------- prefix trie
TURNS = "conv_id long, turn long, role string, text string, depth long, hi string"


def _brute_trie(convs):
    """convs: {conv_id: [(role, text)]} rebuilt."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(convs[c]) == len(node)))
        kids = children[node]
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
                     sum(out[k][5] for k in kids) if kids else 1,
                     sum(out[k][6] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0),
                     hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def _rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, (role or "", text or "")))
    said = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in said}
    return {c: said.get(c - int(math.fmod(c, 100)), [])[:h[c]] + said[c][h[c]:] for c in said}


def _conversations(rng):
    rows = []
    for c in [*range(0, 330), 1234, 5678, -7]:
        for t in range(rng.integers(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"word{rng.integers(0, 3)}é"))
    rows += [(400, 0, "user", "hi")] + [(400 + i, t, "user", "same") for i in range(1, 60) for t in range(8)]
    rows += [(600, 0, None, None), (600, None, "", ""), (600, None, "user", ""), (600, 5, "user", LONG), (601, 0, "user", "x"), (601, 0, "user", "x")]
    rows += [(700, t, "user", f"t{t % 5}") for t in range(700)] + [(701, t, "user", f"t{t % 5}") for t in range(350)]
    return [*rows, (None, 0, "user", "nobody")]


@pytest.mark.parametrize("block, growth, shard, piece", [(50_000, 1000, 50_000, 4096), (20, 3, 50, 7), (1, 2, 10, 1)])
def test_prefix_trie(spark, block, growth, shard, piece):
    workers_find_package(spark)
    rows = _conversations(np.random.default_rng(4))
    if block == 1:
        rows = [r for r in rows if r[0] is None or r[0] < 340]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(5)
    turns = prefix_trie.share_openings(prefix_trie.own_turns(df))
    got = prefix_trie.trie(turns, block=block, growth=growth, shard=shard, piece=piece).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_trie(_rebuild(rows))


def test_prefix_trie_of_nothing(spark):
    workers_find_package(spark)
    df = spark.createDataFrame([], TURNS)
    got = prefix_trie.trie(prefix_trie.share_openings(prefix_trie.own_turns(df)))
    assert got.count() == 0 and got.columns[:3] == ["conv_id", "depth", "parent_conv_id"]


def test_node_slots_are_minimal_and_verified():
    draw = np.random.default_rng(5)
    hi, lo = draw.integers(-2 ** 62, 2 ** 62, 5000), draw.integers(-2 ** 62, 2 ** 62, 5000)
    hi[:1000] = 7  # halves may repeat, pairs do not
    table = prefix_trie.NodeSlots(hi, lo)
    assert sorted(table.find(hi, lo)) == list(range(5000))
    assert (table.find(hi, lo + 1) == -1).all() and len(prefix_trie.NodeSlots(hi[:0], lo[:0]).find(hi, lo)) == 5000
    one = np.array([3, 3])
    with pytest.raises(ValueError):
        prefix_trie.NodeSlots(one, one)


# ---------------------------------------------------------------- hard negatives
VECTORS = "vec_id long, label int, embedding array<double>, norm string, score string"


def _brute_mine(rows, k=5, n=5):
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
              if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, qa in usable:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, label) for i, label, q in usable if i != a and len(q) == len(qa))
        for p, pid, _ in [s for s in scored if s[2] == la][:k]:
            hard = [(-s, i) for s, i, label in scored if label != la and 80 * -p <= 100 * -s <= 100 * -p][:n]
            out += [(a, pid, r + 1, i, -p, s) for r, (s, i) in enumerate(hard)]
    return sorted(out)


def _vectors(rng, count=900, dim=12):
    centres = rng.normal(size=(6, dim))
    rows = [(i, int(i % 4), (centres[i % 6] * 0.3 + rng.normal(size=dim) * (0.02 if i % 3 else 0.4)).tolist()) for i in range(count)]
    rows += [(count + i, 1, rows[min(10, count - 1)][2]) for i in range(40)]  # ties
    rows += [(2000, 1, [0.0] * dim), (2001, 2, [0.0] * dim), (2100, None, rows[0][2]), (2200, 1, None), (2300, 1, [math.nan] * dim),
             (2400, 1, [None] * dim), (2500, 1, [math.inf] * dim), (2600, 0, []), (2601, 0, []), (2602, 1, []), (None, 1, rows[0][2]),
             (2700, 1, [1.0, 2.0]), (2701, 1, [1.0, 2.0]), (2702, 2, [1.0, 1.9]), (2800, 3, (-np.array(rows[0][2])).tolist())]
    return rows


def _mined(spark, rows, **options):
    workers_find_package(spark)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    q = df.select("vec_id", "label", hard_negatives.whole_numbers(F.col("embedding"), 256).alias("q"))
    q = q.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    return hard_negatives.mine(q, F.col("vec_id") % 100 == 0, **options)


@pytest.mark.parametrize("options", [{}, {"window": 7, "round_size": 4, "sample": 50, "references": 3}, {"references": 0, "sample": 1}])
def test_hard_negatives(spark, options):
    rows = _vectors(np.random.default_rng(6))
    got = sorted(tuple(r) for r in _mined(spark, rows, **options).collect())
    assert got == _brute_mine(rows) and len(got) > 150


def test_hard_negatives_of_large_numbers(spark):
    draw = np.random.default_rng(7)
    rows = [(i, int(i % 2), [float(x) for x in draw.integers(-2 ** 22, 2 ** 22, 8)]) for i in range(150)]
    got = sorted(tuple(r) for r in _mined(spark, rows).collect())
    assert got == _brute_mine(rows) and got


def test_hard_negatives_beyond_64_bits_end_the_job(spark):
    with pytest.raises(Exception, match="OverflowError|too large"):
        _mined(spark, [(0, 0, [1e17, 1.0]), (1, 0, [1e17, 1.0]), (2, 1, [1e17, 1.0])]).collect()


def test_hard_negatives_of_nothing(spark):
    rows = _vectors(np.random.default_rng(8), count=5)
    assert _mined(spark, rows[1:5]).count() == 0  # no anchor
    assert _mined(spark, [(1, 1, None)]).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_for_every_pair():
    draw = np.random.default_rng(9)
    q = np.floor(256 * draw.normal(size=(300, 10)) * draw.uniform(0, 3, size=(300, 1)))
    q[5] = 0
    refs = hard_negatives.directions(q[:60], 8)
    norm, angles = hard_negatives.angles_to(q, refs)
    import pandas as pd
    a = hard_negatives.Anchors(pd.DataFrame({"vec_id": range(300), "label": 0, "q": list(q), "norm": norm, "angles": list(angles)}))
    order = np.argsort(angles[:, 0])
    starts = np.arange(0, 300, 6)
    low, high = a.bounds(norm[order], angles[order], starts)
    exact = hard_negatives.scores(q, q[order])
    assert (np.minimum.reduceat(exact, starts, axis=1) >= low).all() and (np.maximum.reduceat(exact, starts, axis=1) <= high).all()
    assert (high < np.outer(norm, np.maximum.reduceat(norm[order], starts))).mean() > 0.5  # they do cut something off


# ---------------------------------------------------------------- spanning forests, equal scores, whole tables
def test_spanning_forest_joins_what_the_links_join():
    from gaugeflow.llm.linking import spanning
    draw = np.random.default_rng(10)
    for n, links in ((30, 20), (50, 400), (5, 0), (300, 260)):
        a, b = draw.integers(0, n, links), draw.integers(0, n, links)

        def groups(pairs):
            root = list(range(n))
            for i, j in pairs:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
            return {frozenset(k for k in range(n) if root[k] == r) for r in root}

        kept = spanning(a, b)
        assert groups(zip(a[kept], b[kept])) == groups(zip(a, b)) and len(kept) == n - len(groups(zip(a, b)))


def test_a_large_group_of_near_copies_is_one_component(spark):
    from gaugeflow.llm import ngram_join
    workers_find_package(spark)
    draw = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(2000):  # each differs from the base in one word: 8 of 117 shingles with 4 words each
        words = list(base)
        words[int(draw.integers(0, 120))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"y{i}_{j}" for j in range(60))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, size=4, num=85, den=100).collect()}
    sets = [{tuple(t.split()[k:k + 4]) for k in range(len(t.split()) - 3)} for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by_gram = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].add(i)
    for i, s in enumerate(sets):
        if len({top(j) for j in range(2000)}) == 1 and i > 0:
            break
        for j in set().union(*(by_gram[g] for g in list(s)[:20])):
            if j > i and top(i) != top(j):
                both = len(s & sets[j])
                if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                    root[top(j)] = top(i)
    want = {}
    for i in range(len(rows)):
        want.setdefault(top(i), []).append(rows[i][0])
    assert got == {d: min(g) for g in want.values() for d in g}


def test_equal_vectors_have_equal_scores_in_every_block(spark):
    from gaugeflow.llm import ann
    workers_find_package(spark)
    draw = np.random.default_rng(12)
    base = draw.normal(size=(100, 37))
    rows = [(int(k), [float(x) for x in base[k % 100]]) for k in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (100_000, 150):
        got = ann.nearest(df, df.where("vec_id % 50 = 0"), k=25, block=block, candidates=1.0).toPandas()
        for q, g in got.groupby("query_id"):
            exact = np.array([math.fsum(base[k % 100] * base[q % 100]) for k in range(1000)])
            exact[q] = -np.inf
            order = np.lexsort((np.arange(1000), -exact))[:25]
            g = g.sort_values("rank")
            assert g["vec_id"].tolist() == order.tolist() and np.allclose(g["score"], exact[order], rtol=1e-13)
            assert g.groupby(g["vec_id"] % 100)["score"].nunique().max() == 1
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_links_and_counts_use_one_measure(spark):
    from gaugeflow.llm import embedding_dedup
    workers_find_package(spark)
    draw = np.random.default_rng(13)
    base = draw.normal(size=(4, 24))
    rows = []
    for i in range(600):
        v = base[i % 4] + draw.normal(size=24) * 0.11
        rows.append((i, [float(x) for x in v * (1e-3 if i % 2 else 1e155)], int(i % 2)))
    rows += [(900, [1e200] * 24, 5), (901, [-1e200] * 24, 5), (902, [2e-200] * 24, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, tables=16).collect()}
    ids = [r[0] for r in rows]
    x = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))])
            if low < comp[i]:
                comp[i], changed = low, True
    assert near.sum() > 1000 and got[902]["component_id"] == 900 and got[901]["n_links"] == 0
    for i, v in enumerate(ids):
        assert got[v]["n_links"] == near[i].sum() and got[v]["component_id"] == ids[comp[i]]


# ---------------------------------------------------------------- language tables, long texts
def test_language_tables_keep_every_unit(spark, monkeypatch):
    from gaugeflow.llm import lang_id
    from gaugeflow.llm.common import fold, read
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    words = ["Ärger", "x", "longer word", "", "日本"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(lang_id.hash_of(r["w"]) == r["h"] for r in got)
    model = lang_id.train(docs)
    train = docs.where((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()).select("text", "lang").collect()
    count, grams = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for r in train:
        for w in lang_id.words_of(r["text"]):
            count[r["lang"]][w] += 1
    for lang, ws in count.items():
        for w, n in ws.items():
            for o in lang_id.ORDERS:
                for g in lang_id.grams_of(w, o):
                    grams[lang, o][g] += n

    def log(table, g):
        return np.log((table.get(g, 0) + lang_id.SMOOTH) / (sum(table.values()) + lang_id.SMOOTH * len(table)))

    def brute(word):
        if any(word in count[x] for x in model["langs"]):
            return [log(count[x], word) for x in model["langs"]]
        for o in lang_id.ORDERS:
            known = [g for g in lang_id.grams_of(word, o) if any(g in grams[x, o] for x in model["langs"])]
            if known:
                return [np.mean([log(grams[x, o], g) for g in known]) for x in model["langs"]]
        return [0.0] * len(model["langs"])

    assert model["langs"] == sorted(count)
    rare = [w for ws in count.values() for w, n in ws.items() if n == 1][:40]
    held = [w for r in docs.where(fold(F.col("doc_id"), 5) == 0).limit(5).collect() for w in lang_id.words_of(r["text"])][:60]
    words = [*rare, *held, "zzqqx", "ß", "ж", "zzqqx"]
    assert np.allclose(lang_id.word_scores(model, words), [brute(w) for w in words], atol=1e-4)
    monkeypatch.setattr(lang_id, "KNOWN", 50)
    monkeypatch.setattr(lang_id, "PIECE", 40)  # texts above and below a piece, and a table that fills up
    texts = [None, "", "1 2", *[r["text"] for r in docs.limit(40).collect()]]
    for text, (lang, score) in zip(texts, lang_id.Scorer(model).predict(texts)):
        said = lang_id.words_of(text)
        total = np.sum([brute(w) for w in said], axis=0) if said else None
        assert (lang, score) == (lang_id.UNDETERMINED, 0.0) if not said else (
            lang == model["langs"][int(total.argmax())] and math.isclose(score, 1 / np.exp(total - total.max()).sum(), rel_tol=1e-2))
    monkeypatch.undo()
    predict = lang_id.predictor(spark, model)
    out = docs.where((fold(F.col("doc_id"), 5) == 0) & F.col("lang").isNotNull()).select("lang", predict(F.col("text")).alias("p")).toPandas()
    assert (out["p"].map(lambda p: p["lang_pred"]) == out["lang"]).mean() >= 0.98


def test_mix_refuses_more_steps_than_its_bound(spark, monkeypatch):
    from gaugeflow.llm import mixing
    workers_find_package(spark)
    df = spark.createDataFrame([(i, "t", f"s{i % 30}") for i in range(300)], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 300
    monkeypatch.setattr(mixing, "MOST_STEPS", 100)
    with pytest.raises(ValueError, match="30 sources"):
        mixing.mix(df)
