"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (tokens, 64-bit hashes). Two sets link when
``den * |intersection| >= num * |union|``.

Order of tokens. All sets are put in one global order: first the tokens whose hash falls into the
lowest ``COUNTED`` share of hash values, by document frequency (rare first), then all
others by hash. Frequencies are counted over all documents, for those tokens only; which order is
taken changes the number of candidates, never the result.

Prefixes. If two sets of n1 and n2 tokens link, the first n - ceil(num/den n) + l tokens of each
share at least l tokens. A set whose 1-prefix has rare tokens only (document frequency up to
``RARE``) indexes each of them. Otherwise its prefix is extended: the frequent tokens are dealt into B
classes by hash, the prefix gets l = 1 + B, and B + 1 shared tokens are either one rare token or two
tokens of one class, so it indexes its rare tokens singly and the 2-token combinations within each
class. B grows with the set's size level (powers of two), which keeps the combinations in
proportion to the prefix; a set near the top of its level is indexed in the next one too, so that sets that can
link always share a level. Tokens that no other set has in its counted part need no index entry.

Candidates are verified on the whole sets. Documents with equal sets are one node; buckets are connected without
listing all their pairs (``linking``).

Words: text with A-Z lower-cased, split at space, tab, line feed, vertical tab, form feed and carriage return. Fewer words than a shingle: the whole
sequence is the one token. Null, empty and blank texts: no token, linked with nothing, component = own doc_id.
Texts of any length are taken whole; an empty table gives an empty result; other columns are ignored, whatever their names.
Repeated rows are equal sets. Null doc_ids take part, but never name a component; a component without any id has null.
Equality of tokens and of sets is equality of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import materialize
from gaugeflow.llm.linking import connect, spanning

COUNTED, RARE, CLASS_SIZE = 0.22, 12, 8
SMALL_IDS = 1_000_000      # text hashes (8 MB) up to which the filter of candidate texts is broadcast
BLOCK, WIDTH = 512, 4096    # sets of a block and tokens of a matrix in block comparisons
PEELS = 2                  # rounds of leaving out sets that cannot link any more
KNOWN = 100_000            # word hashes kept per worker
FLUSH = 250_000          # tokens per batch that leaves a worker
LOW = -(1 << 63) + int(COUNTED * (1 << 64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _stir(h: np.ndarray) -> np.ndarray:
    """Spread sums of word hashes over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(text: str | None, size: int, known: dict) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending (signed)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(known) > KNOWN:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    odd = np.random.default_rng(17).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for i in range(k):
        total += _stir(w[i:len(w) - k + 1 + i] + odd[i]) * odd[i]
    return np.unique(_stir(total).view(np.int64))


def set_hash(toks: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(toks.tobytes()) - (1 << 63) if len(toks) else None


def levels(n: int, num: int, den: int) -> list[int]:
    """Size levels in which a set of n tokens is indexed."""
    level = n.bit_length() - 1
    return [level, level + 1] if n * den // num >= 1 << (level + 1) else [level]


def classes(level: int, num: int, den: int) -> int:
    return max(1, -(-((den - num) << level) // (den * CLASS_SIZE)))


def prefix(n: int, num: int, den: int) -> int:
    """Length of the prefix in which two linked sets share one token."""
    return n + (-num * n) // den + 1


def signatures(n: int, rank: np.ndarray, toks: np.ndarray, df: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of a set from its shared tokens: rank in the global order, hash, document frequency."""
    keys = []
    for level in levels(n, num, den):
        b, p = classes(level, num, den), prefix(n, num, den)
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        near = rank < p
        if (df[near] > RARE).any():
            near = rank < p + b
        one = toks[near & (df <= RARE)].view(np.uint64)
        keys.append(_stir(one + salt))
        often = toks[near & (df > RARE)].view(np.uint64)
        group = _stir(often) % np.uint64(b)
        for g in np.unique(group):
            t = np.sort(often[group == g])
            i, j = np.triu_indices(len(t), 1)
            keys.append(_stir(_stir(t[i] + salt) + t[j]))
    return np.concatenate(keys).view(np.int64)


def block_links(left: list, right: list, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of linked sets of two blocks; overlaps by products of 0/1 matrices over shared tokens."""
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = [np.array([len(t) for t in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(*(np.unique(f) for f in flat))
    common = np.zeros((len(left), len(right)), np.float32)
    spot = [np.searchsorted(shared, f) for f in flat]
    hit = [(shared[np.minimum(s, max(0, len(shared) - 1))] == f) if len(shared) else np.zeros(len(f), bool)
           for s, f in zip(spot, flat)]
    for at in range(0, len(shared), WIDTH):
        sides = []
        for s, h, o, n in zip(spot, hit, owner, (len(left), len(right))):
            m = np.zeros((n, min(WIDTH, len(shared) - at)), np.float32)
            use = h & (s >= at) & (s < at + WIDTH)
            m[o[use], s[use] - at] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return np.nonzero(den * common >= num * union)


def index_of(one: DataFrame, num: int, den: int) -> DataFrame:
    """Index rows (key, id, n) of distinct sets (node, n, counted, toks): the first ``counted`` tokens are
    ranked by their frequency among these sets, the others by hash."""
    post = one.select("node", "n", "counted", F.posexplode("toks").alias("pos", "tok"))
    often = post.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    hits = post.join(often, "tok")
    counted = F.col("pos") < F.col("counted")
    hits = hits.groupBy("node", "n", "counted").agg(F.sort_array(F.collect_list(F.struct(
        (~counted).alias("late"), F.when(counted, F.col("df")).otherwise(0).alias("by"), "tok", "pos", "df"))).alias("h"))
    hits = hits.select("node", "n", "counted", *[F.col(f"h.{c}").alias(c) for c in ("late", "tok", "pos", "df")])

    def index(batches):
        for b in batches:
            rows, held = [], 0
            for node, n, c, late, tok, pos, df in zip(*(b[x] for x in ("node", "n", "counted", "late", "tok", "pos", "df"))):
                late = np.asarray(late, bool)
                early = int((~late).sum())
                # tokens that nobody else has come first; the shared ones follow by frequency
                rank = np.where(late, np.asarray(pos, np.int64), c - early + np.arange(len(late)))
                keys = signatures(int(n), rank, np.asarray(tok, np.int64), np.asarray(df, np.int64), num, den)
                rows.append((node, n, keys))
                held += len(keys)
                if held > FLUSH:
                    yield _index(rows)
                    rows, held = [], 0
            yield _index(rows)

    return materialize(hits.mapInPandas(index, "key long, id long, n long").distinct(), "signatures")


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def shingle(batches):
        known = _Hashes()
        for b in batches:
            rows, held = [], 0
            for doc, text, h in zip(b["doc_id"], b["text"], b["text_hash"]):
                t = tokens(text, size, known)
                n = len(t)
                counted = int(np.searchsorted(t, LOW))
                need = max((prefix(n, num, den) + classes(x, num, den) for x in levels(n, num, den)), default=0) if n else 0
                rows.append((doc, h, n, set_hash(t), counted, t[:max(counted, need)]))
                held += len(rows[-1][5])
                if held > FLUSH:
                    yield _sets(rows)
                    rows, held = [], 0
            yield _sets(rows)

    sketch = texts.mapInPandas(shingle, "doc_id string, text_hash long, n long, node long, counted int, toks array<long>")
    sketch = materialize(sketch.withColumn("doc_id", F.col("doc_id").cast("long")), "shingles")
    one = sketch.where("node IS NOT NULL").select("node", "n", "counted", "toks").dropDuplicates(["node"])
    members = index_of(one, num, den)
    crowded = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = materialize(members.join(crowded, "key"), "members")
    needed = members.select("id").distinct()
    wanted = materialize(sketch.select("node", "text_hash").join(needed.withColumnRenamed("id", "node"), "node")
                         .groupBy("node").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct(), "wanted")
    few = wanted.limit(SMALL_IDS + 1).count() <= SMALL_IDS

    def whole(batches):
        known = _Hashes()
        for b in batches:
            rows, held = [], 0
            for text in b["text"]:
                t = tokens(text, size, known)
                rows.append((set_hash(t), t))
                held += len(t)
                if held > FLUSH:
                    yield pd.DataFrame(rows, columns=["node", "toks"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["node", "toks"])

    chosen = texts.join(F.broadcast(wanted) if few else wanted, "text_hash", "left_semi")
    sets = chosen.select("text").mapInPandas(whole, "node long, toks array<long>").dropDuplicates(["node"])
    sets = materialize(sets, "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("toks").alias("ta")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("toks").alias("tb")), "b")
        common = F.size(F.array_intersect("ta", "tb")).cast("long")
        union = F.size("ta") + F.size("tb")
        linked = both.select("a", "b", common.alias("c"), union.alias("u")).where(F.expr(f"{den} * c >= {num} * (u - c)"))
        return linked.select("a", "b")

    def fits(left, right):
        return (left("n") * den >= right("n") * num) & (right("n") * den >= left("n") * num) & (
            F.least(left("most"), right("most")) * (den + num) >= (left("n") + right("n")) * num)

    def narrow(open_: DataFrame) -> DataFrame:
        """Open sets that can still link to another one, indexed again among themselves on all their tokens.

        A token that no other open set has cannot be shared, so it bounds the overlap (``most``)."""
        ids = open_.select("id", "n").distinct()
        for _ in range(PEELS):
            held = sets.join(ids, sets["node"] == ids["id"]).select("id", F.explode("toks").alias("tok"))
            own = (held.groupBy("tok").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
                   .groupBy("id").agg(F.count("*").alias("own")))
            ids = ids.drop("most").join(own, "id", "left").select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))
            ids = materialize(ids.where(F.col("most") * den >= F.col("n") * num), "open_ids")
        whole = sets.join(ids.select(F.col("id").alias("node"), "n"), "node").select("node", "n", F.col("n").alias("counted"), "toks")
        again = index_of(whole, num, den).drop("n").join(
            ids.select("id", "n", "most", (F.col("most") / F.col("n")).alias("rank")), "id")
        return materialize(again.withColumn("home", F.lit(True)), "narrowed")

    def compare(clusters: DataFrame) -> DataFrame:
        """Links that join what is linked inside clusters of sets, block against block: of all links between two blocks
        a spanning forest of the components so far (``spanning``), so what leaves a pair of blocks is
        bounded by its rows. A pair of blocks that lies in one component is not compared at all."""
        size_of = clusters.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = clusters.join(size_of, "comp").join(sets, "node").withColumn(
            "mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = materialize(rows, "cluster_sets")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        left = rows.select("comp", F.col("mine").alias("lb"), every.alias("rb"), "node", "label", "toks").where("lb <= rb")
        right = rows.select(F.col("comp").alias("comp"), every.alias("lb"), F.col("mine").alias("rb"),
                            F.col("node").alias("r_node"), F.col("label").alias("r_label"), F.col("toks").alias("r_toks")).where("lb <= rb")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            la, lb = a["label"].to_numpy(), b["r_label"].to_numpy()
            if len(np.unique(np.concatenate([la, lb]))) < 2:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            i, j = block_links(list(a["toks"]), list(b["r_toks"]), num, den)
            apart = la[i] != lb[j]
            i, j = i[apart], j[apart]
            few = spanning(la[i], lb[j])
            return pd.DataFrame({"a": a["node"].to_numpy()[i[few]], "b": b["r_node"].to_numpy()[j[few]]})

        key = ["comp", "lb", "rb"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    members = members.withColumn("home", F.lit(True)).withColumn("most", F.col("n"))
    _, comps = connect(members, verify, fits, narrow, compare)
    return named(sketch.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node"), comps)


def named(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows with component_id, the smallest doc_id of the component of their node."""
    first = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    first = first.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = first.groupBy("comp").agg(F.min("first").alias("component_id"))
    names = first.join(ids, "comp").select("node", "component_id")
    linked = rows.join(names, "node").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = rows.where("node IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _sets(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "n", "node", "counted", "toks"], dtype=object)
    # whole numbers beside nulls must not pass through floating point
    return out.astype({"text_hash": "int64", "n": "int64", "node": "Int64", "counted": "int32"})


def _index(rows) -> pd.DataFrame:
    sizes = [len(k) for _, _, k in rows]
    keys = np.concatenate([k for _, _, k in rows]) if rows else np.empty(0, np.int64)
    return pd.DataFrame({"key": keys, "id": np.repeat(np.array([r[0] for r in rows], np.int64), sizes),
                         "n": np.repeat(np.array([r[1] for r in rows], np.int64), sizes)})
