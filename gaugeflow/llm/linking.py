"""Connecting the members of index buckets without listing all pairs of a bucket.

``members`` are rows (key, id, home): a bucket is a key; at least one side of a pair must be home
in it. Each round compares the members of every bucket that is not yet within one component with one
of its home members (another one each round), keeps the verified links and joins the components. What is still in
different components after ``ROUNDS`` rounds, or after a round in which no member of an open bucket fits its
head, is compared member by member across components (large
buckets in blocks, where the caller can do that), so no candidate pair that could join two components is left out, while a bucket of many copies costs one
comparison a member. No bucket is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import components, materialize

ROUNDS = 4
CROWD = 32         # members of a bucket up to which the last step lists its pairs
SHUFFLE = 0.03   # how far chance moves a member's rank from round to round


def connect(members: DataFrame, verify: Callable[[DataFrame], DataFrame], fits=None, narrow=None,
            compare: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, components) of ``members``; ``verify`` keeps the linked ones of distinct pairs
    (a, b), a < b; ``fits`` is a cheap necessary condition over columns of both sides, as
    ``fits(left, right)`` with column getters. ``narrow`` is applied to the members of open buckets after
    the first round and may leave out those that cannot link to any other of them, change the columns
    that ``fits`` reads and set ``rank`` (a member of high rank is compared with first). ``compare`` takes
    clusters (node, comp, label) of members connected by buckets of more than ``CROWD``, label being the component a
    member is in so far, and returns links enough to join what is linked in a cluster (``spanning``), so
    that the last step lists no pairs of large buckets."""
    extra = [c for c in members.columns if c not in ("key", "id", "home")]
    spark = members.sparkSession
    kind = members.schema["id"].dataType.simpleString()
    comps = spark.createDataFrame([], f"node {kind}, comp {kind}")
    links = spark.createDataFrame([], f"a {kind}, b {kind}")
    step = 0
    while step <= ROUNDS:
        now = members.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "comp", F.coalesce("comp", "id")) if step else members.withColumn("comp", F.col("id"))
        chance = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1000)) / 1000.0
        order = (-F.col("rank") + chance * SHUFFLE if "rank" in extra else chance).alias("order")
        sides = F.struct(order, "id", "comp", *extra)
        head = now.groupBy("key").agg(
            F.min(F.when(F.col("home"), sides)).alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.bit_xor(F.xxhash64("id", "home")).alias("print"), F.bit_xor(F.xxhash64("home", "id", F.lit(1))).alias("print2"),
            F.count("*").alias("size"))
        head = head.where("head IS NOT NULL AND lo <> hi")
        if step < ROUNDS:
            pairs = now.join(head.select("key", "head"), "key").where("comp <> head.comp")
            left, right = (lambda c: F.col(c)), (lambda c: F.col(f"head.{c}"))
        else:
            # buckets with the same members say the same: one of them is enough
            once = materialize(head.groupBy("print", "print2", "size", "lo", "hi").agg(F.min("key").alias("key")).select("key"), "buckets")
            now = materialize(now.join(once, "key"), "open")
            if compare is not None:
                crowd = materialize(now.join(head.where(F.col("size") > CROWD).select("key"), "key"), "crowd")
                if not crowd.isEmpty():
                    spokes = crowd.join(crowd.groupBy("key").agg(F.min("id").alias("a")), "key")
                    clusters = components(spokes.select("a", F.col("id").alias("b")))
                    labels = crowd.select(F.col("id").alias("node"), F.col("comp").alias("label")).distinct()
                    links = materialize(links.unionByName(compare(clusters.join(labels, "node"))), "links")
                    now = materialize(now.join(head.where(F.col("size") <= CROWD).select("key"), "key"), "open")
            other = now.where("home").select("key", *[F.col(c).alias(f"r_{c}") for c in ("id", "comp", *extra)])
            pairs = now.join(other, "key").where("comp <> r_comp AND (id < r_id OR NOT home)")
            left, right = (lambda c: F.col(c)), (lambda c: F.col(f"r_{c}"))
        if fits is not None:
            pairs = pairs.where(fits(left, right))
        pairs = pairs.select(F.least(left("id"), right("id")).alias("a"), F.greatest(left("id"), right("id")).alias("b"))
        pairs = materialize(pairs.distinct(), "pairs")
        fruitless = step < ROUNDS and pairs.isEmpty()
        if fruitless:
            if head.isEmpty():
                break
        else:
            links = materialize(links.unionByName(verify(pairs)), "links")
            comps = components(links)
        if step == 0 and narrow is not None:
            open_ = members.join(head.select("key"), "key").join(comps.withColumnRenamed("node", "id"), "id", "left")
            members = narrow(materialize(open_.withColumn("comp", F.coalesce("comp", "id")), "open"))
            extra = [c for c in members.columns if c not in ("key", "id", "home")]
        step = ROUNDS if fruitless else step + 1
    return links, comps


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links between labels ``a`` and ``b`` that join all that the links join: at most one fewer than
    there are labels."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.minimum(at[:len(a)], at[len(a):]), np.maximum(at[:len(a)], at[len(a):])
    _, first = np.unique(x * len(names) + y, return_index=True)
    root = list(range(len(names)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    kept = []
    for at_link, i, j in zip(first.tolist(), x[first].tolist(), y[first].tolist()):
        i, j = top(i), top(j)
        if i != j:
            root[i] = j
            kept.append(at_link)
    return np.array(kept, np.int64)
