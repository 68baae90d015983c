"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

A text is lower-cased (A-Z only) and gets a 64-bit fingerprint. One entry per fingerprint, its *chain*, holds
the number of rows and the row that stays. Chains lie in buckets named by the leading bits of the
fingerprint: the directory starts with one bucket, and as long as a bucket holds more than ``CAPACITY``
chains, the directory doubles and the bucket splits by the next bit (up to ``MAX_DEPTH`` bits; buckets of that depth
may grow). As counts of prefixes add up, all doublings are read off one histogram of at most 2^MAX_DEPTH rows.
Consecutive buckets form the key range of an owner; owners write their buckets to the shared folder, sorted.

Rows that share a fingerprint are compared by their bytes: only texts whose chain has several
rows are read again, equal ones are combined where they are read, and what reaches the owner is one text per map task and
content. Where a chain turns out to hold different texts (a collision), every text gets its own place in the chain
and its rows are assigned by the text itself. ``bits`` shortens the fingerprint, for tests of that path.

Nothing gathers a group: chains are partial aggregates; a chain with more than 1/``SHARE`` of all rows (there are fewer
than ``SHARE`` of them) reaches its rows by broadcast, the others by a shuffle join of chains and ids.

Results: one row per input row. Null text counts as empty. The largest doc_id of a group stays (a null one only
if there is no other; keep_id is null then); of several rows with that doc_id one stays. Repeated rows count each.
An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import join_by_count, materialize
from gaugeflow.operators.joins import BROADCAST_ROW_LIMIT, bounded_rows

CAPACITY, MAX_DEPTH, OWNER_CHAINS = 4096, 16, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """The text with A-Z in lower case; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def fingerprint(norm: Column, bits: int = 64) -> Column:
    """The first ``bits`` bits of a 64-bit hash, left-aligned."""
    h = F.xxhash64(norm)
    return h if bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def prefix(h: Column, depth: Column) -> Column:
    """The leading ``depth`` bits (0 to MAX_DEPTH) of a fingerprint."""
    top = F.shiftrightunsigned(h, 64 - MAX_DEPTH)
    return F.floor(top / F.pow(F.lit(2.0), F.lit(MAX_DEPTH) - depth)).cast("long")


def directory(chains: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cell, bucket, depth, n): one row per cell of the directory at its final (global) depth.

    ``bucket`` numbers the buckets in key order, ``depth`` is a bucket's own depth and ``n`` its chains."""
    top = F.shiftrightunsigned(F.col("h"), 64 - MAX_DEPTH)
    fine = chains.groupBy(top.alias("top")).agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")
    at = F.floor(F.col("top") / F.pow(F.lit(2.0), F.lit(MAX_DEPTH) - F.col("depth"))).cast("long")
    counts = materialize(fine.select("top", "n", level).groupBy("depth", at.alias("prefix")).agg(F.sum("n").alias("n")),
                         "dedup_prefixes")
    split = counts.where((F.col("n") > capacity) & (F.col("depth") < MAX_DEPTH)).select("depth", "prefix")
    whole = counts.join(split, ["depth", "prefix"], "left_anti")
    # a bucket is born when its parent splits; the only bucket without a parent is the first one
    born = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    first = whole.where("depth = 0").select("depth", "prefix")
    buckets = (born.join(split, ["depth", "prefix"], "left_anti").unionByName(first)
               .join(counts, ["depth", "prefix"], "left").select("depth", "prefix", F.coalesce("n", F.lit(0)).alias("n")))
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    width = F.pow(F.lit(2.0), F.lit(depth) - F.col("depth")).cast("long")
    # at most 2^MAX_DEPTH buckets go through this window
    order = Window.orderBy("start")
    buckets = buckets.select("depth", "n", width.alias("width"), (F.col("prefix") * width).alias("start")).select(
        "depth", "n", "width", "start", (F.row_number().over(order) - 1).alias("bucket"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    cells = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("cell")
    return buckets.select(cells, "bucket", "depth", "n", F.floor(F.col("before") / OWNER_CHAINS).cast("int").alias("owner"),
                          F.lit(depth).alias("global_depth"))


def build_index(chains: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The chains with their bucket, written by owners of key ranges, sorted by bucket and fingerprint."""
    cells = materialize(directory(chains, capacity), "dedup_directory")
    known = cells.agg(F.max("global_depth").alias("depth"), F.max("owner").alias("owner")).first()
    depth, owners = known["depth"] or 0, (known["owner"] or 0) + 1
    placed = chains.withColumn("cell", prefix(F.col("h"), F.lit(depth))).join(
        F.broadcast(cells.select("cell", "bucket", "owner")), "cell")  # at most 2^MAX_DEPTH rows
    owned = placed.repartitionByRange(owners, "owner", "bucket").sortWithinPartitions("bucket", "h")
    return materialize(owned.select("owner", "bucket", "h", "n", "top"), "dedup_index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, chain (place in a chain of colliding texts) of every row of
    ``docs`` (doc_id, text)."""
    norm = normalized(F.col("text"))
    texts = docs.select("doc_id", norm.alias("norm")).withColumn("h", fingerprint(F.col("norm"), bits))
    rows = materialize(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"),
                                    F.monotonically_increasing_id().alias("rid")), "dedup_rows")
    last = F.max(F.struct("doc_id", "rid")).alias("top")
    chains = materialize(rows.groupBy("h").agg(F.count("*").alias("n"), last), "dedup_chains")
    index = build_index(chains, capacity)
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    several = index.where("n > 1").select("h", "bucket", "owner", "n")
    read_again = texts.select("h", "norm")
    if bounded_rows(several, BROADCAST_ROW_LIMIT) is not None:
        shared = read_again.join(F.broadcast(several), "h")
    else:
        shared = join_by_count(read_again, several, ["h"], "n", total)
    equal = shared.groupBy("owner", "bucket", "h", "norm").agg(F.count("*").alias("rows"))
    collided = materialize(equal.groupBy("h").agg(F.count("*").alias("texts"), F.sum("rows").alias("n")).where("texts > 1"), "dedup_collided")

    plain = rows
    if not collided.isEmpty():
        plain = rows.join(collided.select("h"), "h", "left_anti")
    found = join_by_count(plain, index.select("h", "n", "top"), ["h"], "n", total)
    out = found.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                       (F.col("rid") == F.col("top.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
                       F.lit(0).cast("long").alias("chain"))
    if collided.isEmpty():
        return out
    return out.unionByName(_unchain(texts, collided, total))


def _unchain(texts: DataFrame, collided: DataFrame, total: int) -> DataFrame:
    """Rows of fingerprints that several texts share, told apart by the texts themselves."""
    rows = join_by_count(texts, collided.select("h", "n"), ["h"], "n", total).drop("n")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "dedup_unchained")
    groups = rows.groupBy("h", "norm").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("top"))
    groups = groups.withColumn("chain", F.row_number().over(Window.partitionBy("h").orderBy("norm")).cast("long") - 1)
    found = join_by_count(rows, materialize(groups, "dedup_groups"), ["h", "norm"], "n", total)
    return found.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("rid") == F.col("top.rid")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"), "chain")
