"""Prefix trie of conversations on a minimal-perfect-hash node table.

A node is a distinct sequence of first turns, named by a chained 128-bit digest; the root is the empty sequence. The
digests of a conversation are chained while its sorted turns stream through a task, and texts never move: a
turn is its SHA-256 digest and its length. Equality of sequences is equality of these digests.

The distinct digests and their totals are partial aggregates (members, smallest member, and ``weight``: the rows of the
members from that depth on, at least the number of nodes below). Weights fall along a path, so the nodes of weight
at most B form whole subtrees of at most B nodes. These are packed into shards. In a shard every node gets a slot of
a minimal perfect hash (levels of bit arrays: a digest that is alone in its place keeps it, the others go on to the next
level), checked against the digest stored in the slot; its values are scattered into flat arrays; children, leaves and
savings are added up through the array of parent slots, deepest nodes first. The sums of a subtree's top go to
its parent, and the heavier nodes above follow by the same steps with B ``GROWTH`` times as large, until the root is done: two
or three rounds, whatever the depth of the trie.

Hot prefixes: totals are combined before the shuffle; nodes of more than 1/1024 of all rows reach the rows by broadcast.
The members that end in a node are joined to text in pieces of at most ``PIECE`` ids; one task then hashes the
pieces of a node in order, as a SHA-256 of one long string is sequential.

Odd rows: turns are ordered by turn (null first; ties: by the digest of role and text). A null role or text counts as
empty. Rows without conv_id belong to no conversation. Repeated rows are turns of their own. An empty table has no nodes.
Other columns are ignored. A single conversation is streamed by one task, however long, and its path is one shard's at most.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import join_by_count, materialize

BLOCK, GROWTH, SHARD, PIECE = 50_000, 1000, 50_000, 4096
ROOT = b"\0" * 16
_NODE = "hi long, lo long, phi long, plo long, conv_id long, depth long, parent_conv long, n_convs long"


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key (digest of role and text), chars of every turn in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return turns.select("conv_id", F.row_number().over(w).alias("place"), "key", "chars")


def share_openings(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt on shared openings: (conv_id, part, place, key, chars), with a row of part 0 for each.

    Conversation c starts with the first h turns of conversation c - c % ``group`` and goes on with its own after the first h;
    h is the unsigned CRC-32 of c in decimal, modulo ``most``."""
    turns = materialize(turns, "trie_turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("giver"))
    convs = materialize(convs, "trie_convs")
    given = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "giver")
    opening = convs.join(given, "giver").where("place <= h").select("conv_id", F.lit(1).alias("part"), "place", "key", "chars")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    rest = turns.where(F.col("place") > h).select("conv_id", F.lit(2).alias("part"), "place", "key", "chars")
    start = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(b"").alias("key"),
                         F.lit(0).cast("long").alias("chars"))
    return start.unionByName(opening).unionByName(rest)


def paths(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, its digest (hi, lo), its parent's (phi, plo), chars, total turns."""
    total = F.count("*").over(Window.partitionBy("conv_id")) - 1
    ordered = rows.withColumn("total", total).sortWithinPartitions("conv_id", "part", "place")

    def chain(batches):
        conv, digest, depth = None, ROOT, 0
        for b in batches:
            here, above, depths = [], [], []
            for c, key in zip(b["conv_id"].tolist(), b["key"].tolist()):
                if c != conv:  # the row of part 0
                    conv, digest, depth = c, ROOT, 0
                    above.append(ROOT)
                else:
                    above.append(digest)
                    digest, depth = hashlib.blake2b(digest + key, digest_size=16).digest(), depth + 1
                here.append(digest)
                depths.append(depth)
            own, up = (np.frombuffer(b"".join(x), "<i8").reshape(-1, 2) for x in (here, above))
            yield pd.DataFrame({"conv_id": b["conv_id"], "depth": depths, "hi": own[:, 0], "lo": own[:, 1],
                                "phi": up[:, 0], "plo": up[:, 1], "chars": b["chars"], "total": b["total"]})

    return ordered.select("conv_id", "key", "chars", "total").mapInPandas(
        chain, "conv_id long, depth long, hi long, lo long, phi long, plo long, chars long, total long")


class NodeSlots:
    """Minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1, each holding its digest for verification."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        if ((np.diff(hi[order]) == 0) & (np.diff(lo[order]) == 0)).any():
            raise ValueError("digests are not distinct")
        self.levels, left, base = [], np.arange(len(hi)), 0
        while len(left):
            size = len(left)
            at = self._place(hi[left], lo[left], len(self.levels), size)
            taken = np.bincount(at, minlength=size) == 1
            self.levels.append((taken, base + np.cumsum(taken) - 1))
            base += int(taken.sum())
            left = left[~taken[at]]
        self.hi, self.lo = np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        slots = self._slots(hi, lo)
        self.hi[slots], self.lo[slots] = hi, lo
        if len(hi) and (np.bincount(slots, minlength=len(hi)) != 1).any():
            raise ValueError("slots are not distinct")

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        x = hi.astype(np.uint64) + salt
        for y, times in ((lo.astype(np.uint64) ^ salt, 0xBF58476D1CE4E5B9), (np.uint64(0), 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(times) + y
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (taken, rank) in enumerate(self.levels):
            at = self._place(hi[left], lo[left], level, len(taken))
            out[left[taken[at]]] = rank[at[taken[at]]]
            left = left[~taken[at]]
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that are not in the table."""
        slots = self._slots(hi, lo)
        known = slots >= 0
        known[known] = (self.hi[slots[known]] == hi[known]) & (self.lo[slots[known]] == lo[known])
        return np.where(known, slots, -1)


def accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Adds children, leaves and savings of a shard's nodes up to their tops, through flat arrays by slot."""
    hi, lo = nodes["hi"].to_numpy(), nodes["lo"].to_numpy()
    table = NodeSlots(hi, lo)
    slot = table.find(hi, lo)

    def scatter(values) -> np.ndarray:
        flat = np.zeros(len(nodes), np.int64)
        flat[slot] = values
        return flat

    depth = scatter(nodes["depth"])
    parent = scatter(np.where(nodes["depth"] > 0, table.find(nodes["phi"].to_numpy(), nodes["plo"].to_numpy()), -1))
    children, leaves, saved = (scatter(nodes[c]) for c in ("up_children", "up_leaves", "up_saved"))
    saved += scatter((nodes["n_convs"] - 1) * nodes["chars"])
    np.add.at(children, parent[parent >= 0], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    out = nodes[[f.split(" ")[0] for f in _NODE.split(", ")]].copy()
    out["n_children"], out["n_leaves"], out["saved_tokens"] = children[slot], leaves[slot], saved[slot]
    out["top"] = parent[slot] < 0
    return out


def _ends(rows: DataFrame, piece: int) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes in which conversations end."""
    ended = rows.where("depth = total").select("hi", "lo", "conv_id", F.floor(F.col("conv_id") / piece).alias("piece"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ended.groupBy("hi", "lo", "piece").agg(ids.alias("ids")).repartition("hi", "lo").sortWithinPartitions("hi", "lo", "piece")

    def digest(batches):
        node, running = None, None
        for b in batches:
            done = []
            for hi, lo, ids in zip(b["hi"].tolist(), b["lo"].tolist(), b["ids"].tolist()):
                if (hi, lo) != node:
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["hi", "lo", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, running.hexdigest())], columns=["hi", "lo", "ends_sha256"])

    return pieces.mapInPandas(digest, "hi long, lo long, ends_sha256 string")


def trie(rows: DataFrame, block: int = BLOCK, growth: int = GROWTH, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, part, place, key, chars; one row of part 0 per conversation).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    rows = materialize(paths(rows), "trie_paths")
    totals = materialize(rows.groupBy("hi", "lo").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("first"),
        F.sum(F.col("total") - F.col("depth") + 1).alias("weight")), "trie_totals")
    size = totals.agg(F.sum("n_convs").alias("rows"), F.max("weight").alias("weight")).first()
    bounds = [block]
    while bounds[-1] < (size["weight"] or 0):
        bounds.append(bounds[-1] * growth)

    path = join_by_count(rows, totals, ["hi", "lo"], "n_convs", size["rows"] or 0)
    w = Window.partitionBy("conv_id").orderBy("depth")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = [F.first(F.when(F.col("weight") <= b, F.struct("hi", "lo")), ignorenulls=True).over(upto).alias(f"top{i}")
            for i, b in enumerate(bounds)]
    path = path.select("*", F.lag("first").over(w).alias("parent_conv"), *tops).where("conv_id = first")
    level, top = F.lit(len(bounds) - 1), F.col(f"top{len(bounds) - 1}")
    for i in reversed(range(len(bounds) - 1)):
        light = F.col("weight") <= bounds[i]
        level, top = F.when(light, F.lit(i)).otherwise(level), F.when(light, F.col(f"top{i}")).otherwise(top)
    nodes = materialize(path.select(
        "hi", "lo", "phi", "plo", "conv_id", "depth", F.coalesce("parent_conv", F.lit(0)).alias("parent_conv"), "n_convs", "chars",
        level.alias("level"), top.alias("top")), "trie_nodes")
    sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}

    done, carried = [], []
    sums = ["up_children", "up_leaves", "up_saved"]
    for i in range(len(bounds)):
        here = nodes.where(F.col("level") == i)
        if carried:
            ups = carried[0]
            for more in carried[1:]:
                ups = ups.unionByName(more)
            ups = ups.groupBy("hi", "lo").agg(*[F.sum(c).alias(c) for c in sums])
            here = here.join(ups, ["hi", "lo"], "left").fillna(0, sums)
        else:
            here = here.select("*", *[F.lit(0).cast("long").alias(c) for c in sums])
        shards = math.ceil(sizes.get(i, 0) / shard) or 1
        here = here.withColumn("shard", F.pmod(F.xxhash64("top.hi", "top.lo"), F.lit(shards))).drop("level", "top")
        summed = here.groupBy("shard").applyInPandas(
            accumulate, f"{_NODE}, n_children long, n_leaves long, saved_tokens long, top boolean")
        summed = materialize(summed, f"trie_level{i}")
        done.append(summed)
        carried.append(summed.where("top AND depth > 0").select(
            F.col("phi").alias("hi"), F.col("plo").alias("lo"), F.lit(1).cast("long").alias("up_children"),
            F.col("n_leaves").alias("up_leaves"), F.col("saved_tokens").alias("up_saved")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.join(_ends(rows, piece), ["hi", "lo"], "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv")).alias("parent_conv_id"), "n_convs",
                      "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
