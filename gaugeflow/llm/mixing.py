"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of a source are cut into blocks of ``BLOCK`` documents, in the order of a hash of
doc_id. Time runs in slots of one block. With weight w, block j of a source is released at slot
floor(j / w) and has to run before slot ceil((j + 1) / w); among the released blocks the one with
the earliest deadline runs (ties: the smaller source name). For weights that sum to 1 this keeps
every source less than one block away from w·t at every slot t.

Weights are whole shares a of W = their sum, so the schedule repeats every W slots, and only
one period is worked out (a fold over W slots); block j then runs in slot (j div a)·W + its slot in the
period. The mix ends at the first slot whose source has no block left: up to there every source keeps
its weight. By default a source's share follows the 3/4 power of its number of documents (at least 1
of about ``GRAIN``), which lifts small sources; ``weights`` gives other shares.

Documents are numbered within a source piece by piece (a hash cuts every source into pieces of
about ``PIECE`` rows, whose offsets come from their counts), so a source with most of the rows is not ordered in
one task. A null source is a source of its own, sorted first; a source without a given weight does not take part.
Repeated rows each take a place; a null doc_id counts as one more value. An empty table gives an empty mix.
Columns other than doc_id, text and source are not read.

The fold over a period takes (shares) x (sources) steps in one task. It is bounded: above ``MOST_STEPS`` (about 7,000 sources of one share
each) ``mix`` ends with an error that asks for fewer sources or shares; so the schedule that is broadcast has at
most that many rows divided by the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import materialize

BLOCK, GRAIN, PIECE = 16, 1000, 20_000
MOST_STEPS = 50_000_000


def shares(counts: DataFrame, grain: int = GRAIN) -> DataFrame:
    """(source, share) by the three-quarter power of each source's documents (source, n)."""
    root = F.sqrt(F.col("n").cast("double")) * F.sqrt(F.sqrt(F.col("n").cast("double")))
    total = counts.agg(F.sum(root).alias("total")).first()["total"] or 1.0
    return counts.select("source", F.greatest(F.lit(1), F.floor(root * grain / F.lit(total))).cast("long").alias("share"))


def period(weights: DataFrame) -> DataFrame:
    """One period of the schedule: (source, share, nth, slot, slots); one row per slot.

    A fold over the slots holds how many blocks each source has run; each slot takes the released
    source with the earliest deadline."""
    named = weights.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("name"), "source", "share")
    one = named.agg(F.sort_array(F.collect_list(F.struct("name", "source", "share"))).alias("src"),
                    F.sum("share").alias("w"))
    slots = """
      aggregate(sequence(0L, w - 1),
        named_struct('run', transform(src, s -> 0L), 'picks', cast(array() as array<int>)),
        (st, t) -> transform(array(
            array_min(transform(src, (s, i) ->
              if(st.run[i] * w div s.share <= t,
                 named_struct('due', ((st.run[i] + 1) * w + s.share - 1) div s.share, 'i', i), null))).i),
          p -> named_struct('run', transform(st.run, (r, i) -> if(i = p, r + 1, r)),
                            'picks', concat(st.picks, array(p))))[0],
        st -> st.picks)"""
    rows = one.where("w > 0").select("src", "w", F.posexplode(F.expr(slots)).alias("slot", "p"))
    rows = rows.select(F.col("src")[F.col("p")].alias("s"), F.col("slot").cast("long").alias("slot"),
                       F.col("w").alias("slots"))
    nth = F.row_number().over(Window.partitionBy("s.name").orderBy("slot")) - 1
    return rows.select("s.source", "s.share", nth.cast("long").alias("nth"), "slot", "slots")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """doc_id, text hash, source, block, slot, pos and selected of every row of ``docs``.

    ``slot`` is null where the source has no weight; ``selected`` tells whether the slot lies before the end of the mix."""
    rows = docs.select("doc_id", "source", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
                       F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"))
    n = rows.count()
    # a piece is a range of the hash, so the pieces of a source are in order
    width = (1 << 32) // max(1, -(-n // piece)) + 1
    rows = rows.withColumn("piece", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(width)).cast("int"))
    sized = materialize(rows.groupBy("key", "source", "piece").agg(F.count("*").alias("n")), "mix_pieces")
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("key", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counts = sized.groupBy("source").agg(F.sum("n").alias("n"))
    given = shares(counts) if weights is None else weights.select("source", F.col("share").cast("long").alias("share"))
    size = given.where("share > 0").agg(F.count("*").alias("sources"), F.sum("share").alias("shares")).first()
    if size["sources"] * (size["shares"] or 0) > MOST_STEPS:
        raise ValueError(f"{size['sources']} sources with {size['shares']} shares: join small sources or give fewer shares")
    plan = materialize(period(given.where("share > 0")), "mix_period")
    within = F.row_number().over(Window.partitionBy("key", "piece").orderBy("h", "doc_id", "text_hash")) - 1
    placed = rows.withColumn("nth_row", within).join(offsets, ["key", "piece"]).select(
        "doc_id", "source", "text_hash", (F.col("nth_row") + F.col("offset")).alias("at"))
    last = counts.join(F.broadcast(plan.select(F.col("source").alias("p_source"), "share", "nth", "slot", "slots")),
                       F.col("source").eqNullSafe(F.col("p_source")), "left")
    blocks = F.expr(f"(n + {block - 1}) div {block}")
    missing = last.where(F.expr("nth IS NOT NULL") & (blocks % F.col("share") == F.col("nth"))).select(
        F.expr(f"((n + {block - 1}) div {block}) div share * slots + slot").alias("end"))
    if weights is not None:  # a weighted source without any document ends the mix at its first slot
        none = plan.join(counts.select(F.col("source").alias("c")), F.col("source").eqNullSafe(F.col("c")), "left_anti")
        missing = missing.unionByName(none.select(F.col("slot").alias("end")))
    end = missing.agg(F.min("end").alias("end")).first()["end"] or 0
    slot = placed.withColumn("block", F.expr(f"at div {block}"))
    share_of = plan.select(F.col("source").alias("p_source"), "share").distinct()
    slot = slot.join(F.broadcast(share_of), F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    slot = slot.withColumn("nth", F.expr("block % share")).withColumn("lap", F.expr("block div share")).drop("share")
    hits = plan.select(F.col("source").alias("p_source"), F.col("nth").alias("p_nth"), "slot", "slots")
    slot = slot.join(F.broadcast(hits), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("nth") == F.col("p_nth")), "left")
    slot = slot.withColumn("slot", F.expr("lap * slots + slot"))
    return slot.select("doc_id", "source", "text_hash", "block", "slot",
                       F.expr(f"slot * {block} + at % {block}").alias("pos"),
                       F.coalesce(F.col("slot") < F.lit(end), F.lit(False)).alias("selected"))

