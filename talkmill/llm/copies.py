"""Exact copies of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import whole
from talkmill.session import cut

#: Counters of the frequency sketch, and frequent digests that may be broadcast.
TRACKED = 4096
FREQUENT = 1000
#: Sketches that meet in the last merge.
LANES = 256


def exact_copies(segments: DataFrame, tracked: int = TRACKED, frequent: int = FREQUENT
                 ) -> DataFrame:
    """Group segments whose texts are equal without ASCII white space.

    Reads ``sequence_id`` and ``text``.  Returns one row per row read: ``sequence_id``,
    ``keep_id`` (the segment that stays: most code points, then smallest ``sequence_id``),
    ``group_size``, ``kept`` and ``text_sha256`` (of the text without white space).

    Groups of any size: a Misra-Gries sketch (``approx_top_k``) per task, merged in lanes,
    names digests that may be frequent.  Their groups are counted exactly with map-side
    partial aggregates; the winners, at most ``frequent`` rows, are broadcast and settle
    their copies without a shuffle.  Only the other digests are shuffled, as narrow rows.

    A null text counts as empty, and empty texts are copies of each other.  A null id sorts
    last.  Of rows that repeat an id in one group the longest may stay, of equally long ones one
    text; rows that are equal in both stay or go together.  An empty table gives an
    empty result.
    """
    rows = cut(segments.select(
        "sequence_id",
        F.sha2(F.regexp_replace(whole(), r"[ \t-\r]+", ""), 256).alias("text_sha256"),
        F.char_length(whole()).alias("_chars"), F.xxhash64(whole()).alias("_version")))
    winners = _frequent_winners(rows, tracked, frequent)
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    copies = Window.partitionBy("text_sha256")
    rest = marked.where(F.col("group_size").isNull()).withColumns({
        "best": F.min(_rank()).over(copies), "group_size": F.count(F.lit(1)).over(copies)})
    return _settled(marked.where(F.col("group_size").isNotNull()).unionByName(rest))


def _settled(rows: DataFrame) -> DataFrame:
    """A row stays if it is the best of its group, in its id and in its text."""
    best = ((F.col("sequence_id").eqNullSafe(F.col("best.id")))
            & (F.col("_version") == F.col("best.version")))
    return rows.select("sequence_id", F.col("best.id").alias("keep_id"), "group_size",
                       best.alias("kept"), "text_sha256")


def _rank() -> Column:
    return F.struct((-F.col("_chars")).alias("chars"),
                    F.col("sequence_id").isNull().alias("missing"),
                    F.col("sequence_id").alias("id"), F.col("_version").alias("version"))


def _frequent_winners(rows: DataFrame, tracked: int, frequent: int) -> DataFrame:
    """``text_sha256, keep_id, group_size`` of the frequent digests, exactly counted."""
    keyed = rows.withColumn("_key", F.xxhash64("text_sha256"))
    sketches = (keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("_lane"))
                .agg(F.expr(f"approx_top_k_accumulate(_key, {tracked})").alias("sketch")))
    # Grouped by a constant: without a key, tasks that have no sketch fail in the merge.
    named = sketches.groupBy(F.lit(0).alias("_all")).agg(F.expr(
        f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {frequent})")
        .alias("top")).select(F.explode("top.item").alias("_key"))
    suspects = keyed.join(F.broadcast(named), "_key", "left_semi")
    counted = suspects.groupBy("text_sha256").agg(
        F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return cut(counted.where(F.col("group_size") > 1))
