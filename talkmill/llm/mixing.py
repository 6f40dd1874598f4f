"""Mixing sessions to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import whole
from talkmill.operators.ordered import Scan, scan
from talkmill.session import cut

#: Weights given to the sessions in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix per word there is, and the most often that a segment may be used.
SHARE = 1.5
PASSES = 2
ROWS_PER_BLOCK = 20_000


def session_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                    passes: int = PASSES) -> DataFrame:
    """Words wanted from every session.

    Reads ``session_id`` and ``source_size`` (words it has); one row per session.  Sessions
    in code point order, null last, get the weights in turn.  A target is its weight's part
    of ``share`` times all words, but at most ``passes`` times the session's own words; what
    that leaves over goes to the other sessions by weight.  This is the time (``level``) at
    which queues served at rates ``weight`` have handed out the whole budget, so it has a
    closed form over the sessions in the order in which their queues run dry: prefix sums
    over ranges of that order, so that no task holds all sessions.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    named = sizes.select("session_id", "source_size", F.col("session_id").isNull().alias("_none"))
    ranked = (scan(_ranges(named, "_none", "session_id"), [], ["_none", "session_id"], "_rng",
                   place=Scan("number")).drop("_rng", "_none").withColumn("weight", weight)
              .withColumn("dry", passes * F.col("source_size") / F.col("weight")))
    by_dry = _ranges(ranked, "dry", "place")
    whole_ = by_dry.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).head()
    words, all_weights = whole_["words"] or 0, whole_["weights"] or 0
    handed = scan(by_dry, [], ["dry", "place"], "_rng",
                  _used=Scan("sum", passes * F.col("source_size"), default=F.lit(0)),
                  _gone=Scan("sum", F.col("weight"), default=F.lit(0)))
    reached = (F.lit(share * words) - F.col("_used")) / (F.lit(all_weights) - F.col("_gone"))
    # The first queue that is not dry when the budget ends gives the time, and later ones give
    # earlier times; if all run dry, the last one does.
    times = handed.select("dry", reached.alias("reached")).agg(
        F.max(F.when(F.col("reached") <= F.col("dry"), F.col("reached"))).alias("ends"),
        F.max("dry").alias("last")).head()
    level = times["last"] if times["ends"] is None else times["ends"]
    return (ranked.withColumn("level", F.lit(level).cast("double"))
            .withColumn("target", F.least((passes * F.col("source_size")).cast("double"),
                                          F.col("level") * F.col("weight")))
            .select("session_id", "weight", "source_size", "level", "target"))


def _ranges(sessions: DataFrame, *order: str) -> DataFrame:
    """One row per session, laid out in ranges of an order, whose numbers are ``_rng``."""
    return cut(sessions.repartitionByRange(*[F.col(c) for c in order])
               .withColumn("_rng", F.spark_partition_id()))


def mix_sessions(segments: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                 passes: int = PASSES, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Queue the segments of all sessions fairly and cut the mix at the word budget.

    Reads ``sequence_id``, ``session_id`` and ``text``.  Returns two tables:

    * all segments: ``sequence_id, session_id, size`` (words), ``source_size``, ``target``,
      ``version`` (hash of the text) and ``row``
    * the mix, range-sorted by ``finish``: ``sequence_id, pass_no, finish, words, place,
      session_id, version, row``.

    ``session_id`` (null-safe) and ``row`` name one row read, also where ids are null or
    repeat: ``row`` is the session's words up to and including it, null if it has none.

    Every session's segments are shuffled (by a seeded hash of the id and text) and queued
    ``passes`` times over.  A copy's virtual finish time is the session's words up to and
    including it divided by the session's weight.  All copies are sorted by that time over
    ranges of it and the mix ends when the budget is used; a copy being served at that
    moment, at most one per session, is cut there (``words`` < size), so that every session
    gives its target to the word.  ``place`` numbers the mix from 1.

    Hot sessions: running totals are prefix scans over hash ranges of a session, so no
    session is ever one task; the only global windows are over one row per range.  Null text and texts without words have size 0 and are never taken; null sessions
    form one session, sorted last; rows repeated with equal id and text follow each other in
    an order of no consequence.  Reruns give the same mix.
    """
    words = F.regexp_count(whole(), F.lit(r"[^ \t-\r]+"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("sequence_id").cast("string")))
    rows = cut(segments.select(
        "sequence_id", "session_id", words.cast("bigint").alias("size"), order.alias("_order"),
        F.xxhash64("text").alias("_tie"),
        F.coalesce(F.concat(F.lit("s"), "session_id"), F.lit("n")).alias("_queue")))
    sizes = rows.groupBy("session_id").agg(F.sum("size").alias("source_size"))
    targets = cut(session_targets(sizes, weights, share, passes).withColumn(
        "_queue", F.coalesce(F.concat(F.lit("s"), "session_id"), F.lit("n"))))
    digits = min(7, max(2, math.ceil(math.log(max(2, rows.count() / ROWS_PER_BLOCK), 16))))
    blocked = rows.withColumn("_blk", F.substring("_order", 1, digits))
    queued = scan(blocked, ["_queue"], ["_order", "_tie"], "_blk",
                  _upto=Scan("sum", F.col("size"), inclusive=True))
    joined = queued.join(targets.drop("session_id"), "_queue")
    segment_rows = joined.select("sequence_id", "session_id", "size", "source_size", "target",
                                 "_order", "_tie", "_queue", "_upto", "weight", "level",
                                 F.col("_tie").alias("version"),
                                 F.when(F.col("size") > 0, F.col("_upto")).alias("row"))
    copies = segment_rows.where(F.col("size") > 0).withColumn(
        "pass_no", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    stop = F.round("target").cast("bigint")
    upto = F.col("_upto") + (F.col("pass_no") - 1) * F.col("source_size")
    taken = F.greatest(F.lit(0), F.least(F.col("size"), stop - (upto - F.col("size"))))
    served = (copies.withColumn("words", taken.cast("bigint")).where(F.col("words") > 0)
              .withColumn("finish", upto / F.col("weight")))
    mix = _in_order(served, 16 ** digits)
    return segment_rows.select("sequence_id", "session_id", "size", "source_size", "target",
                               "version", "row"), mix


def _in_order(served: DataFrame, ranges: int) -> DataFrame:
    """Number the copies by finish time.  Queues are served at constant rates, so equal
    ranges of time hold about equal words."""
    part: Column = F.least(F.col("finish"), F.col("level")) / F.col("level")
    ranged = served.withColumn("_rng", F.floor(part * ranges).cast("bigint"))
    numbered = scan(ranged, [], ["finish", "_queue", "_order", "_tie", "pass_no"], "_rng",
                    place=Scan("number"))
    return numbered.select("sequence_id", "pass_no", "finish", "words", "place", "session_id",
                           "version", "row")
