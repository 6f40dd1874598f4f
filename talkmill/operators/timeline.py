"""Placement on a timeline: closed forms of sequential rules, as prefix scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import text as X
from talkmill.operators.ordered import Scan, islands, scan


def place(clips: DataFrame, key: list[str], order: list[str], blk: str | None,
          min_gap: float = 0.05) -> DataFrame:
    """Start every clip at its source time, or after the clip before it plus a gap.

    ``actual_i = max(start_i, end_{i-1} + gap)`` unrolls to ``P_i + max_{k<=i}(start_k -
    P_k)`` with ``P_i`` the sum of earlier durations and gaps.  Clips have positive length.
    """
    used = clips.where(F.col("duration") > 0)
    shifted = scan(used, key, order, blk, _p=Scan(
        "sum", F.col("duration") + min_gap, default=F.lit(0.0)))
    led = scan(shifted, key, order, blk, _m=Scan(
        "max", F.col("start_s") - F.col("_p"), inclusive=True))
    actual = F.col("_p") + F.col("_m")
    return (led.withColumn("actual_start", actual)
            .withColumn("drift", F.col("actual_start") - F.col("start_s")).drop("_p", "_m"))


def backlog(clips: DataFrame, key: list[str], order: list[str], blk: str | None,
            limit: float = 6.0) -> DataFrame:
    """Seconds of audio queued after each emission, and whether that is too much."""
    length = F.greatest(F.lit(0.0), F.col("duration"))
    shifted = scan(clips, key, order, blk, _p=Scan("sum", length, default=F.lit(0.0)))
    led = scan(shifted, key, order, blk, _m=Scan(
        "max", F.col("at") - F.col("_p"), inclusive=True))
    head = F.col("_p") + F.col("_m") + length
    return (led.withColumn("backlog_s", head - F.col("at")).drop("_p", "_m")
            .withColumn("overloaded", F.col("backlog_s") >= limit))


def fit(raw: Column, source: Column, rate: Column, native_rate: Column,
        max_rate: float = 1.20, min_rate: float = 0.85, tolerance: float = 0.15,
        regenerate: bool = True) -> Column:
    """Struct (method, rate, final_duration, mismatch): how a clip is made to fit."""
    asked = F.greatest(F.lit(min_rate), F.least(F.lit(max_rate), rate))
    source = F.greatest(F.lit(0.0), source)
    ratio = raw / F.when(source > 0, source)
    factor = F.least(ratio, F.lit(max_rate) / F.greatest(asked, F.lit(1e-3)))
    fits = (source <= 0) | (raw <= 0) | (ratio <= 1.0 + tolerance)
    again = F.lit(regenerate) & native_rate
    method = (F.when(fits, "none").when(factor <= 1.01, "capped").when(again, "regenerate")
              .otherwise("time_stretch"))
    changed = method.isin("regenerate", "time_stretch")
    final = F.when(changed, raw / factor).otherwise(raw)
    return F.struct(
        method.alias("method"),
        F.when(method == "regenerate", F.least(F.lit(max_rate), asked * factor))
        .when(method == "time_stretch", factor).otherwise(asked).alias("rate"),
        final.alias("final_duration"),
        F.when(source > 0, final / F.when(source > 0, source)).otherwise(0.0)
        .alias("mismatch"))


def trim_cues(cues: DataFrame, key: list[str], order: list[str], blk: str | None) -> DataFrame:
    """End a cue just before the next one starts, but show it at least 0.3 seconds."""
    ahead = scan(cues, key, order, blk, _next=Scan("lead", F.col("start_s")))
    return ahead.withColumn("end_s", F.when(
        F.col("end_s") > F.col("_next"),
        F.greatest(F.col("start_s") + 0.3, F.col("_next") - 0.01)).otherwise(F.col("end_s"))
        ).drop("_next")


def group_text_events(events: DataFrame, key: list[str], order: list[str], blk: str | None,
                      total: Column, max_gap: float = 1.5) -> DataFrame:
    """Group streamed text pieces into cues by gaps and sentence ends.

    ``events``: key, ``t`` seconds, ``text``, ``finished``; ``total`` is the length of the
    source.  A cue ends 1.5 s after its last piece, at least 1 s after its start, and never
    after the next cue starts.
    """
    said = events.where(~X.blank("text")).withColumn("text", X.strip("text"))
    closed = F.col("text").rlike("[.!?。！？]$") | F.coalesce("finished", F.lit(False))
    prior = scan(said.withColumn("_closed", closed).withColumn("_total", total),
                 key, order, blk, _p=Scan("lag", F.struct("t", "_closed")))
    opens = F.col("_p").isNull() | (F.col("t") - F.col("_p.t") > max_gap) | F.col("_p._closed")
    runs = islands(prior, key, order, blk, opens, "cue")
    cues = runs.groupBy(*key, "cue").agg(
        F.min("t").alias("start_s"), F.max("t").alias("_last"), F.max("_total").alias("_total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))),
                                 lambda x: x["text"]), " ").alias("text"),
        *([F.min(blk).alias(blk)] if blk else []))
    ahead = scan(cues, key, ["cue"], blk, _next=Scan("lead", F.col("start_s")))
    end = F.least(F.greatest(F.col("_last") + 1.5, F.col("start_s") + 1.0),
                  F.coalesce("_next", F.col("_total") + 1.5))
    return ahead.select(
        *key, "cue", F.round("start_s", 3).alias("start_s"), F.round(end, 3).alias("end_s"),
        F.regexp_replace("text", r"\s+([,.!?;:])", "$1").alias("text"))


def sample_clock(chunks: DataFrame, key: list[str], order: list[str], blk: str | None
                 ) -> DataFrame:
    """Start of every chunk on the sample clock: the sum of the samples before it."""
    counted = scan(chunks, key, order, blk, _before=Scan(
        "sum", F.col("samples"), default=F.lit(0)))
    return counted.withColumn("start_s", F.col("_before") / F.col("sample_rate")).drop("_before")


def fixed_blocks(signals: DataFrame, seconds: float) -> DataFrame:
    """Cut (``samples``, ``sample_rate``) signals into blocks of a fixed length."""
    size = F.greatest(F.lit(1), F.floor(F.col("sample_rate") * seconds)).cast("bigint")
    cut = signals.where(F.col("samples") > 0).withColumn("_size", size)
    cut = cut.withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("samples") - 1) / F.col("_size")))))
    first = F.col("block") * F.col("_size")
    return cut.withColumns({
        "first_sample": first,
        "block_samples": F.least(F.col("_size"), F.col("samples") - first)}).drop("_size")


def number_rows(rows: DataFrame, key: list[str], order: list[str], blk: str | None,
                name: str = "sequence_id") -> DataFrame:
    """Dense sequence numbers from 1 per key."""
    return scan(rows, key, order, blk, **{name: Scan("number")})
