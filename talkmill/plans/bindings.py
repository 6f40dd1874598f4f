"""Binds the shared test tables to the domain tables, in Spark and as SQL for the checker.

All times are whole milliseconds before they become seconds, so sums are exact in any
order.  Domain tables are returned with the name of their block column (or None), see
:mod:`talkmill.operators.ordered`.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.ordered import ROWS_PER_FOLD, Scan, scan, split_hot

PIECES_PER_TURN = 1 << 20
#: About the lines of a turn, for blocks that folds can take.
LINES_PER_TURN = 16


class Timed(NamedTuple):
    df: DataFrame
    blk: str | None


#: Spark makes no smaller scan tasks than this.
SPLIT_BYTES = 4 << 20

#: Bytes of a share of a table that is spread.
SPREAD_BYTES = 1 << 20

#: Tables whose rows cost much CPU each, with the column that spreads them.
HEAVY = {"documents": "doc_id", "conversations": "conv_id", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  One small file is one task, so small text tables are spread over the
    idle cores first; Spark splits a larger table by itself.  The size comes from the plan's
    statistics, without a list of files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < cores * SPLIT_BYTES:
            return df.repartition(cores, HEAVY[name])
    return df


def spread(df: DataFrame, by: str) -> DataFrame:
    """Rows that cost much CPU each, in shares that stay small whatever the files' row groups;
    their number grows with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(size / SPREAD_BYTES)), by)


def _pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.,!?])\s+", "$1\n"), "\n")


def raw_segments(spark: SparkSession, sf_dir: str) -> Timed:
    """Recognised lines of every conversation, without times."""
    turns, blk = split_hot(table(spark, sf_dir, "conversations"), ["conv_id"], "turn",
                           ROWS_PER_FOLD // LINES_PER_TURN)
    keep = [blk] if blk else []
    c, t, j = F.col("conv_id"), F.col("turn"), F.col("j").cast("bigint")
    lines = turns.select("conv_id", "turn", "role", *keep,
                         F.posexplode(_pieces(F.col("text"))).alias("j", "piece"))
    lines = lines.where(F.trim("piece") != "")
    language = F.element_at(F.array(*map(F.lit, ["en", "ja", "ko", "hi", "zh"])),
                            (c % 5 + 1).cast("int"))
    bare = F.regexp_replace(F.trim("piece"), "[.,]+$", "")
    ended = (t * 3 + j) % 4 == 0
    lines = lines.withColumn("language", language).withColumn(
        "text", F.when((F.col("language") == "ja") & ended, F.concat(bare, F.lit("です")))
        .when((F.col("language") == "ko") & ended, F.concat(bare, F.lit("습니다")))
        .otherwise(F.trim("piece")))
    df = lines.select(
        c.alias("session_id"), F.when(j < PIECES_PER_TURN, t * PIECES_PER_TURN + j).otherwise(
            F.raise_error("a turn has too many pieces").cast("bigint")).alias("seq"), *keep,
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1)
        .alias("speaker"),
        "role", "text", "language",
        F.when((j % 7).isin(3, 4, 5), "en").otherwise(F.col("language")).alias("detected"),
        ((c * 31 + t * 17 + j * 7) % 100 / 100.0).alias("language_probability"),
        F.when((c + t + j) % 11 != 0, -((c * 13 + t * 7 + j * 3) % 200) / 100.0)
        .alias("avg_logprob"),
        F.when((c + t + j) % 13 != 0, (c * 19 + t * 11 + j * 5) % 100 / 100.0)
        .alias("no_speech_prob"),
        (F.lit(1.0) + (c + t * 5 + j * 3) % 20 / 10.0).alias("compression_ratio"),
        F.when((c + j) % 5 != 0, (c * 7 + t * 3 + j) % 100 / 100.0).alias("confidence"),
        F.greatest(F.lit(350), F.floor(F.char_length("text") * 1000 / 14)).cast("bigint")
        .alias("dur_ms"),
        (100 * ((c * 7 + t * 3 + j * 5) % 12)).cast("bigint").alias("pause_ms"))
    return Timed(df, blk)


def segments(spark: SparkSession, sf_dir: str) -> Timed:
    """Timed segments: every line follows the one before it after its pause."""
    raw, blk = raw_segments(spark, sf_dir)
    timed = scan(raw, ["session_id"], ["seq"], blk, end_ms=Scan(
        "sum", F.col("dur_ms") + F.col("pause_ms"), inclusive=True))
    start = F.col("end_ms") - F.col("dur_ms")
    return Timed(timed.withColumn("start_ms", start)
                 .withColumn("start_s", start / 1000.0)
                 .withColumn("end_s", F.col("end_ms") / 1000.0), blk)


SEG = r"""
seg_line AS (
  SELECT conv_id, turn, role, trim(unnest(l)) AS piece, unnest(range(len(l))) AS j FROM (
    SELECT conv_id, turn, role, string_split(
      regexp_replace(text, '([.,!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS l
    FROM conversations)),
seg_lang AS (
  SELECT *, ['en','ja','ko','hi','zh'][conv_id % 5 + 1] AS language,
    regexp_replace(piece, '[.,]+$', '') AS bare
  FROM seg_line WHERE piece <> ''),
seg_text AS (
  SELECT *, CASE WHEN language = 'ja' AND (turn * 3 + j) % 4 = 0 THEN bare || 'です'
    WHEN language = 'ko' AND (turn * 3 + j) % 4 = 0 THEN bare || '습니다'
    ELSE piece END AS text FROM seg_lang),
seg_raw AS (
  SELECT conv_id AS session_id, turn * 1048576 + j AS seq,
    CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS speaker, role, text, language,
    CASE WHEN j % 7 IN (3, 4, 5) THEN 'en' ELSE language END AS detected,
    ((conv_id*31 + turn*17 + j*7) % 100) / 100e0 AS language_probability,
    CASE WHEN (conv_id + turn + j) % 11 <> 0
      THEN -((conv_id*13 + turn*7 + j*3) % 200) / 100e0 END AS avg_logprob,
    CASE WHEN (conv_id + turn + j) % 13 <> 0
      THEN ((conv_id*19 + turn*11 + j*5) % 100) / 100e0 END AS no_speech_prob,
    1e0 + ((conv_id + turn*5 + j*3) % 20) / 10e0 AS compression_ratio,
    CASE WHEN (conv_id + j) % 5 <> 0
      THEN ((conv_id*7 + turn*3 + j) % 100) / 100e0 END AS confidence,
    greatest(350, (length(text) * 1000) // 14) AS dur_ms,
    100 * ((conv_id*7 + turn*3 + j*5) % 12) AS pause_ms
  FROM seg_text),
seg AS (
  SELECT *, (end_ms - dur_ms) AS start_ms, (end_ms - dur_ms) / 1000e0 AS start_s,
    end_ms / 1000e0 AS end_s
  FROM (SELECT *, CAST(sum(dur_ms + pause_ms) OVER (
          PARTITION BY session_id ORDER BY seq) AS BIGINT) AS end_ms FROM seg_raw))
"""


def windows(spark: SparkSession, sf_dir: str, step_ms: int = 2000) -> Timed:
    """Classifier windows on the same clock: each segment makes the windows it starts."""
    seg, blk = segments(spark, sf_dir)
    ceil = lambda ms: F.floor((ms + (step_ms - 1)) / step_ms)
    first = ceil(F.col("start_ms") - F.col("pause_ms"))
    last = ceil(F.col("end_ms")) - 1
    w = seg.where(last >= first).select(
        "session_id", *([blk] if blk else []), F.explode(F.sequence(first, last)).alias("w"))
    s, n = F.col("session_id"), F.col("w")
    from talkmill import dims
    scores = F.map_from_arrays(
        F.array(*map(F.lit, dims.CATEGORIES)),
        F.array(*[(s * (k + 3) * 7 + n * (k * 5 + 11)) % 101 / 100.0 for k in range(7)]))
    return Timed(w.select(
        "session_id", *([blk] if blk else []), "w",
        (n * step_ms / 1000.0).alias("start_s"), ((n + 1) * step_ms / 1000.0).alias("end_s"),
        ((s * 5 + n * 3) % 6 != 0).alias("vad_speech"),
        ((s * 11 + n * 7) % 100 / 100.0).alias("vad_confidence"),
        scores.alias("scores")), blk)


_SCORES = ", ".join(f"((session_id*{(k + 3) * 7} + w*{k * 5 + 11}) % 101) / 100e0 AS s{k}"
                    for k in range(7))
WIN = SEG + f"""
, win AS (
  SELECT session_id, w, w * 2e0 AS start_s, (w + 1) * 2e0 AS end_s,
    (session_id*5 + w*3) % 6 <> 0 AS vad_speech,
    ((session_id*11 + w*7) % 100) / 100e0 AS vad_confidence, {_SCORES}
  FROM (SELECT session_id, unnest(range((start_ms - pause_ms + 1999) // 2000,
                                        (end_ms + 1999) // 2000)) AS w FROM seg))
"""
GATE = WIN + """
, win_top AS (
  SELECT *, greatest(s1,s2,s3,s4,s5) AS other, greatest(s1,s2,s3,s4,s5,s6) AS any_other FROM win),
gate AS (
  SELECT session_id, w, start_s, end_s, vad_speech,
    CASE WHEN NOT vad_speech THEN false WHEN s0 >= 0.35e0 THEN true
      WHEN other >= 0.6e0 THEN false ELSE true END AS should_transcribe,
    CASE WHEN NOT vad_speech THEN CASE WHEN any_other >= 0.6e0 THEN CASE any_other
        WHEN s1 THEN 'VOCAL_NON_SPEECH' WHEN s2 THEN 'MUSIC' WHEN s3 THEN 'SFX'
        WHEN s4 THEN 'BACKGROUND' WHEN s5 THEN 'SILENCE' ELSE 'UNKNOWN' END ELSE 'SILENCE' END
      WHEN s0 >= 0.35e0 THEN 'DIALOGUE'
      WHEN other >= 0.6e0 THEN CASE other
        WHEN s1 THEN 'VOCAL_NON_SPEECH' WHEN s2 THEN 'MUSIC' WHEN s3 THEN 'SFX'
        WHEN s4 THEN 'BACKGROUND' ELSE 'SILENCE' END
      ELSE 'UNKNOWN' END AS event_type,
    CASE WHEN NOT vad_speech THEN
        CASE WHEN any_other >= 0.6e0 THEN any_other ELSE 1 - vad_confidence END
      WHEN s0 >= 0.35e0 THEN s0 WHEN other >= 0.6e0 THEN other
      ELSE 1 - greatest(s0, other) END AS confidence,
    CASE WHEN NOT vad_speech THEN 'vad:no_speech' WHEN s0 >= 0.35e0 THEN 'dialogue'
      WHEN other >= 0.6e0 THEN 'non_speech' ELSE 'uncertain' END AS reason
  FROM win_top)
"""


def gate(spark: SparkSession, sf_dir: str) -> Timed:
    from talkmill.operators.rules import gate_decision

    w, blk = windows(spark, sf_dir)
    verdict = gate_decision(F.col("vad_confidence"), F.col("vad_speech"), F.col("scores"))
    return Timed(w.withColumn("_v", verdict).select(
        "session_id", *([blk] if blk else []), "w", "start_s", "end_s", "vad_speech", "_v.*"),
        blk)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a UTC timestamp, a whole-microsecond clock and seconds from the value."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type", "value", "props",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.col("value") / 100).alias("seconds"))


def user_events(spark: SparkSession, sf_dir: str) -> Timed:
    """Events as per-user sessions in time order."""
    return Timed(*split_hot(event_rows(spark, sf_dir), ["user_id"], "us"))


EVT = """
evt AS (SELECT event_id, user_id, event_type, value, props, ts, epoch_us(ts) AS us,
  value / 100e0 AS seconds FROM events)
"""
