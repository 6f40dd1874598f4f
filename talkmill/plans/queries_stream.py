"""H: the ordered rules as streams over the event and conversation files.

Each query runs its stream to the end of the files and returns the written table, checked
by the same SQL as its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.operators import segmentation as S
from talkmill.plans import bindings as B
from talkmill.plans.queries_live import DELAY, END_MS, timed_feed
from talkmill.plans.queries_telemetry import SNAP, snapshots
from talkmill.plans.queries_time import HYST, KEY, UNITS
from talkmill.plans.registry import query
from talkmill.session import shared_folder
from talkmill.streaming import jobs as SJ
from talkmill.streaming import processors as SP


def _second(order: str):
    """An event time that runs with the order of a session's rows: a minute a turn."""
    return F.timestamp_seconds(F.floor(F.col(order) / B.PIECES_PER_TURN) * 60 + 60)


def _ending(feed, fold, order: list[str]):
    """A fold whose sessions end, and free their state, when they have been silent for long."""
    return SP.stream_fold(feed, fold, KEY, order, event_time="ts", delay=DELAY,
                          quiet_ms=END_MS, end_ms=END_MS)


def _with_end(feed, order: str):
    """Each session's feed plus one row that ends it."""
    last = feed.groupBy("session_id").agg((F.max(order) + 1).alias(order))
    return feed.withColumn(SP.END, F.lit(False)).unionByName(
        last.withColumn(SP.END, F.lit(True)), allowMissingColumns=True)


@query("h01_stream_stable_spans", f"""
WITH RECURSIVE {SNAP}, e AS (SELECT *, unnest(fresh) AS l, unnest(range(len(fresh))) AS i FROM st)
SELECT session_id, snap, n - len(fresh) + i + 1 AS stable_seq, l.t AS text, l.a AS start_s, l.b AS end_s,
  rev AS revision, back AS rolled_back FROM e
UNION ALL SELECT session_id, snap, -1, '', -1e0, -1e0, rev, true FROM st WHERE back AND len(fresh) = 0""")
def stable_spans(spark, sf_dir):
    s, _ = snapshots(spark, sf_dir)
    feed = s.select("session_id", "snap", "lines", _second("snap").alias("ts"))
    out = SJ.drain(_ending(timed_feed(spark, feed, "session_id"), S.SNAPSHOTS, ["snap"]))
    return out.fillna({"stable_seq": -1, "text": "", "start_s": -1.0, "end_s": -1.0})


@query("h03_stream_units", f"""
WITH RECURSIVE {UNITS}
SELECT session_id, unit, text, start_s, end_s, coalesce(speaker, -1) AS speaker, language, reason
FROM units""")
def stream_units(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    feed = S.with_profiles(seg.select("session_id", "seq", "text", "start_s", "end_s", "speaker",
                                      "language"), dims.lang_profiles(spark))
    feed = _with_end(feed, "seq").withColumn("ts", _second("seq"))
    out = SJ.drain(_ending(timed_feed(spark, feed, "session_id"), S.UNITS, ["seq"]))
    return out.withColumn("speaker", F.coalesce("speaker", F.lit(-1)))


@query("h03_stream_language", f"""
WITH RECURSIVE {HYST}
SELECT session_id, seq, coalesce(cur, '') AS stable, switched FROM hy WHERE rn > 0""")
def stream_language(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    feed = seg.select("session_id", "seq", "detected",
                      F.col("language_probability").alias("probability"),
                      (F.col("dur_ms") / 1000.0).alias("seconds"), _second("seq").alias("ts"))
    out = SJ.drain(_ending(timed_feed(spark, feed, "session_id"), S.language_fold(), ["seq"]))
    return out.withColumn("stable", F.coalesce("stable", F.lit("")))


_NTZ = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark, sf_dir):
    return _stages(spark.readStream.schema(_NTZ).option("pathGlobFilter", "events.parquet")
                   .parquet(sf_dir))


def _stages(raw):
    return raw.select("event_id", "user_id", "event_type", F.col("event_type").alias("stage"),
                      F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100)
                      .alias("seconds"))


def closed_stream(spark, sf_dir):
    """The event stream and one row, 40 days on, that marks the end of the feed: it moves
    the watermark past all windows and sessions, and its own are never written."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{shared_folder(spark)}/feeds/{uuid.uuid4().hex}"
    last = events.agg((F.max("ts") + F.expr("interval 40 days")).alias("ts"))
    last.select(F.lit(-1).cast("bigint").alias("event_id"), "ts",
                F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"),
                F.lit(0.0).alias("value"), F.lit("{}").alias("props")).write.parquet(folder)
    end = spark.readStream.schema(_NTZ).parquet(folder)
    return event_stream(spark, sf_dir).unionByName(_stages(end))


@query("h08_stream_sliding_latency", f"""
WITH {B.EVT}, k AS (SELECT *, unnest(range(0, 12)) AS i FROM evt)
SELECT (us // 3600000000 - i) * 3600 AS window_start, event_type AS stage, count(*) AS n,
  round(avg(seconds), 10) AS mean, max(seconds) AS worst FROM k GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    """Append mode, all windows: the end of the feed closes the last ones."""
    out = SJ.drain(SP.sliding_latency(closed_stream(spark, sf_dir), "ts", "1 hour", "12 hours",
                                      "1 hour"))
    return out.select(F.unix_seconds("window.start").alias("window_start"), "stage", "n",
                      F.round("mean", 10).alias("mean"), "worst")


@query("h09_stream_utterances", f"""
WITH {B.EVT}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 14400000000 THEN 0 ELSE 1 END AS o
  FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM g)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_utterances(spark, sf_dir):
    out = SJ.drain(SP.utterances(closed_stream(spark, sf_dir), "ts", ["user_id"], "4 hours"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("h10_stream_deduplicated", """
SELECT user_id, event_type, hour, count(*) AS n FROM (SELECT DISTINCT user_id, event_type,
  date_trunc('day', ts)::DATE::VARCHAR AS hour, event_id FROM events) GROUP BY ALL""")
def stream_deduplicated(spark, sf_dir):
    """The event file read twice as one stream; every event must count once."""
    once = event_stream(spark, sf_dir)
    both = once.unionByName(event_stream(spark, sf_dir))
    out = SJ.drain(SP.deduplicated(both, "ts", "40 days", ["event_id"]))
    return out.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("hour")
                       ).agg(F.count("*").alias("n"))
