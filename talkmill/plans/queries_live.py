"""H: live operators with state of their own, over feeds in time order.

Each query runs its stream to the end of a feed and is checked by the SQL of its batch twin.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.operators import segmentation as S
from talkmill.plans import bindings as B
from talkmill.plans import queries_telemetry as Q
from talkmill.plans.queries_time import KEY, UNITS
from talkmill.plans.registry import query
from talkmill.session import discard, shared_folder
from talkmill.streaming import jobs as SJ
from talkmill.streaming import live as L
from talkmill.streaming import processors as SP

SLICES = 3
SLICE = "_slice"
#: Rows of one key that a trigger may bring, and of a slice that a file holds, about.
ROWS_PER_TRIGGER = 100_000
ROWS_PER_FILE = 250_000
#: The same where a trigger's rows of a key don't meet in one task.
PACKED_ROWS_PER_TRIGGER = 1_000_000
MOST_FILES = 64
DAYS = 24 * 3600 * 1000
#: The feeds span a month at most, which is how far a file may be behind the one before it.
DELAY = "40 days"
QUIET_MS = 45 * DAYS
END_MS = 50 * DAYS


def timed_feed(spark, rows, key: str | list[str], ts: str = "ts", slices: int = SLICES,
               most: int = ROWS_PER_TRIGGER, keys_a_file: int = 8):
    """Write rows in slices of time and open them as a stream, a slice or so per trigger.

    The rows are made once.  There are more slices where a key has more than ``most`` rows in
    one, so that what a key brings in a trigger is bounded, and a slice has the more files the
    more rows and keys it has.  A key's rows of a slice share a file, so no key's rows pass
    each other.  A last row without values, of key -1 and far in the future, moves the
    watermark past everything, so that timers show what time alone decides.
    """
    key = [key] if isinstance(key, str) else key
    root = f"{shared_folder(spark)}/feeds/{uuid.uuid4().hex}"
    folder = f"{root}/feed"
    schema = rows.schema
    micros = F.unix_micros(ts)
    rows.where(F.col(ts).isNotNull()).write.parquet(f"{root}/rows")
    made = spark.read.schema(schema).parquet(f"{root}/rows")
    keys = made.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    sizes = keys.agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("keys"),
                     F.max("n").alias("largest"), F.sum("n").alias("n")).head()
    if sizes["last"] is not None:
        slices = max(slices, math.ceil(sizes["largest"] / most))
        files = max(2, min(MOST_FILES, sizes["keys"] // keys_a_file,
                           math.ceil(sizes["n"] / slices / ROWS_PER_FILE)))
        shares = [i / slices for i in range(1, slices)]
        cuts = made.agg(F.percentile_approx(micros, shares, max(1000, 20 * slices)).alias("cuts")
                        ).head()["cuts"]
        edges = F.array(*[F.lit(c) for c in sorted(set(cuts))])
        made.withColumn(SLICE, F.size(F.filter(edges, lambda c: c < micros))).write.partitionBy(
            SLICE).parquet(f"{root}/slices")
        cut_ = spark.read.schema(T.StructType([*schema.fields, T.StructField(
            SLICE, T.IntegerType())])).parquet(f"{root}/slices")
        for number in range(len(set(cuts)) + 1):
            cut_.where(F.col(SLICE) == number).drop(SLICE).repartition(files, *key).write.mode(
                "append").parquet(folder)
        discard(spark, f"{root}/slices")
    else:
        files = 2
    discard(spark, f"{root}/rows")
    end = spark.range(1).select(*[
        F.lit(-1).cast(f.dataType).alias(f.name) if f.name == key[0] else
        (F.coalesce(F.lit(sizes["last"]), F.current_timestamp()) + F.expr("interval 400 days"))
        .alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields])
    end.write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("h02_stream_line_deltas", f"""
WITH RECURSIVE {Q.DELTA}
SELECT session_id, seq, delta, round(a, 6) AS start_s, round(b, 6) AS end_s, rev AS revisions
FROM dl WHERE delta <> ''""")
def stream_line_deltas(spark, sf_dir):
    g, blk = Q.growing_lines(spark, sf_dir)
    g = (g.drop(blk) if blk else g).withColumn("ts", F.timestamp_millis(
        F.floor(F.col("end_s") * 1000).cast("bigint")))
    out = SJ.drain(L.line_deltas(timed_feed(spark, g, "session_id"), KEY, ["seq"], "ts",
                                 delay=DELAY, end_ms=END_MS))
    return out.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


#: Silence after which what is pending is given out, and the pause planted after every third
#: turn of a session.
SILENCE_MS = 20_000
PLANTED_MS = 60_000
_SILENT = UNITS.replace(
    "CASE WHEN r.text <> '' AND r.last IS NOT NULL",
    f"CASE WHEN r.text <> '' AND f.gap >= {SILENCE_MS} THEN {{'t': r.text, 'a': r.a, 'b': r.b, "
    "'s': r.spk, 'l': r.lang, 'r': 'silence'} WHEN r.text <> '' AND r.last IS NOT NULL").replace(
    "SELECT s.session_id, s.text, s.start_s,",
    f"SELECT s.session_id, s.end_ms + {PLANTED_MS} * (s.seq // 1048576 // 3) - lag(s.end_ms + "
    f"{PLANTED_MS} * (s.seq // 1048576 // 3)) OVER (PARTITION BY s.session_id ORDER BY s.seq) "
    "AS gap, s.text, s.start_s,")


@query("h03_stream_silence", f"""
WITH RECURSIVE {_SILENT}
SELECT session_id, unit, text, start_s, end_s, coalesce(speaker, -1) AS speaker, language,
  CASE reason WHEN 'end_of_file' THEN 'silence' ELSE reason END AS reason FROM units""")
def stream_silence(spark, sf_dir):
    """No row says that a session fell silent or ended; only event time does."""
    seg, _ = B.segments(spark, sf_dir)
    arrival = F.col("end_ms") + PLANTED_MS * F.floor(
        F.floor(F.col("seq") / B.PIECES_PER_TURN) / 3)
    feed = S.with_profiles(
        seg.select("session_id", "seq", "text", "start_s", "end_s", "speaker", "language",
                   F.timestamp_millis(arrival.cast("bigint")).alias("ts")),
        dims.lang_profiles(spark))
    out = SJ.drain(SP.stream_fold(timed_feed(spark, feed, "session_id"), S.UNITS, KEY, ["seq"],
                                  event_time="ts", delay=DELAY, quiet_ms=SILENCE_MS,
                                  end_ms=END_MS))
    return out.withColumn("speaker", F.coalesce("speaker", F.lit(-1)))


@query("h04_stream_gate", f"""
WITH RECURSIVE {Q.GATED}
SELECT user_id, seq, win, passed, CASE WHEN passed THEN event_type ELSE '' END AS payload FROM v""")
def stream_gate(spark, sf_dir):
    e, _ = B.user_events(spark, sf_dir)
    chunks = e.select(
        "user_id", "us", F.col("event_id").alias("seq"), "ts",
        ((100 + F.col("event_id") % 4 * 50) / 1000.0).alias("duration"),
        F.col("value").alias("score"), F.col("event_type").alias("payload"))
    return SJ.drain(L.gated(timed_feed(spark, chunks, "user_id"), ["user_id"], ["us", "seq"],
                            "ts", least=60.0, delay=DELAY, quiet_ms=QUIET_MS, end_ms=END_MS))


@query("h05_stream_reorder", f"""
WITH RECURSIVE {B.EVT}, {Q.RELEASES} SELECT user_id, seq, outcome, released_at, place FROM released""")
def stream_reorder(spark, sf_dir):
    a, blk = Q.arrivals(spark, sf_dir)
    clips = (a.drop(blk) if blk else a).drop("event_id").withColumn(
        "ts", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("bigint")))
    out = SJ.drain(L.reordered(timed_feed(spark, clips, "user_id"), ["user_id"], "ts",
                               delay=DELAY, end_ms=END_MS))
    return out.select("user_id", "seq", "outcome", F.round("at", 3).alias("released_at"), "place")


@query("h07_stream_decision_history", f"""
WITH {Q.HISTORY}
SELECT session_id, span, held, event_type, should_transcribe, confidence FROM hist""")
def stream_decision_history(spark, sf_dir):
    windows, spans = Q.gate_history(spark, sf_dir)
    feed = windows.drop("reason").withColumns({"kind": F.lit(0), "span": F.lit(None).cast("bigint")}
                                              ).unionByName(spans.withColumn("kind", F.lit(1)),
                                                            allowMissingColumns=True)
    out = SJ.drain(L.remembered_verdicts(timed_feed(spark, feed, "session_id"), KEY,
                                         ["n", "kind"], "ts", delay=DELAY, end_ms=END_MS))
    return out.select(
        "session_id", "span", "held", F.coalesce("event_type", F.lit("none")).alias("event_type"),
        F.coalesce("should_transcribe", F.lit(False)).alias("should_transcribe"),
        F.round(F.coalesce("confidence", F.lit(-1.0)), 6).alias("confidence"))


@query("h08_stream_recent_latency", f"""
WITH {Q.HIST}
SELECT gateway, stage, count, round(mean, 6) AS mean, last, p50, p95, p99 FROM hist""")
def stream_recent_latency(spark, sf_dir):
    """The view at the end of the feed, of all that the triggers gave out."""
    samples = Q.stage_samples(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    key = ["gateway", "stage"]
    feed = timed_feed(spark, samples, key, most=PACKED_ROWS_PER_TRIGGER, keys_a_file=1)
    out = SJ.drain(L.recent_latency(feed, key, ["us", "event_id"], "ts", delay=DELAY,
                                    end_ms=END_MS))
    last = out.groupBy("gateway", "stage").agg(F.max_by(F.struct(
        "count", "mean", "last", "p50", "p95", "p99"), "count").alias("v"))
    return last.select("gateway", "stage", "v.*").withColumn("mean", F.round("mean", 6))
