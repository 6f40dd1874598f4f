"""A: sources and sinks on real files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkmill.plans import bindings as B
from talkmill.plans.queries_quality import LIVE, live_events
from talkmill.plans.registry import query
from talkmill.session import shared_folder
from talkmill.sources import media as M
from talkmill.sources import readers as RD
from talkmill.sources import writers as W
from talkmill.streaming import jobs as SJ

SUFFIXES = [".wav", ".mp3", ".mp4", ".MKV", ".flac", ".txt", ".ogg", ".webm"]
#: Twelve bytes of every container, and of none.
HEADS = ["524946460000000057415645", "FFFB90440000000000000000", "000000186674797069736F6D",
         "1A45DFA30000000000000000", "664C61430000000000000000", "4F6767530000000000000000",
         "000000000000000000000000"]
MAX_BYTES = 6000
FIRST = 500


def media_folder(spark, sf_dir):
    """A file per document: a head of some container, then the text; some are empty."""
    d = B.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (n % k + 1).cast("int"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    files = d.select(
        F.concat(F.lit("f"), (n % 16).cast("string"), F.lit("/g"), (n % 3).cast("string"),
                 F.lit("/d"), F.lpad(n.cast("string"), 12, "0"), pick(SUFFIXES, 8)).alias("path"),
        F.when(n % 31 == 0, F.lit("").cast("binary")).otherwise(
            F.concat(F.unhex(pick(HEADS, 7)), text)).alias("content"))
    root = f"{shared_folder(spark)}/media/{uuid.uuid4().hex}"
    M.write_media(files, root)
    return root


_FILES = f"""files AS (SELECT doc_id, 'f' || doc_id % 16 || '/g' || doc_id % 3 || '/d'
    || lpad(doc_id::VARCHAR, 12, '0') AS stem, {SUFFIXES}[doc_id % 8 + 1] AS suffix,
  CASE WHEN doc_id % 31 = 0 THEN 0 ELSE 12 + strlen(coalesce(text, '')) END AS length FROM documents)"""


@query("a04_media_scan", f"""
WITH {_FILES}
SELECT split_part(stem, '/', 3) AS id, stem || suffix AS audio, 'ja' AS source_language,
  'en' AS target_language FROM files WHERE suffix <> '.txt' ORDER BY audio LIMIT {FIRST}""")
def media_scan(spark, sf_dir):
    """The first files of a written folder in path order, by their suffixes."""
    root = media_folder(spark, sf_dir)
    items = RD.scan_media(spark, root, "ja", "en", limit=FIRST)
    top = len(M.local_path(root)) + 1
    return items.withColumn("audio", F.expr(f"substring(audio, {top + 1})"))


@query("a05_media_files", f"""
WITH {_FILES}, t AS (SELECT *, CASE WHEN length BETWEEN 1 AND {MAX_BYTES} THEN
    ['wav', 'mp3', 'isobmff', 'matroska', 'flac', 'ogg', NULL][doc_id % 7 + 1] END AS container,
  ['wav', 'mp3', 'isobmff', 'matroska', 'flac', NULL, 'ogg', 'matroska'][doc_id % 8 + 1] AS expected
  FROM files)
SELECT stem || suffix AS path, length::BIGINT AS length, coalesce(container, '') AS container,
  CASE WHEN expected IS NULL THEN 'unsupported_type' WHEN length > {MAX_BYTES} THEN 'too_large'
    WHEN container IS DISTINCT FROM expected THEN 'content_mismatch' ELSE 'ok' END AS error FROM t""")
def media_audit(spark, sf_dir):
    """Every written file, empty ones too, judged by twelve bytes."""
    root = media_folder(spark, sf_dir)
    top = len(M.local_path(root)) + 1
    return RD.audit_media(spark, root, MAX_BYTES).select(
        F.expr(f"substring(path, {top + 1})").alias("path"), "length",
        F.coalesce("container", F.lit("")).alias("container"),
        F.coalesce("error", F.lit("ok")).alias("error"))


@query("a12_stream_event_log", f"""
WITH {LIVE}
SELECT session_id::VARCHAR AS session_id, sequence_id, event_type,
  coalesce('{{"code":"' || code || '","n":', '{{"n":') || sequence_id % 5 || '}}' AS payload, '' AS unreadable
FROM live WHERE sequence_id % 50 <> 7
UNION ALL SELECT '', -1, '', '', 'not an envelope ' || session_id || ' ' || sequence_id
FROM live WHERE sequence_id % 50 = 7""")
def stream_event_log(spark, sf_dir):
    """Envelopes and broken lines as a stream of text, into a log that every one enters once:
    the first run sees half of the files, a second goes on where it ended."""
    e = live_events(spark, sf_dir).select(
        "session_id", "sequence_id", "event_type",
        F.timestamp_micros(F.round(F.col("at_s") * 1e6).cast("bigint")).alias("ts"),
        F.to_json(F.struct("code", (F.col("sequence_id") % 5).alias("n"))).alias("payload"))
    broken = F.col("sequence_id") % 50 == 7
    lines = W.envelopes(e.where(~broken)).select("value").unionByName(e.where(broken).select(
        F.concat_ws(" ", F.lit("not an envelope"), "session_id", "sequence_id").alias("value")))
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    root = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}"
    for part in (0, 1):
        lines.where(half == part).write.mode("append").text(f"{root}/lines")
        events = RD.stream_events(spark, f"{root}/lines", files_per_trigger=3)
        SJ.append_log(events, f"{root}/log", f"{root}/progress")
    return SJ.read_log(spark, f"{root}/log", events.schema).select(
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("sequence_id", F.lit(-1)).alias("sequence_id"),
        F.coalesce("event_type", F.lit("")).alias("event_type"),
        F.coalesce("payload", F.lit("")).alias("payload"),
        F.coalesce("unreadable", F.lit("")).alias("unreadable"))
