"""A, I and J: sources, sinks, scalar functions and model hooks over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators import joins as J
from talkmill.operators import telemetry as T
from talkmill.plans import bindings as B
from talkmill.plans.queries_rules import JOBS, TRANS, jobs, translations
from talkmill.plans.queries_telemetry import HIST, histograms
from talkmill.plans.queries_quality import LIVE, live_events
from talkmill.plans.registry import query
from talkmill.session import shared_folder
from talkmill.sources import readers as RD
from talkmill.sources import writers as W

KEY = ["session_id"]


# -- A: sources --------------------------------------------------------------------------

@query("a01_manifest_items", """
SELECT CASE WHEN item_id % 4 = 0 THEN 'list' ELSE 'wrapped' END AS shape, 'i' || item_id AS id,
  CASE WHEN item_id % 3 = 0 THEN 'music' ELSE 'speech' END AS category, text AS reference_text
FROM benchmark""")
def manifest_items(spark, sf_dir):
    """Manifests of both shapes written from the benchmark texts and read back."""
    b = B.table(spark, sf_dir, "benchmark")
    listed = F.col("item_id") % 4 == 0
    item = F.struct(
        F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("id"),
        F.lit("a.wav").alias("audio"), F.lit("en").alias("source_language"),
        F.lit("ja").alias("target_language"), F.col("text").alias("reference_text"),
        F.when(F.col("item_id") % 3 == 0, "music").alias("category"))
    rows = b.select(F.when(listed, "list").otherwise("wrapped").alias("shape"),
                    F.floor(F.col("item_id") / 50).alias("file"), item.alias("r"))
    made = rows.groupBy("shape", "file").agg(F.collect_list("r").alias("items")).select(
        "shape", "file", F.when(F.col("shape") == "list", F.to_json("items")).otherwise(
            F.to_json(F.struct(F.lit("v1").alias("version"), "items"))).alias("value"))
    folder = f"{shared_folder(spark)}/manifests/{uuid.uuid4().hex}"
    made.write.partitionBy("shape", "file").text(folder)
    got = RD.read_manifests(spark, f"{folder}/shape=*/file=*")
    return got.select(F.regexp_extract("manifest", "shape=([a-z]+)", 1).alias("shape"), "id",
                      "category", "reference_text")


@query("a06_report_results", """
SELECT 'run ' || user_id % 8 AS title, event_type AS model, count(*)::VARCHAR AS items FROM events GROUP BY 1, 2""")
def report_results(spark, sf_dir):
    """Benchmark reports written per group of users and scanned again."""
    e = B.table(spark, sf_dir, "events")
    rows = e.groupBy((F.col("user_id") % 8).alias("run"), F.col("event_type").alias("model")
                     ).agg(F.count("*").alias("items"))
    result = F.struct(F.lit("asr").alias("component"), "model", "items",
                      F.array(F.lit(1)).alias("per_item"), F.lit("x").alias("hypothesis"))
    made = rows.groupBy("run").agg(F.collect_list(result).alias("results")).select(
        "run", F.to_json(F.struct(
            F.concat(F.lit("run "), F.col("run").cast("string")).alias("title"),
            F.struct(F.lit("c").alias("cpu")).alias("environment"), "results")).alias("value"))
    folder = f"{shared_folder(spark)}/reports/{uuid.uuid4().hex}"
    made.write.partitionBy("run").text(folder)
    got = RD.read_reports(spark, folder, "*.txt")
    return got.select("title", F.col("result")["model"].alias("model"),
                      F.col("result")["items"].alias("items"))


@query("a02_content_versions", """
SELECT doc_id, left(sha256(text), 12) AS version FROM documents""")
def content_versions(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", RD.content_version(F.col("text")).alias("version"))


@query("a03_first_line_per_id", """
SELECT lang, source, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars
FROM documents GROUP BY lang, source""")
def first_line_per_id(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(
        F.concat_ws("|", "lang", "source").alias("id"), "lang", "source", "doc_id", "n_chars")
    return J.first_per_id(d, "id", "doc_id").drop("id")


@query("a05_media_audit", r"""
WITH m AS (SELECT event_id, ['a.wav','b.mp3','c.mp4','d.mkv','e.flac','f.txt'][event_id % 6 + 1] AS name,
  ['52494646','FFFB9044','00000018','1A45DFA3','664C6143','4F676753'][event_id % 5 + 1]
    || CASE WHEN event_id % 5 = 2 THEN '66747970' ELSE '00000000' END || '57415645' AS head,
  CASE WHEN event_id % 31 = 0 THEN 0 ELSE round(value * 100)::BIGINT END AS size FROM events),
t AS (SELECT *, CASE left(head, 8) WHEN '52494646' THEN 'wav' WHEN 'FFFB9044' THEN 'mp3'
  WHEN '00000018' THEN 'isobmff' WHEN '1A45DFA3' THEN 'matroska' ELSE 'flac' END AS container,
  CASE name WHEN 'a.wav' THEN 'wav' WHEN 'b.mp3' THEN 'mp3' WHEN 'c.mp4' THEN 'isobmff'
    WHEN 'd.mkv' THEN 'matroska' WHEN 'e.flac' THEN 'flac' END AS expected FROM m)
SELECT event_id, container, coalesce(CASE WHEN expected IS NULL THEN 'unsupported_type'
  WHEN container <> expected THEN 'content_mismatch' WHEN size > 20000 THEN 'too_large'
  WHEN size = 0 THEN 'empty' END, 'ok') AS error FROM t""")
def media_audit(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    n = F.col("event_id")
    pick = lambda vs, k: F.element_at(F.array(*map(F.lit, vs)), (n % k + 1).cast("int"))
    head = F.unhex(F.concat(
        pick(["52494646", "FFFB9044", "00000018", "1A45DFA3", "664C6143"], 5),
        F.when(n % 5 == 2, "66747970").otherwise("00000000"), F.lit("57415645")))
    m = e.select(n, pick(["a.wav", "b.mp3", "c.mp4", "d.mkv", "e.flac", "f.txt"], 6)
                 .alias("name"), head.alias("head"),
                 F.when(n % 31 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("bigint"))
                 .alias("size"))
    return m.select("event_id", RD.container_type(F.col("head")).alias("container"), F.coalesce(
        RD.audit_verdict(F.col("name"), F.col("size"), F.col("head"), 20000), F.lit("ok"))
        .alias("error"))


@query("a15_truth_timeline", f"""
WITH {B.SEG}
SELECT session_id, seq, CASE WHEN speaker IS NULL THEN 'music' ELSE 'speech' END AS type,
  round((end_ms - dur_ms - pause_ms) / 1000e0, 3) AS start_s, round(end_ms / 1000e0, 3) AS end_s FROM seg""")
def truth_timeline(spark, sf_dir):
    raw, blk = B.raw_segments(spark, sf_dir)
    pieces = raw.withColumns({
        "duration": (F.col("dur_ms") + F.col("pause_ms")) / 1000.0,
        "type": F.when(F.col("speaker").isNull(), "music").otherwise("speech")})
    return RD.truth_timeline(pieces, KEY, ["seq"], blk).select(
        "session_id", "seq", "type", "start_s", "end_s")


# -- A: sinks ----------------------------------------------------------------------------

_WRAP = """CASE WHEN length(t) <= 42 THEN t ELSE regexp_extract(t, '^(.{1,42})( |$)', 1)
  || CASE WHEN regexp_replace(t, '^.{1,42}( |$)', '') = '' THEN ''
     ELSE chr(10) || regexp_replace(t, '^.{1,42}( |$)', '') END END"""
_CLOCK = lambda ms, m: (
    f"format('{{:02d}}:{{:02d}}:{{:02d}}{m}{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, "
    f"{ms} // 1000 % 60, {ms} % 1000)")
CUES = TRANS + f"""
, k0 AS (SELECT *, trim(regexp_replace(translated_text, '\\s+', ' ', 'g')) AS t FROM trans
  WHERE timestamps_available AND trim(translated_text) <> ''),
k1 AS (SELECT *, lead(start_s) OVER (PARTITION BY session_id ORDER BY start_s, seq) AS nx,
  row_number() OVER (PARTITION BY session_id ORDER BY start_s, seq) AS cue, {_WRAP} AS line FROM k0),
cues AS (SELECT *, round(start_s * 1000)::BIGINT AS a, round(CASE WHEN end_s > nx
  THEN greatest(start_s + 0.3e0, nx - 0.01e0) ELSE end_s END * 1000)::BIGINT AS b FROM k1)
"""


def cues(spark, sf_dir, dual=False):
    """Subtitle cues of all translations."""
    t, blk = translations(spark, sf_dir)
    return W.subtitle_cues(t, KEY, ["seq"], blk, dual)


@query("a07_srt_documents", f"""
WITH {CUES}
SELECT session_id, string_agg(cue || chr(10) || {_CLOCK('a', ',')} || ' --> ' || {_CLOCK('b', ',')}
  || chr(10) || line || chr(10), chr(10) ORDER BY cue) AS document FROM cues GROUP BY session_id""")
def srt_documents(spark, sf_dir):
    return W.documents(cues(spark, sf_dir), KEY, "srt")


@query("a08_vtt_documents", f"""
WITH {CUES}
SELECT session_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_CLOCK('a', '.')} || ' --> '
  || {_CLOCK('b', '.')} || chr(10) || line || chr(10) || trim(source_text) || chr(10), chr(10)
  ORDER BY cue) AS document FROM cues GROUP BY session_id""")
def vtt_documents(spark, sf_dir):
    return W.documents(cues(spark, sf_dir, dual=True), KEY, "vtt")


@query("a09_live_cues", f"""
WITH {TRANS}, c AS (SELECT *, round(start_s * 1000)::BIGINT AS a, round(CASE WHEN seq % 6 = 0
    THEN start_s + 0.8e0 ELSE end_s END * 1000)::BIGINT AS b FROM trans)
SELECT session_id, seq, {_CLOCK('a', ',')} || ' --> ' || {_CLOCK('b', ',')} || chr(10)
  || CASE WHEN speaker IS NULL THEN '' ELSE '[Speaker ' || speaker || '] ' END || trim(translated_text)
  || chr(10) || trim(source_text) || chr(10) AS block FROM c""")
def live_cues(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    zeroed = t.withColumn("end_s", F.when(F.col("seq") % 6 == 0, F.col("start_s"))
                          .otherwise(F.col("end_s")))
    return W.live_cues(zeroed, dual=True).select(
        "session_id", "seq", W.cue_block("vtt").alias("v"), F.regexp_replace(
            W.cue_block("vtt"), r"(\d\d:\d\d:\d\d)\.(\d\d\d)", "$1,$2").alias("block")).drop("v")


def component_rows(spark, sf_dir):
    """Latency results with nested columns, as a benchmark run makes them."""
    e = B.event_rows(spark, sf_dir)
    lat = T.latency_summary(e.withColumn("took", F.col("value") * 1.0137), ["event_type"], "took")
    return lat.select(
        F.lit("asr").alias("component"), F.col("event_type").alias("model"),
        F.col("n").alias("items"), F.struct("p50", "p95", "mean").alias("latency"),
        F.array("p50").alias("dropped"), (F.col("mean") / 100).alias("rtf"))


@query("a10_flat_results", """
SELECT 'asr' AS component, event_type AS model, count(*) AS items,
  round(quantile_cont(value * 1.0137e0, 0.5e0), 3) AS "latency.p50", round(quantile_cont(value * 1.0137e0, 0.95e0), 3) AS "latency.p95",
  round(avg(value * 1.0137e0), 3) AS "latency.mean", round(avg(value * 1.0137e0), 3) / 100 AS rtf
FROM events GROUP BY event_type""")
def flat_results(spark, sf_dir):
    return W.flatten(component_rows(spark, sf_dir))


@query("a11_markdown_table", """
WITH r AS (SELECT event_type, count(*) AS n, round(quantile_cont(value * 1.0137e0, 0.5e0), 3) AS p50,
  round(quantile_cont(value * 1.0137e0, 0.95e0), 3) AS p95, round(avg(value * 1.0137e0), 3) / 100 AS rtf FROM events GROUP BY event_type),
l AS (SELECT event_type, '| ' || event_type || ' | ' || n || ' | - | - | - | '
  || CASE WHEN p50 < 100 THEN printf('%.3f', p50) ELSE printf('%.1f', p50) END || ' | '
  || CASE WHEN p95 < 100 THEN printf('%.3f', p95) ELSE printf('%.1f', p95) END || ' | '
  || printf('%.3f', rtf) || ' | - | - |' AS line FROM r)
SELECT '## asr' || chr(10) || chr(10)
  || '| Model | Items | WER | CER | Halluc. rate | P50 s | P95 s | RTF | Load s | Peak RSS GB |' || chr(10)
  || '| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |' || chr(10)
  || string_agg(line, chr(10) ORDER BY event_type) AS markdown FROM l""")
def markdown_table(spark, sf_dir):
    return W.markdown_table(component_rows(spark, sf_dir), "asr", ["model"])


@query("a12_event_log", f"""
WITH {LIVE}
SELECT session_id::VARCHAR AS session_id, sequence_id, event_type,
  coalesce('{{"code":"' || code || '","n":', '{{"n":') || sequence_id % 5 || '}}' AS payload FROM live""")
def event_log(spark, sf_dir):
    """Envelopes written as JSON text and parsed back."""
    e = live_events(spark, sf_dir).select(
        "session_id", "sequence_id", "event_type",
        F.timestamp_micros(F.round(F.col("at_s") * 1e6).cast("bigint")).alias("ts"),
        F.to_json(F.struct("code", (F.col("sequence_id") % 5).alias("n"))).alias("payload"))
    return RD.parse_events(W.envelopes(e)).drop("ts")


@query("a13_job_records", f"""
WITH {JOBS}
SELECT job_id, status, json_extract_string(r, '$.input.engine') AS engine,
  json_extract_string(r, '$.input.secret') IS NULL AS hidden, json_extract_string(r, '$.owner')::BIGINT AS owner
FROM (SELECT job_id, status, to_json({{'job_id': job_id, 'owner': owner, 'input': {{'engine': 'e' || owner % 3}}}})::VARCHAR AS r
  FROM jobs)""")
def job_records(spark, sf_dir):
    j = jobs(spark, sf_dir).withColumn("payload", F.to_json(F.struct(
        F.concat(F.lit("e"), (F.col("owner") % 3).cast("string")).alias("engine"),
        F.lit("x").alias("secret"))))
    r = W.job_records(j)
    pick = lambda path: F.get_json_object("record", path)
    return r.select("job_id", "status", pick("$.input.engine").alias("engine"),
                    pick("$.input.secret").isNull().alias("hidden"),
                    pick("$.owner").cast("bigint").alias("owner"))


@query("a14_exposition", f"""
WITH {HIST}, m AS (SELECT stage, list_sort(list(p50)) AS v FROM hist GROUP BY stage)
SELECT 'talkmill_' || stage || '_seconds{{quantile="0.5"}} ' || printf('%.6f', v[len(v) // 2 + 1]) AS line,
  '# TYPE talkmill_' || stage || '_seconds gauge' AS header FROM m
UNION ALL SELECT 'talkmill_' || event_type || ' ' || count(*), '# TYPE talkmill_' || event_type || ' counter'
FROM events GROUP BY event_type""")
def exposition(spark, sf_dir):
    mid = T.fleet_medians(histograms(spark, sf_dir)).select(
        F.concat("stage", F.lit("_seconds")).alias("name"), F.lit("gauge").alias("type"),
        F.lit("0.5").alias("quantile"), F.col("p50").alias("value"))
    total = B.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count("*").cast("double").alias("value")).select(
        "name", F.lit("counter").alias("type"), F.lit(None).cast("string").alias("quantile"),
        "value")
    return W.exposition(mid.unionByName(total)).select("line", "header")


# -- I: scalar functions -----------------------------------------------------------------

_NORM = (r"trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), "
         r"'[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))")


@query("i01_normalized_text", f"SELECT doc_id, {_NORM} AS norm FROM documents")
def normalized(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", X.normalize("text").alias("norm"))


@query("i02_timestamps", f"""
WITH t AS (SELECT event_id, round(greatest(0e0, value * 37 - 50) * 1000)::BIGINT AS ms FROM events)
SELECT event_id, {_CLOCK('ms', ',')} AS srt, {_CLOCK('ms', '.')} AS vtt FROM t""")
def timestamps(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    s = F.col("value") * 37 - 50
    return e.select("event_id", X.timestamp(s).alias("srt"), X.timestamp(s, ".").alias("vtt"))


@query("i03_wrapped_lines", f"""
WITH {TRANS}, k AS (SELECT *, trim(regexp_replace(translated_text, '\\s+', ' ', 'g')) AS t FROM trans)
SELECT session_id, seq, {_WRAP} AS body FROM k""")
def wrapped(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    return t.select("session_id", "seq", X.wrap("translated_text").alias("body"))


@query("i04_dual_lines", f"""
WITH {TRANS} SELECT session_id, seq, CASE WHEN source_text = '' THEN translated_text
  ELSE translated_text || chr(10) || trim(source_text) END AS body FROM trans""")
def dual_lines(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    return t.select("session_id", "seq", X.dual_body(
        F.col("translated_text"), F.col("source_text")).alias("body"))


@query("i05_token_estimates", r"""
WITH d AS (SELECT doc_id, text, length(regexp_replace(text,
  '[\x{0900}-\x{097f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]', '', 'g')) AS n FROM documents)
SELECT doc_id, (length(text) - n + n // 4 + 1)::INTEGER AS tokens FROM d""")
def token_estimates(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", X.estimate_tokens("text").alias("tokens"))


def addressed(spark, sf_dir):
    """Lines with honorifics in the source and English titles in the translation."""
    seg, _ = B.segments(spark, sf_dir)
    n = F.col("session_id") + F.col("seq")
    mark = F.element_at(F.array(*map(F.lit, [
        "さん", "先生", "さん先輩", "", "くん君", "언니", "선배"])), (n % 7 + 1).cast("int"))
    title = F.element_at(F.array(*map(F.lit, [
        "Mr. Tanaka", "Miss Sato", "Teacher Mori", "Professor Abe-san", "Mrs Ito"])),
        (n % 5 + 1).cast("int"))
    return seg.select("session_id", "seq", F.concat("text", mark).alias("source"),
                      F.concat(F.lit("Where is "), title, F.lit("? "), "text")
                      .alias("translated"), "language")


ADDRESSED = B.SEG + """
, ad AS (SELECT session_id, seq, language, text || ['さん','先生','さん先輩','','くん君','언니','선배'][(session_id + seq) % 7 + 1] AS source,
  'Where is ' || ['Mr. Tanaka','Miss Sato','Teacher Mori','Professor Abe-san','Mrs Ito'][(session_id + seq) % 5 + 1]
    || '? ' || text AS translated FROM seg),
hon AS (SELECT *, list_filter(CASE WHEN starts_with(language, 'ko') THEN [
    CASE WHEN contains(source, '선배') THEN '-seonbae' END, CASE WHEN contains(source, '후배') THEN '-hubae' END,
    CASE WHEN contains(source, '언니') THEN '-unnie' END, CASE WHEN contains(source, '오빠') THEN '-oppa' END,
    CASE WHEN contains(source, '누나') THEN '-noona' END, CASE WHEN contains(source, '형') THEN '-hyung' END]
  ELSE [CASE WHEN contains(source, 'さん') THEN '-san' END,
    CASE WHEN contains(source, '君') OR contains(source, 'くん') THEN '-kun' END,
    CASE WHEN contains(source, 'ちゃん') THEN '-chan' END,
    CASE WHEN contains(source, '様') OR contains(source, 'さま') THEN '-sama' END,
    CASE WHEN contains(source, '先生') THEN '-sensei' END, CASE WHEN contains(source, '先輩') THEN '-senpai' END,
    CASE WHEN contains(source, '殿') THEN '-dono' END] END, lambda x: x IS NOT NULL) AS hs FROM ad)
"""
_TITLED = r"'\b(Mr\.?|Mrs\.?|Ms\.?|Miss|Master|Sir|Madam{more})\s+([A-Z][A-Za-z''’-]+)'"


@query("i06_honorifics", f"""
WITH {ADDRESSED} SELECT session_id, seq, array_to_string(hs, ',') AS suffixes FROM hon""")
def honorifics(spark, sf_dir):
    return addressed(spark, sf_dir).select("session_id", "seq", F.array_join(
        X.honorifics("source", "language"), ",").alias("suffixes"))


@query("i07_honorific_policy", f"""
WITH {ADDRESSED}
SELECT session_id, seq, CASE WHEN len(hs) <> 1 THEN translated
  WHEN hs[1] = '-sensei' THEN regexp_replace(translated, {_TITLED.format(more='|Teacher|Professor')}, '\\2' || '-sensei', 'g')
  ELSE replace(regexp_replace(translated, {_TITLED.format(more='')}, '\\2@@', 'g'), '@@', hs[1]) END AS translated
FROM hon""")
def honorific_policy(spark, sf_dir):
    a = addressed(spark, sf_dir)
    return a.select("session_id", "seq", X.apply_honorifics(
        "source", "translated", "preserve_honorifics", "language").alias("translated"))


@query("i08_stripped_honorifics", f"""
WITH {ADDRESSED} SELECT session_id, seq, regexp_replace(translated,
  '([A-Za-z])-(seonbae|sensei|senpai|unnie|noona|hyung|hubae|sama|oppa|dono|chan|san|kun)\\b', '\\1', 'g') AS translated
FROM hon""")
def stripped_honorifics(spark, sf_dir):
    return addressed(spark, sf_dir).select(
        "session_id", "seq", X.strip_honorifics("translated").alias("translated"))


_JA = ", ".join(sorted(set(dims.JA_HONORIFICS.values())))
_KO = ", ".join(sorted(set(dims.KO_HONORIFICS.values())))
_KEEP = dims.POLICY_TEXT["preserve_honorifics"].replace("'", "''")


@query("i09_policy_instructions", f"""
WITH {B.SEG}
SELECT session_id, seq, CASE seq % 3 WHEN 0 THEN CASE WHEN language = 'ko'
    THEN '{_KEEP.replace('{examples}', _KO)}' ELSE '{_KEEP.replace('{examples}', _JA)}' END
  WHEN 1 THEN '{dims.POLICY_TEXT['remove']}' ELSE '{dims.POLICY_TEXT['natural_english']}' END AS instruction FROM seg""")
def policy_instructions(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    policy = F.element_at(F.array(*map(F.lit, [
        "preserve_honorifics", "remove", "natural_english"])), (F.col("seq") % 3 + 1).cast("int"))
    return seg.select("session_id", "seq", X.policy_instruction(policy, "language")
                      .alias("instruction"))


@query("i11_cleaned_output", f"""
WITH {B.SEG}, raw AS (SELECT session_id, seq, text,
  CASE seq % 4 WHEN 0 THEN '<think>' || text || chr(10) || '</think>Translation: "' || text || '"'
    WHEN 1 THEN '<current>=> ' || text || '</current>' || chr(10) || chr(10) || '  again'
    WHEN 2 THEN '[speaker 2] “' || text || '”' ELSE 'Output : ' || text END AS y FROM seg)
SELECT session_id, seq, CASE seq % 4 WHEN 1 THEN trim(regexp_replace(text, '^[=> ]+', '')) || ' again'
  ELSE trim(text) END AS cleaned FROM raw""")
def cleaned_output(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    t, n = F.col("text"), F.col("seq") % 4
    raw = (F.when(n == 0, F.concat(F.lit("<think>"), t, F.lit("\n</think>Translation: \""), t,
                                   F.lit('"')))
           .when(n == 1, F.concat(F.lit("<current>=> "), t, F.lit("</current>\n\n  again")))
           .when(n == 2, F.concat(F.lit("[speaker 2] “"), t, F.lit("”")))
           .otherwise(F.concat(F.lit("Output : "), t)))
    return seg.select("session_id", "seq", X.clean_output(raw).alias("cleaned"))


@query("i12_clean_filenames", r"""
WITH f AS (SELECT page_id, regexp_extract(url || CASE page_id % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '' ELSE '/x y.Wav' END,
  '([^/]*)/*$', 1) AS base FROM pages),
p AS (SELECT page_id, base, regexp_extract(base, '[^.](\.[^.]+)$', 1) AS suffix FROM f),
s AS (SELECT page_id, suffix, left(regexp_replace(regexp_replace(left(base, length(base) - length(suffix)),
  '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 80) AS stem FROM p)
SELECT page_id, CASE WHEN stem = '' THEN 'media' ELSE stem END || lower(suffix) AS name FROM s""")
def clean_filenames(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".MP4").when(
        F.col("page_id") % 3 == 1, "").otherwise("/x y.Wav"))
    return p.select("page_id", X.clean_filename(name).alias("name"))


@query("i13_script_check", f"""
WITH {TRANS}
SELECT session_id, seq, CASE WHEN source_text = '' THEN false
  WHEN source_language = 'ja' THEN regexp_matches(source_text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]')
  WHEN source_language = 'ko' THEN regexp_matches(source_text, '[\\x{{ac00}}-\\x{{d7af}}]') ELSE true END AS fits FROM trans""")
def script_check(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    return t.select("session_id", "seq", X.looks_like("source_text", "source_language")
                    .alias("fits"))


@query("i14_language_codes", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa'
  ELSE lang END AS code, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
  WHEN 'es' THEN 'Spanish' ELSE lang END AS name FROM documents""")
def language_codes(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", X.iso_639_2("lang").alias("code"), X.language_name("lang").alias("name"))


@query("i15_parsed_numbers", """
SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN props ELSE json_extract_string(props, '$.k') || '.5' END
  AS DOUBLE) AS k FROM events""")
def parsed_numbers(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(
        F.concat(F.get_json_object("props", "$.k"), F.lit(".5")))
    return e.select("event_id", X.to_number(raw).alias("k"))


@query("i16_iso_times", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at_iso FROM events""")
def iso_times(spark, sf_dir):
    e = B.event_rows(spark, sf_dir)
    return e.select("event_id", X.iso_time(F.floor(F.col("us") / 1_000_000)).alias("at_iso"))


@query("i17_json_fields", """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
  '{"event":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '"}' AS flat FROM events""")
def json_fields(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    body = F.from_json("props", "map<string,string>")
    flat = F.to_json(F.map_concat(F.create_map(F.lit("event"), "event_type"), body))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                    flat.alias("flat"))


@query("i18_count_maps", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts,
  coalesce(max(n) FILTER (event_type = 'error'), 0) AS errors FROM c GROUP BY user_id""")
def count_maps(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws(
        "=", x["key"], x["value"])), ",").alias("counts"),
        F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).cast("bigint").alias("errors"))
