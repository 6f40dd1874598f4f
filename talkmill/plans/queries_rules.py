"""B: row-local rules over segments, windows, documents and events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators import rules as R
from talkmill.plans import bindings as B
from talkmill.plans.registry import query


def _words(text: str = "text"):
    """Timed words of a segment, with made probabilities for every fifth one missing."""
    return F.transform(F.split(text, " "), lambda w, i: F.struct(
        w.alias("text"), F.when(i % 5 != 4, (
            (i * 37 + F.col("session_id") * 3 + F.col("seq")) % 100) / 100.0)
        .alias("probability")))


_WORD_LIST = """list_transform(range(len(string_split(text, ' '))), lambda i:
   CASE WHEN i % 5 <> 4 THEN ((i*37 + session_id*3 + seq) % 100) / 100e0 END)"""

_TEXT_SIGNALS = r"""
 letters AS (SELECT *, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS core,
   list_filter(string_split_regex(regexp_replace(text, '([^\p{L}\p{N}_\s])', ' \1 ', 'g'), '\s+'),
     lambda x: x <> '') AS toks,
   list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '),
     lambda x: x <> '') AS ws FROM base),
 words AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM letters WHERE len(ws) >= 9),
 ahead AS (SELECT *, """ + ", ".join(f"lead(w, {k}) OVER x AS w{k}" for k in range(1, 8)) + r"""
   FROM words WINDOW x AS (PARTITION BY id ORDER BY i)),
 grams AS (""" + " UNION ALL ".join(
    f"SELECT id, {n} AS n, i, w || " + " || ".join(f"' ' || w{k}" for k in range(1, n))
    + f" AS g FROM ahead WHERE w{n - 1} IS NOT NULL" for n in range(2, 9)) + r"""),
 covered AS (
   SELECT id, count(DISTINCT p) AS cov FROM (
     SELECT id, unnest(range(i, i + n)) AS p FROM (
       SELECT *, count(*) OVER (PARTITION BY id, n, g) AS c FROM grams) WHERE c >= 3)
   GROUP BY id),
 signals AS (
   SELECT l.*, CASE WHEN len(toks) < 4 THEN 0e0 ELSE len(list_filter(list_zip(
       toks[1:len(toks)-1], toks[2:]), lambda p: p[1] = p[2])) / (len(toks) - 1)::DOUBLE END AS rep,
     CASE WHEN len(ws) < 9 THEN 0e0 ELSE coalesce(cov, 0) / len(ws)::DOUBLE END AS phrase
   FROM letters l LEFT JOIN covered c ON l.id = c.id)
"""


@query("b02_text_density", f"""
WITH {B.SEG}
SELECT session_id, seq, round(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))
  / greatest(end_s - start_s, 1e-6), 4) AS density FROM seg""")
def density(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    return seg.select("session_id", "seq", F.round(X.text_density(
        "text", F.col("end_s") - F.col("start_s")), 4).alias("density"))


@query("b03_adjacent_repetition", f"""
WITH base AS (SELECT doc_id AS id, text FROM documents), {_TEXT_SIGNALS.split(" words AS")[0].rstrip().rstrip(",")}
SELECT id AS doc_id, round(CASE WHEN len(toks) < 4 THEN 0e0 ELSE len(list_filter(list_zip(
  toks[1:len(toks)-1], toks[2:]), lambda p: p[1] = p[2])) / (len(toks) - 1)::DOUBLE END, 6) AS repetition
FROM letters""")
def repetition(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.adjacent_repetition("text"), 6).alias("repetition"))


@query("b04_ngram_loops", r"""
WITH l AS (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, s, regexp_extract_all(s, '.') AS cs FROM l),
p AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, cs, unnest(range(1, len(cs) - n + 1)) AS i
    FROM c, (SELECT unnest(range(1, 7)) AS n)) WHERE cs[i] = cs[i + n]),
-- Stretches in which each character equals the one n further on.
r AS (SELECT doc_id, n, min(i) AS a, count(*) AS m FROM (SELECT *, i - row_number() OVER (
    PARTITION BY doc_id, n ORDER BY i) AS k FROM p) GROUP BY doc_id, n, k HAVING count(*) >= n),
-- The scan passes over them in order; a loop that was found moves it behind the loop.
w AS (SELECT doc_id, n, list({'z': a + m, 'from': a, 'best': 0} ORDER BY a) AS st FROM r GROUP BY ALL),
f AS (SELECT doc_id, list_reduce(st, lambda acc, x: {
    'z': CASE WHEN x.z - greatest(x."from", acc.z) >= n THEN greatest(x."from", acc.z)
      + n * (1 + (x.z - greatest(x."from", acc.z)) // n) ELSE acc.z END, 'from': 0::BIGINT,
    'best': CASE WHEN x.z - greatest(x."from", acc.z) >= 2 * n THEN greatest(acc.best,
      n * (1 + (x.z - greatest(x."from", acc.z)) // n)) ELSE acc.best END},
    {'z': 0::BIGINT, 'from': 0::BIGINT, 'best': 0::BIGINT}).best AS best FROM w)
SELECT doc_id, round(CASE WHEN length(any_value(s)) < 5 THEN 0e0
  ELSE coalesce(max(best), 0) / length(any_value(s))::DOUBLE END, 6) AS loop
FROM l LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def loops(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.ngram_loop_score("text"), 6).alias("loop"))


@query("b05_phrase_loops", f"""
WITH base AS (SELECT doc_id AS id, text FROM documents), {_TEXT_SIGNALS}
SELECT id AS doc_id, round(phrase, 6) AS phrase_loop FROM signals""")
def phrases(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.phrase_loop_score("text"), 6).alias("phrase_loop"))


@query("b06_compression_ratio")
def deflate(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(X.compression_ratio("text"), 6).alias("ratio"))


@query("b07_word_probability", f"""
WITH {B.SEG}
SELECT session_id, seq, round(list_avg({_WORD_LIST}), 6) AS word_probability FROM seg""")
def word_probability(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    return seg.select("session_id", "seq", F.round(
        R.mean_word_probability(_words()), 6).alias("word_probability"))


@query("b08_combined_confidence", f"""
WITH {B.SEG}, parts AS (SELECT session_id, seq, list_filter([confidence, exp(avg_logprob),
    1 - no_speech_prob], lambda x: x IS NOT NULL) AS p FROM seg)
SELECT session_id, seq, CASE WHEN len(p) = 0 THEN 0.8e0
  ELSE round(greatest(0e0, least(1e0, list_sum(p) / len(p))), 6) END AS confidence FROM parts""")
def confidence(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    return seg.select("session_id", "seq", F.round(R.combined_confidence(
        F.col("confidence"), F.exp("avg_logprob"), 1 - F.col("no_speech_prob")), 6)
        .alias("confidence"))


def _stocked(text: str = "text"):
    """Lines with stock phrases and credits planted by sequence number."""
    n = F.col("session_id") + F.col("seq")
    return (F.when(n % 17 == 3, "Thank you for watching!").when(n % 17 == 8, "감사합니다.")
            .when(n % 17 == 12, F.concat(F.lit("Subtitles by "), F.col(text)))
            .otherwise(F.col(text)))


_STOCKED = """CASE (session_id + seq) % 17 WHEN 3 THEN 'Thank you for watching!'
  WHEN 8 THEN '감사합니다.' WHEN 12 THEN 'Subtitles by ' || text ELSE text END"""
_PHRASES = ", ".join(f"'{p}'" for p in dims.STOCK_PHRASES)
_CREDIT = dims.CREDIT_PATTERN.replace("(?i)", "(?i)")


@query("b09_stock_phrases", f"""
WITH {B.SEG}, planted AS (SELECT session_id, seq, {_STOCKED} AS line FROM seg)
SELECT session_id, seq, regexp_matches(line, '{_CREDIT}') AS credit,
  lower(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) IN ({_PHRASES}) AS stock
FROM planted WHERE regexp_matches(line, '{_CREDIT}')
  OR lower(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) IN ({_PHRASES})""")
def stock(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    return (seg.withColumn("line", _stocked()).select(
        "session_id", "seq", F.col("line").rlike(dims.CREDIT_PATTERN).alias("credit"),
        F.lower(X.letters_only("line")).isin(dims.STOCK_PHRASES).alias("stock"))
        .where("credit or stock"))


_VERDICT = """
 CASE WHEN core = '' THEN 'empty_transcript'
  WHEN end_s - start_s < 0.08e0 THEN 'segment_too_short'
  WHEN length(core) / greatest(end_s - start_s, 1e-6) > 28 THEN 'abnormal_text_density'
  WHEN rep > 0.55e0 OR phrase > 0.5e0 THEN 'repetition'
  WHEN no_speech_prob >= 0.85e0 THEN 'high_no_speech_probability'
  WHEN no_speech_prob > 0.6e0 AND avg_logprob < -1 THEN 'no_speech_and_low_logprob'
  WHEN avg_logprob < -1.5e0 THEN 'low_average_log_probability'
  WHEN compression_ratio > 2.6e0 THEN 'high_compression_ratio'
  WHEN wp < 0.25e0 THEN 'low_word_probability'
  WHEN detected <> language AND language_probability >= 0.8e0 THEN 'language_mismatch'
  WHEN event_type NOT IN ('DIALOGUE', 'UNKNOWN') AND gate_conf >= 0.6e0
    THEN 'non_dialogue_audio_event'
  WHEN regexp_matches(text, '%s') THEN 'subtitle_credit'
  WHEN lower(core) IN (%s) AND (NOT coalesce(event_type = 'DIALOGUE' AND gate_conf >= 0.5e0, false)
     OR coalesce(no_speech_prob > 0.3e0, false) OR coalesce(avg_logprob < -0.6e0, false)
     OR conf < 0.6e0) THEN 'known_hallucination_phrase' END""" % (_CREDIT, _PHRASES)


@query("b01_transcript_validation", f"""
WITH {B.SEG}, base AS (
  SELECT session_id, seq, session_id || '/' || seq AS id, {_STOCKED} AS text, start_s, end_s,
    language, detected, language_probability, avg_logprob, no_speech_prob, compression_ratio,
    confidence, list_avg({_WORD_LIST}) AS wp,
    ['DIALOGUE','MUSIC','UNKNOWN','DIALOGUE','SFX'][(session_id*3 + seq) % 5 + 1] AS event_type,
    ((session_id*7 + seq*3) % 100) / 100e0 AS gate_conf FROM seg), {_TEXT_SIGNALS},
conf AS (SELECT *, list_filter([confidence, exp(avg_logprob), 1 - no_speech_prob, wp],
    lambda x: x IS NOT NULL) AS p FROM signals),
scored AS (SELECT *, CASE WHEN len(p) = 0 THEN 0.8e0 ELSE
    greatest(0e0, least(1e0, list_sum(p) / len(p))) END AS conf FROM conf),
judged AS (SELECT *, {_VERDICT} AS reason FROM scored)
SELECT session_id, seq, reason IS NULL AS valid, coalesce(reason, 'ok') AS reason,
  round(CASE reason WHEN 'empty_transcript' THEN 0e0 WHEN 'segment_too_short' THEN 0.25e0
    WHEN 'abnormal_text_density' THEN 0.35e0 WHEN 'repetition' THEN 0.3e0
    WHEN 'high_no_speech_probability' THEN 0.2e0 WHEN 'no_speech_and_low_logprob' THEN 0.2e0
    WHEN 'low_average_log_probability' THEN 0.35e0 WHEN 'high_compression_ratio' THEN 0.35e0
    WHEN 'low_word_probability' THEN 0.35e0 WHEN 'language_mismatch' THEN 0.3e0
    WHEN 'non_dialogue_audio_event' THEN 0.25e0 WHEN 'subtitle_credit' THEN 0.1e0
    WHEN 'known_hallucination_phrase' THEN 0.3e0 ELSE conf END, 6) AS confidence
FROM judged""")
def validation(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    s, n = F.col("session_id"), F.col("seq")
    events = F.array(*map(F.lit, ["DIALOGUE", "MUSIC", "UNKNOWN", "DIALOGUE", "SFX"]))
    seg = seg.withColumn("words", _words()).withColumn("text", _stocked())
    seg = seg.withColumn("words", F.col("words")).withColumn("decision", F.struct(
        F.element_at(events, ((s * 3 + n) % 5 + 1).cast("int")).alias("event_type"),
        ((s * 7 + n * 3) % 100 / 100.0).alias("confidence")))
    out = R.validate_transcripts(seg, expected=F.col("language"), words="words",
                                 decision="decision")
    return out.select("session_id", "seq", "valid",
                      F.coalesce("reason", F.lit("ok")).alias("reason"),
                      F.round("result_confidence", 6).alias("confidence"))


@query("b10_gate_decision", f"""
WITH {B.GATE}
SELECT session_id, w, should_transcribe, event_type, round(confidence, 6) AS confidence, reason
FROM gate""")
def gate(spark, sf_dir):
    g, _ = B.gate(spark, sf_dir)
    return g.select("session_id", "w", "should_transcribe", "event_type",
                    F.round("confidence", 6).alias("confidence"), "reason")


def frames(spark, sf_dir):
    """Event values as 16-bit samples: one frame of 64 samples per event."""
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: ((F.round(F.col("value") * 100).cast("bigint") * (i * 7 + 3)
                    + F.col("event_id")) % 2000
                   - 1000).cast("int") * F.when(F.col("event_id") % 9 == 0, 0)
        .otherwise(F.col("event_id") % 40).cast("int")).alias("samples"))


FRAMES = """frames AS (SELECT event_id, user_id, list_transform(range(0, 64), lambda i:
  ((round(value * 100)::BIGINT * (i*7 + 3) + event_id) % 2000 - 1000)
  * CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 40 END) AS samples FROM events),
levels AS (SELECT event_id, user_id, floor(sqrt(list_sum(list_transform(samples,
  lambda x: x::DOUBLE * x)) / 64))::INTEGER AS level FROM frames)"""


@query("b11_energy_speech", f"""
WITH {FRAMES}
SELECT event_id, level, level >= 120 AS should_transcribe,
  CASE WHEN level >= 120 THEN 'DIALOGUE' ELSE 'SILENCE' END AS event_type,
  round(least(1e0, level / 480e0), 6) AS confidence FROM levels""")
def energy(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("level", R.rms(F.col("samples")))
    return (f.withColumn("v", R.energy_speech(F.col("level")))
            .select("event_id", "level", "v.should_transcribe", "v.event_type",
                    F.round("v.confidence", 6).alias("confidence")))


@query("b12_energy_event", f"""
WITH {FRAMES}
SELECT event_id, level >= 80 AS should_transcribe, CASE WHEN level < 80 THEN 'SILENCE'
    WHEN level > 12000 THEN 'UNKNOWN' ELSE 'DIALOGUE' END AS event_type,
  round(CASE WHEN level < 80 THEN 0.95e0 WHEN level > 12000 THEN 0.45e0
    ELSE least(0.95e0, greatest(0.5e0, level / 12000e0)) END, 6) AS confidence FROM levels""")
def energy_event(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("level", R.rms(F.col("samples")))
    return (f.withColumn("v", R.energy_event(F.col("level")))
            .select("event_id", "v.should_transcribe", "v.event_type",
                    F.round("v.confidence", 6).alias("confidence")))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _label_probabilities(ids: pa.Array) -> pa.Array:
    """Made probabilities of every label; all are missing where the id is."""
    i = np.arange(dims.LABEL_COUNT, dtype=np.int64)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    events = ids.fill_null(0).to_numpy(zero_copy_only=False)
    # Remainders have the sign of the dividend, as in SQL.
    flat = np.fmod((events * 31)[:, None] + (i * i * 17 + i * 7), 9973).ravel() / 10000.0
    missing = None if known.all() else np.repeat(~known, dims.LABEL_COUNT)
    ends = np.arange(len(events) + 1, dtype=np.int32) * dims.LABEL_COUNT
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=missing))


_RANGES = ", ".join(f"('{c}', {a}, {b})" for c, a, b in dims.LABEL_RANGES)


@query("b13_label_rollup", f"""
WITH ranges(category, a, b) AS (VALUES {_RANGES}),
labels527 AS (SELECT i, coalesce(category, 'SFX') AS category FROM (SELECT unnest(range(527)) AS i)
  LEFT JOIN ranges ON i BETWEEN a AND b),
probs AS (SELECT event_id, category, max(((event_id*31 + i*i*17 + i*7) % 9973) / 10000e0) AS p
  FROM events, labels527 GROUP BY event_id, category),
wide AS (SELECT event_id,
  max(p) FILTER (category = 'DIALOGUE') AS dialogue,
  max(p) FILTER (category = 'VOCAL_NON_SPEECH') AS vocal,
  max(p) FILTER (category = 'MUSIC') AS music, max(p) FILTER (category = 'SFX') AS sfx,
  max(p) FILTER (category = 'BACKGROUND') AS background,
  max(p) FILTER (category = 'SILENCE') AS quiet FROM probs GROUP BY event_id)
SELECT w.event_id, round(dialogue, 6) AS dialogue, round(vocal, 6) AS vocal,
  round(music, 6) AS music, round(sfx, 6) AS sfx, round(background, 6) AS background,
  round(CASE WHEN value / 1e4 < 0.003e0 THEN greatest(quiet, 0.99e0) ELSE quiet END, 6) AS silence,
  CASE greatest(dialogue, vocal, music, sfx, background,
      CASE WHEN value / 1e4 < 0.003e0 THEN greatest(quiet, 0.99e0) ELSE quiet END)
    WHEN dialogue THEN 'DIALOGUE' WHEN vocal THEN 'VOCAL_NON_SPEECH' WHEN music THEN 'MUSIC'
    WHEN sfx THEN 'SFX' WHEN background THEN 'BACKGROUND' ELSE 'SILENCE' END AS event_type
FROM wide w JOIN events e ON w.event_id = e.event_id""")
def label_rollup(spark, sf_dir):
    e = B.spread(B.table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    probs = _label_probabilities(F.col("event_id"))
    w = e.select("event_id", probs.alias("probs"), (F.col("value") / 1e4).alias("level"))
    out = R.label_rollup(w, ["event_id"], "probs", "level")
    pick = lambda n: F.round(F.col("scores")[n], 6)
    return out.select(
        "event_id", pick("DIALOGUE").alias("dialogue"), pick("VOCAL_NON_SPEECH").alias("vocal"),
        pick("MUSIC").alias("music"), pick("SFX").alias("sfx"),
        pick("BACKGROUND").alias("background"), pick("SILENCE").alias("silence"),
        R.decision_from_scores(F.col("scores"))["event_type"].alias("event_type"))


def translations(spark, sf_dir):
    """Made translations: mostly the source with a mark, some blank, equal or looping."""
    seg, blk = B.segments(spark, sf_dir)
    n = F.col("session_id") * 5 + F.col("seq")
    made = (F.when(n % 23 == 1, "").when(n % 23 == 2, F.col("text"))
            .when(n % 23 == 3, "no no no no no no").otherwise(
        F.concat(F.lit("So, "), F.lower("text"))))
    target = F.when(F.col("language") == "en", "ja").when(
        F.col("language") == "ja", "ko").otherwise("en")
    return seg.select("session_id", "seq", *([blk] if blk else []), "speaker",
                      F.col("text").alias("source_text"), made.alias("translated_text"),
                      F.col("language").alias("source_language"),
                      target.alias("target_language"), "start_s", "end_s",
                      (F.col("seq") % 19 != 7).alias("timestamps_available")), blk


TRANS = B.SEG + """
, trans AS (SELECT session_id, seq, speaker, text AS source_text,
  CASE (session_id*5 + seq) % 23 WHEN 1 THEN '' WHEN 2 THEN text WHEN 3 THEN 'no no no no no no'
    ELSE 'So, ' || lower(text) END AS translated_text, language AS source_language,
  CASE language WHEN 'en' THEN 'ja' WHEN 'ja' THEN 'ko' ELSE 'en' END AS target_language,
  start_s, end_s, seq % 19 <> 7 AS timestamps_available FROM seg)
"""

_ISSUES = TRANS + r""",
 t0 AS (SELECT *, trim(translated_text) AS t, regexp_extract_all(trim(translated_text),
   '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS toks FROM trans),
 t1 AS (SELECT *, list_filter([
   CASE WHEN t = '' THEN 'empty_output' END,
   CASE WHEN len(toks) >= 4 AND len(list_filter(list_zip(toks[1:len(toks)-1], toks[2:]),
     lambda p: p[1] = p[2])) / (len(toks) - 1)::DOUBLE > 0.5e0 THEN 'repetition' END,
   CASE WHEN t = '' OR (target_language = 'ja' AND NOT regexp_matches(t, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]'))
     OR (target_language = 'ko' AND NOT regexp_matches(t, '[\x{ac00}-\x{d7af}]'))
     THEN 'possible_language_mismatch' END,
   CASE WHEN t = trim(source_text) AND trim(source_text) <> ''
     AND source_language <> target_language THEN 'unchanged_source_text' END],
   lambda x: x IS NOT NULL) AS issues FROM t0)
"""


@query("b14_translation_validation", f"""
WITH {_ISSUES}
SELECT session_id, seq, array_to_string(issues, '|') AS issues,
  NOT list_has_any(issues, ['empty_output', 'repetition']) AS valid,
  NOT list_contains(issues, 'empty_output') AS valid_fast, len(issues) = 0 AS valid_strict,
  round(1 - least(0.8e0, 0.2e0 * len(issues)), 6) AS confidence FROM t1""")
def translation_validation(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    out = R.validate_translations(t)
    strict = F.size("issues") == 0
    return out.select("session_id", "seq", F.array_join("issues", "|").alias("issues"), "valid",
                      (~F.array_contains("issues", "empty_output")).alias("valid_fast"),
                      strict.alias("valid_strict"),
                      F.round("validation_confidence", 6).alias("confidence"))


@query("b15_media_limits", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'NO_AUDIO_STREAM'
  WHEN o_totalprice / 20 - 200 <= 0 THEN 'CORRUPTED_MEDIA'
  WHEN o_totalprice / 20 - 200 > 14400 THEN 'MEDIA_TOO_LONG' ELSE 'ok' END AS code
FROM orders""")
def media_limits(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.coalesce(R.media_error(
        F.col("o_totalprice") / 20 - 200,
        F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(1)), F.lit("ok")).alias("code"))


@query("b16_subtitle_lines", f"""
WITH {TRANS}
SELECT session_id, seq, start_s, CASE WHEN seq % 5 = 0 THEN start_s + 1 ELSE end_s END AS end_s
FROM trans WHERE timestamps_available AND trim(translated_text) <> ''""")
def subtitle_lines(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    zeroed = t.withColumn("end_s", F.when(F.col("seq") % 5 == 0, F.col("start_s"))
                          .otherwise(F.col("end_s")))
    return R.timed_lines(zeroed).select("session_id", "seq", "start_s", "end_s")


def jobs(spark, sf_dir):
    """Orders as file jobs."""
    o = B.table(spark, sf_dir, "orders")
    begun = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    spent = (F.col("o_totalprice") / 100).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(
            F.col("o_orderstatus") == "P", "failed").otherwise("translating").alias("status"),
        begun.cast("double").alias("started_s"), (begun + spent).cast("double")
        .alias("finished_s"), spent.cast("double").alias("spent_s"))


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'translating' END AS status,
  epoch(o_orderdate)::BIGINT::DOUBLE AS started_s, trunc(o_totalprice / 100)::BIGINT::DOUBLE AS spent_s,
  (epoch(o_orderdate)::BIGINT + trunc(o_totalprice / 100)::BIGINT)::DOUBLE AS finished_s FROM orders)"""


@query("b17_retention", f"""
WITH {JOBS}
SELECT job_id, status, finished_s FROM jobs
WHERE status IN ('completed', 'failed', 'cancelled') AND finished_s < 946684800e0 - 86400e0*365""")
def retention(spark, sf_dir):
    return R.expired_jobs(jobs(spark, sf_dir), F.lit(946684800.0), 86400.0 * 365).select(
        "job_id", "status", "finished_s")


@query("b18_expired_sessions", f"""
WITH {JOBS}, s AS (SELECT owner, min(started_s) AS started_s FROM jobs GROUP BY owner)
SELECT owner, started_s FROM s WHERE started_s < 946684800e0 - 14400e0*365""")
def expired_sessions(spark, sf_dir):
    s = jobs(spark, sf_dir).groupBy("owner").agg(F.min("started_s").alias("started_s"))
    return R.expired_sessions(s, F.lit(946684800.0), 14400.0 * 365)
