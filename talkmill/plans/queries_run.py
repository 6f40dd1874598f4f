"""J and whole runs: user models, the translation step, recordings to subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import joins as J
from talkmill.operators import models as M
from talkmill.operators import ordered as O
from talkmill.plans import bindings as B
from talkmill.plans import file_run as RUN
from talkmill.plans.queries_context import _PROTECT, all_terms
from talkmill.plans.queries_io import _CLOCK, _WRAP
from talkmill.plans.queries_rules import _TEXT_SIGNALS, _VERDICT, _WORD_LIST, TRANS, _words, translations
from talkmill.plans.queries_time import _C1, KEY, UNITS
from talkmill.plans.registry import query


def shouting():
    """A stand-in for a user's model: marks the text with its language pair."""
    return lambda texts, sources, targets: [
        f"{s}>{t}: {x}" for x, s, t in zip(texts, sources, targets, strict=True)]


@query("j01_batch_translation", f"""
WITH {TRANS}
SELECT session_id, seq, source_language || '>' || target_language || ': ' || source_text
  AS translated_text FROM trans""")
def batch_translation(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    lines = t.select("session_id", "seq", "source_text", "source_language", "target_language")
    return M.translate_with(lines, shouting).select("session_id", "seq", "translated_text")


def sentences():
    """A stand-in recogniser: one segment per line of the payload, a second each."""
    return lambda text: [{"text": line, "start": float(i), "end": i + 1.0, "language": "en",
                          "confidence": 0.5} for i, line in enumerate(text.split("\n"))]


@query("j02_transcription", """
WITH c AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations),
p AS (SELECT conv_id, turn, unnest(ls) AS text, unnest(range(len(ls))) AS part FROM c)
SELECT conv_id, turn, part, text, turn * 10e0 + part AS start_s, turn * 10e0 + part + 1 AS end_s,
  'en' AS language, 0.5e0 AS confidence FROM p""")
def transcription(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").withColumn("start_s", F.col("turn") * 10.0)
    return M.transcribe_with(c, ["conv_id", "turn"], "text", "start_s", sentences).select(
        "conv_id", "turn", "part", "text", "start_s", "end_s", "language", "confidence")


def reminded():
    """A stand-in recogniser that is told what was said before: it gives its length."""
    return lambda text, prompt: [
        {"text": line, "start": float(i), "end": i + 1.0, "language": "en",
         "confidence": len(prompt) / 1000} for i, line in enumerate(text.split("\n"))]


@query("j02_transcription_udtf", f"""
WITH c AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations),
p AS (SELECT conv_id, turn, unnest(ls) AS text, unnest(range(len(ls))) AS part FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS place FROM p)
SELECT conv_id, turn, part, place, text, turn * 10e0 + part AS start_s, turn * 10e0 + part + 1 AS end_s,
  'en' AS language, least({M.PROMPT_CHARS}, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id
    ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 1000e0 AS confidence
FROM o""")
def transcription_udtf(spark, sf_dir):
    """The recogniser as a table function of SQL over a partitioned, ordered table."""
    M.register_transcriber(spark, "transcribe", reminded)
    B.table(spark, sf_dir, "conversations").createOrReplaceTempView("_chunks_to_transcribe")
    return spark.sql("""
        SELECT conv_id, turn, part, place, text, start_s, end_s, language, confidence
        FROM transcribe(payload => 'text', start => 'start_s', chunks => TABLE(
          SELECT conv_id, turn, text, turn * 10D AS start_s FROM _chunks_to_transcribe)
          PARTITION BY conv_id ORDER BY turn)""")


def lengths():
    return lambda texts: [{"DIALOGUE": min(1.0, len(t) / 500), "SILENCE": 0.25} for t in texts]


@query("j03_model_scores", """
SELECT conv_id, turn, round(least(1e0, length(text) / 500e0), 6) AS dialogue, 0.25e0 AS silence
FROM conversations""")
def model_scores(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    scored = c.select("conv_id", "turn", M.score_with(lengths)("text").alias("s"))
    return scored.select("conv_id", "turn", F.round(F.col("s")["DIALOGUE"], 6).alias("dialogue"),
                         F.col("s")["SILENCE"].alias("silence"))


@query("j04_batched_scores", """
SELECT conv_id, turn, round(least(1e0, length(text) / 500e0), 6) AS dialogue, true AS same
FROM conversations""")
def batched_scores(spark, sf_dir):
    """The number of items a model is given at once does not change their scores."""
    c = B.table(spark, sf_dir, "conversations")
    scored = c.select("conv_id", "turn", *[
        M.score_with(lengths, batch=n)("text").alias(f"s{n}") for n in (1, 8, 1000)])
    one, eight, many = (F.map_entries(f"s{n}") for n in (1, 8, 1000))
    return scored.select("conv_id", "turn", F.round(F.col("s8")["DIALOGUE"], 6).alias("dialogue"),
                         ((F.array_sort(one) == F.array_sort(eight))
                          & (F.array_sort(eight) == F.array_sort(many))).alias("same"))


def closeness():
    return lambda sources, said, wanted: [
        1.0 - abs(len(s) - len(w)) / max(1, len(s), len(w)) for s, w in zip(said, wanted)]


@query("j06_learned_metric", f"""
WITH {TRANS}
SELECT source_language, round(avg(1 - abs(length(translated_text) - length(source_text))
  / greatest(1, length(translated_text), length(source_text))::DOUBLE), 4) AS learned,
  NULL::DOUBLE AS without_model FROM trans GROUP BY source_language""")
def learned_metric(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    pairs = t.select("source_language", "source_text", F.col("translated_text")
                     .alias("hypothesis"), F.col("source_text").alias("reference_translation"))
    off = M.learned_metric(pairs, ["source_language"], None).withColumnRenamed(
        "learned", "without_model")
    return M.learned_metric(pairs, ["source_language"], closeness).join(off, "source_language")


def remembering():
    """A stand-in model whose answer depends on the context it is given."""
    return lambda text, previous, summary: (
        "" if text.startswith("L") else f"{len(previous)}/{len(summary)} {text}")


@query("j07_contextual_translation", f"""
WITH RECURSIVE {TRANS}, ln AS (SELECT session_id, seq, source_text AS x, row_number() OVER (
    PARTITION BY session_id ORDER BY seq) AS rn FROM trans),
ct AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, 0::BIGINT AS seq, []::VARCHAR[] AS told, '' AS said FROM ln
  UNION ALL
  SELECT session_id, rn, seq, CASE WHEN said = '' THEN told ELSE list_append(told, said) END, said FROM (
    SELECT *, CASE WHEN starts_with(x, 'L') THEN '' ELSE least(8, len(told)) || '/' || CASE
        WHEN length(old) > 400 THEN 403 ELSE length(old) END || ' ' || x END AS said FROM (
      SELECT c.session_id, l.rn, l.seq, l.x, c.told, array_to_string(list_transform(list_slice(
        told, greatest(1, len(told) - 31), greatest(0, len(told) - 8)), lambda t: trim(t)), ' ') AS old
      FROM ct c JOIN ln l ON l.session_id = c.session_id AND l.rn = c.rn + 1)))
SELECT session_id, seq, said AS translated_text FROM ct WHERE rn > 0""")
def contextual_translation(spark, sf_dir):
    t, blk = translations(spark, sf_dir)
    feed = t.select("session_id", "seq", *([blk] if blk else []), "source_text")
    return O.run_fold(feed, M.contextual_fold(remembering, max_tokens=10**6), KEY, ["seq"],
                      blk).select("session_id", "seq", "translated_text")


_BACK = "list_reduce(st.m, lambda a, t: {'x': replace(a.x, 'VBX' || t.p || 'X', t.t)}, {'x': said}).x"


@query("j07_translation_step", f"""
WITH {_PROTECT}, told AS (SELECT session_id, seq, language, st, CASE WHEN language = 'hi' THEN text
    ELSE 'Mr. Tanaka says ' || language || '>hi: ' || coalesce(st.x, text) END AS said,
    text FROM seg LEFT JOIN swapped USING (session_id, seq, text)),
put AS (SELECT *, CASE WHEN st IS NULL OR len(st.m) = 0 OR language = 'hi' THEN said ELSE {_BACK} END AS y FROM told)
SELECT session_id, seq, y AS translated_text FROM put""")
def translation_step(spark, sf_dir):
    """Glossary protection, a model, restoration and the honorific policy."""
    t, _ = translations(spark, sf_dir)
    lines = t.select("session_id", "seq", "source_text", "source_language",
                     F.lit("hi").alias("target_language"))

    def model(held):
        said = M.translate_with(held, shouting, text="masked", out="said")
        return said.withColumn("said", F.concat(F.lit("Mr. Tanaka says "), "said"))

    return M.translate_lines(lines, all_terms(spark, sf_dir), ["session_id", "seq"], model,
                             policy="preserve_honorifics").select(
        "session_id", "seq", "translated_text")


_TAIL = UNITS[len(B.SEG):].replace("FROM seg s JOIN profiles", "FROM accepted s JOIN profiles"
                                   ).replace("p.latency = 'balanced'", "p.latency = 'accurate'")


@query("r01_file_run_subtitles", f"""
WITH RECURSIVE {_C1}, base AS (
  SELECT s.session_id, s.seq, s.session_id || '/' || s.seq AS id, text, s.start_s, s.end_s, speaker,
    language, detected, language_probability, avg_logprob, no_speech_prob, compression_ratio, confidence,
    list_avg({_WORD_LIST.replace('session_id', 's.session_id').replace('seq', 's.seq')}) AS wp,
    v.e AS event_type, v.c AS gate_conf
  FROM seg s LEFT JOIN verdict USING (session_id, seq)), {_TEXT_SIGNALS},
conf AS (SELECT *, list_filter([confidence, exp(avg_logprob), 1 - no_speech_prob, wp],
    lambda x: x IS NOT NULL) AS p FROM signals),
scored AS (SELECT *, CASE WHEN len(p) = 0 THEN 0.8e0 ELSE
    greatest(0e0, least(1e0, list_sum(p) / len(p))) END AS conf FROM conf),
judged AS (SELECT *, {_VERDICT} AS reason FROM scored),
accepted AS (SELECT * FROM judged WHERE reason IS NULL)
{_TAIL},
memory AS (SELECT language, text AS source_text, min('= ' || lower(text)) AS translation
  FROM seg WHERE seq % 2 = 1 GROUP BY ALL),
said AS (SELECT session_id, unit AS seq, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s,
    CASE WHEN u.language = 'en' THEN text ELSE coalesce(translation, '[en] ' || text) END
      AS translated_text
  FROM units u LEFT JOIN memory m ON m.language = u.language AND m.source_text = u.text),
k0 AS (SELECT *, trim(regexp_replace(translated_text, '\\s+', ' ', 'g')) AS t FROM said),
k1 AS (SELECT *, lead(start_s) OVER (PARTITION BY session_id ORDER BY start_s, seq) AS nx,
  row_number() OVER (PARTITION BY session_id ORDER BY start_s, seq) AS cue, {_WRAP} AS line FROM k0),
cues AS (SELECT *, round(start_s * 1000)::BIGINT AS a, round(CASE WHEN end_s > nx
  THEN greatest(start_s + 0.3e0, nx - 0.01e0) ELSE end_s END * 1000)::BIGINT AS b FROM k1)
SELECT session_id, string_agg(cue || chr(10) || {_CLOCK('a', ',')} || ' --> ' || {_CLOCK('b', ',')}
  || chr(10) || line || chr(10), chr(10) ORDER BY cue) AS document FROM cues GROUP BY session_id""")
def file_run(spark, sf_dir):
    """Recognised segments and gate windows to finished English subtitle files.  Every other
    recognised line is known to the translation memory."""
    seg, blk = B.segments(spark, sf_dir)
    verdicts, _ = B.gate(spark, sf_dir)
    seg = seg.withColumn("words", _words())
    ok = RUN.accepted_segments(seg, verdicts, KEY, F.col("language"), "words")
    units = RUN.units_of(ok, dims.lang_profiles(spark), KEY, blk)
    memory = seg.where(F.col("seq") % 2 == 1).select(
        F.col("language").alias("source_language"), F.lit("en").alias("target_language"),
        F.col("text").alias("source_text"),
        F.concat(F.lit("= "), F.lower("text")).alias("translation"))
    lines = RUN.lines_of(units, "en", lambda u: J.from_memory(u, memory).drop("known"))
    return RUN.subtitles_of(lines, KEY, hot=blk is not None)
