"""C1, C13, C18 and F: intervals, folds and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill import dims

from talkmill.operators import intervals as I
from talkmill.operators import ordered as O
from talkmill.operators import segmentation as S
from talkmill.operators import timeline as L
from talkmill.plans import bindings as B
from talkmill.plans.registry import query

KEY = ["session_id"]


# -- C: interval joins -------------------------------------------------------------------

_C1 = B.GATE + """
, pairs AS (
  SELECT s.session_id, s.seq, s.start_s, s.end_s, g.w, g.should_transcribe, g.event_type,
    g.confidence, least(s.end_s + 0.5e0, g.end_s) - greatest(s.start_s - 0.5e0, g.start_s) AS ov
  FROM seg s JOIN gate g ON s.session_id = g.session_id
    AND g.start_s < s.end_s + 0.5e0 AND g.end_s > s.start_s - 0.5e0),
best AS (
  SELECT session_id, seq, any_value(end_s - start_s) AS span,
    sum(ov) FILTER (should_transcribe) AS approved,
    arg_max({'e': event_type, 'c': confidence, 'k': true}, {'c': confidence, 'w': -w})
      FILTER (should_transcribe) AS yes,
    arg_max({'e': event_type, 'c': confidence, 'k': false}, {'c': ov, 'w': -w})
      FILTER (NOT should_transcribe) AS no
  FROM pairs WHERE ov > 0 GROUP BY session_id, seq),
verdict AS (
  SELECT session_id, seq, CASE WHEN approved / greatest(1e-6, span) >= 0.25e0 THEN yes
    ELSE coalesce(no, yes) END AS v FROM best)
"""


@query("c01_span_verdicts", f"""
WITH {_C1}
SELECT s.session_id, s.seq, coalesce(v.e, 'none') AS event_type,
  coalesce(v.k, false) AS should_transcribe, round(coalesce(v.c, -1e0), 6) AS confidence
FROM seg s LEFT JOIN verdict USING (session_id, seq)""")
def span_verdicts(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    g, _ = B.gate(spark, sf_dir)
    out = I.span_verdicts(seg.select("session_id", "seq", "start_s", "end_s"), g, KEY, "seq", "w")
    return out.select(
        "session_id", "seq",
        F.coalesce("decision.event_type", F.lit("none")).alias("event_type"),
        F.coalesce("decision.should_transcribe", F.lit(False)).alias("should_transcribe"),
        F.round(F.coalesce("decision.confidence", F.lit(-1.0)), 6).alias("confidence"))


@query("c13_reference_spans", f"""
WITH RECURSIVE {B.SEG},
line AS (SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(speaker, -1)
  ORDER BY seq) AS rn, coalesce(speaker, -1) AS spk FROM seg),
grow AS (
  SELECT session_id, spk, seq, start_s AS a, end_s AS b, 0::BIGINT AS hop FROM line
  UNION ALL
  SELECT g.session_id, g.spk, g.seq,
    CASE WHEN g.b - g.a < 3 AND abs(l.start_s - g.a) < 20 THEN least(g.a, l.start_s) ELSE g.a END,
    CASE WHEN g.b - g.a < 3 AND abs(l.start_s - g.a) < 20 THEN greatest(g.b, l.end_s) ELSE g.b END,
    g.hop + 1
  FROM grow g JOIN line l ON g.session_id = l.session_id AND g.spk = l.spk AND l.rn = g.hop + 1)
SELECT session_id, seq, round(a, 3) AS ref_start, round(least(b, a + 12), 3) AS ref_end
FROM grow QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY hop DESC) = 1""")
def reference_spans(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    out = I.reference_spans(seg, KEY, "seq")
    return out.select("session_id", "seq", F.round("ref_start", 3).alias("ref_start"),
                      F.round("ref_end", 3).alias("ref_end"))


@query("c18_ground_truth_hits", f"""
WITH {B.GATE}, truth AS (SELECT * FROM gate WHERE event_type IN ('MUSIC', 'SFX'))
SELECT t.session_id, t.w, t.event_type, EXISTS (SELECT 1 FROM seg s
  WHERE s.session_id = t.session_id AND s.start_s < t.end_s AND s.end_s > t.start_s
    AND s.speaker IS NOT NULL) AS hit FROM truth t""")
def ground_truth(spark, sf_dir):
    g, _ = B.gate(spark, sf_dir)
    seg, _ = B.segments(spark, sf_dir)
    truth = g.where(F.col("event_type").isin("MUSIC", "SFX")).select(
        "session_id", "w", "event_type", "start_s", "end_s")
    out = I.overlaps_any(truth, seg.where(F.col("speaker").isNotNull()), KEY, ["w"])
    return out.select("session_id", "w", "event_type", "hit")


# -- F1-F4: units ------------------------------------------------------------------------

_profile_row = lambda p: (
    "('{language}', '{latency}', {pause_threshold_ms}, {minimum_stable_chars}, {max_chars}, "
    "{max_seconds}e0, {bias}, [{ends}]::VARCHAR[])".format(
        **p, bias=str(p["sentence_final_bias"]).lower(),
        ends=", ".join(f"'{e}'" for e in p["endings"])))
_PROFILE_ROWS = ", ".join(
    _profile_row(dims.profile(a, b)) for a in dims.PROFILES for b in dims.LATENCIES)
PROFILES = f"""profiles(language, latency, pause_threshold_ms, minimum_stable_chars, max_chars,
  max_seconds, bias, endings) AS (VALUES {_PROFILE_ROWS})"""

_DENSE = r"[\x{3000}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]"
_SEP = lambda a, b: (
    f"CASE WHEN {a} = '' OR regexp_matches({a}, '[ \\n]$') OR regexp_matches({a}, '{_DENSE}$') "
    f"OR regexp_matches({b}, '^{_DENSE}') OR regexp_matches({b}, "
    "'^[.,!?;:)\\]}%''\"、。！？」』）]') THEN '' ELSE ' ' END")

UNITS = B.SEG + f"""
, {PROFILES},
feed AS (
  SELECT s.session_id, s.text, s.start_s, s.end_s, s.speaker, s.language,
    row_number() OVER (PARTITION BY s.session_id ORDER BY s.seq) AS rn,
    p.pause_threshold_ms AS pt, p.minimum_stable_chars AS mn, p.max_chars AS mx,
    p.max_seconds AS ms, p.bias, p.endings
  FROM seg s JOIN profiles p ON p.language = s.language AND p.latency = 'balanced'),
run AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, '' AS text, 0e0 AS a, 0e0 AS b,
    NULL::INTEGER AS spk, NULL::VARCHAR AS lang, NULL::DOUBLE AS last,
    NULL::STRUCT(t VARCHAR, a DOUBLE, b DOUBLE, s INTEGER, l VARCHAR, r VARCHAR) AS e1,
    NULL::STRUCT(t VARCHAR, a DOUBLE, b DOUBLE, s INTEGER, l VARCHAR, r VARCHAR) AS e2
  FROM feed
  UNION ALL
  SELECT session_id, rn, CASE WHEN why IS NULL THEN t2 ELSE '' END, a2, b2, s2, l2, last2, e1,
    CASE WHEN why IS NOT NULL THEN {{'t': t2, 'a': a2, 'b': b2, 's': s2, 'l': l2, 'r': why}} END
  FROM (
    SELECT *, CASE WHEN length(t2) >= mx THEN 'max_chars'
      WHEN greatest(0e0, b2 - a2) >= ms THEN 'max_seconds'
      WHEN length(t2) < mn THEN NULL
      WHEN regexp_matches(t2, '[.!?。！？…‥]$') THEN 'punctuation'
      WHEN bias THEN CASE WHEN len(list_filter(endings, lambda e: ends_with(t2, e))) > 0
        THEN 'sentence_final' END
      WHEN regexp_matches(t2, '[,、，;；:：]$') AND length(t2) >= mx // 2 THEN 'soft_break'
      END AS why
    FROM (
      SELECT session_id, rn, mx, ms, mn, bias, endings, last2, e1,
        CASE WHEN fresh THEN ntext ELSE text || {_SEP('text', 'ntext')} || ntext END AS t2,
        CASE WHEN fresh THEN na ELSE a END AS a2, nb AS b2,
        CASE WHEN fresh THEN nspk ELSE spk END AS s2,
        CASE WHEN fresh THEN nlang ELSE lang END AS l2
      FROM (
        SELECT *, text = '' OR e1 IS NOT NULL AS fresh FROM (
          SELECT r.session_id, f.rn, r.text, r.a, r.b, r.spk, r.lang, f.text AS ntext,
            f.start_s AS na, f.end_s AS nb, f.speaker AS nspk, f.language AS nlang,
            f.end_s AS last2, f.mx, f.ms, f.mn, f.bias, f.endings,
            CASE WHEN r.text <> '' AND r.last IS NOT NULL
                AND greatest(0e0, f.start_s - r.last) * 1000 >= f.pt AND length(r.text) >= f.mn
              THEN {{'t': r.text, 'a': r.a, 'b': r.b, 's': r.spk, 'l': r.lang, 'r': 'pause'}}
              WHEN r.text <> '' AND f.speaker <> r.spk
              THEN {{'t': r.text, 'a': r.a, 'b': r.b, 's': r.spk, 'l': r.lang,
                     'r': 'speaker_change'}} END AS e1
          FROM run r JOIN feed f ON f.session_id = r.session_id AND f.rn = r.rn + 1))))),
emitted AS (
  SELECT session_id, rn, 1 AS k, e1 AS e FROM run WHERE e1 IS NOT NULL
  UNION ALL SELECT session_id, rn, 2, e2 FROM run WHERE e2 IS NOT NULL
  UNION ALL SELECT session_id, rn, 3, {{'t': text, 'a': a, 'b': b, 's': spk, 'l': lang,
      'r': 'end_of_file'}} FROM run WHERE text <> ''
    AND rn = (SELECT max(rn) FROM feed f WHERE f.session_id = run.session_id)),
units AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rn, k) AS unit,
    e.t AS text, e.a AS start_s, e.b AS end_s, e.s AS speaker, e.l AS language, e.r AS reason
  FROM emitted)
"""


def units(spark, sf_dir, extra=None):
    seg, blk = B.segments(spark, sf_dir)
    feed = S.with_profiles(
        seg.select("session_id", "seq", *([blk] if blk else []), "text", "start_s", "end_s",
                   "speaker", "language"), dims.lang_profiles(spark, extra))
    return O.run_fold(feed, S.UNITS, KEY, ["seq"], blk)


@query("f01_translation_units", f"""
WITH RECURSIVE {UNITS}
SELECT session_id, unit, text, start_s, end_s, coalesce(speaker, -1) AS speaker, language, reason
FROM units""")
def translation_units(spark, sf_dir):
    return units(spark, sf_dir).withColumn("speaker", F.coalesce("speaker", F.lit(-1)))



#: A user's profile in place of the built-in one of its language.
OWN_PROFILE = {**dims.profile("en"), "max_chars": 60, "minimum_stable_chars": 25,
               "pause_threshold_ms": 900}
_OWN_UNITS = UNITS.replace(_profile_row(dims.profile("en")), _profile_row(OWN_PROFILE))


@query("j05_registered_profile", f"""
WITH RECURSIVE {_OWN_UNITS}
SELECT session_id, unit, text, start_s, end_s, coalesce(speaker, -1) AS speaker, language, reason
FROM units""")
def registered_profile(spark, sf_dir):
    """Units with a registered profile for English."""
    return units(spark, sf_dir, [OWN_PROFILE]).withColumn(
        "speaker", F.coalesce("speaker", F.lit(-1)))


@query("f02_silence_flush", f"""
WITH RECURSIVE {UNITS}
SELECT session_id, unit, text, replace(reason, 'pause', 'silence') AS reason FROM units""")
def silence_flush(spark, sf_dir):
    """The audio layer reports each gap as its own row before the next line."""
    seg, blk = B.segments(spark, sf_dir)
    keep = ["session_id", "seq", *([blk] if blk else []), "text", "start_s", "end_s", "speaker",
            "language"]
    quiet = S.pauses(seg, KEY, ["seq"], blk).select(*keep, "pause_s")
    steps = F.array(F.struct(F.lit(0).alias("step"), F.col("pause_s").alias("silence_s")),
                    F.struct(F.lit(1).alias("step"), F.lit(None).cast("double").alias("silence_s")))
    feed = S.with_profiles(quiet, dims.lang_profiles(spark)).withColumn(
        "_s", F.explode(steps)).select("*", "_s.step", "_s.silence_s").drop("_s")
    out = O.run_fold(feed, S.UNITS, KEY, ["seq", "step"], blk)
    return out.select("session_id", "unit", "text", "reason")


@query("f03_profiles", f"""
WITH {B.SEG}, {PROFILES}, latency(latency) AS (VALUES ('low_latency'), ('balanced'), ('accurate'))
SELECT s.session_id, s.seq, l.latency, p.pause_threshold_ms, p.minimum_stable_chars, p.max_chars,
  p.max_seconds
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN upper(language) || '-XX' WHEN seq % 7 = 1 THEN 'fr'
    ELSE language END AS tag FROM seg) s, latency l
JOIN profiles p ON p.latency = l.latency AND p.language =
  CASE WHEN split_part(lower(s.tag), '-', 1) IN ('en','ja','ko','zh','hi')
    THEN split_part(lower(s.tag), '-', 1) ELSE 'default' END""")
def profiles(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    tag = F.when(F.col("seq") % 3 == 0, F.concat(F.upper("language"), F.lit("-XX"))).when(
        F.col("seq") % 7 == 1, "fr").otherwise(F.col("language"))
    base = seg.select("session_id", "seq", tag.alias("language"))
    return S.with_every_profile(base, dims.lang_profiles(spark)).select(
        "session_id", "seq", "latency", "pause_threshold_ms", "minimum_stable_chars",
        "max_chars", "max_seconds")


@query("f04_pauses", f"""
WITH {B.SEG}
SELECT session_id, seq, round(greatest(0e0, coalesce(start_s - lag(end_s) OVER (
  PARTITION BY session_id ORDER BY seq), 0e0)), 6) AS pause_s FROM seg""")
def pauses(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    out = S.pauses(seg, KEY, ["seq"], blk)
    return out.select("session_id", "seq", F.round("pause_s", 6).alias("pause_s"))


# -- F5-F9: verdict runs, windows, chunks ------------------------------------------------

MERGED = B.GATE + """
, flagged AS (SELECT *, CASE WHEN lag(should_transcribe) OVER w = should_transcribe
    AND lag(event_type) OVER w = event_type AND start_s - lag(end_s) OVER w <= 0.05e0
    THEN 0 ELSE 1 END AS opens FROM gate WINDOW w AS (PARTITION BY session_id ORDER BY w)),
runs AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY w) AS BIGINT) AS island
  FROM flagged),
merged AS (SELECT session_id, island, arg_min(should_transcribe, w) AS should_transcribe,
  arg_min(event_type, w) AS event_type, arg_min(reason, w) AS reason, min(start_s) AS start_s,
  max(end_s) AS end_s, sum(confidence * (end_s - start_s)) / greatest(sum(end_s - start_s), 1e-6)
    AS confidence FROM runs GROUP BY session_id, island)
"""


def merged(spark, sf_dir):
    g, blk = B.gate(spark, sf_dir)
    return I.merge_equal(g, KEY, ["w"], blk)


@query("f05_merged_verdicts", f"""
WITH {MERGED}
SELECT session_id, island, should_transcribe, event_type, reason, start_s, end_s,
  round(confidence, 6) AS confidence FROM merged""")
def merged_verdicts(spark, sf_dir):
    return merged(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query("f06_region_windows", f"""
WITH {B.SEG}, n AS (SELECT *, end_s - start_s AS len, greatest(1, CASE
    WHEN (end_s - start_s) - floor((end_s - start_s) / 2) * 2 < 1
    THEN floor((end_s - start_s) / 2) ELSE ceil((end_s - start_s) / 2) END)::INTEGER AS n FROM seg),
parts AS (SELECT *, unnest(range(n))::INTEGER AS part FROM n WHERE len > 1e-3)
SELECT session_id, seq, part, round(start_s + part * 2e0, 3) AS window_start,
  round(CASE WHEN part = n - 1 THEN end_s ELSE start_s + part * 2e0 + 2 END, 3) AS window_end
FROM parts""")
def region_windows(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    out = I.region_windows(seg.select("session_id", "seq", "start_s", "end_s"))
    return out.select("session_id", "seq", "part",
                      F.round("window_start", 3).alias("window_start"),
                      F.round("window_end", 3).alias("window_end"))


def _packed(limit: str, gap: str) -> str:
    return MERGED + f"""
, reg AS (SELECT session_id, start_s, end_s, row_number() OVER (
    PARTITION BY session_id ORDER BY island) AS rn FROM merged WHERE should_transcribe),
pack AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, NULL::DOUBLE AS a, NULL::DOUBLE AS b,
    []::STRUCT(a DOUBLE, b DOUBLE)[] AS e FROM reg
  UNION ALL
  SELECT session_id, rn,
    CASE WHEN joins THEN pa ELSE ra END, rb,
    list_concat(CASE WHEN pa IS NOT NULL AND NOT joins THEN [{{'a': pa, 'b': pb}}]
      ELSE []::STRUCT(a DOUBLE, b DOUBLE)[] END, []::STRUCT(a DOUBLE, b DOUBLE)[])
  FROM (SELECT p.session_id, r.rn, p.a AS pa, p.b AS pb, r.start_s AS ra, r.end_s AS rb,
      coalesce(r.start_s - p.b {gap} AND r.end_s - p.a <= {limit}, false) AS joins
    FROM pack p JOIN reg r ON r.session_id = p.session_id AND r.rn = p.rn + 1)),
chunks AS (
  SELECT session_id, e[1].a AS start_s, e[1].b AS end_s FROM pack WHERE len(e) > 0
  UNION ALL
  SELECT session_id, a, b FROM pack WHERE a IS NOT NULL AND rn = (
    SELECT max(rn) FROM reg WHERE reg.session_id = pack.session_id))
"""


def _speech(spark, sf_dir):
    g, blk = B.gate(spark, sf_dir)
    m = I.merge_equal(g, KEY, ["w"], blk).where("should_transcribe")
    return O.split_hot(m, KEY, "island") if blk else (m, None)


def _levels(spark, sf_dir):
    """A level every tenth of a second of every classifier window."""
    w, _ = B.windows(spark, sf_dir)
    return w.select("session_id", "w", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select(
        "session_id", (F.col("w") * 2 + F.col("i") * 0.1).alias("t"),
        ((F.col("w") * 131 + F.col("i") * 17) % 97).cast("double").alias("level"))


def _cut(limit: float, gap: float = 0.8) -> str:
    """Packing one region or cut at a time; ``rest`` is what is left of an over-long region."""
    return MERGED + f"""
, lv AS (SELECT session_id, list({{'t': w * 2 + i * 0.1e0, 'l': ((w*131 + i*17) % 97)::DOUBLE}}) AS f
  FROM win, (SELECT unnest(range(20)) AS i) GROUP BY session_id),
reg AS (SELECT session_id, start_s, end_s, row_number() OVER (
    PARTITION BY session_id ORDER BY island) AS rn FROM merged WHERE should_transcribe),
pack AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, 0::BIGINT AS step, NULL::DOUBLE AS a, NULL::DOUBLE AS b,
    NULL::DOUBLE AS oa, NULL::DOUBLE AS ob, NULL::DOUBLE AS ea, NULL::DOUBLE AS eb FROM reg
  UNION ALL
  SELECT session_id, rn2, step + 1, CASE WHEN cuts THEN here WHEN a IS NULL THEN ra END,
    CASE WHEN cuts THEN b WHEN a IS NULL THEN rb END,
    CASE WHEN cuts THEN a WHEN a IS NULL THEN oa WHEN joins THEN oa ELSE a END,
    CASE WHEN cuts THEN here WHEN a IS NULL THEN ob ELSE b END,
    CASE WHEN a IS NULL OR (joins AND NOT cuts) THEN NULL ELSE oa END,
    CASE WHEN a IS NULL OR (joins AND NOT cuts) THEN NULL ELSE ob END
  FROM (
    SELECT *, CASE WHEN len(q) = 0 THEN a + 0.75e0 * {limit} ELSE list_min(list_transform(q,
        lambda x: {{'l': x.l, 't': x.t}})).t + 0.1e0 / 2 END AS here
    FROM (
      SELECT *, CASE WHEN cuts THEN list_filter(f, lambda x: a + {limit} / 2e0 - 1e-9 <= x.t
          AND x.t + 0.1e0 <= a + {limit} + 1e-9) ELSE [] END AS q
      FROM (
        SELECT p.*, r.rn AS nrn, coalesce(r.rn, p.rn) AS rn2, r.start_s AS ra, r.end_s AS rb, lv.f,
          coalesce(p.b - p.a > {limit}, false) AS cuts,
          coalesce(p.a - p.ob <= {gap} AND p.b - p.oa <= {limit}, false) AS joins
        FROM pack p JOIN lv USING (session_id)
        LEFT JOIN reg r ON r.session_id = p.session_id AND r.rn = p.rn + 1 AND p.a IS NULL
        WHERE p.a IS NOT NULL OR r.rn IS NOT NULL)))),
chunk AS (
  SELECT session_id, step, ea AS a, eb AS b FROM pack WHERE ea IS NOT NULL
  UNION ALL SELECT session_id, step + 1, oa, ob FROM pack WHERE oa IS NOT NULL AND step = (
    SELECT max(step) FROM pack z WHERE z.session_id = pack.session_id))
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY step) AS chunk,
  round(a, 3) AS start_s, round(b, 3) AS end_s FROM chunk"""


def _chunks(spark, sf_dir, **limits):
    m, blk = _speech(spark, sf_dir)
    return I.pack_regions(m, KEY, ["island"], blk, _levels(spark, sf_dir), **limits).select(
        "session_id", "chunk", F.round("start_s", 3).alias("start_s"),
        F.round("end_s", 3).alias("end_s"))


@query("f07_speech_chunks", f"WITH RECURSIVE {_cut('28e0')}")
def speech_chunks(spark, sf_dir):
    """Regions packed up to 28 s; longer ones cut at their quietest frame (F8)."""
    return _chunks(spark, sf_dir)


@query("f08_cut_chunks", f"WITH RECURSIVE {_cut('3e0')}")
def cut_chunks(spark, sf_dir):
    """The same with a limit of 3 s, which most regions exceed, some of them several times."""
    return _chunks(spark, sf_dir, max_seconds=3.0)


@query("f07_packed_regions", f"""
WITH RECURSIVE {_packed('1e9', '<= 3')}
SELECT session_id, start_s, end_s FROM chunks""")
def packed_regions(spark, sf_dir):
    m, blk = _speech(spark, sf_dir)
    return I.pack_regions(m, KEY, ["island"], blk, gap=3.0, max_seconds=1e9).drop("chunk")


@query("f09_packed_unsplit", f"""
WITH RECURSIVE {_packed('30', '< 4.6')}
SELECT session_id, start_s, end_s FROM chunks""")
def packed_unsplit(spark, sf_dir):
    """The region-level variant: open limit on the gap, own maximum, no cutting."""
    m, blk = _speech(spark, sf_dir)
    return I.pack_regions(m, KEY, ["island"], blk, gap=4.6, max_seconds=30.0, strict=True,
                          split=False).drop("chunk")


@query("f08_quietest_frame", f"""
WITH {MERGED}, frames AS (
  SELECT session_id, w * 2 + i * 0.1e0 AS t, ((w*131 + i*17) % 97)::DOUBLE AS level
  FROM win, (SELECT unnest(range(20)) AS i)),
long AS (SELECT * FROM merged WHERE should_transcribe AND end_s - start_s > 6)
SELECT l.session_id, l.island, round(arg_min(f.t, {{'l': f.level, 't': f.t}}), 3) AS quiet_at
FROM long l JOIN frames f ON f.session_id = l.session_id AND f.t >= l.start_s - 1e-9
  AND f.t + 0.1e0 <= l.end_s + 1e-9 GROUP BY ALL""")
def quietest_frame(spark, sf_dir):
    m, _ = _speech(spark, sf_dir)
    inside = I.frames_inside(m, _levels(spark, sf_dir), KEY,
                             ["session_id", "island", "start_s", "end_s"], 6.0)
    return inside.where(
        (F.col("t") >= F.col("start_s") - 1e-9) & (F.col("t") + 0.1 <= F.col("end_s") + 1e-9)
    ).groupBy("session_id", "island").agg(
        F.round(F.min(F.struct("level", "t"))["t"], 3).alias("quiet_at"))


# -- F10-F13 -----------------------------------------------------------------------------

@query("f10_text_event_groups", f"""
WITH {B.SEG}, ev AS (SELECT session_id, seq, start_s AS t, trim(text) AS text,
    seq % 11 = 5 AS finished FROM seg),
p AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 1.5e0
    OR lag(regexp_matches(text, '[.!?。！？]$') OR finished) OVER w THEN 1 ELSE 0 END AS opens
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
g AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS cue FROM p),
c AS (SELECT session_id, cue, min(t) AS a, max(t) AS z, string_agg(text, ' ' ORDER BY seq) AS text
  FROM g GROUP BY session_id, cue)
SELECT session_id, cue, round(a, 3) AS start_s, round(least(greatest(z + 1.5e0, a + 1),
    coalesce(lead(a) OVER (PARTITION BY session_id ORDER BY cue), total + 1.5e0)), 3) AS end_s,
  regexp_replace(text, '\\s+([,.!?;:])', '\\1', 'g') AS text
FROM c JOIN (SELECT session_id, max(end_s) AS total FROM seg GROUP BY session_id) USING (session_id)""")
def text_event_groups(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    ev = seg.select("session_id", "seq", *([blk] if blk else []), F.col("start_s").alias("t"),
                    "text", (F.col("seq") % 11 == 5).alias("finished"))
    length = seg.groupBy("session_id").agg(F.max("end_s").alias("total"))
    return L.group_text_events(ev.join(length, "session_id"), KEY, ["seq"], blk,
                               F.col("total"))


@query("f11_trimmed_cues", f"""
WITH {B.SEG}, long AS (SELECT *, end_s + 0.7e0 AS e FROM seg),
n AS (SELECT *, lead(start_s) OVER (PARTITION BY session_id ORDER BY start_s, seq) AS nx FROM long)
SELECT session_id, seq, start_s, round(CASE WHEN e > nx THEN greatest(start_s + 0.3e0, nx - 0.01e0)
  ELSE e END, 3) AS end_s FROM n""")
def trimmed_cues(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    cues = seg.withColumn("end_s", F.col("end_s") + 0.7)
    out = L.trim_cues(cues, KEY, ["start_s", "seq"], blk)
    return out.select("session_id", "seq", "start_s", F.round("end_s", 3).alias("end_s"))


PLACED = B.SEG + """
, clip AS (SELECT session_id, seq, start_s, (dur_ms * (80 + seq % 60) / 99.7e0) / 1000 AS duration,
    row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM seg),
placed AS (
  SELECT session_id, seq, rn, start_s, duration, start_s AS actual FROM clip WHERE rn = 1
  UNION ALL
  SELECT c.session_id, c.seq, c.rn, c.start_s, c.duration,
    greatest(c.start_s, p.actual + p.duration + 0.05e0)
  FROM placed p JOIN clip c ON c.session_id = p.session_id AND c.rn = p.rn + 1)
"""


def clips(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    made = F.col("dur_ms") * (80 + F.col("seq") % 60) / 99.7 / 1000
    return seg.withColumn("duration", made), blk


@query("f12_timeline_placement", f"""
WITH RECURSIVE {PLACED}
SELECT session_id, seq, round(actual, 6) AS actual_start, round(actual - start_s, 6) AS drift
FROM placed""")
def timeline_placement(spark, sf_dir):
    c, blk = clips(spark, sf_dir)
    out = L.place(c, KEY, ["seq"], blk)
    return out.select("session_id", "seq", F.round("actual_start", 6).alias("actual_start"),
                      F.round("drift", 6).alias("drift"))


FITTED = B.SEG + """
, raw AS (SELECT *, (dur_ms * (80 + seq % 60) / 99.7e0) / 1000 AS raw_s, end_s - start_s AS src,
    0.8e0 + (seq % 5) / 10e0 AS asked FROM seg),
f0 AS (SELECT *, greatest(0.85e0, least(1.2e0, asked)) AS rate0, raw_s / src AS ratio FROM raw),
f1 AS (SELECT *, least(ratio, 1.2e0 / greatest(rate0, 1e-3)) AS factor FROM f0),
f2 AS (SELECT *, CASE WHEN ratio <= 1.15e0 THEN 'none' WHEN factor <= 1.01e0 THEN 'capped'
  WHEN seq % 2 = 0 THEN 'regenerate' ELSE 'time_stretch' END AS method FROM f1),
fitted AS (SELECT *, CASE WHEN method = 'regenerate' THEN least(1.2e0, rate0 * factor)
    WHEN method = 'time_stretch' THEN factor ELSE rate0 END AS rate,
  CASE WHEN method IN ('regenerate', 'time_stretch') THEN raw_s / factor ELSE raw_s END AS final
  FROM f2)
"""


def fitted(spark, sf_dir):
    c, blk = clips(spark, sf_dir)
    verdict = L.fit(F.col("duration"), F.col("end_s") - F.col("start_s"),
                    0.8 + (F.col("seq") % 5) / 10.0, F.col("seq") % 2 == 0)
    return c.withColumn("fit", verdict), blk


@query("f13_duration_fit", f"""
WITH {FITTED}
SELECT session_id, seq, method, round(rate, 6) AS rate, round(final, 6) AS final_duration,
  round(final / src, 6) AS mismatch FROM fitted""")
def duration_fit(spark, sf_dir):
    f, _ = fitted(spark, sf_dir)
    return f.select("session_id", "seq", "fit.method", F.round("fit.rate", 6).alias("rate"),
                    F.round("fit.final_duration", 6).alias("final_duration"),
                    F.round("fit.mismatch", 6).alias("mismatch"))


# -- F16-F22 -----------------------------------------------------------------------------

HYST = B.SEG + """
, ob AS (SELECT session_id, seq, detected, language_probability AS p, dur_ms / 1000e0 AS secs,
    row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM seg),
hy AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS cur,
    NULL::VARCHAR AS cand, 0 AS streak, 0e0 AS secs, false AS switched FROM ob
  UNION ALL
  SELECT session_id, rn, seq, CASE WHEN sw THEN detected ELSE cur END,
    CASE WHEN NOT counts THEN cand WHEN sw OR same THEN NULL ELSE detected END,
    CASE WHEN NOT counts THEN streak WHEN sw OR same THEN 0 ELSE ns END, secs, sw
  FROM (SELECT *, counts AND NOT same AND (cur IS NULL OR (ns >= 3 AND secs >= 2)) AS sw
    FROM (SELECT h.session_id, o.rn, o.seq, h.cur, h.cand, h.streak, h.secs + o.secs AS secs,
        o.detected, o.p >= 0.5e0 AS counts, o.detected IS NOT DISTINCT FROM h.cur AS same,
        CASE WHEN o.detected IS NOT DISTINCT FROM h.cand THEN h.streak + 1 ELSE 1 END AS ns
      FROM hy h JOIN ob o ON o.session_id = h.session_id AND o.rn = h.rn + 1)))
"""


@query("f16_language_hysteresis", f"""
WITH RECURSIVE {HYST}
SELECT session_id, seq, coalesce(cur, '') AS stable, switched FROM hy WHERE rn > 0""")
def language_hysteresis(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    feed = seg.select("session_id", "seq", *([blk] if blk else []), "detected",
                      F.col("language_probability").alias("probability"),
                      (F.col("dur_ms") / 1000.0).alias("seconds"))
    out = O.run_fold(feed, S.language_fold(), KEY, ["seq"], blk)
    return out.withColumn("stable", F.coalesce("stable", F.lit("")))


@query("f17_committed_text", f"""
WITH {B.SEG}, b AS (SELECT session_id, seq, trim(text) AS t, coalesce(lag(trim(text)) OVER (
  PARTITION BY session_id ORDER BY seq), '') AS before FROM seg)
SELECT session_id, string_agg({_SEP('before', 't')} || t, '' ORDER BY seq) AS text
FROM b GROUP BY session_id""")
def committed_text(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    return S.joined_text(seg, KEY, ["seq"], blk)


@query("f18_sample_clock", f"""
WITH {B.EVT}
SELECT user_id, event_id, coalesce(sum(1600 + event_id % 7 * 160) OVER (PARTITION BY user_id
  ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / 16000e0
  AS start_s FROM evt""")
def sample_clock(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    chunks = e.withColumns({"samples": 1600 + F.col("event_id") % 7 * 160,
                            "sample_rate": F.lit(16000)})
    out = L.sample_clock(chunks, ["user_id"], ["us", "event_id"], blk)
    return out.select("user_id", "event_id", "start_s")


@query("f19_fixed_blocks", """
WITH f AS (SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS samples FROM orders),
b AS (SELECT id, samples, unnest(range((samples - 1) // 9600000 + 1)) AS block FROM f WHERE samples > 0)
SELECT id, block, block * 9600000 AS first_sample,
  least(9600000, samples - block * 9600000) AS block_samples FROM b""")
def fixed_blocks(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("id"),
                 F.round(F.col("o_totalprice") * 100).cast("bigint").alias("samples"),
                 F.lit(16000).alias("sample_rate"))
    return L.fixed_blocks(f, 600.0).select("id", "block", "first_sample", "block_samples")


@query("f20_sequence_numbers", f"""
WITH {B.EVT}
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id)
  AS sequence_id FROM evt""")
def sequence_numbers(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    return L.number_rows(e, ["user_id"], ["us", "event_id"], blk).select(
        "user_id", "event_id", "sequence_id")


@query("f21_backlog", f"""
WITH RECURSIVE {B.SEG}, clip AS (SELECT session_id, seq, start_s + 1 AS tm,
    (dur_ms * (80 + seq % 60) / 60e0) / 1000 AS duration,
    row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM seg),
play AS (
  SELECT session_id, seq, rn, tm, tm + duration AS head FROM clip WHERE rn = 1
  UNION ALL
  SELECT c.session_id, c.seq, c.rn, c.tm, greatest(p.head, c.tm) + c.duration
  FROM play p JOIN clip c ON c.session_id = p.session_id AND c.rn = p.rn + 1)
SELECT session_id, seq, round(head - tm, 5) AS backlog_s, round(head - tm, 5) >= 6 AS overloaded
FROM play""")
def backlog(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    c = seg.withColumns({"at": F.col("start_s") + 1,
                         "duration": F.col("dur_ms") * (80 + F.col("seq") % 60) / 60.0 / 1000})
    out = L.backlog(c, KEY, ["seq"], blk)
    late = F.round("backlog_s", 5)
    return out.select("session_id", "seq", late.alias("backlog_s"),
                      (late >= 6).alias("overloaded"))


def frame_probs(spark, sf_dir):
    """Per-frame speech probability: frames tile the 2 s windows in 62 steps of 32 ms."""
    w, blk = B.windows(spark, sf_dir)
    f = w.select("session_id", *([blk] if blk else []), "w",
                 F.explode(F.sequence(F.lit(0), F.lit(61))).alias("i"))
    frame = F.col("w") * 62 + F.col("i")
    block = F.floor(frame / (8 + F.col("session_id") % 17))
    prob = ((block * block * 7 + F.col("session_id") * 13 + block * 3) % 10) / 10.0
    return f.select("session_id", *([blk] if blk else []), frame.alias("frame"),
                    prob.alias("prob")), blk


@query("f22_voiced_regions", f"""
WITH {B.WIN}, fr AS (SELECT session_id, w * 62 + i AS frame FROM win, (SELECT unnest(range(62)) AS i)),
pr AS (SELECT session_id, frame, ((b*b*7 + session_id*13 + b*3) % 10) / 10e0 AS prob FROM (
  SELECT *, frame // (8 + session_id % 17) AS b FROM fr)),
v AS (SELECT *, lag(frame) OVER (PARTITION BY session_id ORDER BY frame) AS p FROM pr WHERE prob >= 0.5e0),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR (frame - p - 1) * 32 >= 500 THEN 1 ELSE 0 END) OVER (
  PARTITION BY session_id ORDER BY frame) AS island FROM v),
s AS (SELECT session_id, island, min(frame) * 32 AS a, (max(frame) + 1) * 32 AS b, avg(prob) AS conf
  FROM r GROUP BY session_id, island HAVING (max(frame) + 1 - min(frame)) * 32 >= 250),
n AS (SELECT *, lag(b) OVER (PARTITION BY session_id ORDER BY a) AS pb,
  lead(a) OVER (PARTITION BY session_id ORDER BY a) AS na FROM s),
pad AS (SELECT session_id, a - least(200, coalesce((a - pb) // 2, a)) AS lo,
  b + least(200, coalesce((na - b) // 2, 200)) AS hi, conf FROM n),
parts AS (SELECT *, unnest(range(lo, hi, 30000)) AS p0 FROM pad)
SELECT session_id, p0 AS start_ms, least(p0 + 30000, hi) AS end_ms, round(conf, 6) AS confidence
FROM parts""")
def voiced_regions(spark, sf_dir):
    f, blk = frame_probs(spark, sf_dir)
    return I.voiced_regions(f, KEY, blk).withColumn("confidence", F.round("confidence", 6))
