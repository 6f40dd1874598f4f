"""D: recognition, translation and audio quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkmill.operators import quality as Q
from talkmill.operators import sketches as SK
from talkmill.operators import telemetry as T
from talkmill.plans import bindings as B
from talkmill.plans.queries_rules import FRAMES, frames
from talkmill.plans.queries_time import FITTED, PLACED, fitted
from talkmill.operators import timeline as L
from talkmill.plans.registry import query
from talkmill.session import shared_folder


def items(spark, sf_dir):
    """Every turn as one benchmark item: the text is the reference, and a copy with words
    dropped and replaced is the hypothesis.  System turns are non-speech items."""
    c = B.table(spark, sf_dir, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    words = F.filter(F.split("text", " "), lambda w, i: ((i + 1) * 3 + n + t) % 11 != 0)
    heard = F.array_join(F.transform(words, lambda w, i: F.when(
        (i + 1 + n) % 13 == 0, "um").otherwise(w)), " ")
    silent = F.col("role") == "system"
    return c.select(
        "conv_id", "turn", F.concat(F.lit("m"), (t % 3).cast("string")).alias("model"),
        (n % 2 == 0).alias("gate"), (n % 3 == 0).alias("validation"),
        F.element_at(F.array(*map(F.lit, ["en", "ja", "fr", "hi", "zh"])),
                     (n % 5 + 1).cast("int")).alias("source_language"),
        F.when((n + t) % 6 != 0, F.element_at(F.array(*map(F.lit, [
            "en", "ja", "fr", "hi", "zh"])), ((n + t % 2) % 5 + 1).cast("int")))
        .alias("detected"),
        F.when(silent, "").otherwise(F.col("text")).alias("reference_text"),
        F.when(silent & (n % 4 != 0), " ").otherwise(heard).alias("hypothesis"),
        ((n * 37 + t * 11) % 997 / 100.0).alias("latency"),
        (F.char_length("text") / 14.0).alias("media_s"))


ITEMS = """
items AS (SELECT conv_id, turn, 'm' || turn % 3 AS model, conv_id % 2 = 0 AS gate,
  conv_id % 3 = 0 AS validation, ['en','ja','fr','hi','zh'][conv_id % 5 + 1] AS source_language,
  CASE WHEN (conv_id + turn) % 6 <> 0
    THEN ['en','ja','fr','hi','zh'][(conv_id + turn % 2) % 5 + 1] END AS detected,
  CASE WHEN role = 'system' THEN '' ELSE text END AS reference_text,
  CASE WHEN role = 'system' AND conv_id % 4 <> 0 THEN ' ' ELSE array_to_string(list_transform(
    list_filter(string_split(text, ' '), lambda w, i: (i*3 + conv_id + turn) % 11 <> 0),
    lambda w, i: CASE WHEN (i + conv_id) % 13 = 0 THEN 'um' ELSE w END), ' ') END AS hypothesis,
  ((conv_id*37 + turn*11) % 997) / 100e0 AS latency, length(text) / 14e0 AS media_s
  FROM conversations)
"""

_NORM = lambda c: (
    f"trim(regexp_replace(regexp_replace(replace(lower({c}), 'ß', 'ss'), "
    r"'[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))")
_WORDS = lambda c: f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, ' ') END"
_BYTES = lambda c: f"translate(replace({c}, ' ', ''), 'éèêçñüöäíó', 'ABCDEFGHIJ')"

# One row of the edit table per reference word; the hypothesis is walked inside.
RATES = ITEMS + f"""
, nf AS (SELECT *, {_NORM('reference_text')} AS r, {_NORM('hypothesis')} AS h FROM items),
tok AS (SELECT *, {_WORDS('r')} AS rw, {_WORDS('h')} AS hw FROM nf),
dist AS (SELECT *, list_reduce(rw, lambda st, w: {{
    'd': list_reduce(hw, lambda a, v, j: {{'o': list_append(a.o, least(a.o[j] + 1, st.d[j + 1] + 1,
        st.d[j] + CASE WHEN v = w THEN 0 ELSE 1 END))}}, {{'o': [st.d[1] + 1]}}).o}},
    {{'d': range(0, len(hw) + 1)}}).d AS last FROM tok),
rated AS (SELECT * EXCLUDE (last), CASE WHEN len(rw) > 0 THEN last[len(hw) + 1] / len(rw)::DOUBLE END AS wer,
  CASE WHEN r <> '' THEN levenshtein({_BYTES('r')}, {_BYTES('h')}) / length(replace(r, ' ', ''))::DOUBLE
    END AS cer FROM dist)
"""


@query("d01_word_error_rate", f"""
WITH {RATES}
SELECT conv_id, turn, round(coalesce(wer, -1e0), 6) AS wer FROM rated""")
def word_error_rate(spark, sf_dir):
    out = Q.error_rates(items(spark, sf_dir), "reference_text", "hypothesis")
    return out.select("conv_id", "turn", F.round(F.coalesce("wer", F.lit(-1.0)), 6).alias("wer"))


@query("d02_character_error_rate", f"""
WITH {ITEMS}, nf AS (SELECT *, {_NORM('reference_text')} AS r, {_NORM('hypothesis')} AS h FROM items)
SELECT conv_id, turn, round(CASE WHEN r = '' THEN -1e0 ELSE levenshtein({_BYTES('r')}, {_BYTES('h')})
  / length(replace(r, ' ', ''))::DOUBLE END, 6) AS cer FROM nf""")
def character_error_rate(spark, sf_dir):
    out = Q.error_rates(items(spark, sf_dir), "reference_text", "hypothesis")
    return out.select("conv_id", "turn", F.round(F.coalesce("cer", F.lit(-1.0)), 6).alias("cer"))


_13A = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  ' ' || replace(replace(replace(replace(replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''),
    chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
  '([\{{-~\[-` -&\(-\+:-@/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'),
  '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')"""


def _grams(top: int, sep: str) -> str:
    return f"""
 g AS (SELECT id, model, n, side, array_to_string(list_slice(w, i, i + n - 1), '{sep}') AS gram FROM (
   SELECT id, model, n, side, w, unnest(range(1, len(w) - n + 2)) AS i FROM sides,
     (SELECT unnest(range(1, {top + 1})) AS n))),
 c AS (SELECT id, model, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r
   FROM g GROUP BY ALL),
 per AS (SELECT id, model, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL)"""


@query("d03_corpus_bleu", f"""
WITH {ITEMS}, sides AS (
  SELECT conv_id || '/' || turn AS id, model, 'r' AS side, {_13A.format(c='reference_text')} AS w FROM items
  UNION ALL SELECT conv_id || '/' || turn, model, 'h', {_13A.format(c='hypothesis')} FROM items),
 {_grams(4, ' ')},
 tot AS (SELECT model, n, sum(m)::DOUBLE AS m, sum(h)::DOUBLE AS t FROM per GROUP BY ALL),
 len AS (SELECT model, sum(len(w)) FILTER (side = 'h')::DOUBLE AS hl,
   sum(len(w)) FILTER (side = 'r')::DOUBLE AS rl FROM sides GROUP BY model)
SELECT model, round(any_value(CASE WHEN hl >= rl THEN 1e0 ELSE exp(1 - rl / hl) END)
  * exp(avg(ln(100 * m / t))), 2) AS bleu FROM tot JOIN len USING (model) GROUP BY model""")
def corpus_bleu(spark, sf_dir):
    return Q.corpus_bleu(items(spark, sf_dir), ["model"], "reference_text", "hypothesis")


@query("d04_corpus_chrf", f"""
WITH {ITEMS}, sides AS (
  SELECT conv_id || '/' || turn AS id, model, 'r' AS side, list_filter(string_split(regexp_replace(
    reference_text, '\\s+', '', 'g'), ''), lambda x: x <> '') AS w FROM items
  UNION ALL SELECT conv_id || '/' || turn, model, 'h', list_filter(string_split(regexp_replace(
    hypothesis, '\\s+', '', 'g'), ''), lambda x: x <> '') FROM items),
 {_grams(6, '')},
 tot AS (SELECT model, n, sum(m)::DOUBLE AS m, sum(CASE WHEN r > 0 THEN h ELSE 0 END)::DOUBLE AS h,
   sum(r)::DOUBLE AS r FROM per GROUP BY ALL),
 f AS (SELECT model, avg(m / h) AS p, avg(m / r) AS q FROM tot WHERE h > 0 AND r > 0 GROUP BY model)
SELECT model, round(100 * 5 * p * q / (4 * p + q), 2) AS chrf FROM f""")
def corpus_chrf(spark, sf_dir):
    return Q.corpus_chrf(items(spark, sf_dir), ["model"], "reference_text", "hypothesis")


def rated(spark, sf_dir):
    return Q.error_rates(items(spark, sf_dir), "reference_text", "hypothesis")


_SUMMARY = """
  count(*) AS items,
  round(avg(CASE WHEN reference_text <> '' AND source_language NOT IN ('ja','zh','ko','th')
    THEN wer END), 4) AS wer,
  round(avg(CASE WHEN reference_text <> '' THEN cer END), 4) AS cer,
  round(avg(CASE WHEN reference_text = '' THEN (trim(hypothesis) <> '')::INT END), 3) AS hallucination_rate,
  round(avg((detected IS NOT DISTINCT FROM source_language)::INT), 3) AS language_accuracy,
  count(*) FILTER (reference_text <> '') AS speech_items"""


@query("d05_recognition_summary", f"""
WITH {RATES}
SELECT model, gate, validation, {_SUMMARY} FROM rated GROUP BY model, gate, validation""")
def recognition_summary(spark, sf_dir):
    return Q.recognition_summary(rated(spark, sf_dir), ["model", "gate", "validation"])


@query("d06_hallucination_rate", f"""
WITH {ITEMS}
SELECT gate, count(*) AS nonspeech, round(avg((trim(hypothesis) <> '')::INT), 3) AS hallucination_rate
FROM items WHERE reference_text = '' GROUP BY gate""")
def hallucination_rate(spark, sf_dir):
    quiet = items(spark, sf_dir).where(F.col("reference_text") == "")
    return quiet.groupBy("gate").agg(
        F.count("*").alias("nonspeech"),
        F.round(F.avg((F.trim("hypothesis") != "").cast("int")), 3).alias("hallucination_rate"))


@query("d07_language_identification", f"""
WITH {B.SEG}, f AS (SELECT session_id, speaker, any_value(language) AS language, arg_min(
    CASE WHEN seq % 5 <> 2 THEN detected END, seq) FILTER (seq % 5 <> 2) AS first
  FROM seg WHERE speaker IS NOT NULL GROUP BY ALL)
SELECT language, count(*) AS items, round(avg((first IS NOT DISTINCT FROM language)::INT), 3) AS accuracy
FROM f GROUP BY language""")
def language_identification(spark, sf_dir):
    """One item per session and speaker; every fifth segment has no detection."""
    seg, _ = B.segments(spark, sf_dir)
    heard = seg.where(F.col("speaker").isNotNull()).withColumn(
        "detected", F.when(F.col("seq") % 5 != 2, F.col("detected")))
    found = Q.first_language(heard, ["session_id", "speaker", "language"], ["seq"], "detected")
    return found.groupBy("language").agg(F.count("*").alias("items"), F.round(F.avg(
        F.col("detected").eqNullSafe(F.col("language")).cast("int")), 3).alias("accuracy"))


@query("d08_hypothesis_assembly", f"""
WITH {B.SEG}, item AS (SELECT session_id, seq // 1048576 AS turn, any_value(language) AS language,
    list(text ORDER BY seq) FILTER (coalesce(no_speech_prob, 0) < 0.85e0) AS p FROM seg GROUP BY ALL)
SELECT session_id, turn, language, coalesce(CASE WHEN language IN ('ja','zh','ko','th')
  THEN array_to_string(p, '') ELSE array_to_string(p, ' ') END, '') AS hypothesis FROM item""")
def hypothesis_assembly(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    lines = seg.withColumn("turn", F.floor(F.col("seq") / B.PIECES_PER_TURN))
    ok = F.coalesce("no_speech_prob", F.lit(0.0)) < 0.85
    return Q.hypotheses(lines, ["session_id", "turn"], ["seq"], "language", ok)


@query("d09_latency_percentiles", f"""
WITH {B.EVT}
SELECT event_type AS stage, round(quantile_cont(seconds, 0.5e0), 3) AS p50,
  round(quantile_cont(seconds, 0.95e0), 3) AS p95, round(avg(seconds), 3) AS mean, count(*) AS n
FROM evt GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    e = B.event_rows(spark, sf_dir).withColumnRenamed("event_type", "stage")
    return T.latency_summary(e, ["stage"], "seconds")


@query("d09_sketched_percentiles", f"""
WITH {B.EVT}
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS stage, count(*) AS n, round(avg(seconds), 9) AS mean,
  min(seconds) AS low, max(seconds) AS high, true AS p50_close, true AS p95_close
FROM evt GROUP BY ALL""")
def sketched_percentiles(spark, sf_dir):
    """Stored hourly sketches merged to days; the shares of samples up to each percentile
    are within the rank error."""
    e = B.event_rows(spark, sf_dir).withColumnRenamed("event_type", "stage")
    folder = f"{shared_folder(spark)}/sketches/{uuid.uuid4().hex}"
    SK.hourly_sketches(e, ["stage"], "ts", "seconds").write.parquet(folder)
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    hours = spark.read.parquet(folder).select("*", day)
    days = SK.sketched_summary(hours, ["day", "stage"], p50=0.5, p95=0.95)
    samples = e.select("stage", "seconds", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    met = SK.rank_bounds(days, samples, ["day", "stage"], "seconds", "p50", "p95")
    close = lambda name, share: (
        (F.col(f"{name}_below") <= share + SK.RANK_ERROR)
        & (F.col(f"{name}_upto") >= share - SK.RANK_ERROR)).alias(f"{name}_close")
    return days.join(met, ["day", "stage"]).select(
        "day", "stage", "n", F.round("mean", 9).alias("mean"), "low", "high",
        close("p50", 0.5), close("p95", 0.95))


@query("d10_real_time_factor", f"""
WITH {ITEMS}
SELECT model, round(avg(CASE WHEN media_s > 0 THEN latency / media_s ELSE 0 END), 3) AS rtf
FROM items GROUP BY model""")
def real_time_factor(spark, sf_dir):
    return items(spark, sf_dir).groupBy("model").agg(F.round(F.avg(F.when(
        F.col("media_s") > 0, F.col("latency") / F.col("media_s")).otherwise(0.0)), 3)
        .alias("rtf"))


@query("d11_throughput", f"""
WITH {ITEMS}
SELECT model, round(sum(length(hypothesis)) / sum(latency), 1) AS chars_per_second
FROM items GROUP BY model""")
def throughput(spark, sf_dir):
    return items(spark, sf_dir).groupBy("model").agg(F.round(
        F.sum(F.char_length("hypothesis")) / F.sum("latency"), 1).alias("chars_per_second"))


def signal(spark, sf_dir):
    """One sample per row: the frames of a user's events one after the other."""
    e = B.table(spark, sf_dir, "events")
    at = F.explode(F.sequence(F.lit(0), F.lit(63)))
    return e.select("user_id", "event_id", "value", at.alias("i")).select(
        F.col("user_id"), (F.col("event_id") * 64 + F.col("i")).alias("position"),
        (F.when((F.col("event_id") * 31 + F.col("i")) % 257 == 0, 1.0).otherwise(
            ((F.col("event_id") * 7 + F.col("i") * F.col("i")) % 2000 - 1000)
            * ((F.floor(F.col("event_id") / 5)) % 5) / 200000.0)).alias("x"))


SIGNAL = """sig AS (SELECT user_id, event_id * 64 + i AS position,
  CASE WHEN (event_id*31 + i) % 257 = 0 THEN 1e0
    ELSE ((event_id*7 + i*i) % 2000 - 1000) * ((event_id // 5) % 5) / 200000e0 END AS x
  FROM events, (SELECT unnest(range(64)) AS i))"""


@query("d12_audio_statistics", f"""
WITH {SIGNAL}, fr AS (SELECT user_id, position // 320 AS f, count(*) AS n, sum(x*x) AS e,
    max(abs(x)) AS p, count(*) FILTER (abs(x) >= 0.999e0) AS c FROM sig GROUP BY ALL)
SELECT user_id, round(sum(n)::BIGINT / 16000e0, 3) AS duration, round(max(p), 4) AS peak,
  round(sqrt(sum(e) / sum(n)::BIGINT), 4) AS rms, round(sum(c)::BIGINT / sum(n)::BIGINT::DOUBLE, 6) AS clipping,
  round(coalesce(count(*) FILTER (n = 320 AND sqrt(e / n) < 0.01e0)
      / nullif(count(*) FILTER (n = 320), 0)::DOUBLE, max((sqrt(e / n) < 0.01e0)::INT)), 4) AS silence_ratio
FROM fr GROUP BY user_id""")
def audio_statistics(spark, sf_dir):
    return T.audio_statistics(signal(spark, sf_dir), ["user_id"], "position", "x")


@query("d13_level_dbfs", f"""
WITH {FRAMES}, r AS (SELECT event_id, sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x)) / 64)
  / 32768 AS rms FROM frames)
SELECT event_id, CASE WHEN rms > 1e-9 THEN round(20 * log10(rms), 6) END AS dbfs FROM r""")
def level_dbfs(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", F.round(T.dbfs(F.col("samples")), 6)
                                        .alias("dbfs"))


@query("d14_round_trip", f"""
WITH {RATES}
SELECT model, round(avg(wer), 4) AS roundtrip_wer, round(avg(cer), 4) AS roundtrip_cer,
  round(avg(media_s), 3) AS mean_audio_seconds FROM rated GROUP BY model""")
def round_trip(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("model").agg(
        F.round(F.avg("wer"), 4).alias("roundtrip_wer"),
        F.round(F.avg("cer"), 4).alias("roundtrip_cer"),
        F.round(F.avg("media_s"), 3).alias("mean_audio_seconds"))


@query("d15_duration_ratio", f"""
WITH {FITTED}
SELECT session_id, round(sum(final) / sum(src), 3) AS duration_ratio FROM fitted GROUP BY session_id""")
def duration_ratio(spark, sf_dir):
    f, _ = fitted(spark, sf_dir)
    return f.groupBy("session_id").agg(F.round(
        F.sum("fit.final_duration") / F.sum(F.col("end_s") - F.col("start_s")), 3)
        .alias("duration_ratio"))


def live_events(spark, sf_dir):
    """A live event log from the segments of each session."""
    seg, _ = B.segments(spark, sf_dir)
    kinds = F.array(
        F.struct(F.lit("ASR_PARTIAL").alias("event_type"), F.lit(0.4).alias("late")),
        F.struct(F.lit("TRANSLATION_FINAL").alias("event_type"),
                 (1.5 + F.col("seq") % 7 * 0.23717).alias("late")),
        F.struct(F.lit("TTS_AUDIO").alias("event_type"),
                 (2.25 + F.col("seq") % 5 * 0.51319).alias("late")),
        F.struct(F.lit("WARNING").alias("event_type"), F.lit(0.0).alias("late")))
    rows = seg.select("session_id", "seq", "end_s", F.posexplode(kinds).alias("k", "e"))
    kept = (F.col("k") < 3) | (F.col("seq") % 9 == 0)
    return rows.where(kept).select(
        "session_id", (F.col("seq") * 4 + F.col("k")).alias("sequence_id"), "e.event_type",
        (F.col("end_s") + F.col("e.late")).alias("at_s"), "end_s",
        F.when(F.col("k") == 3, F.concat(F.lit("code_"), (F.col("seq") % 4).cast("string")))
        .alias("code"))


LIVE = B.SEG + """
, live AS (SELECT session_id, seq * 4 + k AS sequence_id, ['ASR_PARTIAL','TRANSLATION_FINAL',
    'TTS_AUDIO','WARNING'][k + 1] AS event_type, end_s, end_s + CASE k WHEN 0 THEN 0.4e0
    WHEN 1 THEN 1.5e0 + seq % 7 * 0.23717e0 WHEN 2 THEN 2.25e0 + seq % 5 * 0.51319e0 ELSE 0 END AS at_s,
    CASE WHEN k = 3 THEN 'code_' || seq % 4 END AS code
  FROM seg, (SELECT unnest(range(4)) AS k) WHERE k < 3 OR seq % 9 = 0)
"""


@query("d16_segment_latency", f"""
WITH {LIVE}
SELECT session_id, round(quantile_cont(at_s - end_s, 0.5e0), 3) AS p50,
  round(quantile_cont(at_s - end_s, 0.95e0), 3) AS p95, round(avg(at_s - end_s), 3) AS mean,
  count(*) AS n FROM live WHERE event_type = 'TRANSLATION_FINAL' GROUP BY session_id""")
def segment_latency(spark, sf_dir):
    e = live_events(spark, sf_dir).where(F.col("event_type") == "TRANSLATION_FINAL")
    # Emission and source times are on a millisecond grid, so is their difference.
    late = e.withColumn("late", F.round(F.col("at_s") - F.col("end_s"), 6))
    return T.latency_summary(late, ["session_id"], "late")


@query("d17_live_latency", f"""
WITH {LIVE}
SELECT session_id, round(min(at_s) FILTER (event_type = 'ASR_PARTIAL'), 3) AS first_subtitle,
  round(min(at_s) FILTER (event_type = 'TRANSLATION_FINAL'), 3) AS ttft,
  round(min(at_s) FILTER (event_type = 'TTS_AUDIO'), 3) AS ttfa,
  count(*) FILTER (event_type = 'ASR_PARTIAL') AS partials,
  count(*) FILTER (event_type = 'TRANSLATION_FINAL') AS segments,
  coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS warnings
FROM live GROUP BY session_id""")
def live_latency(spark, sf_dir):
    out = T.live_latency(live_events(spark, sf_dir), ["session_id"])
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query("d18_ablation_grid", f"""
WITH {ITEMS}
SELECT coalesce(model, 'all') AS model, coalesce(gate::VARCHAR, 'all') AS gate,
  coalesce(validation::VARCHAR, 'all') AS validation, count(*) AS items,
  round(avg(latency), 4) AS latency,
  round(avg(CASE WHEN reference_text = '' THEN (trim(hypothesis) <> '')::INT END), 3) AS hallucination_rate
FROM items GROUP BY CUBE (model, gate, validation)""")
def ablation_grid(spark, sf_dir):
    grid = items(spark, sf_dir).cube("model", "gate", "validation").agg(
        F.count("*").alias("items"), F.round(F.avg("latency"), 4).alias("latency"),
        F.round(F.avg(F.when(F.col("reference_text") == "", (
            F.trim("hypothesis") != "").cast("int"))), 3).alias("hallucination_rate"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return grid.select(name("model"), name("gate"), name("validation"), "items", "latency",
                       "hallucination_rate")


@query("d18_pair_category_pivot", f"""
WITH {ITEMS}
SELECT source_language, round(avg(latency) FILTER (model = 'm0'), 4) AS m0,
  round(avg(latency) FILTER (model = 'm1'), 4) AS m1, round(avg(latency) FILTER (model = 'm2'), 4) AS m2
FROM items GROUP BY source_language""")
def pair_pivot(spark, sf_dir):
    wide = items(spark, sf_dir).groupBy("source_language").pivot(
        "model", ["m0", "m1", "m2"]).agg(F.round(F.avg("latency"), 4))
    return wide.select("source_language", "m0", "m1", "m2")


@query("d18_brand_rollup", """
SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status,
  count(*) AS rows, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(spark, sf_dir):
    out = B.table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"),
                      F.coalesce("l_linestatus", F.lit("all")).alias("status"),
                      "rows", "suppliers", "quantity")


@query("d19_resource_summary", f"""
WITH {B.EVT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM evt)
SELECT user_id, round(max(value) * 10485760 / 1073741824, 3) AS peak_rss_gb,
  round(avg(value * 10485760) / 1073741824, 3) AS mean_rss_gb,
  round(coalesce(avg(value / 3) FILTER (rn > 1), 0), 1) AS mean_cpu_percent,
  round(max(value) FILTER (event_type = 'view') * 1048576 / 1073741824, 3) AS peak_vram_gb,
  round(avg(value * 1048576) FILTER (event_type = 'view') / 1073741824, 3) AS mean_vram_gb
FROM n GROUP BY user_id""")
def resource_summary(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    s = e.withColumns({"rss": F.col("value") * 10485760, "cpu": F.col("value") / 3,
                       "vram": F.when(F.col("event_type") == "view",
                                      F.col("value") * 1048576)})
    return T.resource_summary(s, ["user_id"], ["us", "event_id"], blk)


_FITTED_TAIL = FITTED[len(B.SEG):].lstrip().removeprefix(",")


@query("e07_synthesis_statistics", f"""
WITH RECURSIVE {PLACED}, {_FITTED_TAIL}
SELECT f.session_id, round(sum(0.3e0 + f.seq % 7 * 0.1e0) / sum(f.final), 3) AS tts_rtf,
  round(avg(f.final / f.src), 3) AS duration_mismatch_mean,
  round(max(f.final / f.src), 3) AS duration_mismatch_max,
  round(max(actual - p.start_s), 3) AS max_drift_seconds,
  round(avg(actual - p.start_s), 3) AS mean_drift_seconds,
  count(*) FILTER (method = 'none') AS fits_none, count(*) FILTER (method = 'capped') AS fits_capped,
  count(*) FILTER (method = 'regenerate') AS fits_regenerate,
  count(*) FILTER (method = 'time_stretch') AS fits_time_stretch
FROM fitted f JOIN placed p USING (session_id, seq) GROUP BY f.session_id""")
def synthesis_statistics(spark, sf_dir):
    f, blk = fitted(spark, sf_dir)
    placed = L.place(f, ["session_id"], ["seq"], blk)
    c = placed.select(
        "session_id", "fit.method", (F.col("end_s") - F.col("start_s")).alias("source_s"),
        "fit.mismatch", "drift", (0.3 + F.col("seq") % 7 * 0.1).alias("synth_s"),
        F.col("fit.final_duration").alias("duration"))
    out = T.synthesis_statistics(c, ["session_id"])
    fits = lambda m: F.coalesce(F.try_element_at("fit_methods", F.lit(m)), F.lit(0)).cast(
        "bigint").alias(f"fits_{m}")
    return out.select("*", *[fits(m) for m in (
        "none", "capped", "regenerate", "time_stretch")]).drop("fit_methods")
