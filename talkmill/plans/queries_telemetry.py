"""E, G and the batch twins of H: operations, ranking, ordering checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import intervals as I
from talkmill.operators import ordered as O
from talkmill.operators import segmentation as S
from talkmill.operators import telemetry as T
from talkmill.plans import bindings as B
from talkmill.plans.queries_quality import LIVE, live_events
from talkmill.plans.queries_rules import JOBS, TRANS, _ISSUES, jobs, translations
from talkmill.plans.queries_time import MERGED, merged
from talkmill.operators import rules as R
from talkmill.plans.registry import query

KEY = ["session_id"]


def stage_samples(spark, sf_dir):
    """Two gateways, five stages; every 50th sample is negative and must be ignored."""
    e = B.event_rows(spark, sf_dir)
    return e.select((F.col("user_id") % 2).alias("gateway"), F.col("event_type").alias("stage"),
                    F.when(F.col("event_id") % 50 == 7, -F.col("seconds")).otherwise(
                        F.col("seconds")).alias("seconds"), "us", "event_id", "user_id")


_NEAR = lambda p, n: (
    f"CASE WHEN {p} * ({n} - 1) - floor({p} * ({n} - 1)) = 0.5e0 AND floor({p} * ({n} - 1))::BIGINT % 2 = 0 "
    f"THEN floor({p} * ({n} - 1)) ELSE round({p} * ({n} - 1)) END::BIGINT + 1")
HIST = B.EVT + f"""
, ss AS (SELECT user_id % 2 AS gateway, user_id, event_type AS stage, us, event_id,
    CASE WHEN event_id % 50 = 7 THEN -seconds ELSE seconds END AS seconds FROM evt),
ok AS (SELECT *, row_number() OVER (PARTITION BY gateway, stage ORDER BY us DESC, event_id DESC) AS age
  FROM ss WHERE seconds >= 0),
res AS (SELECT gateway, stage, list_sort(list(seconds)) AS v, arg_min(seconds, age) AS last
  FROM ok WHERE age <= 512 GROUP BY ALL),
hist AS (SELECT gateway, stage, count(*) AS count, avg(seconds) AS mean, any_value(last) AS last,
    any_value(v[{_NEAR('0.5e0', 'len(v)')}]) AS p50, any_value(v[{_NEAR('0.95e0', 'len(v)')}]) AS p95,
    any_value(v[{_NEAR('0.99e0', 'len(v)')}]) AS p99
  FROM ok JOIN res USING (gateway, stage) GROUP BY gateway, stage)
"""


def histograms(spark, sf_dir):
    return T.stage_histograms(stage_samples(spark, sf_dir), ["gateway", "stage"],
                              ["us", "event_id"])


@query("e01_stage_histograms", f"""
WITH {HIST}
SELECT gateway, stage, count, round(mean, 6) AS mean, last, p50, p95, p99 FROM hist""")
def stage_histograms(spark, sf_dir):
    return histograms(spark, sf_dir).withColumn("mean", F.round("mean", 6))


@query("e02_nearest_rank", f"""
WITH {B.EVT}, v AS (SELECT event_type, list_sort(list(value)) AS v FROM evt GROUP BY event_type)
SELECT event_type, v[{_NEAR('0.1e0', 'len(v)')}] AS p10, v[{_NEAR('0.5e0', 'len(v)')}] AS p50,
  v[{_NEAR('0.9e0', 'len(v)')}] AS p90 FROM v""")
def nearest_rank(spark, sf_dir):
    from talkmill.operators import quantiles as Q
    e = B.event_rows(spark, sf_dir)
    return Q.nearest(e, ["event_type"], "value", p10=10, p50=50, p90=90)


@query("e03_counters_and_gauges", f"""
WITH {B.EVT}
SELECT user_id, event_type, CAST(sum(json_extract_string(props, '$.k')::BIGINT) AS BIGINT) AS total,
  arg_max(value, {{'u': us, 'e': event_id}}) AS gauge FROM evt GROUP BY user_id, event_type""")
def counters_and_gauges(spark, sf_dir):
    e = B.event_rows(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return T.counters_and_gauges(e, ["user_id", "event_type"], k, "value", ["us", "event_id"])


@query("e04_session_summary", f"""
WITH {HIST}
SELECT gateway, max(p50) FILTER (stage = 'view') AS end_to_end_p50,
  max(p95) FILTER (stage = 'view') AS end_to_end_p95, max(p50) FILTER (stage = 'click') AS subtitle_p50,
  max(p50) FILTER (stage = 'purchase') AS speech_p50 FROM hist GROUP BY gateway""")
def session_summary(spark, sf_dir):
    return T.session_summary(histograms(spark, sf_dir), ["gateway"], "stage", {
        "end_to_end_p50": ("view", "p50"), "end_to_end_p95": ("view", "p95"),
        "subtitle_p50": ("click", "p50"), "speech_p50": ("purchase", "p50")})


@query("e05_gate_statistics", f"""
WITH {MERGED}, per AS (SELECT session_id, event_type, count(*) FILTER (NOT should_transcribe) AS n
  FROM merged GROUP BY ALL HAVING n > 0),
m AS (SELECT session_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_event
  FROM per GROUP BY session_id)
SELECT g.session_id, count(*) FILTER (should_transcribe) AS speech_regions,
  count(*) FILTER (NOT should_transcribe) AS rejected_regions,
  round(coalesce(sum(end_s - start_s) FILTER (should_transcribe), 0), 2) AS speech_seconds,
  round(greatest(0e0, max(end_s) - coalesce(sum(end_s - start_s) FILTER (should_transcribe), 0)), 2)
    AS non_speech_seconds, coalesce(any_value(by_event), '') AS rejected_by_event
FROM merged g LEFT JOIN m USING (session_id) GROUP BY g.session_id""")
def gate_statistics(spark, sf_dir):
    out = T.gate_statistics(merged(spark, sf_dir), KEY)
    return out.withColumn("rejected_by_event", F.array_join(F.transform(
        F.map_entries("rejected_by_event"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("e06_rejection_counts", f"""
WITH {_ISSUES}, one AS (SELECT session_id, unnest(issues) AS issue FROM t1),
n AS (SELECT session_id, issue, count(*) AS n FROM one GROUP BY ALL)
SELECT session_id, CAST(sum(n) AS BIGINT) AS rejected,
  string_agg(issue || '=' || n, ',' ORDER BY issue) AS reasons FROM n GROUP BY session_id""")
def rejection_counts(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    one = R.validate_translations(t).select("session_id", F.explode("issues").alias("issue"))
    out = T.reason_counts(one, KEY, "issue")
    return out.withColumn("reasons", F.array_join(F.transform(
        F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("e08_stage_seconds", f"""
WITH {B.EVT}
SELECT user_id, event_type AS stage, round(sum(seconds), 6) AS seconds FROM evt GROUP BY ALL""")
def stage_seconds(spark, sf_dir):
    e = B.event_rows(spark, sf_dir)
    return e.groupBy("user_id", F.col("event_type").alias("stage")).agg(
        F.round(F.sum("seconds"), 6).alias("seconds"))


@query("e09_language_observations", f"""
WITH {B.SEG} SELECT session_id, detected AS language, count(*) AS n FROM seg GROUP BY ALL""")
def language_observations(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    return seg.groupBy("session_id", F.col("detected").alias("language")).agg(
        F.count("*").alias("n"))


_STAGES = ["transcribing", "translating", "synthesizing"]


@query("e10_job_outcomes", f"""
WITH {JOBS}, st AS (SELECT job_id, finished_s, unnest([0.2e0, 0.3e0, 0.5e0]) * spent_s AS seconds,
    unnest(['transcribing', 'translating', 'synthesizing']) AS stage FROM jobs WHERE status = 'completed'),
aged AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY finished_s DESC, job_id DESC) AS age FROM st),
res AS (SELECT stage, list_sort(list(seconds)) AS v, arg_min(seconds, age) AS last FROM aged
  WHERE age <= 512 GROUP BY stage)
SELECT stage, count(*) AS count, round(avg(seconds), 4) AS mean, any_value(last) AS last,
  any_value(v[{_NEAR('0.5e0', 'len(v)')}]) AS p50, any_value(v[{_NEAR('0.95e0', 'len(v)')}]) AS p95,
  any_value(v[{_NEAR('0.99e0', 'len(v)')}]) AS p99
FROM aged JOIN res USING (stage) GROUP BY stage
UNION ALL SELECT 'jobs_' || status, count(*), NULL, NULL, NULL, NULL, NULL FROM jobs GROUP BY status""")
def job_outcomes(spark, sf_dir):
    j = jobs(spark, sf_dir)
    shares = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    staged = j.withColumn("stage_seconds", F.map_from_arrays(
        F.array(*map(F.lit, _STAGES)), F.transform(shares, lambda s: s * F.col("spent_s"))))
    hist = T.job_histograms(staged).withColumn("mean", F.round("mean", 4))
    outcomes = j.groupBy(F.concat(F.lit("jobs_"), "status").alias("stage")).agg(
        F.count("*").alias("count"))
    return hist.unionByName(outcomes, allowMissingColumns=True)


_SPANS = ", ".join(f"('{s}', {a}e0, {b}e0)" for s, (a, b) in dims.STAGE_SPANS.items())
PROG = B.EVT + f"""
, spans(stage, a, b) AS (VALUES {_SPANS}),
up AS (SELECT user_id, event_id, us, ['preprocessing','speech_detection','transcribing','translating',
    'synthesizing','rendering','failed'][event_id % 7 + 1] AS stage, value / 100e0 AS fraction,
    ((us // 1000000) % 100000)::DOUBLE AS elapsed_s FROM evt),
prog AS (SELECT up.*, max(a + (b - a) * greatest(0e0, least(1e0, fraction))) OVER (
    PARTITION BY user_id ORDER BY us, event_id) AS p FROM up LEFT JOIN spans USING (stage))
"""


@query("e11_job_progress", f"""
WITH {PROG}
SELECT user_id, event_id, round(coalesce(p, 0), 6) AS progress, CASE WHEN stage <> 'failed' AND p >= 5
  THEN floor(elapsed_s * (100 - p) / p)::BIGINT END AS eta_seconds FROM prog""")
def job_progress(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    stages = F.array(*map(F.lit, ["preprocessing", "speech_detection", "transcribing",
                                  "translating", "synthesizing", "rendering", "failed"]))
    up = e.withColumns({
        "stage": F.element_at(stages, (F.col("event_id") % 7 + 1).cast("int")),
        "fraction": F.col("value") / 100,
        "elapsed_s": (F.floor(F.col("us") / 1_000_000) % 100_000).cast("double")})
    out = T.job_progress(up, dims.stage_spans(spark), ["user_id"], ["us", "event_id"], blk)
    return out.select("user_id", "event_id", F.round("progress", 6).alias("progress"),
                      "eta_seconds")


@query("e12_fleet_medians", f"""
WITH {B.EVT}, s AS (SELECT user_id, event_type AS stage, list_sort(list(seconds)) AS v FROM evt GROUP BY ALL),
m AS (SELECT stage, list_sort(list(v[{_NEAR('0.5e0', 'len(v)')}])) AS m FROM s GROUP BY stage)
SELECT stage, m[len(m) // 2 + 1] AS p50, len(m)::BIGINT AS sessions FROM m""")
def fleet_medians(spark, sf_dir):
    from talkmill.operators import quantiles as Q
    e = B.event_rows(spark, sf_dir).withColumnRenamed("event_type", "stage")
    per = Q.nearest(e, ["user_id", "stage"], "seconds", p50=50)
    return T.fleet_medians(per).join(
        per.groupBy("stage").agg(F.count("*").alias("sessions")), "stage")


@query("e13_throttled_warnings", f"""
WITH RECURSIVE {B.EVT}, wn AS (SELECT user_id, event_type AS code, us / 1e6 AS tm,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS rn FROM evt),
th AS (SELECT user_id, code, tm, rn, tm AS last, true AS out FROM wn WHERE rn = 1
  UNION ALL
  SELECT w.user_id, w.code, w.tm, w.rn, CASE WHEN w.tm - t.last < 86400 THEN t.last ELSE w.tm END,
    NOT (w.tm - t.last < 86400)
  FROM th t JOIN wn w ON w.user_id = t.user_id AND w.code = t.code AND w.rn = t.rn + 1)
SELECT user_id, code, round(tm, 3) AS tm, rn AS repeats FROM th WHERE out""")
def throttled_warnings(spark, sf_dir):
    """One warning per user, code and day."""
    e = B.event_rows(spark, sf_dir).withColumnRenamed("event_type", "code")
    e, blk = O.split_hot(e, ["user_id", "code"], "us", O.ROWS_PER_FOLD)
    feed = e.select("user_id", "code", *([blk] if blk else []), "us", "event_id",
                    (F.col("us") / 1e6).alias("at"))
    out = O.run_fold(feed, S.throttle(86400.0), ["user_id", "code"], ["us", "event_id"], blk)
    return out.select("user_id", "code", F.round("at", 3).alias("tm"), "repeats")


QUEUE = B.EVT + """
, q AS (SELECT *, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1
    WHEN event_type = 'purchase' THEN -1 ELSE 0 END AS move FROM evt),
d AS (SELECT *, CAST(sum(move) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS depth FROM q)
"""


@query("e14_queue_statistics", f"""
WITH {QUEUE}
SELECT user_id, count(*) FILTER (move = 1) AS enqueued, count(*) FILTER (move = 0) AS dropped,
  max(depth) AS max_depth, count(*) FILTER (depth / 16e0 >= 0.8e0) AS overloads FROM d GROUP BY user_id""")
def queue_statistics(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    action = F.when(F.col("event_type").isin("view", "click", "signup"), "enqueue").when(
        F.col("event_type") == "purchase", "dequeue").otherwise("drop")
    run = T.queue_statistics(e.withColumn("action", action), ["user_id"], ["us", "event_id"],
                             blk, 16)
    return T.queue_totals(run, ["user_id"])


# -- G -----------------------------------------------------------------------------------

@query("g01_top_category", f"""
WITH {B.WIN}
SELECT session_id, w, CASE greatest(s0,s1,s2,s3,s4,s5,s6) WHEN s0 THEN 'DIALOGUE'
  WHEN s1 THEN 'VOCAL_NON_SPEECH' WHEN s2 THEN 'MUSIC' WHEN s3 THEN 'SFX' WHEN s4 THEN 'BACKGROUND'
  WHEN s5 THEN 'SILENCE' ELSE 'UNKNOWN' END AS category FROM win""")
def top_category(spark, sf_dir):
    w, _ = B.windows(spark, sf_dir)
    return w.select("session_id", "w", R.top_category(F.col("scores"), [])["k"].alias("category"))


@query("g02_longest_first", """
WITH t AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM (
  SELECT item_id, string_split(text, ' ') AS w FROM benchmark))
SELECT item_id, string_agg(term, '|' ORDER BY length(term) DESC, i) AS terms FROM t GROUP BY item_id""")
def longest_first(spark, sf_dir):
    b = B.table(spark, sf_dir, "benchmark")
    ranked = F.array_sort(F.transform(F.split("text", " "), lambda t, i: F.struct(
        (-F.char_length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return b.select("item_id", F.array_join(F.transform(ranked, lambda r: r["t"]), "|")
                    .alias("terms"))


@query("g03_cue_order", f"""
WITH {B.SEG}
SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY start_s, seq) AS cue
FROM seg""")
def cue_order(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    return O.scan(seg, KEY, ["start_s", "seq"], blk, cue=O.Scan("number")).select(
        "session_id", "seq", "cue")


@query("g04_newest_jobs", f"""
WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY finished_s DESC, job_id DESC) AS rank
  FROM jobs WHERE status IN ('completed', 'failed'))
SELECT status, rank, job_id FROM r WHERE rank <= 200""")
def newest_jobs(spark, sf_dir):
    done = jobs(spark, sf_dir).where(F.col("status").isin(dims.TERMINAL))
    return O.top_k(done, ["status"], [F.col("finished_s").desc(), F.col("job_id").desc()],
                   200).select("status", "rank", "job_id").withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("g05_previews", f"""
WITH {TRANS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rank FROM trans)
SELECT session_id, rank, source_text, translated_text FROM r WHERE rank <= 5""")
def previews(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    return O.top_k(t, KEY, [F.col("seq")], 5).select(
        "session_id", F.col("rank").cast("bigint").alias("rank"), "source_text",
        "translated_text")


@query("g06_component_union", f"""
WITH {JOBS}, {B.EVT}
SELECT 'engine' AS component, status AS id, count(*) AS items, round(avg(spent_s), 3) AS wall_seconds,
  NULL::DOUBLE AS p50 FROM jobs GROUP BY status
UNION ALL SELECT 'latency', event_type, count(*), NULL, round(quantile_cont(seconds, 0.5e0), 3)
FROM evt GROUP BY event_type""")
def component_union(spark, sf_dir):
    engine = jobs(spark, sf_dir).groupBy(F.col("status").alias("id")).agg(
        F.count("*").alias("items"), F.round(F.avg("spent_s"), 3).alias("wall_seconds")
    ).withColumn("component", F.lit("engine"))
    e = B.event_rows(spark, sf_dir).withColumnRenamed("event_type", "id")
    latency = T.latency_summary(e, ["id"], "seconds").select(
        F.lit("latency").alias("component"), "id", F.col("n").alias("items"), "p50")
    return engine.unionByName(latency, allowMissingColumns=True)


@query("g07_set_operations", f"""
WITH {B.SEG}, l AS (SELECT DISTINCT session_id AS id FROM seg WHERE detected = 'en'),
r AS (SELECT DISTINCT doc_id AS id FROM labels),
s AS (SELECT session_id, list(DISTINCT language) AS a, list(DISTINCT detected) AS b FROM seg GROUP BY 1)
SELECT 'both' AS kind, id, '' AS langs FROM (SELECT id FROM l INTERSECT SELECT id FROM r)
UNION ALL SELECT 'only_left', id, '' FROM (SELECT id FROM l EXCEPT SELECT id FROM r)
UNION ALL SELECT 'union', session_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') FROM s
UNION ALL SELECT 'except', session_id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') FROM s""")
def set_operations(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    left = seg.where(F.col("detected") == "en").select(F.col("session_id").alias("id"))
    right = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    s = seg.groupBy(F.col("session_id").alias("id")).agg(
        F.collect_set("language").alias("a"), F.collect_set("detected").alias("b"))
    row = lambda df, kind, langs: df.select(F.lit(kind).alias("kind"), "id", langs.alias("langs"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return (row(left.intersect(right), "both", F.lit(""))
            .unionAll(row(left.subtract(right), "only_left",
                          F.lit("")))
            .unionAll(row(s, "union", text(F.array_union("a", "b"))))
            .unionAll(row(s, "except", text(F.array_except("b", "a")))))


@query("g08_blocking_issues", f"""
WITH {_ISSUES}
SELECT session_id, seq, array_to_string(list_sort(list_intersect(issues, ['repetition', 'unchanged_source_text'])), ',')
  AS blocking FROM t1 WHERE list_has_any(issues, ['repetition', 'unchanged_source_text'])""")
def blocking_issues(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    wanted = F.array(F.lit("repetition"), F.lit("unchanged_source_text"))
    out = R.validate_translations(t).where(F.arrays_overlap("issues", wanted))
    return out.select("session_id", "seq", F.array_join(F.array_sort(
        F.array_intersect("issues", wanted)), ",").alias("blocking"))


# -- H: ordering rules over whole logs ---------------------------------------------------

def snapshots(spark, sf_dir):
    """Each line arrives as a snapshot of the last three lines; some snapshots retract."""
    seg, blk = B.segments(spark, sf_dir)
    line = F.struct("text", "start_s", "end_s")
    two = O.scan(seg, KEY, ["seq"], blk, _a=O.Scan("lag", line))
    three = O.scan(two, KEY, ["seq"], blk, _b=O.Scan("lag", F.col("_a")))
    # Every seventh snapshot holds only the line two back: a retraction.
    lines = F.when((F.col("seq") % 7 == 6) & F.col("_b").isNotNull(), F.array("_b")).otherwise(
        F.array_compact(F.array(F.col("_b"), F.col("_a"), line)))
    return three.select("session_id", *([blk] if blk else []), F.col("seq").alias("snap"),
                        lines.alias("lines")), blk


SNAP = B.SEG + """
, sn AS (SELECT session_id, seq AS snap, row_number() OVER w AS rn,
    CASE WHEN seq % 7 = 6 AND lag(seq, 2) OVER w IS NOT NULL
      THEN [{'t': lag(text, 2) OVER w, 'a': lag(start_s, 2) OVER w, 'b': lag(end_s, 2) OVER w}]
      ELSE list_filter([{'t': lag(text, 2) OVER w, 'a': lag(start_s, 2) OVER w, 'b': lag(end_s, 2) OVER w},
        {'t': lag(text) OVER w, 'a': lag(start_s) OVER w, 'b': lag(end_s) OVER w},
        {'t': text, 'a': start_s, 'b': end_s}], lambda l: l.t IS NOT NULL) END AS ls
  FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
st AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, 0::BIGINT AS snap, 0e0 AS fin, 0::BIGINT AS n, 0::BIGINT AS rev,
    []::STRUCT(t VARCHAR, a DOUBLE, b DOUBLE)[] AS fresh, false AS back FROM sn
  UNION ALL
  SELECT session_id, rn, snap, greatest(fin, coalesce(list_max(list_transform(f, lambda l: l.b)), 0)),
    n + len(f), rev + CASE WHEN len(f) > 0 THEN 1 ELSE 0 END, f, back
  FROM (SELECT t.session_id, s.rn, s.snap, t.fin, t.n, t.rev,
      list_filter(s.ls, lambda l: l.b > t.fin + 1e-6) AS f,
      list_max(list_transform(s.ls, lambda l: l.b)) + 1e-6 < t.fin AS back
    FROM st t JOIN sn s ON s.session_id = t.session_id AND s.rn = t.rn + 1))
"""


@query("h01_stable_spans", f"""
WITH RECURSIVE {SNAP}, e AS (SELECT *, unnest(fresh) AS l, unnest(range(len(fresh))) AS i FROM st)
SELECT session_id, snap, n - len(fresh) + i + 1 AS stable_seq, l.t AS text, l.a AS start_s, l.b AS end_s,
  rev AS revision, back AS rolled_back FROM e
UNION ALL SELECT session_id, snap, -1, '', -1e0, -1e0, rev, true FROM st WHERE back AND len(fresh) = 0""")
def stable_spans(spark, sf_dir):
    s, blk = snapshots(spark, sf_dir)
    out = O.run_fold(s, S.SNAPSHOTS, KEY, ["snap"], blk)
    return out.fillna({"stable_seq": -1, "text": "", "start_s": -1.0, "end_s": -1.0})


def growing_lines(spark, sf_dir):
    """Every line grows in three snapshots; some are revised near the end."""
    seg, blk = B.segments(spark, sf_dir)
    n = F.char_length("text")
    cutoff = lambda part: F.greatest(F.lit(1), F.floor(n * part / 3)).cast("int")
    steps = F.posexplode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k", "part")
    rows = seg.select("session_id", "seq", *([blk] if blk else []), "text", "start_s", "end_s",
                      "speaker", steps)
    head = F.substring(F.col("text"), F.lit(1), cutoff(F.col("part")))
    revised = (F.col("part") == 2) & (F.col("seq") % 6 == 1)
    return rows.select(
        "session_id", *([blk] if blk else []), (F.col("seq") * 3 + F.col("k")).alias("seq"),
        F.col("seq").alias("line_idx"),
        F.when(revised, F.concat(head, F.lit("zz"))).otherwise(head).alias("text"),
        "start_s", (F.col("start_s") + (F.col("end_s") - F.col("start_s")) * F.col("part") / 3)
        .alias("end_s"), F.when(F.col("seq") % 13 == 4, -2).otherwise(
            F.coalesce("speaker", F.lit(-1))).alias("speaker")), blk


DELTA = B.SEG + """
, gl AS (SELECT session_id, seq * 3 + part - 1 AS seq, seq AS line, start_s,
    start_s + (end_s - start_s) * part / 3e0 AS end_s, row_number() OVER (PARTITION BY session_id
      ORDER BY seq, part) AS rn,
    trim(left(text, greatest(1, (length(text) * part) // 3)::INTEGER)
      || CASE WHEN part = 2 AND seq % 6 = 1 THEN 'zz' ELSE '' END) AS text
  FROM seg, (SELECT unnest([1, 2, 3]) AS part) WHERE seq % 13 <> 4),
dl AS (
  SELECT DISTINCT session_id, 0::BIGINT AS rn, 0::BIGINT AS seq, 0::BIGINT AS line, '' AS seen, 0e0 AS fin,
    0::BIGINT AS rev, '' AS delta, 0e0 AS a, 0e0 AS b FROM gl
  UNION ALL
  SELECT session_id, rn, seq, line, text, CASE WHEN delta <> '' THEN nb ELSE fin END, rev2, delta,
    CASE WHEN old <> '' THEN fin ELSE start_s END, nb
  FROM (SELECT *, trim(substr(text, known + 1)) AS delta, CASE WHEN end_s > fin + 1e-6 THEN end_s
        ELSE fin + 1e-3 END AS nb, rev + CASE WHEN revised THEN 1 ELSE 0 END AS rev2
    FROM (SELECT *, CASE WHEN NOT revised THEN length(old) ELSE coalesce(list_min(list_filter(
          range(0, least(length(old), length(text))), lambda i: substr(old, i + 1, 1) <> substr(text, i + 1, 1))),
          least(length(old), length(text))) END AS known
      FROM (SELECT *, old <> '' AND NOT starts_with(text, old) AS revised
        FROM (SELECT d.session_id, g.rn, g.seq, g.line, g.text, g.start_s, g.end_s, d.fin, d.rev,
            CASE WHEN d.line = g.line AND d.rn > 0 THEN d.seen ELSE '' END AS old
          FROM dl d JOIN gl g ON g.session_id = d.session_id AND g.rn = d.rn + 1)))))
"""


@query("h02_line_deltas", f"""
WITH RECURSIVE {DELTA}
SELECT session_id, seq, delta, round(a, 6) AS start_s, round(b, 6) AS end_s, rev AS revisions
FROM dl WHERE delta <> ''""")
def line_deltas(spark, sf_dir):
    g, blk = growing_lines(spark, sf_dir)
    out = O.run_fold(g, S.DELTAS, KEY, ["seq"], blk)
    return out.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


def chunks(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    c = e.withColumn("ms", 100 + F.col("event_id") % 4 * 50)
    c = O.scan(c, ["user_id"], ["us", "event_id"], blk, _b=O.Scan(
        "sum", F.col("ms"), default=F.lit(0)))
    return c.select("user_id", *([blk] if blk else []), "us", F.col("event_id").alias("seq"),
                    (F.col("ms") / 1000.0).alias("duration"), (F.col("_b") / 1000.0)
                    .alias("start_s")), blk


@query("h04_filled_windows", f"""
WITH RECURSIVE {B.EVT}, ch AS (SELECT user_id, event_id AS seq, 100 + event_id % 4 * 50 AS ms,
    row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM evt),
fl AS (SELECT user_id, seq, rn, 1::BIGINT AS win, ms AS filled FROM ch WHERE rn = 1
  UNION ALL
  SELECT c.user_id, c.seq, c.rn, CASE WHEN f.filled >= 600 THEN f.win + 1 ELSE f.win END,
    CASE WHEN f.filled >= 600 THEN c.ms ELSE f.filled + c.ms END
  FROM fl f JOIN ch c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT user_id, seq, win, count(*) OVER (PARTITION BY user_id, win) AS members FROM fl""")
def filled_windows(spark, sf_dir):
    c, blk = chunks(spark, sf_dir)
    return O.run_fold(c, S.filled_windows(0.6), ["user_id"], ["us", "seq"], blk).drop(
        "win_start_s")


GATED = f"""{B.EVT}, ch AS (SELECT user_id, event_id AS seq, 100 + event_id % 4 * 50 AS ms,
    value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM evt),
fl AS (SELECT user_id, seq, rn, value, event_type, 1::BIGINT AS win, ms AS filled FROM ch WHERE rn = 1
  UNION ALL
  SELECT c.user_id, c.seq, c.rn, c.value, c.event_type,
    CASE WHEN f.filled >= 600 THEN f.win + 1 ELSE f.win END,
    CASE WHEN f.filled >= 600 THEN c.ms ELSE f.filled + c.ms END
  FROM fl f JOIN ch c ON c.user_id = f.user_id AND c.rn = f.rn + 1),
v AS (SELECT *, max(value) OVER (PARTITION BY user_id, win) >= 60 AS passed FROM fl)
"""


@query("h04_gated_chunks", f"""
WITH RECURSIVE {GATED}
SELECT user_id, seq, win, passed, CASE WHEN passed THEN event_type ELSE '' END AS payload FROM v""")
def gated_chunks(spark, sf_dir):
    """One verdict per filled window, for all its chunks; refused payloads are blanked."""
    c, blk = chunks(spark, sf_dir)
    members = O.run_fold(c, S.filled_windows(0.6), ["user_id"], ["us", "seq"], blk)
    payloads = B.event_rows(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("seq"), "value", F.col("event_type").alias("payload"))
    return S.gated(members.join(payloads, ["user_id", "seq"]), ["user_id"],
                   F.max("value"), 60.0, "payload").select(
        "user_id", "seq", "win", "passed", "payload")


def arrivals(spark, sf_dir):
    """Clips arrive disturbed: by up to four places, with losses and failures."""
    e, blk = B.user_events(spark, sf_dir)
    e = O.scan(e, ["user_id"], ["us", "event_id"], blk, seq=O.Scan("number"))
    return e.select(
        "user_id", *([blk] if blk else []), "seq", "event_id",
        (F.col("seq") + (F.col("event_id") * 7) % 5 * 1.3).alias("at"),
        (F.col("event_id") % 17 == 3).alias("failed")).where(F.col("event_id") % 23 != 5), blk


REORDER = """
arr AS (SELECT user_id, event_id, rn AS seq, rn + ((event_id*7) % 5) * 1.3e0 AS tm,
    event_id % 17 = 3 AS failed FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY us, event_id) AS rn FROM evt) WHERE event_id % 23 <> 5)
"""


_OPEN = lambda q, held, failed: (
    f"NOT list_contains(list_transform({held}, lambda x: x.s), {q}) AND NOT list_contains({failed}, {q})")
_FIRST_OPEN = lambda start, held, failed: (
    f"list_min(list_filter(range({start}, {start} + 1 + len({held}) + len({failed})), lambda q: "
    f"{_OPEN('q', held, failed)}))")
#: At one clip a second and a timeout of five, the buffer of 64 never fills, so SQL has no limit.
RELEASES = REORDER + f"""
, ar AS (SELECT user_id, seq, tm, failed AS bad, row_number() OVER (PARTITION BY user_id ORDER BY tm, seq) AS rn
  FROM arr UNION ALL SELECT user_id, NULL, 1e18, false, count(*) + 1 FROM arr GROUP BY user_id),
buf AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, 1::BIGINT AS nxt, 0::BIGINT AS place,
    []::STRUCT(s BIGINT, a DOUBLE)[] AS held, []::BIGINT[] AS failed,
    []::STRUCT(s BIGINT, o VARCHAR, a DOUBLE)[] AS out FROM arr
  UNION ALL
  SELECT user_id, rn, n2, base, list_filter(held2, lambda x: x.s >= n2), list_filter(failed2, lambda f: f >= n2),
    list_concat(out1, CASE WHEN seq < n1 THEN [{{'s': seq, 'o': 'late', 'a': tm}}]
      ELSE list_transform(range(n1, n2), lambda q: {{'s': q, 'o': CASE WHEN list_contains(failed2, q)
        THEN 'skipped' ELSE 'released' END, 'a': tm}}) END)
  FROM (
    SELECT *, CASE WHEN seq IS NULL OR seq < n1 THEN n1 ELSE {_FIRST_OPEN('n1', 'held2', 'failed2')} END AS n2
    FROM (
      SELECT *, CASE WHEN seq >= n1 AND NOT bad THEN list_append(held1, {{'s': seq, 'a': tm}}) ELSE held1 END AS held2,
        CASE WHEN seq >= n1 AND bad THEN list_append(failed1, seq) ELSE failed1 END AS failed2
      FROM (
        SELECT *, list_filter(held, lambda x: x.s >= n1) AS held1, list_filter(failed, lambda f: f >= n1) AS failed1,
          list_transform(range(nxt, n1), lambda q: {{'s': q, 'o': CASE WHEN list_contains(list_transform(held,
            lambda x: x.s), q) THEN 'released' ELSE 'skipped' END, 'a': 5e0 + list_min(list_transform(list_filter(
              held, lambda x: x.s > list_max(list_filter(range(nxt, q + 1), lambda h: {_OPEN('h', 'held', 'failed')}))),
              lambda x: x.a))}}) AS out1
        FROM (
          SELECT *, CASE WHEN due IS NULL THEN nxt ELSE {_FIRST_OPEN('(due + 1)', 'held', 'failed')} END AS n1
          FROM (
            SELECT b.user_id, a.rn, b.nxt, b.place + len(b.out) AS base, b.held, b.failed, a.seq, a.tm, a.bad,
              list_max(list_transform(list_filter(b.held, lambda x: a.tm - x.a >= 5e0), lambda x: x.s)) AS due
            FROM buf b JOIN ar a ON a.user_id = b.user_id AND a.rn = b.rn + 1)))))),
released AS (SELECT user_id, o.s AS seq, o.o AS outcome, round(o.a, 3) AS released_at, place + i + 1 AS place
  FROM (SELECT user_id, place, unnest(out) AS o, unnest(range(len(out))) AS i FROM buf))
"""


@query("h05_reordered_clips", f"""
WITH RECURSIVE {B.EVT}, {RELEASES} SELECT user_id, seq, outcome, released_at, place FROM released""")
def reordered_clips(spark, sf_dir):
    a, blk = arrivals(spark, sf_dir)
    if blk:
        a, blk = O.split_hot(a.drop(blk), ["user_id"], "at", O.ROWS_PER_FOLD)
    out = O.run_fold(a, S.reorder(), ["user_id"], ["at", "seq"], blk)
    return out.select("user_id", "seq", "outcome", F.round("at", 3).alias("released_at"), "place")


@query("h06_health_mask", f"""
WITH {B.EVT}
SELECT user_id, event_id, coalesce(max((event_type = 'error' AND value > 120)::INT) OVER (PARTITION BY user_id
  ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS stage_on FROM evt""")
def health_mask(spark, sf_dir):
    e, blk = B.user_events(spark, sf_dir)
    bad = ((F.col("event_type") == "error") & (F.col("value") > 120)).cast("int")
    out = O.scan(e, ["user_id"], ["us", "event_id"], blk, _bad=O.Scan(
        "max", bad, default=F.lit(0)))
    return out.select("user_id", "event_id", (F.col("_bad") == 0).alias("stage_on"))


@query("h07_recent_history", f"""
WITH {B.SEG}
SELECT session_id, seq, count(*) OVER w AS lines, CAST(sum(dur_ms) OVER w AS BIGINT) AS speech_ms
FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY start_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)""")
def recent_history(spark, sf_dir):
    """Lines of the last 60 seconds: each row looks at its own minute and the one before,
    so a session spreads over its minutes."""
    seg, _ = B.segments(spark, sf_dir)
    minute = F.floor(F.col("start_ms") / 60_000)
    twice = seg.select("session_id", "seq", "start_ms", "dur_ms", F.posexplode(
        F.array(minute, minute + 1)).alias("copy", "minute"))
    w = Window.partitionBy("session_id", "minute").orderBy("start_ms").rangeBetween(-60_000, 0)
    return twice.withColumns({"lines": F.count("*").over(w),
                              "speech_ms": F.sum("dur_ms").over(w)}).where("copy = 0").select(
        "session_id", "seq", "lines", "speech_ms")


def gate_history(spark, sf_dir):
    """Windows of two seconds in eight long sessions, and every fifth window a span to judge
    that lies up to 300 windows back, as of a recogniser that lags."""
    e = B.event_rows(spark, sf_dir).withColumn("session_id", F.col("user_id") % 8)
    e, blk = O.split_hot(e, KEY, "us")
    n = O.scan(e, KEY, ["us", "event_id"], blk, n=O.Scan("number"))
    windows = n.select(
        "session_id", "n", "ts", ((F.col("n") - 1) * 2.0).alias("start_s"),
        (F.col("n") * 2.0).alias("end_s"), (F.col("value") >= 50).alias("should_transcribe"),
        "event_type", (F.col("event_id") * 7 % 100 / 100.0).alias("confidence"),
        F.lit("scores").alias("reason"))
    start = (F.col("n") - F.col("event_id") * 13 % 300) * 2.0 - 1.3
    spans = n.where("n % 5 = 0").select(
        "session_id", F.col("event_id").alias("span"), "n", "ts", start.alias("start_s"),
        (start + 3.1).alias("end_s"))
    return windows, spans


HISTORY = B.EVT + """
, dec AS (SELECT user_id % 8 AS session_id, event_id, value >= 50 AS k, event_type AS e,
    event_id * 7 % 100 / 100e0 AS c,
    row_number() OVER (PARTITION BY user_id % 8 ORDER BY us, event_id) AS n FROM evt),
spn AS (SELECT session_id, event_id AS span, n, a, a + 3.1e0 AS b,
    CASE WHEN n <= 256 THEN n ELSE 129 + (n - 257) % 128 END AS held
  FROM (SELECT *, (n - event_id * 13 % 300) * 2e0 - 1.3e0 AS a FROM dec WHERE n % 5 = 0)),
ovl AS (SELECT s.session_id, s.span, s.b - s.a AS len, w.k, w.e, w.c, w.n,
    least(s.b + 0.5e0, w.n * 2e0) - greatest(s.a - 0.5e0, (w.n - 1) * 2e0) AS ov
  FROM spn s JOIN dec w ON w.session_id = s.session_id AND w.n <= s.n AND w.n > s.n - s.held
    AND w.n BETWEEN floor(s.a / 2) - 1 AND ceil(s.b / 2) + 2),
vdt AS (SELECT session_id, span, any_value(len) AS len, sum(ov) FILTER (k) AS approved,
    arg_max({'e': e, 'c': c, 'k': true}, {'c': c, 'n': -n}) FILTER (k) AS yes,
    arg_max({'e': e, 'c': c, 'k': false}, {'c': ov, 'n': -n}) FILTER (NOT k) AS no
  FROM ovl WHERE ov > 0 GROUP BY session_id, span),
hist AS (SELECT session_id, span, held, coalesce(v.e, 'none') AS event_type,
    coalesce(v.k, false) AS should_transcribe, round(coalesce(v.c, -1e0), 6) AS confidence
  FROM (SELECT s.session_id, s.span, s.held,
      CASE WHEN approved / greatest(1e-6, len) >= 0.25e0 THEN yes ELSE coalesce(no, yes) END AS v
    FROM spn s LEFT JOIN vdt USING (session_id, span)))
"""


@query("h07_decision_history", f"""
WITH {HISTORY}
SELECT session_id, span, held, event_type, should_transcribe, confidence FROM hist""")
def decision_history(spark, sf_dir):
    """A span is judged by the 129 to 256 windows that are still remembered."""
    windows, spans = gate_history(spark, sf_dir)
    out = I.remembered_verdicts(spans.drop("ts"), windows.drop("ts"), KEY, "span", "n", "n")
    return out.select(
        "session_id", "span", "held",
        F.coalesce("decision.event_type", F.lit("none")).alias("event_type"),
        F.coalesce("decision.should_transcribe", F.lit(False)).alias("should_transcribe"),
        F.round(F.coalesce("decision.confidence", F.lit(-1.0)), 6).alias("confidence"))


@query("h08_sliding_latency", f"""
WITH {B.EVT}, k AS (SELECT *, unnest(range(0, 12)) AS i FROM evt)
SELECT (us // 3600000000 - i) * 3600 AS window_start, event_type AS stage, count(*) AS n,
  round(avg(seconds), 10) AS mean, max(seconds) AS worst FROM k GROUP BY ALL""")
def sliding_latency(spark, sf_dir):
    """Twelve-hour windows sliding by one hour."""
    e = B.event_rows(spark, sf_dir)
    return e.groupBy(F.window("ts", "12 hours", "1 hour"),
                     F.col("event_type").alias("stage")).agg(
        F.count("*").alias("n"), F.round(F.avg("seconds"), 10).alias("mean"),
        F.max("seconds").alias("worst")).select(
        F.unix_seconds("window.start").alias("window_start"), "stage", "n", "mean", "worst")


@query("h09_session_windows", f"""
WITH {B.EVT}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 14400000000 THEN 0 ELSE 1 END AS o
  FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 14400000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    e = B.event_rows(spark, sf_dir)
    return e.groupBy("user_id", F.session_window("ts", "4 hours")).agg(
        F.count("*").alias("n")).select(
        "user_id", F.unix_micros("session_window.start").alias("start_us"),
        F.unix_micros("session_window.end").alias("end_us"), "n")


@query("h10_late_data", f"""
WITH {B.EVT}, {REORDER}, o AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY tm, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arr)
SELECT user_id, count(*) AS arrivals, count(*) FILTER (seq < top) AS out_of_order,
  count(*) FILTER (failed) AS failed, max(greatest(0, coalesce(top, 0) - seq)) AS worst FROM o GROUP BY user_id""")
def late_data(spark, sf_dir):
    a, blk = arrivals(spark, sf_dir)
    if blk:
        a, blk = O.split_hot(a.drop(blk), ["user_id"], "at")
    o = O.scan(a, ["user_id"], ["at", "seq"], blk, top=O.Scan("max", F.col("seq")))
    return o.groupBy("user_id").agg(
        F.count("*").alias("arrivals"), F.count_if(F.col("seq") < F.col("top"))
        .alias("out_of_order"), F.count_if("failed").alias("failed"),
        F.max(F.greatest(F.lit(0), F.coalesce("top", F.lit(0)) - F.col("seq"))).alias("worst"))


@query("h11_invariants", f"""
WITH {LIVE}, f AS (SELECT *, lag(sequence_id) OVER (PARTITION BY session_id ORDER BY sequence_id) AS p
  FROM live WHERE event_type <> 'ASR_PARTIAL')
SELECT session_id, count(*) AS final_events, count(*) FILTER (p >= sequence_id) AS out_of_order,
  count(*) FILTER (event_type = 'TTS_AUDIO' AND sequence_id // 4 NOT IN (SELECT seq FROM seg)) AS uncommitted
FROM f GROUP BY session_id""")
def invariants(spark, sf_dir):
    """Spoken lines must be committed lines, in order; partial results never count."""
    e = live_events(spark, sf_dir).where(F.col("event_type") != "ASR_PARTIAL")
    seg, _ = B.segments(spark, sf_dir)
    spoken = e.where(F.col("event_type") == "TTS_AUDIO").withColumn(
        "seq", F.floor(F.col("sequence_id") / 4))
    loose = spoken.join(seg.select("session_id", "seq"), ["session_id", "seq"], "left_anti"
                        ).groupBy("session_id").agg(F.count("*").alias("_u"))
    e, blk = O.split_hot(e, KEY, "sequence_id")
    prior = O.scan(e, KEY, ["sequence_id"], blk, _p=O.Scan("lag", F.col("sequence_id")))
    return prior.groupBy("session_id").agg(
        F.count("*").alias("final_events"),
        F.count_if(F.col("_p") >= F.col("sequence_id")).alias("out_of_order")).join(
        loose, "session_id", "left").select(
        "session_id", "final_events", "out_of_order",
        F.coalesce("_u", F.lit(0)).cast("bigint").alias("uncommitted"))
