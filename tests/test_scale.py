"""Steps whose cost must not grow faster than their input."""

import random

from pyspark.sql import functions as F

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators import intervals as I
from talkmill.operators import models as M
from talkmill.operators import rules as R
from talkmill.plans import bindings as B
from talkmill.plans import queries_live as QL
from talkmill.streaming import jobs as SJ
from talkmill.streaming import live as L


def test_frames_travel_by_the_pack(spark):
    """Also where frames come in no order; a frame on a pack's edge is not lost."""
    rows = [("a", round(i * 0.1, 1), float(i * 37 % 101)) for i in range(400)]
    frames = spark.createDataFrame(rows, "k string, t double, level double").coalesce(1)
    assert I._packed(frames, ["k"]).count() <= 10
    random.Random(5).shuffle(rows)
    mixed = spark.createDataFrame(rows, "k string, t double, level double").repartition(3)
    regions = spark.createDataFrame([("a", 1, 0.05, 12.0), ("a", 2, 15.0, 15.5), ("a", 3, 20.0, 38.0)],
                                    "k string, island long, start_s double, end_s double")
    got = {(r["island"], r["t"]) for r in I.frames_inside(regions, mixed, ["k"], ["k", "island"],
                                                          2.0).collect()}
    assert got == {(n, t) for n, a, b in ((1, 0.05, 12.0), (3, 20.0, 38.0)) for _, t, _ in rows
                   if min(b, t + I.FRAME) - max(a, t) > 0}
    chunks = [sorted(tuple(r) for r in I.pack_regions(regions, ["k"], ["island"], None, f,
                                                      max_seconds=3.0).collect())
              for f in (frames, mixed)]
    assert chunks[0] == chunks[1] and len(chunks[0]) > 8


def test_labels_are_rolled_up_by_the_batch(spark):
    whole = [((i * 7919) % 1000) / 1000 for i in range(dims.LABEL_COUNT)]
    holes = [None if i % 3 else p for i, p in enumerate(whole)]
    cases = [whole, holes, whole[:5], [], None]
    df = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(cases)],
                               "id int, probs array<double>, level double")
    out = R.label_rollup(df, ["id"], "probs", "level")
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    taken = {i: c for c, a, b in dims.LABEL_RANGES for i in range(a, b + 1)}
    for r in out.collect():
        probs = cases[r["id"]] or []
        for name in dims.CATEGORIES[:-1]:
            known = [p for i, p in enumerate(probs) if p is not None
                     and taken.get(i, dims.SFX) == name]
            assert r["scores"][name] == max(known, default=0.0)


def test_shares_of_a_spread_table_grow_with_it(spark, tmp_path, monkeypatch):
    spark.range(50_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(B, "SPREAD_BYTES", 10_000)
    assert B.spread(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions() > 8


def test_phrases_are_compared_by_the_batch(spark):
    texts = ["go on now " * 4, "a b c d e f g h i", None, "", "x " * 20, "short one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    out = df.select("i", X.phrase_loop_score("t").alias("p"))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["p"] for r in out.orderBy("i").collect()] == [1.0, 0.0, None, 0.0, 1.0, 0.0]


def test_tokens_of_a_line_are_counted_once():
    M._tokens.cache_clear()
    assert [M._tokens(t) for t in ("日本go", "日本go", "नम abcd")] == [3, 3, 4]
    assert M._tokens.cache_info().hits == 1


def test_a_key_with_many_rows_comes_in_more_triggers(spark):
    rows = spark.range(1, 1001).select(F.lit(7).cast("long").alias("k"), "id",
                                       F.timestamp_seconds("id").alias("ts"))
    out = SJ.drain(QL.timed_feed(spark, rows, "k", most=100).select(
        "k", "id", F.input_file_name().alias("f")))
    sizes = [r["count"] for r in out.where("k = 7").groupBy("f").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 10 and max(sizes) < 200


def test_slices_are_counted_by_the_whole_key(spark):
    rows = spark.range(1, 1001).select(F.lit(7).cast("long").alias("k"), F.concat(
        F.lit("s"), F.col("id") % 10).alias("stage"), "id", F.timestamp_seconds("id").alias("ts"))
    out = SJ.drain(QL.timed_feed(spark, rows, ["k", "stage"], most=50, keys_a_file=1).select(
        "k", "stage", "id", F.input_file_name().alias("f")))
    files = out.where("k = 7").groupBy("stage").agg(F.countDistinct("f").alias("n")).collect()
    assert {r["stage"]: r["n"] for r in files} == {f"s{i}": 3 for i in range(10)}
    assert out.where("k = 7").count() == 1000


def test_a_missing_key_is_a_key_of_its_own(spark):
    rows = [(k, "s", i, i, 1.0) for i in range(60) for k in (None, 1, 2)]
    feed = spark.createDataFrame(rows, "k long, stage string, us long, event_id long, seconds double"
                                 ).withColumn("ts", F.timestamp_seconds(F.col("us") + 1000))
    out = SJ.drain(L.recent_latency(QL.timed_feed(spark, feed, "k"), ["k", "stage"],
                                    ["us", "event_id"], "ts", delay="40 days"))
    most = {r["k"]: r["n"] for r in out.groupBy("k").agg(F.max("count").alias("n")).collect()}
    assert most == {None: 60, 1: 60, 2: 60}


def test_all_gaps_are_given_up_at_the_end(spark):
    rows = [(1, s, float(s), False) for s in (1, 3, 6, 9, 20)]
    clips = spark.createDataFrame(rows, "k long, seq long, at double, failed boolean").withColumn(
        "ts", F.timestamp_seconds(F.col("at") + 1000))
    out = SJ.drain(L.reordered(QL.timed_feed(spark, clips, "k"), ["k"], "ts", delay="40 days"))
    assert {r["seq"] for r in out.where("outcome = 'released'").collect()} == {1, 3, 6, 9, 20}
