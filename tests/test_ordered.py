"""Hot keys: block plans must give exactly the rows of the plain plans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import context as C
from talkmill.operators import ordered as O
from talkmill.operators import quantiles as Q
from talkmill.operators import segmentation as S
from talkmill.operators import timeline as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, count in (("hot", 700), ("warm", 60), ("cold", 3)):
        t = 0
        for i in range(count):
            t += rng.choice([0, 1, 1, 2, 9])
            data.append((key, t, i, rng.choice([None, 1, 2, 5]), rng.randint(-5, 20)))
    return spark.createDataFrame(data, "k string, t long, i long, v int, x int").cache()


def same(a, b):
    cols = sorted(a.columns)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, a.select(cols).collect())) == sorted(map(key, b.select(cols).collect()))


def test_split_hot_cuts_only_hot_keys(rows):
    df, blk = O.split_hot(rows, ["k"], "t", rows=50)
    assert blk == O.BLOCK
    per = {r["k"]: r for r in df.groupBy("k").agg(F.count_distinct(blk).alias("n")).collect()}
    assert per["hot"]["n"] > 10 and per["cold"]["n"] == 1
    biggest = df.groupBy("k", blk).count().agg(F.max("count")).head()[0]
    assert biggest < 150
    # Blocks never go back along the order.
    w = Window.partitionBy("k").orderBy("t", "i")
    assert df.withColumn("p", F.lag(blk).over(w)).where(F.col("p") > F.col(blk)).count() == 0
    assert O.split_hot(rows, ["k"], "t")[1] is None


def test_scans_agree_across_plans(rows):
    outs = dict(
        s=O.Scan("sum", F.col("x")), si=O.Scan("sum", F.col("x"), inclusive=True),
        m=O.Scan("max", F.col("x"), inclusive=True), mp=O.Scan("max", F.col("x")),
        lg=O.Scan("lag", F.col("v"), default=F.lit(-9)), ld=O.Scan("lead", F.col("v")),
        n=O.Scan("number"))
    plain = O.scan(rows, ["k"], ["t", "i"], None, **outs)
    split, blk = O.split_hot(rows, ["k"], "t", rows=50)
    same(plain, O.scan(split, ["k"], ["t", "i"], blk, **outs).drop(blk))
    w = Window.partitionBy("k").orderBy("t", "i")
    want = rows.withColumn("s", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same(want, plain.select(*rows.columns, "s"))


def test_islands_agree(rows):
    plain = O.islands(rows, ["k"], ["t", "i"], None, F.col("x") > 10)
    split, blk = O.split_hot(rows, ["k"], "t", rows=40)
    same(plain, O.islands(split, ["k"], ["t", "i"], blk, F.col("x") > 10).drop(blk))


def test_folds_agree_when_state_crosses_blocks(spark, rows):
    feed = rows.select("k", F.col("i").alias("seq"), F.col("t").cast("double").alias("at"))
    plain = O.run_fold(feed, S.throttle(50.0), ["k"], ["seq"])
    split, blk = O.split_hot(feed, ["k"], "seq", rows=50)
    same(plain, O.run_fold(split, S.throttle(50.0), ["k"], ["seq"], blk))


def test_unit_folds_agree(spark, rows):
    words = F.element_at(F.array(*map(F.lit, ["well,", "I see", "that is it.", "and then",
                                              "we go on for a long while"])),
                         (F.pmod("x", F.lit(5)) + 1).cast("int"))
    seg = rows.select("k", F.col("i").alias("seq"), words.alias("text"),
                      F.col("t").cast("double").alias("start_s"), (F.col("t") + 0.9)
                      .alias("end_s"), F.col("v").alias("speaker"), F.lit("en").alias("language"))
    feed = S.with_profiles(seg, dims.lang_profiles(spark))
    plain = O.run_fold(feed, S.UNITS, ["k"], ["seq"])
    split, blk = O.split_hot(feed, ["k"], "seq", rows=50)
    assert blk
    same(plain, O.run_fold(split, S.UNITS, ["k"], ["seq"], blk))


def test_history_agrees_across_plans(rows):
    pairs = rows.select("k", "i", F.concat(F.lit("s"), "i").alias("source_text"), F.when(
        F.col("x") > 0, F.concat(F.lit("t"), "i")).otherwise("").alias("translated_text"),
        F.col("v").alias("speaker"))
    accepted = F.col("translated_text") != ""
    split, blk = O.split_hot(pairs, ["k"], "i", rows=50)
    for ok in (None, accepted):
        plain = C.rolling_context(pairs, ["k"], ["i"], None, accepted=ok)
        wide = C.rolling_context(split, ["k"], ["i"], blk, accepted=ok).drop(blk)
        pick = ["k", "i", F.col("previous").cast("string").alias("p"), "summary"]
        same(plain.select(*pick), wide.select(*pick))
    plain = C.bounded_window(pairs, ["k"], ["i"], None)
    wide = C.bounded_window(split, ["k"], ["i"], blk)
    pick = ["k", "i", F.col("window").cast("string").alias("w")]
    same(plain.select(*pick), wide.select(*pick))


def test_joined_text_agrees(rows):
    seg = rows.select("k", "i", F.element_at(F.array(*map(F.lit, ["おはよう", "yes", ". no", "그래"])), (
        F.pmod("x", F.lit(4)) + 1).cast("int")).alias("text"))
    split, blk = O.split_hot(seg, ["k"], "i", rows=50)
    same(S.joined_text(seg, ["k"], ["i"], None), S.joined_text(split, ["k"], ["i"], blk))


def test_placement_equals_the_sequential_rule(spark):
    rng = random.Random(11)
    data, want = [], {}
    for key in range(6):
        t, cursor = 0.0, 0.0
        for i in range(80):
            t += rng.random() * 3
            d = 0.2 + rng.random() * 3
            actual = max(t, cursor + (0.05 if cursor > 0 else 0.0))
            cursor = actual + d
            want[key, i] = actual
            data.append((key, i, t, d))
    df = spark.createDataFrame(data, "k int, i int, start_s double, duration double")
    split, blk = O.split_hot(df, ["k"], "i", rows=20)
    for frame, b in ((df, None), (split, blk)):
        for r in L.place(frame, ["k"], ["i"], b).collect():
            assert abs(r["actual_start"] - want[r["k"], r["i"]]) < 1e-9


def test_quantiles_agree_and_match_numpy(spark, rows):
    import numpy as np

    values = rows.withColumn("y", F.col("x") + F.col("t") / 7.0)
    got = {r["k"]: r for r in Q.linear(values, ["k"], "y", p50=0.5, p95=0.95).collect()}
    hot = {r["k"]: r for r in Q.linear(values, ["k"], "y", rows=60, p50=0.5, p95=0.95).collect()}
    by = {}
    for r in values.collect():
        by.setdefault(r["k"], []).append(r["y"])
    for k, ys in by.items():
        for name, q in (("p50", 50), ("p95", 95)):
            assert abs(got[k][name] - np.percentile(ys, q)) < 1e-9
            assert abs(hot[k][name] - np.percentile(ys, q)) < 1e-9
        near = sorted(ys)[int(round(0.95 * (len(ys) - 1)))]
        assert Q.nearest(values.where(F.col("k") == k), ["k"], "y", p=95).head()["p"] == near


def test_top_k_is_exact(rows):
    got = O.top_k(rows, ["k"], [F.col("x").desc(), F.col("i")], 7)
    w = Window.partitionBy("k").orderBy(F.col("x").desc(), "i")
    same(got, rows.withColumn("rank", F.row_number().over(w)).where("rank <= 7"))


def test_rounds_of_a_hot_fold_do_not_grow_with_its_blocks(spark, monkeypatch):
    """Counters are added up afterwards, so a block is not stale because of them."""
    rows = spark.range(256).select(F.lit("k").alias("k"), (F.col("id") * 4.0).alias("at"),
                                   F.col("id"))
    cuts = []
    monkeypatch.setattr(O, "cut", lambda df, real=O.cut: cuts.append(1) or real(df))
    plain = O.run_fold(rows, S.throttle(), ["k"], ["at"])
    rounds = {}
    for blocks in (8, 64):
        cuts.clear()
        size = 256 // blocks
        split = rows.withColumn("_blk", F.floor(F.col("id") / size))
        # Blocks start where the period has run out, as at a pause.
        split = split.withColumn("at", F.col("at") + F.col("_blk") * 1000.0)
        same(O.run_fold(split, S.throttle(), ["k"], ["at"], "_blk"),
             O.run_fold(split.drop("_blk"), S.throttle(), ["k"], ["at"]))
        rounds[blocks] = len(cuts)
    assert rounds[8] == rounds[64]
    assert plain.count() > 0


@pytest.mark.parametrize("limit", [1, 5000])
def test_blank_language_takes_all_terms_in_both_plans(spark, limit):
    lines = spark.createDataFrame([(1, "a tango", ""), (2, "a tango", None), (3, "a tango", "ja"),
                                   (4, "a tango", "xx")], "id long, text string, language string")
    terms = C.glossary(spark.createDataFrame(
        [("tango", "T", "", "ja", 0), ("a", "A", "", None, 1)],
        "source string, target string, romanized string, source_language string, idx long"))
    got = {r["id"]: [t["source"] for t in r["terms"]] for r in C.attach_terms(
        lines, terms, ["id"], "text", "language", limit).collect()}
    assert got == {1: ["tango", "a"], 2: ["tango", "a"], 3: ["tango", "a"], 4: ["a"]}
