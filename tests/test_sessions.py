"""Published example cases of the ordered rules, in batch and as streams."""

import random

import pytest
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import ordered as O
from talkmill.operators import segmentation as S
from talkmill.operators import timeline as L
from talkmill.streaming import jobs as SJ
from talkmill.streaming import processors as SP

SEG = "k string, seq long, text string, start_s double, end_s double, speaker int, language string"


def units(spark, rows, latency="balanced"):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], SEG)
    feed = S.with_profiles(df, dims.lang_profiles(spark), latency)
    return sorted((r["unit"], r["text"], r["reason"], r["speaker"]) for r in O.run_fold(
        feed, S.UNITS, ["k"], ["seq"]).collect())


def test_english_sentence(spark):
    words = "I think the main reason is that we should wait.".split()
    got = units(spark, [(w, i * 0.3, i * 0.3 + 0.3, None, "en") for i, w in enumerate(words)])
    assert [(u[1], u[2]) for u in got] == [(" ".join(words), "punctuation")]


def test_short_line_is_held_to_the_end(spark):
    assert units(spark, [("Yes.", 0.0, 0.4, None, "en")])[0][2] == "end_of_file"


def test_japanese_and_korean(spark):
    got = units(spark, [("私は昨日映画館に行って", 0.0, 2.0, None, "ja"), ("友達と会いました", 2.0, 3.5, None, "ja")])
    assert got == [(1, "私は昨日映画館に行って友達と会いました", "sentence_final", None)]
    got = units(spark, [("어제 친구를 만나서", 0.0, 2.0, None, "ko"), ("영화를 봤습니다", 2.0, 3.5, None, "ko")])
    assert got == [(1, "어제 친구를 만나서 영화를 봤습니다", "sentence_final", None)]


def test_limits_pause_and_speakers(spark):
    got = units(spark, [("あの時に", i * 0.1, i * 0.1 + 0.1, None, "ja") for i in range(40)])
    assert got[0][2] == "max_chars"
    assert units(spark, [("no marks in this line", 0.0, 30.0, None, "en")])[0][2] == "max_seconds"
    got = units(spark, [("this line has no end", 0.0, 1.0, None, "en"), ("next one", 5.0, 6.0, None, "en")])
    assert got[0][2] == "pause"
    got = units(spark, [("one voice", 0.0, 1.0, 1, "en"), ("another voice", 1.0, 2.0, 2, "en")])
    assert got[0][2:] == ("speaker_change", 1)


def test_profiles_scale(spark):
    low = dims.profile("en", "low_latency")
    assert low["pause_threshold_ms"] == 360 and low["minimum_stable_chars"] == 7
    df = spark.createDataFrame([("EN_us",), (None,), ("xx",)], "language string")
    got = {r["language"]: r["max_chars"] for r in S.with_profiles(
        df, dims.lang_profiles(spark, [dict(dims.profile("en"), language="xx", max_chars=7)])).collect()}
    assert got == {"EN_us": 240, None: 220, "xx": 7}


def snapshots(spark, snaps):
    return spark.createDataFrame(
        [("s", i, [(t, 0.0, e) for t, e in lines]) for i, lines in enumerate(snaps)],
        "k string, snap long, lines array<struct<text:string,start_s:double,end_s:double>>")


def test_snapshots(spark):
    a, b = ("Hello there", 1.0), ("how are you", 2.0)
    out = O.run_fold(snapshots(spark, [[a], [a], [a, b]]), S.SNAPSHOTS, ["k"], ["snap"]).collect()
    assert [(r["snap"], r["text"]) for r in out] == [(0, "Hello there"), (2, "how are you")]
    out = O.run_fold(snapshots(spark, [[("x", 3.0)], [("x", 1.0)]]), S.SNAPSHOTS, ["k"], ["snap"]).collect()
    assert out[1]["rolled_back"] and out[1]["text"] is None


def deltas(spark, rows):
    df = spark.createDataFrame([("s", i, 0, t, a, b, None) for i, (t, a, b) in enumerate(rows)],
                               "k string, seq long, line_idx int, text string, start_s double,"
                               " end_s double, speaker int")
    return O.run_fold(df, S.DELTAS, ["k"], ["seq"]).orderBy("seq").collect()


def test_growing_lines(spark):
    out = deltas(spark, [("I think the", 0.1, 2.0), ("I think the main reason", 0.1, 4.7),
                         ("I think the main reason.", 0.1, 4.7)])
    assert [r["delta"] for r in out] == ["I think the", "main reason", "."]
    assert (out[1]["start_s"], out[1]["end_s"]) == (2.0, 4.7) and out[2]["end_s"] > 4.7
    out = deltas(spark, [("we under estimated", 0.0, 1.0), ("we underestimated it", 0.0, 2.0)])
    assert out[1]["delta"] == "estimated it" and out[1]["revisions"] == 1


def released(spark, rows, **options):
    df = spark.createDataFrame([("s", s, float(t), f) for s, t, f in rows],
                               "k string, seq long, at double, failed boolean")
    out = O.run_fold(df, S.reorder(**options), ["k"], ["at", "seq"]).orderBy("place").collect()
    return [(r["seq"], r["outcome"]) for r in out]


def test_reorder(spark):
    assert released(spark, [(3, 0, False), (2, 1, False), (1, 2, False)]) == [
        (1, "released"), (2, "released"), (3, "released")]
    assert released(spark, [(1, 0, False), (3, 1, False), (2, 2, True)]) == [
        (1, "released"), (2, "skipped"), (3, "released")]
    assert released(spark, [(1, 0, False), (2, 1, False), (1, 2, False)])[-1] == (1, "late")
    assert released(spark, [(1, 0, False), (3, 1, False), (4, 9, False)]) == [
        (1, "released"), (2, "skipped"), (3, "released"), (4, "released")]
    got = released(spark, [(5, 0, False), (4, 0.1, False), (3, 0.2, False)], capacity=2)
    assert got[0] == (5, "skipped")


def test_reorder_never_goes_back(spark):
    rng = random.Random(2)
    rows = [(i, i + rng.random() * 6, rng.random() < 0.1) for i in range(1, 200) if rng.random() > 0.1]
    got = released(spark, rows)
    out = [s for s, o in got if o == "released"]
    assert out == sorted(out) and len(set(out)) == len(out)
    assert {s for s, _, _ in rows} <= {s for s, _ in got}


def test_hysteresis(spark):
    def final(seen):
        df = spark.createDataFrame([("s", i, x, 0.9, 1.0) for i, x in enumerate(seen)],
                                   "k string, seq long, detected string, probability double, seconds double")
        return [r["stable"] for r in O.run_fold(df, S.language_fold(), ["k"], ["seq"]).orderBy("seq").collect()]
    assert final(["ja", "en", "en", "en"])[-2:] == ["ja", "en"]
    assert final(["ja", "en", "en", "ja", "en"])[-1] == "ja"


def test_text_event_groups(spark):
    rows = [(1.0, "Hello"), (1.6, "there ."), (5.0, "How"), (5.3, "are"), (5.9, "you")]
    df = spark.createDataFrame([("s", i, t, x, False) for i, (t, x) in enumerate(rows)],
                               "k string, seq int, t double, text string, finished boolean")
    out = L.group_text_events(df, ["k"], ["seq"], None, F.lit(8.0)).orderBy("cue").collect()
    assert [r["text"] for r in out] == ["Hello there.", "How are you"]
    assert out[0]["end_s"] == 3.1


def test_placement_and_backlog(spark):
    df = spark.createDataFrame([("s", 0, 1.0, 3.0), ("s", 1, 2.0, 1.0), ("s", 2, 7.0, 1.0)],
                               "k string, i int, start_s double, duration double")
    out = L.place(df, ["k"], ["i"], None).orderBy("i").collect()
    assert [round(r["actual_start"], 6) for r in out] == [1.0, 4.05, 7.0]
    late = L.backlog(df.withColumn("at", F.col("start_s")), ["k"], ["i"], None, limit=1.0)
    assert late.where("i = 0").head()["overloaded"]


# -- streams -----------------------------------------------------------------------------

def feed(spark, tmp_path, frames):
    folder = str(tmp_path / "feed")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("closing", ["row", "timer"])
def test_stream_units_close(spark, tmp_path, closing):
    """A held line leaves when its session ends by a row, or pauses past the watermark."""
    rows = [("a", 0, "Yes.", 0.0, 0.4, None, "en"), ("b", 0, "No.", 0.0, 0.4, None, "en")]
    base = spark.createDataFrame(rows, SEG).withColumn("ts", F.timestamp_seconds(F.lit(100)))
    later = spark.createDataFrame([("z", 1, "Later", 0.0, 0.4, None, "en")], SEG).withColumn(
        "ts", F.timestamp_seconds(F.lit(100_000)))
    even = spark.createDataFrame([("z", 2, "still", 0.4, 0.8, None, "en")], SEG).withColumn(
        "ts", F.timestamp_seconds(F.lit(200_000)))
    frames = [S.with_profiles(df, dims.lang_profiles(spark)).withColumn(SP.END, F.lit(False))
              for df in (base, later, even)]
    if closing == "row":
        ends = frames[0].withColumns({SP.END: F.lit(True), "seq": F.lit(9).cast("long")})
        frames = [frames[0], ends]
    stream = feed(spark, tmp_path, frames)
    options = {} if closing == "row" else {"event_time": "ts", "quiet_ms": 60_000}
    out = SJ.drain(SP.stream_fold(stream, S.UNITS, ["k"], ["seq"], **options),
                   folder=str(tmp_path / "run"))
    got = {(r["k"], r["text"], r["reason"]) for r in out.collect()}
    reason = "end_of_file" if closing == "row" else "silence"
    assert {("a", "Yes.", reason), ("b", "No.", reason)} <= got


def test_a_key_heard_again_after_its_timer_repeats_nothing(spark, tmp_path):
    """Snapshots are cumulative: what was stable before the pause must not come again."""
    schema = ("k string, snap long, at long, "
              "lines array<struct<text:string,start_s:double,end_s:double>>")
    lines = [("t1", 0.0, 1.0), ("t2", 1.0, 2.0), ("t3", 2.0, 3.0)]
    rows = [[("a", 1, 100, lines[:2])], [("z", 1, 100_000, lines[:1])],
            [("z", 2, 200_000, lines[:1])], [("a", 2, 200_100, lines)]]
    frames = [spark.createDataFrame(r, schema).withColumn("ts", F.timestamp_seconds("at"))
              for r in rows]
    out = SJ.drain(SP.stream_fold(feed(spark, tmp_path, frames), S.SNAPSHOTS, ["k"], ["snap"],
                                  event_time="ts", quiet_ms=60_000),
                   folder=str(tmp_path / "run"))
    assert sorted((r["stable_seq"], r["text"]) for r in out.where("k = 'a'").collect()) == [
        (1, "t1"), (2, "t2"), (3, "t3")]


def test_stream_reorder_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, i, i + rng.random() * 4, False) for k in "pq" for i in range(1, 60)]
    rows.sort(key=lambda r: r[2])
    schema = "k string, seq long, at double, failed boolean"
    frames = [spark.createDataFrame(rows[:60], schema), spark.createDataFrame(rows[60:], schema)]
    fold = S.reorder(gap_timeout=1e9)
    out = SJ.drain(SP.stream_fold(feed(spark, tmp_path, frames), fold, ["k"], ["at", "seq"]),
                   folder=str(tmp_path / "run"))
    batch = O.run_fold(spark.createDataFrame(rows, schema), fold, ["k"], ["at", "seq"])
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(out) == key(batch)


def test_contextual_fold_sees_the_rolling_context(spark):
    """The sequential rule and the columns agree on what a line may see."""
    from talkmill.operators import context as C
    from talkmill.operators import models as M

    rng = random.Random(8)
    lines = [("s", i, " ".join("word" for _ in range(rng.randint(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(lines, "k string, seq long, source_text string")
    limits = dict(max_segments=4, max_tokens=90, summary_chars=80)
    told = O.run_fold(df, M.contextual_fold(
        lambda: lambda text, previous, summary: "" if len(text) % 7 == 0 else "T " + text, **limits),
        ["k"], ["seq"])
    pairs = df.join(told.select("seq", "translated_text"), "seq").withColumn(
        "speaker", F.lit(None).cast("int"))
    want = C.rolling_context(pairs, ["k"], ["seq"], None,
                             accepted=F.col("translated_text") != "", **limits).select(
        "seq", F.transform("previous", lambda e: e["source"]).alias("p"), "summary")
    key = lambda df: sorted((r[0], tuple(r[1]), r[2]) for r in df.collect())
    assert key(told.select("seq", "previous", "summary")) == key(want)
