"""Published example cases of the gate, the validators and the span verdict."""

import pytest
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import context as C
from talkmill.operators import intervals as I
from talkmill.operators import rules as R


def gate(spark, vad, **scores):
    full = {c: 0.0 for c in dims.CATEGORIES} | scores
    df = spark.createDataFrame([(0.9, vad, full)], "c double, s boolean, m map<string,double>")
    return df.select(R.gate_decision(F.col("c"), F.col("s"), F.col("m")).alias("d")).head()["d"]


def test_gate(spark):
    d = gate(spark, True, DIALOGUE=0.55, MUSIC=0.95)
    assert d["should_transcribe"] and d["event_type"] == "DIALOGUE"
    d = gate(spark, True, DIALOGUE=0.05, MUSIC=0.92)
    assert not d["should_transcribe"] and d["event_type"] == "MUSIC"
    d = gate(spark, True, DIALOGUE=0.2, SFX=0.4)
    assert d["should_transcribe"] and d["event_type"] == "UNKNOWN"
    d = gate(spark, False, MUSIC=0.7)
    assert (d["should_transcribe"], d["event_type"], d["reason"]) == (False, "MUSIC", "vad:no_speech")
    df = spark.createDataFrame([(0.4, True)], "c double, s boolean").withColumn(
        "m", F.lit(None).cast("map<string,double>"))
    d = df.select(R.gate_decision(F.col("c"), F.col("s"), F.col("m")).alias("d")).head()["d"]
    assert d["reason"] == "vad_only" and d["event_type"] == "DIALOGUE"


@pytest.mark.parametrize("text,end,values,reason", [
    ("...", 1.0, {}, "empty_transcript"),
    ("hello there", 0.05, {}, "segment_too_short"),
    ("x" * 200, 1.0, {}, "abnormal_text_density"),
    ("あ、あ、あ、あ、あ、あ、あ", 3.0, {}, "repetition"),
    ("ははははははははは", 3.0, {}, "repetition"),
    ("a fine line", 3.0, {"no_speech_prob": 0.95}, "high_no_speech_probability"),
    ("a fine line", 3.0, {"no_speech_prob": 0.7, "avg_logprob": -1.2}, "no_speech_and_low_logprob"),
    ("a fine line", 3.0, {"avg_logprob": -2.2}, "low_average_log_probability"),
    ("a fine line", 3.0, {"compression_ratio": 3.0}, "high_compression_ratio"),
    ("字幕：someone", 3.0, {}, "subtitle_credit"),
    ("ご視聴ありがとうございました", 3.0, {"no_speech_prob": 0.0, "avg_logprob": -0.3},
     "known_hallucination_phrase"),
    ("a fine line", 3.0, {"avg_logprob": -0.2}, None),
])
def test_transcripts(spark, text, end, values, reason):
    names = ["no_speech_prob", "avg_logprob", "compression_ratio"]
    df = spark.createDataFrame([(text, 0.0, end, *[values.get(n) for n in names])],
                               "text string, start_s double, end_s double, " + ", ".join(
                                   f"{n} double" for n in names))
    row = R.validate_transcripts(df).head()
    assert row["reason"] == reason and row["valid"] == (reason is None)


def test_stock_phrase_needs_dialogue(spark):
    df = spark.createDataFrame([("ご視聴ありがとうございました", 0.0, 3.0, 0.0, -0.3)],
                               "text string, start_s double, end_s double, no_speech_prob double,"
                               " avg_logprob double")
    for event, sure, valid in (("DIALOGUE", 0.9, True), ("UNKNOWN", 0.9, False),
                               ("MUSIC", 0.9, False)):
        judged = df.withColumn("decision", F.struct(
            F.lit(event).alias("event_type"), F.lit(sure).alias("confidence")))
        assert R.validate_transcripts(judged, decision="decision").head()["valid"] == valid


def test_language_mismatch(spark):
    df = spark.createDataFrame([("guten tag", 0.0, 2.0, "de", 0.9), ("guten tag", 0.0, 2.0, "de", 0.5),
                                ("guten tag", 0.0, 2.0, "de", None)],
                               "text string, start_s double, end_s double, language string,"
                               " language_probability double")
    out = R.validate_transcripts(df, expected=F.lit("en")).collect()
    assert [r["valid"] for r in out] == [False, True, False]


def windows(spark, rows):
    return spark.createDataFrame(
        [("s", i, *r, "") for i, r in enumerate(rows)],
        "k string, w int, should_transcribe boolean, event_type string, confidence double,"
        " start_s double, end_s double, reason string")


def test_span_verdicts(spark):
    w = windows(spark, [(True, "DIALOGUE", 0.7, 0.0, 0.6), (False, "SILENCE", 0.95, 0.6, 1.2),
                        (True, "DIALOGUE", 0.9, 1.2, 1.8), (True, "DIALOGUE", 0.8, 1.8, 2.4),
                        (False, "MUSIC", 0.9, 10.0, 13.0)])
    seg = spark.createDataFrame([("s", 0, 0.0, 2.4), ("s", 1, 10.6, 12.0), ("s", 2, 50.0, 51.0),
                                 ("t", 0, 0.0, 2.0)],
                                "k string, seq int, start_s double, end_s double")
    got = {(r["k"], r["seq"]): r["decision"] for r in I.span_verdicts(
        seg, w, ["k"], "seq", "w").collect()}
    assert got["s", 0]["event_type"] == "DIALOGUE" and got["s", 0]["confidence"] == 0.9
    assert got["s", 1]["event_type"] == "MUSIC" and not got["s", 1]["should_transcribe"]
    assert got["s", 2] is None and got["t", 0] is None


def test_merge(spark):
    w = windows(spark, [(True, "DIALOGUE", 0.5, 0.0, 2.0), (True, "DIALOGUE", 0.7, 2.0, 4.0),
                        (False, "MUSIC", 0.9, 4.0, 6.0)])
    out = sorted((r["start_s"], r["end_s"], round(r["confidence"], 6)) for r in I.merge_equal(
        w, ["k"], ["w"], None).collect())
    assert out == [(0.0, 4.0, 0.6), (4.0, 6.0, 0.9)]


def test_chunks_cut_at_the_breath(spark):
    """Regions 1-5, 5.4-8 and 10-39 with a breath at 24.0-24.4."""
    regions = spark.createDataFrame([("s", 0, 1.0, 5.0), ("s", 1, 5.4, 8.0), ("s", 2, 10.0, 39.0)],
                                    "k string, island int, start_s double, end_s double")
    frames = spark.createDataFrame(
        [("s", i / 10, 1.0 if 240 <= i < 244 else 50.0 + i % 3) for i in range(500)],
        "k string, t double, level double")
    out = sorted((r["start_s"], r["end_s"]) for r in I.pack_regions(
        regions, ["k"], ["island"], None, frames).collect())
    assert out[0] == (1.0, 8.0) and out[-1][1] == 39.0
    assert 24.0 <= out[1][1] <= 24.4 and out[1][1] == out[2][0]


def cut_at_quietest(regions, frames, most, gap=0.8):
    """Chunks by looking at all frames for every cut."""
    chunks, open_ = [], None
    for a, b in regions:
        mine = [(t, v) for t, v in frames if t + 0.1 > a and t < b]
        while b - a > most:
            low, high = a + most / 2, a + most
            fit = [(v, t) for t, v in mine if low - 1e-9 <= t and t + 0.1 <= high + 1e-9]
            at = min(fit)[1] + 0.05 if fit else (low + high) / 2 if mine else high
            chunks += [open_] if open_ else []
            open_, a = (a, at), at
        if open_ and a - open_[1] <= gap and b - open_[0] <= most:
            open_ = (open_[0], b)
        else:
            chunks += [open_] if open_ else []
            open_ = (a, b)
    return chunks + ([open_] if open_ else [])


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_a_look_at_all_frames(spark, seed):
    """Long regions with ties, missing frames and no frames at all; with blocks too."""
    import random

    rng = random.Random(seed)
    regions, frames, at = [], [], 0.0
    for i in range(12):
        length = rng.choice([2.0, 9.5, 31.25, 70.0, 131.7])
        regions.append((at, at + length))
        if i % 5 != 3:
            frames += [(k / 10, float(rng.randint(0, 6))) for k in range(
                int(at * 10) - 2, int((at + length) * 10) + 2) if rng.random() > 0.02 * seed
                and not (seed == 3 and 300 < k % 1000 < 700)]
        at += length + rng.choice([0.5, 3.0])
    df = spark.createDataFrame([("s", i, a, b, i // 4) for i, (a, b) in enumerate(regions)],
                               "k string, island int, start_s double, end_s double, blk int")
    levels = spark.createDataFrame([("s", t, v) for t, v in frames],
                                   "k string, t double, level double")
    for blk in (None, "blk"):
        rows = I.pack_regions(df, ["k"], ["island"], blk, levels).orderBy("chunk").collect()
        assert [(round(r["start_s"], 6), round(r["end_s"], 6)) for r in rows] == [
            (round(a, 6), round(b, 6)) for a, b in cut_at_quietest(regions, frames, 28.0)]


def test_chunk_limit_without_frames(spark):
    regions = spark.createDataFrame([("s", 0, 0.0, 100.0)],
                                    "k string, island int, start_s double, end_s double")
    out = [(r["start_s"], r["end_s"]) for r in I.pack_regions(
        regions, ["k"], ["island"], None).collect()]
    assert out == [(0.0, 28.0), (28.0, 56.0), (56.0, 84.0), (84.0, 100.0)]


def test_glossary(spark):
    terms = spark.createDataFrame(
        [("五条", "Gojo", None, None, 0), ("五条悟", "Satoru Gojo", "Satoru Gojo", "ja", 1),
         (" ", "x", None, None, 2)],
        "source string, target string, romanized string, source_language string, idx int")
    g = C.glossary(terms)
    assert g.count() == 2
    lines = spark.createDataFrame([(1, "五条悟です", "ja"), (2, "hello", "ja"), (3, "五条悟", "en"),
                                   (4, "五条悟と五条", None)], "i int, text string, language string")
    for limit in (100, 0):
        p = C.attach_terms(lines, g, ["i"], "text", "language", limit).withColumn(
            "p", C.protect(F.col("text"), F.col("terms")))
        got = {r["i"]: r for r in p.select("i", "p.text", C.restore(
            F.col("p.text"), F.col("p.used")).alias("back"), C.restore(
            F.col("p.text"), F.col("p.used"), "preserve_and_romanize").alias("both")).collect()}
        assert got[1]["text"] == "VBX0Xです" and got[1]["back"] == "Satoru Gojoです"
        assert got[1]["both"].startswith("五条悟 (Satoru Gojo)")
        assert got[2]["text"] == "hello" and got[3]["back"] == "Gojo悟"
        assert got[4]["back"] == "Satoru GojoとGojo"


def test_rolling_context(spark):
    df = spark.createDataFrame([("s", i, f"source {i}", f"translated {i}", None) for i in range(6)],
                               "k string, seq int, source_text string, translated_text string, speaker int")
    out = C.rolling_context(df, ["k"], ["seq"], None, max_segments=2)
    last = out.where("seq = 5").head()
    assert [e["source"] for e in last["previous"]] == ["source 3", "source 4"]
    assert "translated 0" in last["summary"] and "translated 2" in last["summary"]
    tight = C.rolling_context(df, ["k"], ["seq"], None, max_tokens=3).where("seq = 5").head()
    assert tight["previous"] == [] and "translated 4" in tight["summary"]
    long_ = C.rolling_context(df, ["k"], ["seq"], None, max_segments=1, summary_chars=10)
    assert long_.where("seq = 5").head()["summary"] == "...anslated 3"
