"""Live operators: what event time alone decides, state that stays bounded, any triggers."""

import pickle
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import intervals as I
from talkmill.operators import ordered as O
from talkmill.operators import segmentation as S
from talkmill.streaming import jobs as SJ
from talkmill.streaming import live as L
from talkmill.streaming import processors as SP

CLIP = "k string, seq long, at double, failed boolean"


def stream_of(spark, tmp_path, schema, batches, seconds):
    """One file, and so one trigger, per batch; ``seconds`` names the column of event time."""
    folder = str(tmp_path / "feed")
    for rows in batches:
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(
            F.round((F.col(seconds) + 1000) * 1_000_000).cast("bigint")))
        df.coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def state_rows(spark, folder, variable):
    """What a stream's checkpoint holds of a state variable."""
    return spark.read.format("statestore").option("stateVarName", variable).load(
        f"{folder}/progress")


def test_a_gap_is_given_up_without_a_new_row(spark, tmp_path):
    """Session a waits for clip 2; only another session is heard while its time runs out."""
    batches = [[("a", 1, 0.0, False), ("a", 3, 1.0, False), ("z", 1, 0.0, False)],
               [("z", 2, 7.0, False)], [("z", 3, 9.0, False)], [("a", 2, 10.0, False)],
               [("z", 4, 99.0, False)]]
    out = SJ.drain(L.reordered(stream_of(spark, tmp_path, CLIP, batches, "at"), ["k"], "ts",
                               delay="0 seconds"), folder=str(tmp_path / "run"))
    got = [(r["seq"], r["outcome"], r["at"]) for r in out.where("k = 'a'").orderBy("place").collect()]
    assert got == [(1, "released", 0.0), (2, "skipped", 6.0), (3, "released", 6.0),
                   (2, "late", 10.0)]


@pytest.mark.parametrize("capacity", [64, 3])
def test_reorder_stream_equals_batch(spark, tmp_path, capacity):
    """Losses, failures, late clips and a full buffer, cut into triggers at random places."""
    rng = random.Random(11)
    rows = [(k, i, round(i + rng.random() * 8, 3), rng.random() < 0.1) for k in "pq"
            for i in range(1, 80) if rng.random() > 0.15]
    rows.sort(key=lambda r: r[2])
    cuts = sorted(rng.sample(range(len(rows)), 5))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    batches += [[("end", 1, 5000.0, False)], [("end", 2, 5001.0, False)]]
    out = SJ.drain(L.reordered(stream_of(spark, tmp_path, CLIP, batches, "at"), ["k"], "ts",
                               delay="1 minute", capacity=capacity), folder=str(tmp_path / "run"))
    batch = O.run_fold(spark.createDataFrame(rows, CLIP), S.reorder(capacity=capacity), ["k"],
                       ["at", "seq"])
    key = lambda df: sorted(tuple(r) for r in df.where("k <> 'end'").collect())
    assert key(out) == key(batch)
    outcomes = {r[2] for r in key(out)}
    assert {"released", "skipped"} <= outcomes


def test_a_silent_session_frees_its_buffer(spark, tmp_path):
    batches = [[("a", 1, 0.0, False), ("a", 3, 1.0, False)], [("z", 1, 500.0, False)],
               [("z", 2, 501.0, False)]]
    SJ.drain(L.reordered(stream_of(spark, tmp_path, CLIP, batches, "at"), ["k"], "ts",
                         delay="0 seconds", end_ms=60_000), folder=str(tmp_path / "run"))
    held = {r["key"]["k"] for r in state_rows(spark, tmp_path / "run", "place").collect()}
    assert held == {"z"}


CHUNK = "k string, seq long, at double, duration double, score double, payload string"


def test_a_window_is_judged_once_and_the_rest_after_a_pause(spark, tmp_path):
    chunk = lambda i, at, score: ("a", i, at, 0.2, score, f"p{i}")
    batches = [[chunk(1, 0.0, 5.0), chunk(2, 0.2, 70.0)], [chunk(3, 0.4, None), chunk(4, 0.6, 1.0)],
               [("z", 1, 100.0, 0.9, 99.0, "z")], [("z", 2, 101.0, 0.9, None, "z")],
               [chunk(5, 200.0, 80.0), chunk(6, 200.2, 2.0), chunk(7, 200.4, 3.0)]]
    out = SJ.drain(L.gated(stream_of(spark, tmp_path, CHUNK, batches, "at"), ["k"], ["at", "seq"],
                           "ts", least=60.0, delay="0 seconds", quiet_ms=30_000),
                   folder=str(tmp_path / "run"))
    got = [tuple(r)[1:] for r in out.where("k = 'a'").orderBy("seq").collect()]
    assert got == [(1, 1, True, "p1"), (2, 1, True, "p2"), (3, 1, True, "p3"), (4, 2, False, ""),
                   (5, 3, True, "p5"), (6, 3, True, "p6"), (7, 3, True, "p7")]
    other = [tuple(r)[1:] for r in out.where("k = 'z'").orderBy("seq").collect()]
    assert other == [(1, 1, True, "z"), (2, 2, False, "")]


@pytest.mark.parametrize("apart", [True, False])
def test_silence_closes_a_unit_wherever_the_trigger_falls(spark, tmp_path, apart):
    """The line after the pause comes in the same micro-batch or in a later one."""
    schema = ("k string, seq long, text string, start_s double, end_s double, speaker int, "
              "language string")
    one, two = ("a", 1, "So we", 0.0, 1.0, None, "en"), ("a", 2, "go on", 60.0, 61.0, None, "en")
    batches = [[one], [("z", 1, "x", 30.0, 31.0, None, "en")], [two]] if apart else [[one, two]]
    batches += [[("z", 9, "y", 900.0, 901.0, None, "en")], [("z", 10, "y", 990.0, 991.0, None, "en")]]
    feed = S.with_profiles(stream_of(spark, tmp_path, schema, batches, "end_s"),
                           dims.lang_profiles(spark))
    out = SJ.drain(SP.stream_fold(feed, S.UNITS, ["k"], ["seq"], event_time="ts",
                                  delay="0 seconds", quiet_ms=20_000, end_ms=10_000_000),
                   folder=str(tmp_path / "run"))
    got = [(r["unit"], r["text"], r["reason"]) for r in out.where("k = 'a'").orderBy("unit").collect()]
    assert got == [(1, "So we", "silence"), (2, "go on", "silence")]


LINE = ("k string, seq long, line_idx long, text string, start_s double, end_s double, "
        "speaker int")


def test_line_state_is_bounded(spark, tmp_path):
    """Ten thousand lines, each in three snapshots; a closed line is not given twice."""
    rows = [("a", 3 * i + j, i, "word " * (j + 1), float(i), i + 0.3 * j, None)
            for i in range(10_000) for j in range(3)]
    again = [("a", 30_001, 5, "word word word more", 10_000.0, 10_001.0, None),
             ("a", 30_002, 9_999, "word word word more", 10_000.0, 10_002.0, None)]
    out = SJ.drain(L.line_deltas(stream_of(spark, tmp_path, LINE, [rows[:15_001], rows[15_001:],
                                                                   again], "end_s"),
                                 ["k"], ["seq"], "ts", keep=8, delay="1 hour"),
                   folder=str(tmp_path / "run"))
    assert state_rows(spark, tmp_path / "run", "lines").count() == 8
    assert out.where("seq <= 30000").count() == 30_000
    assert [r["delta"] for r in out.where("seq > 30000").collect()] == ["more"]


def test_line_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    words = "we think that the under over estimated main reason is this".split()
    rows = []
    for i in range(60):
        text = ""
        for j in range(4):
            text = (text + " " + rng.choice(words)).strip() if rng.random() > 0.2 else text[:-3]
            rows.append(("a", 4 * i + j, i, text, float(i), i + 0.2 * j,
                         -2 if rng.random() < 0.1 else None))
    out = SJ.drain(L.line_deltas(stream_of(spark, tmp_path, LINE, [rows[:70], rows[70:71], rows[71:]],
                                           "end_s"), ["k"], ["seq"], "ts", delay="1 hour"),
                   folder=str(tmp_path / "run"))
    batch = O.run_fold(spark.createDataFrame(rows, LINE), S.DELTAS, ["k"], ["seq"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_the_history_is_a_sawtooth(spark):
    """129 to 256 windows, as a list that loses its 128 oldest at the 257th."""
    held, lengths = [], []
    for n in range(1, 700):
        held.append(n)
        if len(held) > 256:
            del held[:128]
        lengths.append((n, len(held)))
    spans = spark.createDataFrame([("s", n, n, 0.0, 1.0) for n, _ in lengths],
                                  "k string, span long, n long, start_s double, end_s double")
    windows = spark.createDataFrame(
        [("s", n, True, "DIALOGUE", 0.5, "", n * 2.0 - 2, n * 2.0) for n in range(1, 700)],
        "k string, n long, should_transcribe boolean, event_type string, confidence double, "
        "reason string, start_s double, end_s double")
    out = I.remembered_verdicts(spans, windows, ["k"], "span", "n", "n").collect()
    assert sorted((r["span"], r["held"]) for r in out) == lengths
    # The first window is remembered until the 257th comes.
    assert all((r["decision"] is not None) == (r["span"] <= 256) for r in out)


def test_verdict_of_a_span_follows_the_published_cases():
    windows = [(0.0, 0.6, True, "DIALOGUE", 0.7), (0.6, 1.2, False, "SILENCE", 0.95),
               (1.2, 1.8, True, "DIALOGUE", 0.9), (1.8, 2.4, True, "DIALOGUE", 0.8)]
    assert I.verdict_of(windows, 0.0, 2.4) == windows[2]
    music = [(10.0, 12.5, False, "MUSIC", 0.9)]
    assert I.verdict_of(music, 10.6, 12.0) == music[0]
    assert I.verdict_of([], 0.0, 1.0) is None


@pytest.mark.parametrize("cuts", [[], [1, 2, 700], [512, 513, 1024]])
def test_recent_latency_in_any_triggers(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = [("s", i, float(i), round(rng.random() * 9 - 0.5, 3)) for i in range(1300)]
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    out = SJ.drain(L.recent_latency(
        stream_of(spark, tmp_path, "k string, i long, at double, seconds double", batches, "at"),
        ["k"], ["i"], "ts", delay="1 hour"), folder=str(tmp_path / "run"))
    last = max(out.collect(), key=lambda r: r["count"])
    good = [s for *_, s in rows if s >= 0]
    recent = sorted(good[-512:])
    assert (last["count"], last["last"]) == (len(good), good[-1])
    assert last["mean"] == pytest.approx(sum(good) / len(good))
    assert [last["p50"], last["p95"], last["p99"]] == [
        recent[round(p / 100 * 511)] for p in (50, 95, 99)]
    assert state_rows(spark, tmp_path / "run", "ring").count() == 512


def test_samples_travel_as_packs():
    """Of 30,000 rows in many batches a key's task gets a row or two of 8 samples."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random() * 9]), i,
             rng.choice([None, -1.0, rng.random()]), 1000 + i) for i in range(30_000)]
    names = ["k", "at", "i", "seconds", "_ms"]
    table = pa.table({n: pa.array(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
    table = table.append_column("ts", table["_ms"].cast(pa.timestamp("ms", "UTC")))
    out = pa.Table.from_batches(L._packs(["k"], ["at", "i"], "ts", 8, 20_000)(
        iter(table.to_batches(max_chunksize=700)))).to_pylist()
    assert len(out) == 6
    for k in ("a", "b", None):
        mine = [r for r in rows if r[0] == k]
        found = [pickle.loads(r["_row"]) for r in out if r["k"] == k]
        good = [r for r in mine if r[1] is not None and (r[3] or -1) >= 0]
        assert sum(f[0] for f in found) == len(good)
        assert sum(f[1] for f in found) == pytest.approx(sum(r[3] for r in good))
        assert max(f[2] for f in found) == max(r[4] for r in mine if r[1] is not None)
        assert max(r["ts"].timestamp() for r in out if r["k"] == k) * 1000 == pytest.approx(
            max(r[4] for r in mine))
        assert all(len(f[3]) == 8 for f in found)
        assert sorted(x for f in found for x in f[3])[-8:] == sorted(
            ((r[1], r[2]), r[3]) for r in good)[-8:]


@pytest.mark.parametrize("pack_rows", [1, 50, 1 << 18])
def test_recent_latency_of_odd_rows(spark, tmp_path, pack_rows):
    """Missing keys, places and samples, NaN, ties in the first order column."""
    rng = random.Random(8)
    odd = lambda v: rng.choice([None, float("nan"), -v, v, v, v])
    rows = [(rng.choice(["a", None]), rng.choice([1, 2]), None if i % 17 == 0 else i // 3, i,
             float(i), odd(rng.random())) for i in range(400)]
    schema = "k string, g long, o long, i long, at double, seconds double"
    out = SJ.drain(L.recent_latency(
        stream_of(spark, tmp_path, schema, [rows[:150], rows[150:151], rows[151:]], "at"),
        ["k", "g"], ["o", "i"], "ts", capacity=20, delay="1 hour", pack_rows=pack_rows),
        folder=str(tmp_path / "run")).collect()
    for k in ("a", None):
        for g in (1, 2):
            good = [r[5] for r in rows if r[:2] == (k, g) and r[2] is not None
                    and r[5] is not None and r[5] >= 0]
            got = max((r for r in out if (r["k"], r["g"]) == (k, g)), key=lambda r: r["count"])
            recent = sorted(good[-20:])
            assert (got["count"], got["last"]) == (len(good), good[-1])
            assert got["mean"] == pytest.approx(statistics.fmean(good))
            assert [got["p50"], got["p95"], got["p99"]] == [
                recent[round(p / 100 * 19)] for p in (50, 95, 99)]
