"""Sources and sinks on real files."""

import csv
import json

from pyspark.sql import functions as F

from talkmill.sources import readers as RD
from talkmill.sources import writers as W


def test_manifests_in_both_shapes(spark, tmp_path):
    items = [{"id": "ja_1", "audio": "a/1.wav", "source_language": "ja", "target_language": "en",
              "reference_text": "はい", "reference_translation": "Yes"},
             {"id": 2, "audio": "/abs/2.wav", "source_language": "ko", "target_language": "en",
              "category": "music"}]
    (tmp_path / "list.json").write_text(json.dumps(items), "utf-8")
    (tmp_path / "dict.json").write_text(json.dumps({"version": "v1", "items": items[:1]}), "utf-8")
    got = RD.read_manifests(spark, [str(tmp_path / "list.json"), str(tmp_path / "dict.json")])
    rows = sorted((r["id"], r["audio"], r["category"]) for r in got.collect())
    assert rows == [("2", "/abs/2.wav", "music"), ("ja_1", f"{tmp_path}/a/1.wav", "speech"),
                    ("ja_1", f"{tmp_path}/a/1.wav", "speech")]
    versions = RD.manifest_versions(spark, str(tmp_path / "list.json")).head()["version"]
    import hashlib
    assert versions == hashlib.sha256((tmp_path / "list.json").read_bytes()).hexdigest()[:12]


def test_corpus_keeps_first_speaker(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('7\tx.wav\tsaid "so\n7\ty.wav\tother\n9\tz.wav\tnine\n', "utf-8")
    got = {r["id"]: (r["file"], r["text"]) for r in RD.read_corpus(
        spark, str(tmp_path / "c.tsv"), ["id", "file", "text"]).collect()}
    assert got == {"7": ("x.wav", 'said "so'), "9": ("z.wav", "nine")}


def test_media_scan_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ok.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    (tmp_path / "in" / "fake.MP3").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    (tmp_path / "in" / "film.mp4").write_bytes(b"\0\0\0\x18ftypisom")
    (tmp_path / "in" / "note.txt").write_bytes(b"hello")
    items = RD.scan_media(spark, str(tmp_path), "ja", "en")
    assert sorted(r["id"] for r in items.collect()) == ["fake", "film", "ok"]
    got = {r["path"].rsplit("/", 1)[1]: (r["container"], r["error"])
           for r in RD.audit_media(spark, str(tmp_path)).collect()}
    assert got["ok.wav"] == ("wav", None) and got["film.mp4"] == ("isobmff", None)
    assert got["fake.MP3"] == ("wav", "content_mismatch")
    assert got["note.txt"][1] == "unsupported_type"
    (tmp_path / "in" / "none.wav").write_bytes(b"")
    empty = RD.audit_media(spark, f"file://{tmp_path}").where("path LIKE '%none.wav'").head()
    assert (empty["length"], empty["container"], empty["error"]) == (0, None, "content_mismatch")
    small = {r["path"].rsplit("/", 1)[1]: r["error"]
             for r in RD.audit_media(spark, str(tmp_path), 10).collect()}
    assert small["ok.wav"] == "too_large"


def test_reports_are_read_and_bad_files_skipped(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    report = {"title": "t", "environment": {"timestamp": "now", "cpu": "c", "python": "3"},
              "results": [{"component": "asr", "model": "m", "wer": 0.25, "per_item": [1],
                           "hypothesis": "x", "latency": {"p50": 1.5}}]}
    (tmp_path / "r1" / "benchmark.json").write_text(json.dumps(report), "utf-8")
    (tmp_path / "comparison.json").write_text("{not json", "utf-8")
    (tmp_path / "other.json").write_text(json.dumps(report), "utf-8")
    rows = RD.read_reports(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["result"]["model"] == "m"
    assert set(rows[0]["result"]) == {"component", "model", "wer", "latency"}
    assert rows[0]["environment"] == {"cpu": "c"} and rows[0]["timestamp"] == "now"


LINES = ("k string, seq int, start_s double, end_s double, translated_text string,"
         " source_text string, timestamps_available boolean")


def test_subtitles(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 2.1, 4.8, "Hello there.", "こんにちは", True),
                                ("m", 2, 5.1, 7.6, "How are you?", "元気", True),
                                ("m", 3, None, None, "untimed", "x", False)], LINES)
    srt = W.documents(W.subtitle_cues(df, ["k"], ["seq"], None), ["k"], "srt").head()["document"]
    assert srt == ("1\n00:00:02,100 --> 00:00:04,800\nHello there.\n\n"
                   "2\n00:00:05,100 --> 00:00:07,600\nHow are you?\n")
    vtt = W.documents(W.subtitle_cues(df, ["k"], ["seq"], None, dual=True), ["k"], "vtt")
    assert vtt.head()["document"].startswith(
        "WEBVTT\n\n00:00:02.100 --> 00:00:04.800\nHello there.\nこんにちは\n")
    W.write_documents(vtt, str(tmp_path / "out"), "k")
    written = list((tmp_path / "out" / "k=m").glob("*.txt"))
    assert written[0].read_text("utf-8") == vtt.head()["document"]


def test_overlapping_cue_is_trimmed(spark):
    df = spark.createDataFrame([("m", 1, 0.0, 5.0, "a", "", True), ("m", 2, 3.0, 6.0, "b", "", True)],
                               LINES)
    cues = W.subtitle_cues(df, ["k"], ["seq"], None).orderBy("cue").collect()
    assert round(cues[0]["end_s"], 3) == 2.99


def test_reports_are_written(spark, tmp_path):
    a = spark.range(1).select(F.lit("asr").alias("component"), F.lit("m1").alias("model"),
                              F.lit(0.1234).alias("wer"), F.struct(F.lit(123.456).alias("p50"),
                              F.lit(None).cast("double").alias("p95")).alias("latency"),
                              F.array(F.lit(1)).alias("per_item"))
    b = spark.range(1).select(F.lit("engine").alias("component"), F.lit("e1").alias("engine"))
    both = W.union_rows(a, b)
    W.write_reports(both, str(tmp_path / "rep"))
    rows = [r for f in (tmp_path / "rep" / "csv").glob("*.csv")
            for r in csv.DictReader(f.open(encoding="utf-8"))]
    assert set(rows[0]) == {"component", "engine", "latency.p50", "latency.p95", "model", "wer"}
    text = W.markdown_table(both, "asr", ["model"]).head()["markdown"]
    assert text.endswith("| m1 | - | 0.123 | - | - | 123.5 | - | - | - | - |")


def test_events_round_trip_as_a_stream(spark, tmp_path):
    e = spark.createDataFrame([("s", 2, "METRIC", 1.5, '{"a":1,"b":"x"}'), ("s", 1, "ERROR", 1.0, None)],
                              "session_id string, sequence_id long, event_type string, t double, payload string"
                              ).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    W.write_events(e, str(tmp_path / "log"))
    stream = RD.stream_events(spark, str(tmp_path / "log"))
    q = stream.writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r["sequence_id"]: (r["event_type"], r["payload"]) for r in spark.table("log").collect()}
    assert rows == {2: ("METRIC", '{"a":1,"b":"x"}'), 1: ("ERROR", "{}")}


def test_job_records(spark, tmp_path):
    j = spark.createDataFrame([("j1", "completed", '{"filename":"f.wav","api_key":"secret"}')],
                              "job_id string, status string, payload string")
    W.write_jobs(j, str(tmp_path / "jobs"))
    record = spark.read.json(str(tmp_path / "jobs" / "status=completed")).head()["record"]
    assert json.loads(record)["input"] == {"filename": "f.wav"}


def test_a_media_tree_is_shared_out_and_written_once(spark, tmp_path, monkeypatch):
    """A wide and deep tree: every file once, whether a task lists one folder or all below."""
    from talkmill.sources import media as M

    rows = [(f"a{i % 7}/b{i % 5}/c{i % 3}/f{i}.wav", bytes([i % 256]) * (i % 40)) for i in range(300)]
    files = spark.createDataFrame(rows, "path string, content binary")
    M.write_media(files, str(tmp_path / "m"))
    M.write_media(files.limit(50), f"file://{tmp_path}/m")
    for most in (1, 4, 50, 100_000):
        monkeypatch.setattr(M, "FOLDERS", most)
        reader = M.MediaFolder({"path": str(tmp_path / "m")}).reader(None)
        found = [e.path for part in reader.partitions() for e in reader._files(part.path, part.whole)]
        assert sorted(found) == sorted(f"{tmp_path}/m/{p}" for p, _ in rows)
    got = {r["path"]: (r["length"], bytes(r["head"])) for r in M.media_files(
        spark, str(tmp_path / "m")).collect()}
    assert got == {f"{tmp_path}/m/{p}": (len(c), c[:12]) for p, c in rows}
    assert M.media_files(spark, str(tmp_path / "m"), 0).where("head IS NOT NULL").count() == 0


def test_event_log_survives_a_crash_between_write_and_commit(spark, tmp_path):
    import pytest

    from talkmill.streaming import jobs as SJ

    good = ['{"event":"ASR_FINAL","session_id":"s","sequence_id":%d,"timestamp":1.5,"n":%d}' % (i, i)
            for i in range(40)]
    bad = ['{"event":"ASR', "", "[1, 2]", "plain text"]
    for i in range(4):
        spark.createDataFrame([(v,) for v in good[10 * i:10 * i + 10] + bad[i:i + 1]], "value string"
                              ).coalesce(1).write.mode("append").text(str(tmp_path / "lines"))
    events = RD.stream_events(spark, str(tmp_path / "lines"), files_per_trigger=1)

    def crash(number):
        if number == 2:
            raise RuntimeError("died before the commit")

    with pytest.raises(Exception, match="died before the commit"):
        SJ.append_log(events, str(tmp_path / "log"), str(tmp_path / "progress"), crash)
    SJ.append_log(events, str(tmp_path / "log"), str(tmp_path / "progress"))
    rows = SJ.read_log(spark, str(tmp_path / "log"), events.schema).collect()
    assert sorted(r["sequence_id"] for r in rows if r["unreadable"] is None) == list(range(40))
    assert sorted(r["unreadable"] for r in rows if r["unreadable"] is not None) == sorted(bad)
    assert {r["batch"] for r in rows} == {0, 1, 2, 3}
