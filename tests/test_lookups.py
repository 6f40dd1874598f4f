"""Lookups keep one row per line, and media are judged by size before they are read."""

from talkmill.operators import joins as J
from talkmill.sources import readers as R


def test_a_repeated_key_does_not_multiply_lines(spark):
    requests = spark.createDataFrame([(1, "de", None)],
                                     "id long, target_language string, explicit string")
    overrides = spark.createDataFrame([("de", "a"), ("de", "b")],
                                      "language string, provider string")
    assert [r["provider"] for r in J.route_provider(requests, overrides, "x").collect()] == ["b"]
    voices = spark.createDataFrame([(1, "v"), (1, "w")], "speaker int, voice string")
    lines = spark.createDataFrame([(1,), (2,)], "speaker int")
    assert sorted(r["voice"] for r in J.voice_for(lines, voices, "z").collect()) == ["w", "z"]


def test_the_last_row_of_a_key_wins_by_order(spark):
    rows = spark.createDataFrame([("k", 1, "z"), ("k", 2, "a")], "k string, at int, v string")
    assert [tuple(r) for r in J.one_per_key(rows, ["k"], ["v"], "at").collect()] == [("k", "a")]


def test_files_over_the_limit_are_refused_unread(spark, tmp_path):
    (tmp_path / "small.wav").write_bytes(b"RIFF\0\0\0\0WAVE" + b"\0" * 20)
    for name in ("large.wav", "large.txt"):
        with open(tmp_path / name, "wb") as out:
            out.truncate(3 << 30)
    got = {r["path"].rsplit("/", 1)[1]: (r["container"], r["error"])
           for r in R.audit_media(spark, str(tmp_path)).collect()}
    assert got == {"small.wav": ("wav", None), "large.wav": (None, "too_large"),
                   "large.txt": (None, "unsupported_type")}


def test_media_scan_keeps_the_first_files_in_path_order(spark, tmp_path):
    for name in ("c.wav", "a.wav", "b.mp3", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = R.scan_media(spark, str(tmp_path), "en", "de", limit=2)
    assert sorted(r["id"] for r in found.collect()) == ["a", "b"]
