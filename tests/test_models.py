"""The recogniser as a table function, and sketches against exact percentiles."""

import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import models as M
from talkmill.operators import sketches as SK


def echo():
    return lambda payload, prompt: [
        {"text": word, "start": i * 0.5, "end": i * 0.5 + 0.5, "confidence": float(len(prompt))}
        for i, word in enumerate(payload.split())]


CHUNKS = "session_id string, seq long, payload string, start_s double"


def test_a_session_is_decoded_in_order(spark):
    rows = [("a", 3, "five", 30.0), ("a", 1, "one two", 10.0), ("b", 1, None, 0.0), ("b", 2, "", 1.0),
            ("a", 2, "three four", 20.0), ("b", 9, "last", 2.0)]
    spark.createDataFrame(rows, CHUNKS).repartition(4).createOrReplaceTempView("chunks")
    M.register_transcriber(spark, "hear", echo, prompt_chars=12)
    got = spark.sql("SELECT * FROM hear(payload => 'payload', start => 'start_s', chunks => "
                    "TABLE(chunks) PARTITION BY session_id ORDER BY seq)")
    assert got.columns == ["session_id", "seq", "part", "place", "text", "start_s", "end_s",
                           "language", "confidence"]
    rows = [(r["session_id"], r["seq"], r["part"], r["place"], r["text"], r["start_s"], r["confidence"])
            for r in got.orderBy("session_id", "place").collect()]
    assert rows == [("a", 1, 0, 1, "one", 10.0, 0.0), ("a", 1, 1, 2, "two", 10.5, 0.0),
                    ("a", 2, 0, 3, "three", 20.0, 8.0), ("a", 2, 1, 4, "four", 20.5, 8.0),
                    ("a", 3, 0, 5, "five", 30.0, 12.0), ("b", 9, 0, 1, "last", 2.0, 0.0)]


def test_the_table_function_names_what_is_missing(spark):
    spark.createDataFrame([], CHUNKS).createOrReplaceTempView("none")
    M.register_transcriber(spark, "hear_none", echo)
    call = ("SELECT * FROM hear_none(payload => '{}', start => 'start_s', chunks => TABLE(none) "
            "PARTITION BY session_id ORDER BY seq)")
    assert spark.sql(call.format("payload")).count() == 0
    with pytest.raises(Exception, match="no column sound"):
        spark.sql(call.format("sound")).count()


@pytest.mark.parametrize("shape", ["uniform", "skewed", "few values"])
def test_merged_sketches_stay_within_the_rank_error(spark, shape):
    """Hours of very different sizes, merged; count, mean and extremes are exact."""
    rng = random.Random(shape)
    draw = {"uniform": rng.random, "skewed": lambda: rng.paretovariate(1.1),
            "few values": lambda: float(rng.randint(1, 4))}[shape]
    sizes = [40_000, 10, 3000, 1, 15_000, 500]
    rows = [("s", h * 3600 + rng.randint(0, 3599), draw()) for h, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows + [("s", 5, None), ("s", 5, float("nan"))],
                               "stage string, at long, seconds double").withColumn(
        "ts", F.timestamp_seconds("at"))
    hours = SK.hourly_sketches(df, ["stage"], "ts", "seconds")
    assert sorted(r["n"] for r in hours.collect()) == sorted(sizes)
    twice = SK.merged_sketches(hours.withColumn("half", F.hour("hour") % 2), ["stage", "half"])
    for parts in (hours, twice):
        out = SK.sketched_summary(parts, ["stage"], p50=0.5, p95=0.95, p99=0.99).head()
        values = sorted(v for _, _, v in rows)
        n = len(values)
        assert (out["n"], out["low"], out["high"]) == (n, values[0], values[-1])
        assert out["mean"] == pytest.approx(sum(values) / n)
        for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            below = sum(v < out[name] for v in values) / n
            upto = sum(v <= out[name] for v in values) / n
            assert below <= share + SK.RANK_ERROR and upto >= share - SK.RANK_ERROR
