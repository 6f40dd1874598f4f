"""The whole batch run over many recordings: verdicts, validation, units, translation,
subtitles.  Every stage is keyed by session, so one layout of the data serves them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.operators import intervals as I
from talkmill.operators import ordered as O
from talkmill.operators import rules as R
from talkmill.operators import segmentation as S
from talkmill.session import cut
from talkmill.sources import writers as W


def accepted_segments(segments: DataFrame, verdicts: DataFrame, key: list[str],
                      expected: Column, words: str | None = None) -> DataFrame:
    """Segments that pass validation against decoder signals and the gate."""
    judged = I.span_verdicts(segments, verdicts, key, "seq", "w")
    checked = R.validate_transcripts(judged, expected=expected, words=words,
                                     decision="decision")
    return checked.where("valid")


def units_of(accepted: DataFrame, profiles: DataFrame, key: list[str], blk: str | None,
             latency: str = "accurate") -> DataFrame:
    feed = S.with_profiles(accepted.select(
        *key, "seq", *([blk] if blk else []), "text", "start_s", "end_s", "speaker",
        "language"), profiles, latency)
    return O.run_fold(feed, S.UNITS, key, ["seq"], blk)


def lines_of(units: DataFrame, target: str, translator: Callable[[DataFrame], DataFrame],
             policy: str = "balanced") -> DataFrame:
    """Translated lines that pass validation; same-language lines go through unchanged.

    ``translator`` sees all lines at once, so that they are made and read in one pass; what
    it says about lines already in the target language is not used.
    """
    named = units.select(
        "session_id", F.col("unit").alias("seq"), F.col("text").alias("source_text"),
        F.col("language").alias("source_language"), F.lit(target).alias("target_language"),
        F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "speaker",
        F.lit(True).alias("timestamps_available"))
    same = F.col("source_language") == F.col("target_language")
    told = translator(named).withColumn("translated_text", F.when(
        same, F.col("source_text")).otherwise(F.col("translated_text")))
    told = told.select(*named.columns, "translated_text")
    return R.validate_translations(told, policy).where("valid")


def subtitles_of(lines: DataFrame, key: list[str], style: str = "srt", hot: bool = False
                 ) -> DataFrame:
    """Subtitle documents.  ``hot`` says that some session was split before: the lines are
    then fixed on disk and split again for the cue windows."""
    blk = None
    if hot:
        lines, blk = O.split_hot(cut(lines), key, "start_s")
    return W.documents(W.subtitle_cues(lines, key, ["seq"], blk), key, style)
