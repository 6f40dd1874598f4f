"""Row-local rule cascades: the audio gate and the text validators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.functions import text as X


@dataclass(frozen=True)
class GateRules:
    dialogue_threshold: float = 0.35
    unknown_threshold: float = 0.35
    non_speech_threshold: float = 0.60
    transcribe_unknown: bool = True


def top_category(scores: Column, without: list[str]) -> Column:
    """Struct ``(v, i, k)`` of the highest-scored category; the first one wins a tie."""
    kept = F.filter(F.map_entries(scores), lambda e: ~e["key"].isin(without))
    return F.array_max(F.transform(kept, lambda e, i: F.struct(
        e["value"].alias("v"), (-i).alias("i"), e["key"].alias("k"))))


def gate_decision(vad_confidence: Column, vad_speech: Column, scores: Column,
                  rules: GateRules = GateRules()) -> Column:
    """Struct (should_transcribe, event_type, confidence, reason) for one window."""
    quiet = vad_speech == F.lit(False)
    unscored = scores.isNull() | (F.size(scores) == 0)
    dialogue = F.coalesce(F.try_element_at(scores, F.lit(dims.DIALOGUE)), F.lit(0.0))
    loud = top_category(scores, [dims.DIALOGUE])
    other = top_category(scores, [dims.DIALOGUE, dims.UNKNOWN])
    named = loud["v"] >= rules.non_speech_threshold

    def verdict(keep: Column, event: Column, confidence: Column, reason: str) -> Column:
        return F.struct(keep.alias("should_transcribe"), event.alias("event_type"),
                        confidence.cast("double").alias("confidence"),
                        F.lit(reason).alias("reason"))

    known = F.coalesce(vad_confidence, F.lit(0.0))
    return (
        F.when(quiet, verdict(
            F.lit(False), F.when(named, loud["k"]).otherwise(dims.SILENCE),
            F.when(named, loud["v"]).otherwise(1 - known), "vad:no_speech"))
        .when(unscored, verdict(
            F.lit(True), F.when(vad_speech, dims.DIALOGUE).otherwise(dims.UNKNOWN),
            known, "vad_only"))
        .when(dialogue >= rules.dialogue_threshold, verdict(
            F.lit(True), F.lit(dims.DIALOGUE), dialogue, "dialogue"))
        .when(other["v"] >= rules.non_speech_threshold, verdict(
            F.lit(False), other["k"], other["v"], "non_speech"))
        .otherwise(verdict(
            F.lit(rules.transcribe_unknown) | (dialogue >= rules.unknown_threshold),
            F.lit(dims.UNKNOWN),
            1 - F.greatest(dialogue, F.coalesce(other["v"], F.lit(0.0))), "uncertain")))


def rms(samples: Column) -> Column:
    """Whole-number RMS of integer samples; 0 for an empty frame."""
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.when(F.size(samples) > 0, F.floor(F.sqrt(power / F.size(samples)))).otherwise(
        F.lit(0)).cast("int")


def energy_speech(level: Column, threshold: int = 120) -> Column:
    """Struct (should_transcribe, event_type, confidence) from the frame level."""
    loud = level >= threshold
    return F.struct(loud.alias("should_transcribe"),
                    F.when(loud, dims.DIALOGUE).otherwise(dims.SILENCE).alias("event_type"),
                    F.least(F.lit(1.0), level / max(1, threshold * 4)).alias("confidence"))


def energy_event(level: Column, silence: int = 80, loud: int = 12000) -> Column:
    quiet, extreme = level < silence, level > loud
    return F.struct(
        (~quiet).alias("should_transcribe"),
        F.when(quiet, dims.SILENCE).when(extreme, dims.UNKNOWN).otherwise(dims.DIALOGUE)
        .alias("event_type"),
        F.when(quiet, 0.95).when(extreme, 0.45)
        .otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.5), level / max(1, loud))))
        .alias("confidence"))


def _label_spans() -> dict[str, list[tuple[int, int]]]:
    """First and last label of every range of a category; sound effects have the rest."""
    spans = {c: [(a, b) for name, a, b in dims.LABEL_RANGES if name == c]
             for c in dims.CATEGORIES}
    free, edge = [], 0
    for a, b in sorted((a, b) for _, a, b in dims.LABEL_RANGES):
        if a > edge:
            free.append((edge, a - 1))
        edge = b + 1
    spans[dims.SFX] = free + ([(edge, dims.LABEL_COUNT - 1)] if edge < dims.LABEL_COUNT else [])
    return spans


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _best_labels(probs: pa.Array) -> pa.Array:
    """Greatest probability of every category; a range without any counts 0."""
    sizes = pc.fill_null(pc.list_value_length(probs), 0).to_numpy().astype(np.int64)
    flat = probs.flatten()
    wide = max(dims.LABEL_COUNT, int(sizes.max(initial=0)))
    valid = None
    if (sizes == wide).all() and not flat.null_count:
        table = flat.to_numpy().reshape(-1, wide)
    else:
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        table, valid = np.full((len(sizes), wide), -np.inf), np.zeros((len(sizes), wide), bool)
        valid[row, at] = flat.is_valid().to_numpy(zero_copy_only=False)
        table[row, at] = flat.fill_null(-np.inf).to_numpy()
    best = np.zeros((len(sizes), len(dims.CATEGORIES)))
    for k, spans in enumerate(_label_spans().values()):
        for i, (a, b) in enumerate(spans):
            top = table[:, a:b + 1].max(axis=1)
            if valid is not None:
                top = np.where(valid[:, a:b + 1].any(axis=1), top, 0.0)
            best[:, k] = np.maximum(best[:, k], top) if i else top
    ends = np.arange(len(sizes) + 1, dtype=np.int32) * len(dims.CATEGORIES)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel()))


def label_rollup(windows: DataFrame, key: list[str], probs: str, level: str,
                 silence_level: float = 0.003) -> DataFrame:
    """Label probabilities (array by label index) -> one score per category.

    The ranges are fixed, so every category is the maximum of a few slices of a batch's
    probabilities; no explode, join or shuffle.
    """
    found = windows.select(*key, level, _best_labels(F.col(probs).cast("array<double>")).alias(
        "_best"))
    best = {name: F.col("_best")[k] for k, name in enumerate(_label_spans())}
    best[dims.SILENCE] = F.when(F.col(level) < silence_level, F.greatest(
        best[dims.SILENCE], F.lit(0.99))).otherwise(best[dims.SILENCE])
    best[dims.UNKNOWN] = F.lit(0.0)
    scores = F.create_map(*[x for name in dims.CATEGORIES for x in (
        F.lit(name), best[name].cast("double"))])
    return found.select(*key, scores.alias("scores"))


def decision_from_scores(scores: Column) -> Column:
    top = top_category(scores, [])
    weak = top["v"] < 0.10
    event = F.when(weak, dims.UNKNOWN).otherwise(top["k"])
    return F.struct(event.isin(dims.DIALOGUE, dims.UNKNOWN).alias("should_transcribe"),
                    event.alias("event_type"),
                    F.when(weak, 1 - top["v"]).otherwise(top["v"]).alias("confidence"))


# -- transcript validation -------------------------------------------------------------

@dataclass(frozen=True)
class TranscriptRules:
    min_duration: float = 0.08
    max_chars_per_second: float = 28.0
    no_speech_threshold: float = 0.85
    min_avg_logprob: float = -1.5
    max_compression_ratio: float = 2.6
    min_word_probability: float = 0.25
    reject_non_dialogue_confidence: float = 0.60
    language_mismatch_probability: float = 0.80


def mean_word_probability(words: Column) -> Column:
    """Mean of the known word probabilities; null when there is none."""
    known = F.array_compact(F.transform(words, lambda w: w["probability"]))
    return F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(
        F.size(known), F.lit(0))


def combined_confidence(*parts: Column) -> Column:
    """Mean of the parts that exist, within 0..1; 0.8 when none exists."""
    known = F.array_compact(F.array(*parts))
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    return F.when(F.size(known) == 0, 0.80).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def validate_transcripts(df: DataFrame, rules: TranscriptRules = TranscriptRules(),
                         expected: Column | None = None, words: str | None = None,
                         decision: str | None = None) -> DataFrame:
    """Add ``valid``, ``reason`` and ``result_confidence`` to segments.

    The first failing rule names the reason.  Cheap text rules come first; zlib runs only
    for rows they let through.  ``decision`` is the gate's verdict struct for the span;
    ``words`` the column of timed words.
    """
    has = set(df.columns)
    number = lambda n: F.col(n).cast("double") if n in has else F.lit(None).cast("double")
    text = X.strip("text")
    duration = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    core = X.letters_only(text)
    df = df.withColumns({
        "_core": core, "_dur": duration,
        "_rep": X.adjacent_repetition(text), "_loop": X.ngram_loop_score(text),
        "_phrase": X.phrase_loop_score(text)})
    early = (F.when(F.coalesce(F.col("_core"), F.lit("")) == "", "empty_transcript")
             .when(F.col("_dur") < rules.min_duration, "segment_too_short")
             .when(F.char_length("_core") / F.greatest(F.col("_dur"), F.lit(1e-6))
                   > rules.max_chars_per_second, "abnormal_text_density")
             .when((F.col("_rep") > 0.55) | (F.col("_loop") > 0.6) | (F.col("_phrase") > 0.5),
                   "repetition"))
    df = df.withColumn("_early", early).withColumns({
        "_ratio": X.compression_ratio(
            F.when(F.col("_early").isNull(), text), number("compression_ratio")),
        "_word": (mean_word_probability(F.col(words)) if words
                  else F.lit(None).cast("double"))})

    silent, logprob = number("no_speech_prob"), number("avg_logprob")
    ratio, word = F.col("_ratio"), F.col("_word")
    language = F.col("language") if "language" in has else F.lit(None).cast("string")
    language = F.coalesce(F.col("detected"), language) if "detected" in has else language
    sure = number("language_probability")
    expected = F.lit(None).cast("string") if expected is None else expected
    mismatch = ((expected != "auto") & (expected != "") & (language != "")
                & (language != expected)
                & (sure.isNull() | (sure >= rules.language_mismatch_probability)))
    if decision:
        event, certain = F.col(decision)["event_type"], F.col(decision)["confidence"]
    else:
        event, certain = F.lit(None).cast("string"), F.lit(None).cast("double")
    foreign = F.coalesce(~event.isin(dims.DIALOGUE, dims.UNKNOWN), F.lit(False))
    confidence = combined_confidence(
        number("confidence"), F.exp(logprob), 1 - silent, word)
    stock = F.lower("_core").isin(dims.STOCK_PHRASES)
    spoken = F.coalesce((event == dims.DIALOGUE) & (certain >= 0.5), F.lit(False))
    weak = (~spoken | F.coalesce(silent > 0.3, F.lit(False))
            | F.coalesce(logprob < -0.6, F.lit(False)) | (confidence < 0.6))
    reason = (F.when(F.col("_early").isNotNull(), F.col("_early"))
              .when(silent >= rules.no_speech_threshold, "high_no_speech_probability")
              .when((silent > 0.6) & (logprob < -1.0), "no_speech_and_low_logprob")
              .when(logprob < rules.min_avg_logprob, "low_average_log_probability")
              .when(ratio > rules.max_compression_ratio, "high_compression_ratio")
              .when(word < rules.min_word_probability, "low_word_probability")
              .when(mismatch, "language_mismatch")
              .when(foreign & (certain >= rules.reject_non_dialogue_confidence),
                    "non_dialogue_audio_event")
              .when(text.rlike(dims.CREDIT_PATTERN), "subtitle_credit")
              .when(stock & weak, "known_hallucination_phrase"))
    # Confidence of a rejection by reason.
    scale = {"empty_transcript": 0.0, "segment_too_short": 0.25, "abnormal_text_density": 0.35,
             "repetition": 0.30, "high_no_speech_probability": 0.20,
             "no_speech_and_low_logprob": 0.20, "low_average_log_probability": 0.35,
             "high_compression_ratio": 0.35, "low_word_probability": 0.35,
             "language_mismatch": 0.30, "non_dialogue_audio_event": 0.25,
             "subtitle_credit": 0.10, "known_hallucination_phrase": 0.30}
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    df = df.withColumn("reason", reason)
    return df.withColumns({
        "valid": F.col("reason").isNull(),
        "result_confidence": F.coalesce(F.try_element_at(table, F.col("reason")), confidence),
    }).drop("_core", "_dur", "_rep", "_loop", "_phrase", "_early", "_ratio", "_word")


def validate_translations(df: DataFrame, policy: str = "balanced") -> DataFrame:
    """Add ``issues``, ``valid`` and ``validation_confidence`` to translations."""
    text = X.strip(F.coalesce("translated_text", F.lit("")))
    source = X.strip(F.coalesce("source_text", F.lit("")))
    target = F.col("target_language")
    df = df.withColumns({"_t": text, "_s": source}).withColumn(
        "_rep", X.adjacent_repetition(F.col("_t")))
    issues = F.array_compact(F.array(
        F.when(F.col("_t") == "", "empty_output"),
        F.when(F.col("_rep") > 0.50, "repetition"),
        F.when((target != "") & ~X.looks_like(F.col("_t"), target),
               "possible_language_mismatch"),
        F.when((F.col("_s") != "") & (F.col("_t") == F.col("_s"))
               & ~F.col("source_language").eqNullSafe(target), "unchanged_source_text")))
    df = df.withColumn("issues", issues)
    blocking = {"fast": ["empty_output"], "balanced": ["empty_output", "repetition"]}
    if policy == "strict":
        blocked = F.size("issues") > 0
    else:
        names = blocking.get(policy, blocking["balanced"])
        blocked = F.arrays_overlap("issues", F.array(*map(F.lit, names)))
    return df.withColumns({
        "valid": ~blocked,
        "validation_confidence": 1.0 - F.least(F.lit(0.8), F.lit(0.2) * F.size("issues")),
    }).drop("_t", "_s", "_rep")


# -- media and retention ---------------------------------------------------------------

def media_error(duration: Column, audio_streams: Column, limit: float = 4 * 3600) -> Column:
    """Error code of a file that cannot be processed, or null."""
    return (F.when(F.coalesce(audio_streams, F.lit(0)) == 0, "NO_AUDIO_STREAM")
            .when(F.coalesce(duration, F.lit(0.0)) <= 0, "CORRUPTED_MEDIA")
            .when(duration > limit, "MEDIA_TOO_LONG"))


def expired_jobs(jobs: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Finished jobs whose results are older than the retention time."""
    return jobs.where(F.col("status").isin(dims.TERMINAL)
                      & (F.coalesce("finished_s", F.lit(0.0)) < now - seconds))


def expired_sessions(sessions: DataFrame, now: Column, seconds: float) -> DataFrame:
    return sessions.where(F.col("started_s") < now - seconds)


def timed_lines(lines: DataFrame, minimum: float = 1.0, text: str = "translated_text"
                ) -> DataFrame:
    """Lines that may become subtitles: timed and not blank; a zero length gets a floor."""
    kept = lines.where(F.coalesce("timestamps_available", F.lit(True))
                       & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
                       & ~X.blank(text))
    return kept.withColumn("end_s", F.when(
        F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(
        F.col("start_s") + minimum))
