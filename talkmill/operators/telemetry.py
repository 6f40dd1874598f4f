"""Operational statistics over samples, events and job records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.operators import quantiles as Q
from talkmill.operators.ordered import Scan, scan, top_k

RESERVOIR = 512


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 (linear), mean and count per group, rounded to three digits."""
    known = samples.where(F.col(value).isNotNull())
    marks = Q.linear(known, by, value, p50=0.5, p95=0.95)
    plain = known.groupBy(*by).agg(F.avg(value).alias("_m"), F.count(value).alias("n"))
    return marks.join(plain, by).select(
        *by, F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"),
        F.round("_m", 3).alias("mean"), "n")


def stage_histograms(samples: DataFrame, by: list[str], order: list[str],
                     value: str = "seconds", capacity: int = RESERVOIR) -> DataFrame:
    """Count and mean over all samples; percentiles and last over the newest ones.

    Negative samples are ignored.  The reservoir is a bounded top-k per group.
    """
    kept = samples.where(F.col(value) >= 0)
    recent = top_k(kept, by, [F.col(o).desc() for o in order], capacity, rank="_age")
    marks = Q.nearest(recent, by, value, p50=50, p95=95, p99=99)
    last = recent.where(F.col("_age") == 1).select(*by, F.col(value).alias("last"))
    totals = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"))
    return totals.join(marks, by).join(last, by)


def counters(events: DataFrame, by: list[str], amount: Column) -> DataFrame:
    return events.groupBy(*by).agg(F.sum(amount).alias("total"))


def gauges(events: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value set."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("value"))


def counters_and_gauges(events: DataFrame, by: list[str], amount: Column, value: str,
                        order: list[str]) -> DataFrame:
    """Both in one pass: ``total`` and ``gauge``."""
    return events.groupBy(*by).agg(F.sum(amount).alias("total"),
                                   F.max_by(value, F.struct(*order)).alias("gauge"))


def session_summary(histograms: DataFrame, by: list[str], stage: str,
                    wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Selected percentiles side by side: output name -> (stage, percentile column)."""
    return histograms.groupBy(*by).agg(*[
        F.max(F.when(F.col(stage) == name, F.col(mark))).alias(out)
        for out, (name, mark) in wanted.items()])


def gate_statistics(decisions: DataFrame, by: list[str], total: Column | None = None
                    ) -> DataFrame:
    """Kept and rejected regions, speech and non-speech seconds, rejections by event.

    Events are counted first, so only one small row per event reaches a session.
    """
    length = F.col("end_s") - F.col("start_s")
    keep = F.col("should_transcribe")
    part = decisions.groupBy(*by, "event_type").agg(
        F.count_if(keep).alias("_kept"), F.count_if(~keep).alias("_no"),
        F.sum(F.when(keep, length).otherwise(0.0)).alias("_speech"),
        F.max("end_s").alias("_end"))
    whole = F.max("_end") if total is None else F.max(total)
    return part.groupBy(*by).agg(
        F.sum("_kept").alias("speech_regions"), F.sum("_no").alias("rejected_regions"),
        F.round(F.sum("_speech"), 2).alias("speech_seconds"),
        F.round(F.greatest(F.lit(0.0), whole - F.sum("_speech")), 2)
        .alias("non_speech_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("_no") > 0, F.struct("event_type", "_no"))))).alias("rejected_by_event"))


def reason_counts(rows: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Map of reason -> count per group; rows without a reason do not count."""
    part = rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(
        F.count(F.lit(1)).alias("_n"))
    return part.groupBy(*by).agg(
        F.sum("_n").alias("rejected"), F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(reason, "_n")))).alias("reasons"))


def synthesis_statistics(clips: DataFrame, by: list[str]) -> DataFrame:
    """Mismatch, drift and synthesis RTF, with counts per fit method.

    ``clips``: method, source_s, mismatch, drift, synth_s, duration.
    """
    timed = F.col("source_s") > 0
    part = clips.groupBy(*by, "method").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("synth_s").alias("_t"),
        F.sum("duration").alias("_d"), F.sum("drift").alias("_drift"),
        F.max("drift").alias("_top"), F.sum(F.when(timed, F.col("mismatch"))).alias("_mis"),
        F.count_if(timed).alias("_mn"), F.max(F.when(timed, F.col("mismatch"))).alias("_mm"))
    per = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 3)
    return part.groupBy(*by).agg(
        per("_t", "_d").alias("tts_rtf"),
        per("_mis", "_mn").alias("duration_mismatch_mean"),
        F.round(F.max("_mm"), 3).alias("duration_mismatch_max"),
        F.round(F.max("_top"), 3).alias("max_drift_seconds"),
        per("_drift", "_n").alias("mean_drift_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "_n"))))
        .alias("fit_methods"))


def job_histograms(jobs: DataFrame, stages: str = "stage_seconds", order: str = "finished_s"
                   ) -> DataFrame:
    """Histograms of the stage seconds of completed jobs, from a map column."""
    done = jobs.where(F.col("status") == "completed")
    rows = done.select("job_id", order, F.explode(stages).alias("stage", "seconds"))
    return stage_histograms(rows.where("seconds is not null"), ["stage"], [order, "job_id"])


def job_progress(updates: DataFrame, spans: DataFrame, key: list[str], order: list[str],
                 blk: str | None) -> DataFrame:
    """Overall progress (never falling) and remaining seconds after each update.

    ``updates``: stage, fraction, elapsed_s.  Spans are eight fixed rows.
    """
    placed = updates.join(F.broadcast(spans), "stage", "left")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    reached = F.col("span_from") + (F.col("span_to") - F.col("span_from")) * share
    run = scan(placed, key, order, blk, progress=Scan(
        "max", reached, inclusive=True, default=F.lit(0.0)))
    live = ~F.col("stage").isin(dims.TERMINAL) & (F.col("progress") >= 5)
    return run.withColumn("eta_seconds", F.when(live, F.floor(
        F.col("elapsed_s") * (100 - F.col("progress")) / F.col("progress")).cast("bigint"))
        ).drop("span_from", "span_to")


def fleet_medians(histograms: DataFrame, stage: str = "stage") -> DataFrame:
    """Upper median over sessions of each stage's p50."""
    return Q.upper_median(histograms, [stage], "p50", name="p50")


def queue_statistics(events: DataFrame, key: list[str], order: list[str], blk: str | None,
                     maxsize: int, ratio: float = 0.8) -> DataFrame:
    """Depth after every enqueue (+1), dequeue (-1) or drop (0), with overload marks."""
    move = F.when(F.col("action") == "enqueue", 1).when(
        F.col("action") == "dequeue", -1).otherwise(0).cast("bigint")
    run = scan(events, key, order, blk, depth=Scan("sum", move, inclusive=True))
    return run.withColumn("depth_ratio", F.col("depth") / maxsize).withColumn(
        "overloaded", F.col("depth_ratio") >= ratio)


def queue_totals(run: DataFrame, by: list[str]) -> DataFrame:
    return run.groupBy(*by).agg(
        F.count_if(F.col("action") == "enqueue").alias("enqueued"),
        F.count_if(F.col("action") == "drop").alias("dropped"),
        F.max("depth").alias("max_depth"), F.count_if("overloaded").alias("overloads"))


def resource_summary(samples: DataFrame, key: list[str], order: list[str], blk: str | None
                     ) -> DataFrame:
    """Peak and mean memory in GiB and mean CPU without the first (priming) sample."""
    gib = float(1 << 30)
    numbered = scan(samples, key, order, blk, _n=Scan("number"))
    mean = lambda c: F.avg(c) / gib
    return numbered.groupBy(*key).agg(
        F.round(F.max("rss") / gib, 3).alias("peak_rss_gb"),
        F.round(mean("rss"), 3).alias("mean_rss_gb"),
        F.round(F.coalesce(F.avg(F.when(F.col("_n") > 1, F.col("cpu"))), F.lit(0.0)), 1)
        .alias("mean_cpu_percent"),
        F.round(F.max("vram") / gib, 3).alias("peak_vram_gb"),
        F.round(mean("vram"), 3).alias("mean_vram_gb"))


def live_latency(events: DataFrame, by: list[str]) -> DataFrame:
    """First text, first audio and counts of a live run from its event log.

    ``events``: event_type, at_s (since the stream began), code (warnings).
    """
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("at_s")))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    return events.groupBy(*by).agg(
        F.round(first("ASR_PARTIAL"), 3).alias("first_subtitle"),
        F.round(first("TRANSLATION_FINAL"), 3).alias("ttft"),
        F.round(first("TTS_AUDIO"), 3).alias("ttfa"),
        count("ASR_PARTIAL").alias("partials"), count("TRANSLATION_FINAL").alias("segments"),
        F.array_sort(F.collect_set(F.when(
            F.col("event_type") == "WARNING", F.coalesce("code", F.lit(""))))).alias("warnings"))


# -- audio -------------------------------------------------------------------------------

def audio_statistics(samples: DataFrame, by: list[str], position: str, value: str,
                     rate: int = 16000, silence: float = 0.01) -> DataFrame:
    """Duration, peak, RMS, clipped and silent share of signals given one sample per row.

    Frames of 20 ms are aggregated first (a partial last frame does not count for
    silence), so a long signal is reduced where it lies.
    """
    size = max(1, int(rate * 0.02))
    x = F.col(value)
    frames = samples.groupBy(*by, F.floor(F.col(position) / size).alias("_f")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(x * x).alias("_e"), F.max(F.abs(x)).alias("_p"),
        F.count_if(F.abs(x) >= 0.999).alias("_c"))
    full = F.col("_n") == size
    quiet = F.sqrt(F.col("_e") / F.col("_n")) < silence
    # A signal shorter than one frame counts as one frame.
    return frames.groupBy(*by).agg(
        F.round(F.sum("_n") / rate, 3).alias("duration"),
        F.round(F.max("_p"), 4).alias("peak"),
        F.round(F.sqrt(F.sum("_e") / F.sum("_n")), 4).alias("rms"),
        F.round(F.sum("_c") / F.sum("_n"), 6).alias("clipping"),
        F.round(F.coalesce(F.count_if(full & quiet) / F.nullif(F.count_if(full), F.lit(0)),
                           F.max(quiet.cast("int"))), 4).alias("silence_ratio"))


def dbfs(samples: Column) -> Column:
    """RMS level in dB below full scale; null for silence."""
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    level = F.sqrt(power / F.size(samples)) / 32768.0
    return F.when((F.size(samples) > 0) & (level > 0), 20 * F.log10(level))
