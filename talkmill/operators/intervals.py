"""Interval operators on a session clock: overlap joins, merging, packing, regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.operators.ordered import Fold, Scan, islands, run_fold, scan


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, key: Sequence[str],
                 left_span: tuple[Column, Column], right_span: tuple[str, str],
                 width: float = 10.0, how: str = "left") -> DataFrame:
    """Join rows whose intervals overlap, through an equi-join on (key, time bucket).

    Both sides are copied into the buckets they touch; a pair is kept only in the first
    bucket they share, so it appears once.  A long session spreads over its buckets.
    With ``how='left'`` a left row may also appear unmatched next to its matches; callers
    aggregate, and nulls do not count.  Adds ``overlap`` in seconds.
    """
    key = list(key)
    lo, hi = left_span
    rs, re = right_span
    l = left.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "_bucket", F.explode(_buckets(F.col("_lo"), F.col("_hi"), width)))
    r = right.withColumn("_rbucket", F.explode(_buckets(F.col(rs), F.col(re), width)))
    for k in key:
        r = r.withColumnRenamed(k, f"_r_{k}")
    shared = F.greatest(F.floor(F.col("_lo") / width), F.floor(F.col(rs) / width))
    overlap = F.least(F.col("_hi"), F.col(re)) - F.greatest(F.col("_lo"), F.col(rs))
    on = ((F.col("_bucket") == F.col("_rbucket")) & (F.col("_bucket") == shared)
          & (overlap > 0))
    for k in key:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return (l.join(r, on, how)
            .withColumn("overlap", F.when(F.col("_rbucket").isNotNull(), overlap))
            .drop("_bucket", "_rbucket", "_lo", "_hi", *[f"_r_{k}" for k in key]))


def span_verdicts(segments: DataFrame, windows: DataFrame, key: Sequence[str], seq: str,
                  window_order: str, slack: float = 0.5, min_fraction: float = 0.25,
                  within: Callable[[Column], Column] | None = None,
                  carry: Sequence[str] = ()) -> DataFrame:
    """The gate's verdict for every segment, as struct column ``decision``.

    Approving windows must cover ``min_fraction`` of the segment; then the strongest of
    them is the verdict, else the rejecting window with the largest overlap, else whatever
    overlaps, else null.  The first window wins a tie.  ``within`` tells by a window's order
    whether the segment may use it; the segment's times and the columns named in ``carry``
    are fields of ``_row``.
    """
    key = list(key)
    w = windows.select(*key, F.struct(
        "should_transcribe", "event_type", "confidence", "reason", "start_s", "end_s")
        .alias("_w"), F.col(window_order).alias("_wi"),
        F.col("start_s").alias("_ws"), F.col("end_s").alias("_we"))
    # Only the spans go through the join; the rest of a segment's row stays where it is.
    pairs = overlap_join(
        segments.select(*key, F.col(seq).alias("_seq"), "start_s", "end_s",
                        F.struct("start_s", "end_s", *carry).alias("_row")),
        w, key, (F.col("start_s") - slack, F.col("end_s") + slack), ("_ws", "_we"), how="inner")
    ok = F.col("_w.should_transcribe")
    if within is not None:
        pairs = pairs.where(within(F.col("_wi")))
    found = pairs.groupBy(*key, "_seq").agg(
        F.any_value(F.col("_row.end_s") - F.col("_row.start_s")).alias("_span"),
        F.sum(F.when(ok, F.col("overlap"))).alias("_approved"),
        F.max_by("_w", F.when(ok, F.struct("_w.confidence", -F.col("_wi")))).alias("_yes"),
        F.max_by("_w", F.when(~ok, F.struct("overlap", -F.col("_wi")))).alias("_no"))
    enough = F.coalesce(F.col("_approved") / F.greatest(F.lit(1e-6), F.col("_span"))
                        >= min_fraction, F.lit(False))
    decided = found.select(*key, F.col("_seq").alias(seq), F.when(enough, F.col("_yes")).otherwise(
        F.coalesce("_no", "_yes")).alias("decision"))
    return segments.join(decided, [*key, seq], "left").select(
        *[segments[c] for c in segments.columns], "decision")


#: Windows the gate remembers at most, and how many of the oldest go when one more comes.
HISTORY = 256
HISTORY_DROPPED = 128


def verdict_of(windows: Sequence[tuple], start: float, end: float, slack: float = 0.5,
               min_fraction: float = 0.25) -> tuple | None:
    """The window whose verdict a span has, by the rule of :func:`span_verdicts`.

    Windows are tuples that begin with start, end, approved, category and confidence."""
    approved, yes, no = 0.0, None, None
    for at, w in enumerate(windows):
        overlap = min(end + slack, w[1]) - max(start - slack, w[0])
        if overlap <= 0:
            continue
        if w[2]:
            approved += overlap
            if yes is None or w[4] > yes[4]:
                yes = w
        elif no is None or overlap > no[0]:
            no = (overlap, w)
    if yes is not None and approved / max(1e-6, end - start) >= min_fraction:
        return yes
    return no[1] if no is not None else yes


def remembered_verdicts(spans: DataFrame, windows: DataFrame, key: Sequence[str], span: str,
                        seen: str, number: str, most: int = HISTORY,
                        dropped: int = HISTORY_DROPPED) -> DataFrame:
    """Verdicts of spans by the windows the gate still remembers when a span is judged.

    ``windows`` are numbered from 1 per key in column ``number``; ``seen`` of a span is how
    many of them it has behind it.  The history grows to ``most`` windows; one more, and the
    ``dropped`` oldest go: its length is a sawtooth of the row number, so no state is needed.
    Adds ``held`` and the struct ``decision``.
    """
    n = F.col(seen)
    low = most + 1 - dropped
    held = F.when(n <= most, n).otherwise(low + (n - (most + 1)) % dropped)
    judged = spans.withColumn("held", held.cast("bigint"))
    w = windows.select(*key, number, "should_transcribe", "event_type", "confidence", "reason",
                       "start_s", "end_s")
    return span_verdicts(judged, w, key, span, number, carry=[seen, "held"],
                         within=lambda at: (at <= F.col("_row." + seen)) & (
                             at > F.col("_row." + seen) - F.col("_row.held")))


def overlaps_any(left: DataFrame, right: DataFrame, key: Sequence[str], ident: Sequence[str]
                 ) -> DataFrame:
    """Add ``hit``: whether any right interval of the key overlaps the left one."""
    names = [c for c in left.columns if c not in (*key, *ident)]
    r = right.select(*key, F.col("start_s").alias("_rs"), F.col("end_s").alias("_re"))
    pairs = overlap_join(left, r, key, (F.col("start_s"), F.col("end_s")), ("_rs", "_re"))
    return pairs.groupBy(*key, *ident).agg(
        *[F.any_value(c).alias(c) for c in names],
        (F.count("overlap") > 0).alias("hit"))


def merge_equal(windows: DataFrame, key: Sequence[str], order: Sequence[str], blk: str | None,
                max_gap: float = 0.05) -> DataFrame:
    """Merge neighbouring windows with the same verdict; confidence weighted by length."""
    kind = F.struct("should_transcribe", "event_type", "end_s")
    prior = scan(windows, key, order, blk, _p=Scan("lag", kind))
    p = F.col("_p")
    opens = p.isNull() | ~(
        (p["should_transcribe"] == F.col("should_transcribe"))
        & (p["event_type"] == F.col("event_type"))
        & (F.col("start_s") - p["end_s"] <= max_gap))
    runs = islands(prior, key, order, blk, opens)
    length = F.col("end_s") - F.col("start_s")
    first = F.struct(*order)
    return runs.groupBy(*key, "island").agg(
        F.min_by("should_transcribe", first).alias("should_transcribe"),
        F.min_by("event_type", first).alias("event_type"),
        F.min_by("reason", first).alias("reason"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        (F.sum(F.col("confidence") * length)
         / F.greatest(F.sum(length), F.lit(1e-6))).alias("confidence"))


def region_windows(regions: DataFrame, step: float = 2.0) -> DataFrame:
    """Cut regions into classifier windows; a tail below half a step joins the last one."""
    length = F.col("end_s") - F.col("start_s")
    count = F.greatest(F.lit(1), F.when(
        length - F.floor(length / step) * step < step / 2, F.floor(length / step))
        .otherwise(F.ceil(length / step))).cast("int")
    cut = regions.where(length > 1e-3).withColumn("_n", count)
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.col("start_s") + F.col("part") * step
    return cut.withColumns({
        "window_start": at,
        "window_end": F.when(F.col("part") == F.col("_n") - 1, F.col("end_s"))
        .otherwise(at + step)}).drop("_n")


# -- packing speech regions into chunks ---------------------------------------------------

CHUNK_SCHEMA = T.StructType([T.StructField("chunk", T.LongType()),
                             T.StructField("start_s", T.DoubleType()),
                             T.StructField("end_s", T.DoubleType())])


#: Seconds of a level frame.
FRAME = 0.1


def packing(max_seconds: float = 28.0, gap: float = 0.8, strict: bool = False,
            split: bool = True) -> Fold:
    """Greedy packing: join a region to the open chunk while both limits hold.

    A region longer than the limit is cut in the second half of every ``max_seconds``, in the
    middle of the quietest whole level frame there (the first of equals); in the middle of that
    half if it holds no frame, and at the limit if the region has none at all.  ``strict`` asks
    for a gap below the limit instead of up to it.

    Rows are regions (``start_s``, ``end_s``) and after each over-long one its level frames
    in time order, by the pack (arrays ``ts``, ``levels``) or alone (``t``, ``level``).  The state keeps only frames that may still be the
    quietest of a stretch: later ones that are louder drop out as they come.
    """
    def put(s: dict, a: float, b: float) -> list[dict]:
        """Join a piece to the open chunk, or give that out and open another."""
        near = s["open"] and (a - s["open"][1] < gap if strict else a - s["open"][1] <= gap)
        if near and b - s["open"][0] <= max_seconds:
            s["open"] = [s["open"][0], b]
            return []
        out = close(s)
        s["open"] = [a, b]
        return out

    def close(s: dict) -> list[dict]:
        if not s["open"]:
            return []
        s["n"] += 1
        return [{"chunk": s["n"], "start_s": s["open"][0], "end_s": s["open"][1]}]

    def cut_once(s: dict) -> list[dict]:
        a, b, framed = s["long"]
        low, high = a + max_seconds / 2, a + max_seconds
        if s["quiet"]:
            at = s["quiet"][0][0] + FRAME / 2
        else:
            at = (low + high) / 2 if framed else high
        out = close(s)
        s["open"], s["long"] = [a, at], [at, b, framed]
        low = at + max_seconds / 2
        s["quiet"] = [f for f in s["quiet"] if f[0] >= low - 1e-9]
        return out

    def settle(s: dict) -> list[dict]:
        """Cut what is left of an over-long region and join its end."""
        out: list[dict] = []
        if s["long"]:
            while s["long"][1] - s["long"][0] > max_seconds:
                out += cut_once(s)
            a, b, _ = s["long"]
            s.update(long=None, quiet=[])
            out += put(s, a, b)
        return out

    def hear(s: dict, t: float, level: float) -> list[dict]:
        out: list[dict] = []
        if not s["long"]:
            return out
        s["long"] = [*s["long"][:2], True]
        while s["long"][1] - s["long"][0] > max_seconds and \
                t + FRAME > s["long"][0] + max_seconds + 1e-9:
            out += cut_once(s)
        if t >= s["long"][0] + max_seconds / 2 - 1e-9:
            while s["quiet"] and s["quiet"][-1][1] > level:
                s["quiet"].pop()
            s["quiet"].append([t, level])
        return out

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        s = {**state, "quiet": list(state["quiet"])}
        if row.get("ts") is not None:
            return s, [c for t, level in zip(row["ts"], row["levels"], strict=True)
                       for c in hear(s, t, level)]
        if row.get("t") is not None:
            return s, hear(s, row["t"], row["level"])
        out = settle(s)
        a, b = row["start_s"], row["end_s"]
        if split and b - a > max_seconds:
            s["long"] = [a, b, False]
        else:
            out += put(s, a, b)
        return s, out

    def finish(state: dict) -> list[dict]:
        s = {**state, "quiet": list(state["quiet"])}
        return settle(s) + close(s)

    return Fold(lambda: {"n": 0, "open": None, "long": None, "quiet": []}, step, CHUNK_SCHEMA,
                finish, counters=("n",))


def pack_regions(regions: DataFrame, key: Sequence[str], order: Sequence[str],
                 blk: str | None, frames: DataFrame | None = None, **limits) -> DataFrame:
    """Chunks per session from its speech regions in order.

    ``frames`` (``t``, ``level`` every tenth of a second) say where over-long regions are
    quiet; only those inside such regions travel, some seconds of a region in a row.
    """
    fold = packing(**limits)
    place = [*key, *order, *([blk] if blk else [])]
    rows = regions.select(*place, "start_s", "end_s")
    if frames is not None:
        inside = _packs_inside(rows, frames, key, place, limits.get("max_seconds", 28.0))
        # Packs of a region and time may have come from several tasks.
        packs = inside.groupBy(*place, "_bucket").agg(F.array_sort(F.flatten(
            F.collect_list("_frames"))).alias("_f"))
        packs = packs.select(*place, F.col("_f")[0]["t"].alias("t"), F.col("_f.t").alias("ts"),
                             F.col("_f.level").alias("levels"))
        rows = rows.unionByName(packs, allowMissingColumns=True)
    else:
        rows = rows.withColumn("t", F.lit(None).cast("double"))
    return run_fold(rows, fold, key, [*order, "t"], blk)


def frames_inside(regions: DataFrame, frames: DataFrame, key: Sequence[str],
                  ident: Sequence[str], longer: float) -> DataFrame:
    """Level frames that overlap a region longer than ``longer`` seconds: ``ident`` of the
    region, ``t`` and ``level``."""
    return _packs_inside(regions, frames, key, ident, longer).select(
        *ident, F.inline("_frames"))


#: Seconds of a pack of level frames.
PACK = 10.0


def _packs_inside(regions: DataFrame, frames: DataFrame, key: Sequence[str],
                  ident: Sequence[str], longer: float) -> DataFrame:
    """The same, as ``ident``, ``_bucket`` and an array ``_frames`` of (``t``, ``level``).

    Frames are many and small, so those of a key and a pack's time that follow each other are
    shuffled as one row.  A frame is in one pack only, and a region in all packs it touches.
    """
    lo, hi = F.col("start_s"), F.col("end_s")
    long_ = regions.where(hi - lo > longer).select(
        *ident, lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(
            F.floor((lo - 2 * FRAME) / PACK), F.floor(hi / PACK))).alias("_bucket"))
    packs = _packed(frames.where(F.col("t").isNotNull()).select(*key, "t", "level"), key)
    pairs = long_.join(packs, [*key, "_bucket"])
    inside = F.filter(F.arrays_zip("t", "level"), lambda f: F.least(
        F.col("_hi"), f["t"] + FRAME) - F.greatest(F.col("_lo"), f["t"]) > 0)
    return pairs.select(*ident, "_bucket", inside.alias("_frames")).where(F.size("_frames") > 0)


def _packed(frames: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key``, ``_bucket`` and the arrays ``t`` and ``level`` of neighbouring frames."""
    key = list(key)
    kinds = frames.schema
    schema = T.StructType([*[kinds[k] for k in key], T.StructField("_bucket", T.LongType()),
                           *[T.StructField(c, T.ArrayType(kinds[c].dataType))
                             for c in ("t", "level")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bucket = np.floor(batch.column("t").to_numpy() / PACK).astype(np.int64)
            opens = np.ones(n, bool)
            opens[1:] = bucket[1:] != bucket[:-1]
            for k in key:
                values = batch.column(k)
                opens[1:] |= pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, n - 1)),
                                          True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(opens)
            ends = pa.array(np.append(first, n), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(pa.array(first)) for k in key], pa.array(bucket[first]),
                 *[pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("t", "level")]],
                schema.fieldNames())

    return frames.mapInArrow(run, schema)


# -- voiced regions from frame probabilities ---------------------------------------------

def voiced_regions(frames: DataFrame, key: Sequence[str], blk: str | None,
                   frame_ms: int = 32, threshold: float = 0.5, min_speech_ms: int = 250,
                   min_silence_ms: int = 500, pad_ms: int = 200, max_ms: int = 30_000
                   ) -> DataFrame:
    """Voiced regions with hysteresis from ``(key, frame, prob)``.

    Voiced frames closer than the minimum silence form a region; regions shorter than the
    minimum speech go; the rest are padded, at most to the middle of the gap, and cut to
    the maximum length.  ``confidence`` is the mean probability of the region's frames.
    """
    key = list(key)
    voiced = frames.where(F.col("prob") >= threshold)
    near = scan(voiced, key, ["frame"], blk, _p=Scan("lag", F.col("frame")))
    gap = (F.col("frame") - F.col("_p") - 1) * frame_ms
    runs = islands(near, key, ["frame"], blk, F.coalesce(gap >= min_silence_ms, F.lit(True)))
    spans = runs.groupBy(*key, "island").agg(
        (F.min("frame") * frame_ms).alias("from_ms"),
        ((F.max("frame") + 1) * frame_ms).alias("to_ms"),
        F.avg("prob").alias("confidence"),
        *([F.min(blk).alias(blk)] if blk else []))
    kept = spans.where(F.col("to_ms") - F.col("from_ms") >= min_speech_ms)
    around = scan(kept, key, ["from_ms"], blk, _before=Scan("lag", F.col("to_ms")),
                  _after=Scan("lead", F.col("from_ms")))
    half = lambda c: F.floor(c / 2)
    lo = F.col("from_ms") - F.least(F.lit(pad_ms), F.coalesce(
        half(F.col("from_ms") - F.col("_before")), F.col("from_ms")))
    hi = F.col("to_ms") + F.least(F.lit(pad_ms), F.coalesce(
        half(F.col("_after") - F.col("to_ms")), F.lit(pad_ms)))
    padded = around.withColumns({"lo_ms": lo.cast("bigint"), "hi_ms": hi.cast("bigint")})
    parts = padded.withColumn("_at", F.explode(F.sequence(
        F.col("lo_ms"), F.col("hi_ms") - 1, F.lit(max_ms).cast("bigint"))))
    return parts.select(*key, F.col("_at").alias("start_ms"),
                        F.least(F.col("_at") + max_ms, F.col("hi_ms")).alias("end_ms"),
                        "confidence")


# -- borrowing from neighbours --------------------------------------------------------------

def reference_spans(lines: DataFrame, key: Sequence[str], seq: str, minimum: float = 3.0,
                    maximum: float = 12.0, reach: float = 20.0) -> DataFrame:
    """Span of source audio for a speaker sample, at least ``minimum`` seconds if possible.

    A short line takes in lines of the same speaker that start within ``reach`` seconds of
    the span it has so far, in order, until it is long enough.  The span start only moves
    back and it may move at most ``minimum`` before the fold stops, so candidates lie within
    ``reach + minimum`` of the line: a bucketed range join, then a fold over few rows.
    """
    key = list(key)
    line = lines.select(*key, "speaker", F.col(seq).alias("_seq"), "start_s", "end_s")
    short = line.where(F.col("end_s") - F.col("start_s") < minimum)
    other = line.select(
        *[F.col(k).alias(k) for k in key], F.coalesce("speaker", F.lit(-1)).alias("_spk"),
        F.col("_seq").alias("_oseq"), F.col("start_s").alias("_os"), F.col("end_s").alias("_oe"))
    far = reach + minimum
    pairs = overlap_join(
        short.withColumn("_spk", F.coalesce("speaker", F.lit(-1))),
        other.withColumn("_oend", F.col("_os") + 1e-9), [*key, "_spk"],
        (F.col("start_s") - far, F.col("start_s") + far), ("_os", "_oend"), width=far)
    grown = pairs.groupBy(*key, "_seq").agg(
        F.any_value("start_s").alias("start_s"), F.any_value("end_s").alias("end_s"),
        F.array_sort(F.collect_list(F.when(F.col("_oseq").isNotNull(), F.struct(
            "_oseq", "_os", "_oe")))).alias("near"))
    first = F.struct(F.col("start_s").alias("a"), F.col("end_s").alias("b"))

    def take(s: Column, o: Column) -> Column:
        done = s["b"] - s["a"] >= minimum
        close = F.abs(o["_os"] - s["a"]) < reach
        return F.when(~done & close, F.struct(
            F.least(s["a"], o["_os"]).alias("a"), F.greatest(s["b"], o["_oe"]).alias("b"))
            ).otherwise(s)

    spans = grown.select(*key, "_seq", F.aggregate("near", first, take).alias("_s"))
    out = line.join(spans, [*key, "_seq"], "left")
    a = F.coalesce("_s.a", "start_s")
    return out.select(*key, F.col("_seq").alias(seq), a.alias("ref_start"), F.least(
        F.coalesce("_s.b", "end_s"), a + maximum).alias("ref_end"))


