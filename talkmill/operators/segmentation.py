"""Translation units, snapshot bookkeeping and other rules that depend on their own output.

Each rule is one pure step shared by batch groups and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators.ordered import Fold, Scan, scan


def with_profiles(df: DataFrame, profiles: DataFrame, latency: str = "balanced",
                  language: Column | None = None) -> DataFrame:
    """Add the segmentation profile of each row's language (a few dimension rows)."""
    tag = X.primary_language(F.col("language") if language is None else language)
    p = profiles.where(F.col("latency") == latency).drop("latency")
    names = [c for c in p.columns if c != "language"]
    fallback = p.where(F.col("language") == "default").agg(
        F.first(F.struct(*names)).alias("d")).scalar()
    known = p.select(F.col("language").alias("_tag"), F.struct(*names).alias("_own"))
    out = (df.withColumn("_l", F.coalesce(tag, F.lit("")))
           .join(F.broadcast(known), F.col("_l") == F.col("_tag"), "left")
           .withColumn("_p", F.coalesce("_own", fallback)))
    return out.select(*df.columns, *[F.col("_p")[n].alias(n) for n in names])


def with_every_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per row and latency preference, with that profile of the row's language."""
    tags = profiles.select(F.col("language").alias("_tag")).distinct()
    tagged = df.withColumn("_l", F.coalesce(X.primary_language(F.col("language")), F.lit("")))
    known = tagged.join(F.broadcast(tags), F.col("_l") == F.col("_tag"), "left").withColumn(
        "_l", F.coalesce("_tag", F.lit("default"))).drop("_tag")
    named = profiles.withColumnRenamed("language", "_tag")
    return known.join(F.broadcast(named), F.col("_l") == F.col("_tag")).drop("_l", "_tag")


def pauses(segments: DataFrame, key: list[str], order: list[str], blk: str | None) -> DataFrame:
    """Silence before every non-blank segment, from the end of the one before it."""
    spoken = segments.where(~X.blank("text"))
    prior = scan(spoken, key, order, blk, _end=Scan("lag", F.col("end_s")))
    return prior.withColumn("pause_s", F.greatest(F.lit(0.0), F.coalesce(
        F.col("start_s") - F.col("_end"), F.lit(0.0)))).drop("_end")


# -- script-aware joining, for the folds -----------------------------------------------------

_DENSE_BLOCKS = ((0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF))


def dense(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in _DENSE_BLOCKS)


def glue(before: str, after: str) -> str:
    """``after`` with the separator its scripts need."""
    after = after.strip()
    if not after or not before:
        return after
    attached = (before[-1] in " \n" or after[0] in dims.CLOSING_MARKS
                or dense(before[-1]) or dense(after[0]))
    return after if attached else " " + after


# -- translation units -------------------------------------------------------------------------

UNIT_SCHEMA = T.StructType([
    T.StructField("unit", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
    T.StructField("speaker", T.IntegerType()), T.StructField("language", T.StringType()),
    T.StructField("reason", T.StringType())])


def _closing(text: str, seconds: float, row: dict) -> str | None:
    """Why a pending unit closes now, or None."""
    if len(text) >= row["max_chars"]:
        return "max_chars"
    if seconds >= row["max_seconds"]:
        return "max_seconds"
    if len(text) < row["minimum_stable_chars"]:
        return None
    if row["punctuation_flush"] and text[-1] in dims.TERMINATORS:
        return "punctuation"
    if row["sentence_final_bias"]:
        return "sentence_final" if text.endswith(tuple(row["endings"])) else None
    if text[-1] in dims.SOFT_BREAKS and len(text) >= row["max_chars"] // 2:
        return "soft_break"
    return None


def _unit_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    s = dict(state)
    out: list[dict] = []

    def close(reason: str) -> None:
        s["units"] += 1
        out.append({"unit": s["units"], "text": s["text"].strip(), "start_s": s["start"],
                    "end_s": s["end"], "speaker": s["speaker"], "language": s["language"],
                    "reason": reason})
        s["text"] = ""

    def enough() -> bool:
        return len(s["text"].strip()) >= row["minimum_stable_chars"]

    silence = row.get("silence_s")
    if silence is not None:
        if s["text"] and silence * 1000 >= row["pause_threshold_ms"] and enough():
            close("silence")
        return s, out
    text = (row["text"] or "").strip()
    if not text:
        return s, out
    pause = 0.0 if s["last"] is None else max(0.0, row["start_s"] - s["last"])
    s["last"] = row["end_s"]
    if s["text"] and pause * 1000 >= row["pause_threshold_ms"] and enough():
        close("pause")
    speaker = None if row["speaker"] is None else int(row["speaker"])
    if s["text"] and speaker is not None and s["speaker"] is not None \
            and speaker != s["speaker"]:
        close("speaker_change")
    if s["text"]:
        s["text"] += glue(s["text"], text)
        s["end"] = row["end_s"]
    else:
        s.update(text=text, start=row["start_s"], end=row["end_s"], speaker=speaker,
                 language=row["language"])
    reason = _closing(s["text"].strip(), max(0.0, s["end"] - s["start"]), row)
    if reason:
        close(reason)
    return s, out


def _unit_finish(state: dict) -> list[dict]:
    if not state["text"].strip():
        return []
    return [{"unit": state["units"] + 1, "text": state["text"].strip(),
             "start_s": state["start"], "end_s": state["end"], "speaker": state["speaker"],
             "language": state["language"], "reason": "end_of_file"}]


def _unit_quiet(state: dict) -> tuple[dict, list[dict]]:
    """A pause closes the pending unit; the session goes on."""
    rows = [{**r, "reason": "silence"} for r in _unit_finish(state)]
    return {**state, "units": state["units"] + len(rows), "text": ""}, rows


UNITS = Fold(lambda: {"units": 0, "text": "", "start": 0.0, "end": 0.0, "speaker": None,
                      "language": None, "last": None}, _unit_step, UNIT_SCHEMA, _unit_finish,
             counters=("units",), quiet=_unit_quiet)


# -- language hysteresis -----------------------------------------------------------------------

LANGUAGE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("stable", T.StringType()),
    T.StructField("switched", T.BooleanType())])


def language_fold(evidence: int = 3, min_confidence: float = 0.5, min_seconds: float = 2.0
                  ) -> Fold:
    """The first detection counts at once; a switch needs a streak of confident ones."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        s = dict(state)
        # Only "long enough" matters, so more is not remembered.
        s["seconds"] = min(min_seconds, s["seconds"] + max(0.0, row.get("seconds") or 0.0))
        seen, sure = row["detected"], row["probability"]
        switched = False
        if seen and seen != "auto" and (sure is None or sure >= min_confidence):
            if seen == s["current"]:
                s["candidate"], s["streak"] = None, 0
            else:
                s["streak"] = s["streak"] + 1 if seen == s["candidate"] else 1
                s["candidate"] = seen
                if s["current"] is None or (
                        s["streak"] >= evidence and s["seconds"] >= min_seconds):
                    s.update(current=seen, candidate=None, streak=0)
                    switched = True
        return s, [{"seq": row["seq"], "stable": s["current"], "switched": switched}]

    return Fold(lambda: {"current": None, "candidate": None, "streak": 0, "seconds": 0.0},
                step, LANGUAGE_SCHEMA)


# -- recogniser snapshots -----------------------------------------------------------------------

STABLE_SCHEMA = T.StructType([
    T.StructField("snap", T.LongType()), T.StructField("stable_seq", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("start_s", T.DoubleType()),
    T.StructField("end_s", T.DoubleType()), T.StructField("revision", T.LongType()),
    T.StructField("rolled_back", T.BooleanType())])


def _snapshot_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One cumulative snapshot (``lines``: all committed spans so far) -> its new spans."""
    s, out = dict(state), []
    lines = [ln for ln in row["lines"] if ln is not None]
    retracted = bool(lines) and max(ln["end_s"] for ln in lines) + 1e-6 < s["end"]
    fresh = []
    for ln in lines:
        if (ln["text"] or "").strip() and ln["end_s"] > s["end"] + 1e-6:
            s["seq"] += 1
            s["end"] = max(s["end"], ln["end_s"])
            fresh.append((s["seq"], ln))
    if fresh:
        s["revision"] += 1
    for seq, ln in fresh:
        out.append({"snap": row["snap"], "stable_seq": seq, "text": ln["text"],
                    "start_s": ln["start_s"], "end_s": ln["end_s"],
                    "revision": s["revision"], "rolled_back": retracted})
    if retracted and not fresh:
        out.append({"snap": row["snap"], "stable_seq": None, "text": None, "start_s": None,
                    "end_s": None, "revision": s["revision"], "rolled_back": True})
    return s, out


SNAPSHOTS = Fold(lambda: {"seq": 0, "end": 0.0, "revision": 0}, _snapshot_step, STABLE_SCHEMA,
                 counters=("seq", "revision"))

DELTA_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("delta", T.StringType()),
    T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
    T.StructField("revisions", T.LongType())])


def _shared_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y),
                min(len(a), len(b)))


def _delta_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One growing line -> only its new suffix; speaker -2 marks silence."""
    text = (row["text"] or "").strip()
    if row.get("speaker") == -2 or not text:
        return state, []
    line = str(row["line_idx"])
    seen = state["lines"].get(line, "")
    if text == seen:
        return state, []
    s = {**state, "lines": {**state["lines"], line: text}}
    known = len(seen)
    if seen and not text.startswith(seen):
        known = _shared_prefix(seen, text)
        s["revisions"] += 1
    delta = text[known:].strip()
    if not delta:
        return s, []
    start = s["end"] if seen else row["start_s"]
    end = row["end_s"] if row["end_s"] > s["end"] + 1e-6 else s["end"] + 1e-3
    s["end"] = end
    return s, [{"seq": row["seq"], "delta": delta, "start_s": start, "end_s": end,
                "revisions": s["revisions"]}]


DELTAS = Fold(lambda: {"lines": {}, "end": 0.0, "revisions": 0}, _delta_step, DELTA_SCHEMA,
              counters=("revisions",))


# -- gate windows filled by duration -----------------------------------------------------------

FILLED_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("win", T.LongType()),
    T.StructField("members", T.LongType()), T.StructField("win_start_s", T.DoubleType())])


def filled_windows(seconds: float = 0.6) -> Fold:
    """Chunks fill a window until its duration is reached; the rest closes at the end."""
    def close(s: dict) -> list[dict]:
        s["win"] += 1
        rows = [{"seq": q, "win": s["win"], "members": len(s["held"]),
                 "win_start_s": s["start"]} for q in s["held"]]
        s.update(held=[], filled=0.0, start=None)
        return rows

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        s = {**state, "held": [*state["held"], row["seq"]],
             "filled": state["filled"] + row["duration"]}
        if s["start"] is None:
            s["start"] = row["start_s"]
        return (s, close(s)) if s["filled"] >= seconds - 1e-9 else (s, [])

    def finish(state: dict) -> list[dict]:
        return close(dict(state)) if state["held"] else []

    def quiet(state: dict) -> tuple[dict, list[dict]]:
        s = dict(state)
        return (s, close(s)) if s["held"] else (s, [])

    return Fold(lambda: {"win": 0, "held": [], "filled": 0.0, "start": None}, step,
                FILLED_SCHEMA, finish, counters=("win",), quiet=quiet)


def gated(members: DataFrame, key: list[str], score: Column, least: float, payload: str
          ) -> DataFrame:
    """Hand each filled window's verdict to its chunks: ``passed`` where the window's
    ``score`` (an aggregate of its chunks) reaches ``least``; other payloads are blanked.

    A window is bounded by its duration, so a window function over (key, window) spreads a
    session over its windows.
    """
    whole = Window.partitionBy(*key, "win")
    judged = members.withColumn("passed", F.coalesce(score.over(whole) >= least, F.lit(False)))
    return judged.withColumn(payload, F.when(F.col("passed"), F.col(payload)).otherwise(
        F.lit("").cast(members.schema[payload].dataType)))


# -- reorder buffer ----------------------------------------------------------------------------

RELEASE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("outcome", T.StringType()),
    T.StructField("at", T.DoubleType()), T.StructField("place", T.LongType())])


def _released(s: dict, seq: int, outcome: str, at: float) -> dict:
    s["place"] += 1
    return {"seq": seq, "outcome": outcome, "at": at, "place": s["place"]}


def _drain(s: dict, at: float) -> list[dict]:
    """All that is next in turn, in place."""
    rows = []
    while True:
        key = str(s["next"])
        if key in s["held"]:
            del s["held"][key]
            rows.append(_released(s, s["next"], "released", at))
        elif s["next"] in s["failed"]:
            s["failed"].remove(s["next"])
            rows.append(_released(s, s["next"], "skipped", at))
        else:
            return rows
        s["next"] += 1


def _own(state: dict) -> dict:
    return {**state, "held": dict(state["held"]), "failed": list(state["failed"])}


def gap_due(state: dict, gap_timeout: float) -> float | None:
    """When the gap that holds up a reorder buffer is given up, or None."""
    return min(state["held"].values()) + gap_timeout if state["held"] else None


def give_up(state: dict, at: float) -> tuple[dict, list[dict]]:
    """Give up the next sequence number, which is missing."""
    s = _own(state)
    if s["next"] not in s["failed"]:
        s["failed"].append(s["next"])
    return s, _drain(s, at)


def reorder(first: int = 1, gap_timeout: float = 5.0, capacity: int = 64) -> Fold:
    """Release clips strictly by sequence number.

    Rows are arrivals in time order: ``seq``, ``at`` seconds, ``failed``.  Outcomes:
    released, skipped (failed, timed out or evicted) and late.  A hole is given up
    ``gap_timeout`` after the first of the clips behind it came, at that very time; at the
    end all holes are, as time would have it.
    """
    def settle(s: dict, until: float) -> tuple[dict, list[dict]]:
        rows: list[dict] = []
        while s["held"] and until - min(s["held"].values()) >= gap_timeout:
            s, found = give_up(s, gap_due(s, gap_timeout))
            rows += found
        return s, rows

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        seq, at = int(row["seq"]), row["at"]
        s, rows = settle(_own(state), at)
        if seq < s["next"]:
            return s, rows + [_released(s, seq, "late", at)]
        if row.get("failed"):
            if seq not in s["failed"]:
                s["failed"].append(seq)
            return s, rows + _drain(s, at)
        if len(s["held"]) >= capacity:
            furthest = max(int(k) for k in s["held"])
            if furthest > seq:
                del s["held"][str(furthest)]
                rows.append(_released(s, furthest, "skipped", at))
            else:
                return s, rows + [_released(s, seq, "skipped", at)]
        s["held"][str(seq)] = at
        return s, rows + _drain(s, at)

    def quiet(state: dict) -> tuple[dict, list[dict]]:
        """A stream that pauses longer than the timeout gives up all holes and goes on."""
        return settle(_own(state), float("inf"))

    return Fold(lambda: {"next": first, "held": {}, "failed": [], "place": 0}, step,
                RELEASE_SCHEMA, lambda state: quiet(state)[1], counters=("place",), quiet=quiet)


# -- warning throttle --------------------------------------------------------------------------

WARNING_SCHEMA = T.StructType([
    T.StructField("at", T.DoubleType()), T.StructField("repeats", T.LongType())])


def throttle(seconds: float = 10.0) -> Fold:
    """At most one warning per key and period, with the count of all so far."""
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        count = state["count"] + 1
        last = state["last"]
        if last is not None and row["at"] - last < seconds:
            return {**state, "count": count}, []
        return {"count": count, "last": row["at"]}, [{"at": row["at"], "repeats": count}]

    return Fold(lambda: {"count": 0, "last": None}, step, WARNING_SCHEMA, counters=("count",))


# -- cumulative text ---------------------------------------------------------------------------

def joined_text(segments: DataFrame, key: list[str], order: list[str], blk: str | None
                ) -> DataFrame:
    """Each session's text with script-aware separators.

    The separator of a piece depends only on its neighbour, so pieces carry it with them.
    A session's text is one value, so its pieces meet in the end; they first join per
    block, which keeps a long session from being built in one step.
    """
    spoken = segments.where(~X.blank("text"))
    prior = scan(spoken, key, order, blk, _before=Scan("lag", X.strip("text")))
    piece = F.concat(X.separator("_before", "text"), X.strip("text"))
    pieces = prior.withColumn("_piece", piece)

    def together(df: DataFrame, by: list[str], place: list[str], text: str) -> DataFrame:
        return df.groupBy(*by).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(*place, text))), lambda x: x[text]), "")
            .alias("text"))

    if blk is None:
        return together(pieces, key, order, "_piece")
    return together(together(pieces, [*key, blk], order, "_piece"), key, [blk], "text")
