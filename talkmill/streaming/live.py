"""Live operators with state of their own shape: lists, maps and event-time timers.

Each gives the rows of its batch twin, whatever the triggers: what time alone decides (a gap
given up, a pause, an end) is decided by event times, either when the next row shows it or,
if none comes, by a timer once the watermark has passed.  Every operator ends a key that has
been silent for ``end_ms`` and frees its state.  Rows without a value in the order column
only move the watermark.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from talkmill.operators import intervals as I
from talkmill.operators import quantiles as Q
from talkmill.operators import segmentation as S
from talkmill.streaming.processors import (
    CLOCK, PACKED, expired, move_timer, ordered_rows, with_clock)

DAY_MS = 24 * 3600 * 1000


class Keyed(StatefulProcessor):
    """What all live operators share: sorted rows, event times, timers, output rows."""

    def __init__(self, key: Sequence[str], order: Sequence[str], event_time: str,
                 schema: T.StructType, end_ms: int) -> None:
        self.key, self.order, self.event_time = list(key), list(order), event_time
        self.names, self.end_ms = [f.name for f in schema.fields], end_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.result = Row(*self.key, *self.names)

    def frames(self, rows) -> Iterator[dict]:
        """Rows of a micro-batch in order, with their event time as ``_ms``."""
        yield from ordered_rows(rows, self.order)

    def wake_at(self, before: int | None, *times: float | None) -> int | None:
        """Set the key's one timer, which was at ``before``, to the earliest of the times.

        Operators keep the time in their state, which is cheaper than a list of timers."""
        due = [math.ceil(t) for t in times if t is not None]
        return move_timer(self.handle, before, min(due) if due else None)

    def end_later(self, before: int | None, latest: int) -> None:
        """For keys whose timer is that of their end alone: it is set with the first row."""
        if before is None:
            self.handle.registerTimer(latest + self.end_ms)

    def is_over(self, latest: int, timer_values, info) -> bool:
        """Whether the key has ended; else its timer is set again."""
        end = latest + self.end_ms
        if end > expired(timer_values, info):
            self.handle.registerTimer(end)
            return False
        return True

    def emit(self, key, rows: list[dict]) -> Iterator[Row]:
        for row in rows:
            yield self.result(*key, *[row.get(n) for n in self.names])

    def close(self) -> None:
        pass


def _run(stream: DataFrame, processor: Keyed, schema: T.StructType, delay: str) -> DataFrame:
    return _driven(with_clock(stream, processor.key, processor.event_time, delay), processor, schema)


def _driven(ready: DataFrame, processor: Keyed, schema: T.StructType) -> DataFrame:
    kinds = {f.name: f for f in ready.schema.fields}
    out = T.StructType([kinds[k] for k in processor.key] + list(schema.fields))
    return ready.groupBy(*processor.key).transformWithState(
        statefulProcessor=processor, outputStructType=out, outputMode="Append",
        timeMode="EventTime")


# -- reorder buffer ----------------------------------------------------------------------------

class ReorderBuffer(Keyed):
    """Clips that wait, by sequence number; a gap is given up when its timer expires."""

    def __init__(self, key, order, event_time, end_ms, gap_timeout: float, capacity: int) -> None:
        super().__init__(key, order, event_time, S.RELEASE_SCHEMA, end_ms)
        self.gap_timeout = gap_timeout
        self.fold = S.reorder(gap_timeout=gap_timeout, capacity=capacity)

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "seq bigint", "at double, failed boolean")
        self.place = handle.getValueState("place", "next bigint, place bigint, latest bigint, "
                                         "origin double, wake bigint")

    def _load(self) -> tuple[dict, int | None, float]:
        """The buffer, the latest event time, and that of second 0 of the clips' clock."""
        state, latest, origin, self.wake = self.fold.initial(), None, 0.0, None
        place = self.place.get()
        if place is not None:
            state["next"], state["place"], latest, origin, self.wake = place
        for (seq,), (at, failed) in self.waiting.iterator():
            if failed:
                state["failed"].append(seq)
            else:
                state["held"][str(seq)] = at
        self.stored = {seq: (at, False) for seq, at in
                       ((int(k), v) for k, v in state["held"].items())}
        self.stored |= {seq: (None, True) for seq in state["failed"]}
        return state, latest, origin

    def _store(self, state: dict, latest: int, origin: float) -> None:
        """Write only what changed."""
        now = {int(k): (at, False) for k, at in state["held"].items()}
        now |= {seq: (None, True) for seq in state["failed"]}
        for seq in self.stored.keys() - now.keys():
            self.waiting.removeKey((seq,))
        for seq, value in now.items():
            if self.stored.get(seq) != value:
                self.waiting.updateValue((seq,), value)
        due = S.gap_due(state, self.gap_timeout)
        wake = self.wake_at(self.wake, latest + self.end_ms,
                            None if due is None else origin + due * 1000)
        self.place.update((state["next"], state["place"], latest, origin, wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, latest, origin = self._load()
        out: list[dict] = []
        for row in self.frames(rows):
            state, found = self.fold.step(state, row)
            out += found
            if latest is None:
                origin = row["_ms"] - row["at"] * 1000
            latest = row["_ms"] if latest is None else max(latest, row["_ms"])
        if latest is not None:
            self._store(state, latest, origin)
        yield from self.emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, latest, origin = self._load()
        now, self.wake = expired(timerValues, expiredTimerInfo), None
        out: list[dict] = []
        while (due := S.gap_due(state, self.gap_timeout)) is not None \
                and origin + due * 1000 <= now:
            state, found = S.give_up(state, due)
            out += found
        if now >= latest + self.end_ms:
            self.waiting.clear()
            self.place.clear()
        else:
            self._store(state, latest, origin)
        yield from self.emit(key, out)


def reordered(clips: DataFrame, key: Sequence[str], event_time: str, delay: str = "10 seconds",
              gap_timeout: float = 5.0, capacity: int = 64, end_ms: int = DAY_MS) -> DataFrame:
    """Release a stream of clips (``seq``, ``at`` seconds, ``failed``) strictly in order.

    The rows are those of :func:`~talkmill.operators.segmentation.reorder`.  ``event_time``
    runs with ``at``.  A clip that waits behind a gap leaves ``gap_timeout`` seconds after the
    first of those waiting came, even if the session says nothing more.
    """
    buffer = ReorderBuffer(key, ["at", "seq"], event_time, end_ms, gap_timeout, capacity)
    return _run(clips, buffer, S.RELEASE_SCHEMA, delay)


# -- gate --------------------------------------------------------------------------------------

GATE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("win", T.LongType()),
    T.StructField("passed", T.BooleanType()), T.StructField("payload", T.StringType())])


class WindowGate(Keyed):
    """The chunks of the window that is filling, released together with its verdict."""

    def __init__(self, key, order, event_time, end_ms, seconds: float, least: float,
                 quiet_ms: int) -> None:
        super().__init__(key, order, event_time, GATE_SCHEMA, end_ms)
        self.seconds, self.least, self.quiet_ms = seconds, least, quiet_ms

    def init(self, handle) -> None:
        super().init(handle)
        # The open window is a list beside the rest, so a trigger reads and writes one value.
        self.mark = handle.getValueState("mark", T.StructType([
            T.StructField("win", T.LongType()), T.StructField("latest", T.LongType()),
            T.StructField("wake", T.LongType()), T.StructField("open", T.StringType())]))

    def _judge(self, win: int, chunks: list[tuple]) -> list[dict]:
        scores = [c[2] for c in chunks if c[2] is not None]
        passed = bool(scores) and max(scores) >= self.least
        return [{"seq": c[0], "win": win, "passed": passed, "payload": c[3] if passed else ""}
                for c in chunks]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        win, latest, wake, open_ = self.mark.get() or (0, None, None, "[]")
        held = [tuple(c) for c in json.loads(open_)]
        filled = sum(c[1] for c in held)
        out: list[dict] = []
        for row in self.frames(rows):
            if held and row["_ms"] - latest >= self.quiet_ms:
                win, filled = win + 1, 0.0
                out += self._judge(win, held)
                held = []
            latest = row["_ms"] if latest is None else max(latest, row["_ms"])
            held.append((row["seq"], row["duration"], row["score"], row["payload"]))
            filled += row["duration"]
            if filled >= self.seconds - 1e-9:
                win, filled = win + 1, 0.0
                out += self._judge(win, held)
                held = []
        if latest is not None:
            self._store(win, latest, held, wake)
        yield from self.emit(key, out)

    def _store(self, win: int, latest: int, held: list[tuple], wake: int | None) -> None:
        wake = self.wake_at(wake, latest + self.end_ms, latest + self.quiet_ms if held else None)
        self.mark.update((win, latest, wake, json.dumps(held, ensure_ascii=False)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        win, latest, _, open_ = self.mark.get()
        held = [tuple(c) for c in json.loads(open_)]
        now, out = expired(timerValues, expiredTimerInfo), []
        if held and now >= min(latest + self.quiet_ms, latest + self.end_ms):
            win, out, held = win + 1, self._judge(win + 1, held), []
        if now >= latest + self.end_ms:
            self.mark.clear()
        else:
            self._store(win, latest, held, None)
        yield from self.emit(key, out)


def gated(chunks: DataFrame, key: Sequence[str], order: Sequence[str], event_time: str,
          least: float, seconds: float = 0.6, delay: str = "10 seconds",
          quiet_ms: int = 60_000, end_ms: int = DAY_MS) -> DataFrame:
    """Gate a stream of chunks (``seq``, ``duration``, ``score``, ``payload``) by windows that
    fill up to ``seconds``: one verdict per window, for all its chunks, whose payload is
    blanked unless the best score reaches ``least``.

    A window is held until it is full; what is left when the session pauses for ``quiet_ms``
    is judged as it is.
    """
    return _run(chunks, WindowGate(key, order, event_time, end_ms, seconds, least, quiet_ms),
                GATE_SCHEMA, delay)


# -- growing lines -----------------------------------------------------------------------------

class GrowingLines(Keyed):
    """What was given out of each open line, one map entry a line."""

    def __init__(self, key, order, event_time, end_ms, keep: int) -> None:
        super().__init__(key, order, event_time, S.DELTA_SCHEMA, end_ms)
        self.keep = keep

    def init(self, handle) -> None:
        super().init(handle)
        self.lines = handle.getMapState("lines", "line bigint", "text string")
        self.mark = handle.getValueState("mark", "end double, revisions bigint, closed bigint, "
                                         "latest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end, revisions, closed, latest = self.mark.get() or (0.0, 0, None, None)
        first = latest
        seen = {line: text for (line,), (text,) in self.lines.iterator()}
        before = dict(seen)
        out: list[dict] = []
        for row in self.frames(rows):
            latest = row["_ms"] if latest is None else max(latest, row["_ms"])
            line = row["line_idx"]
            if closed is not None and line <= closed:
                continue
            state = {"lines": {str(line): seen[line]} if line in seen else {}, "end": end,
                     "revisions": revisions}
            state, found = S.DELTAS.step(state, row)
            out += found
            end, revisions = state["end"], state["revisions"]
            if str(line) in state["lines"]:
                seen[line] = state["lines"][str(line)]
            while len(seen) > self.keep:
                closed = min(seen)
                del seen[closed]
        for line in before.keys() - seen.keys():
            self.lines.removeKey((line,))
        for line, text in seen.items():
            if before.get(line) != text:
                self.lines.updateValue((line,), (text,))
        if latest is not None:
            self.mark.update((end, revisions, closed, latest))
            self.end_later(first, latest)
        yield from self.emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.is_over(self.mark.get()[3], timerValues, expiredTimerInfo):
            self.lines.clear()
            self.mark.clear()
        yield from ()


def line_deltas(lines: DataFrame, key: Sequence[str], order: Sequence[str], event_time: str,
                keep: int = 16, delay: str = "10 seconds", end_ms: int = DAY_MS) -> DataFrame:
    """New suffixes of a stream of growing lines (``seq``, ``line_idx``, ``text``,
    ``start_s``, ``end_s``, ``speaker``).

    The ``keep`` highest lines of a session are open; a lower one is closed for good: it
    leaves the state, and rows that still name it are given no second time.
    """
    return _run(lines, GrowingLines(key, order, event_time, end_ms, keep), S.DELTA_SCHEMA, delay)


# -- decision history --------------------------------------------------------------------------

VERDICT_SCHEMA = T.StructType([
    T.StructField("span", T.LongType()), T.StructField("held", T.LongType()),
    T.StructField("should_transcribe", T.BooleanType()), T.StructField("event_type", T.StringType()),
    T.StructField("confidence", T.DoubleType())])


class DecisionHistory(Keyed):
    """The gate's latest windows as a list, whose ``dropped`` oldest go when there are
    more than ``most``."""

    def __init__(self, key, order, event_time, end_ms, most: int, dropped: int) -> None:
        super().__init__(key, order, event_time, VERDICT_SCHEMA, end_ms)
        self.most, self.dropped = most, dropped

    def init(self, handle) -> None:
        super().init(handle)
        self.windows = handle.getListState(
            "windows", "start_s double, end_s double, should_transcribe boolean, "
            "event_type string, confidence double")
        self.latest = handle.getValueState("latest", "latest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (latest,) = self.latest.get() or (None,)
        before = latest
        held = [tuple(w) for w in self.windows.get()] if latest is not None else []
        fresh: list[tuple] = []
        trimmed = False
        out: list[dict] = []
        for row in self.frames(rows):
            latest = row["_ms"] if latest is None else max(latest, row["_ms"])
            if row["span"] is None:
                window = (row["start_s"], row["end_s"], row["should_transcribe"],
                          row["event_type"], row["confidence"])
                held.append(window)
                fresh.append(window)
                if len(held) > self.most:
                    held = held[self.dropped:]
                    trimmed = True
                continue
            found = I.verdict_of(held, row["start_s"], row["end_s"])
            out.append({"span": row["span"], "held": len(held),
                        "should_transcribe": found and found[2], "event_type": found and found[3],
                        "confidence": found and found[4]})
        if trimmed:
            self.windows.put(held)
        elif fresh:
            self.windows.appendList(fresh)
        if latest is not None:
            self.latest.update((latest,))
            self.end_later(before, latest)
        yield from self.emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.is_over(self.latest.get()[0], timerValues, expiredTimerInfo):
            self.windows.clear()
            self.latest.clear()
        yield from ()


def remembered_verdicts(feed: DataFrame, key: Sequence[str], order: Sequence[str],
                        event_time: str, most: int = I.HISTORY,
                        dropped: int = I.HISTORY_DROPPED,
                        delay: str = "10 seconds", end_ms: int = DAY_MS) -> DataFrame:
    """Verdicts of spans by the windows the gate still remembers.

    ``feed`` holds windows (``span`` null; ``start_s``, ``end_s``, ``should_transcribe``,
    ``event_type``, ``confidence``) and spans to judge (``span``, ``start_s``, ``end_s``) in
    the order in which a session sees them.  Twin of
    :func:`~talkmill.operators.intervals.remembered_verdicts`.
    """
    return _run(feed, DecisionHistory(key, order, event_time, end_ms, most, dropped),
                VERDICT_SCHEMA, delay)


# -- recent samples ----------------------------------------------------------------------------

RECENT_SCHEMA = T.StructType([
    T.StructField("count", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("last", T.DoubleType()), T.StructField("p50", T.DoubleType()),
    T.StructField("p95", T.DoubleType()), T.StructField("p99", T.DoubleType())])


#: Rows that are packed at a time.
PACK_ROWS = 1 << 18


def _places(row: tuple) -> list[tuple]:
    """Sorts like a row's order columns, missing values last."""
    return [(v is None, 0 if v is None else v) for v in row]


def _packs(key: Sequence[str], order: Sequence[str], event_time: str, capacity: int,
           most: int):
    """Rows to one row per key and about ``most`` rows of a task: the latest event time, and
    pickled the number and sum of the samples, the latest time in ms of rows with a place in
    the order, and the last ``capacity`` samples as (order, seconds)."""
    never = np.iinfo(np.int64).min

    def latest(times: pa.ChunkedArray, of: np.ndarray, starts: np.ndarray) -> pa.Array:
        ticks = np.where(of, times.cast(pa.int64()).fill_null(never).to_numpy(), never)
        found = np.maximum.reduceat(ticks, starts)
        return pa.array(found, mask=found == never).cast(times.type)

    def packed(table: pa.Table) -> pa.RecordBatch:
        code = np.zeros(table.num_rows, np.int64)
        for k in key:
            found = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode")
            code = code * len(found.dictionary) + found.indices.to_numpy()
            code = np.unique(code, return_inverse=True)[1]
        table = table.append_column("_code", pa.array(code))
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("_code", *order)]))
        starts = np.flatnonzero(np.diff(table["_code"].to_numpy(), prepend=-1))
        seconds = table["seconds"].to_numpy().astype(np.float64)
        placed = table[order[0]].is_valid().to_numpy()
        good = placed & (seconds >= 0)
        counts = np.add.reduceat(good, starts, dtype=np.int64)
        totals = np.add.reduceat(np.where(good, seconds, 0.0), starts)
        # Of a key's samples the last ones.
        left = np.repeat(np.cumsum(counts), counts) - np.arange(counts.sum())
        recent = np.flatnonzero(good)[left <= capacity]
        edges = np.concatenate(([0], np.cumsum(np.minimum(counts, capacity)))).tolist()
        columns = [c.to_pylist() for c in table.select(order).take(recent).columns]
        last = list(zip(zip(*columns, strict=True), seconds[recent].tolist(), strict=True))
        known = zip(counts.tolist(), totals.tolist(),
                    latest(table[CLOCK], placed, starts).to_pylist(), edges[:-1], edges[1:],
                    strict=True)
        texts = [pickle.dumps((n, total, time, last[s:e])) for n, total, time, s, e in known]
        firsts = table.select(key).take(starts).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*[firsts[k].combine_chunks() for k in key],
             latest(table[event_time], np.ones(len(good), bool), starts),
             pa.array(texts, pa.binary())], [*key, event_time, PACKED])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if part.num_rows:
                held.append(part)
            if sum(p.num_rows for p in held) >= most:
                yield packed(pa.Table.from_batches(held))
                held = []
        if held:
            yield packed(pa.Table.from_batches(held))
    return run


class RecentSamples(Keyed):
    """The last samples of a key in a ring: slot number -> seconds."""

    def __init__(self, key, order, event_time, end_ms, capacity: int) -> None:
        super().__init__(key, order, event_time, RECENT_SCHEMA, end_ms)
        self.capacity = capacity

    def init(self, handle) -> None:
        super().init(handle)
        self.ring = handle.getMapState("ring", "slot int", "seconds double")
        self.mark = handle.getValueState("mark", "count bigint, total double, latest bigint")

    def _merged(self, rows) -> tuple[int, float, int | None, list[float]]:
        """Number, sum and latest time of a trigger's samples, and the last of them in order."""
        count, total, latest, recent = 0, 0.0, None, []
        for row in rows:
            n, seconds, time, last = pickle.loads(row[PACKED])
            count, total = count + n, total + seconds
            if time is not None:
                latest = time if latest is None else max(latest, time)
            recent = sorted(recent + last, key=lambda r: _places(r[0]))[-self.capacity:]
        return count, total, latest, [seconds for _, seconds in recent]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        count, total, latest = self.mark.get() or (0, 0.0, None)
        before = latest
        n, seconds, time, fresh = self._merged(rows)
        if time is not None:
            latest = time if latest is None else max(latest, time)
        if latest is None:
            return
        count, total = count + n, total + seconds
        held = {slot: seconds for (slot,), (seconds,) in self.ring.iterator()}
        for place, value in enumerate(fresh, count - len(fresh)):
            slot = place % self.capacity
            held[slot] = value
            self.ring.updateValue((slot,), (value,))
        self.mark.update((count, total, latest))
        self.end_later(before, latest)
        if fresh:
            ordered = sorted(held.values())
            pick = {f"p{p}": ordered[Q.nearest_index(p, len(ordered))] for p in (50, 95, 99)}
            yield from self.emit(key, [{"count": count, "mean": total / count,
                                        "last": fresh[-1], **pick}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.is_over(self.mark.get()[2], timerValues, expiredTimerInfo):
            self.ring.clear()
            self.mark.clear()
        yield from ()


def recent_latency(samples: DataFrame, key: Sequence[str], order: Sequence[str],
                   event_time: str, capacity: int = 512, delay: str = "10 seconds",
                   end_ms: int = DAY_MS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """A key's histogram after every trigger that brought samples (``seconds``): count and
    mean over all, nearest-rank percentiles over the last ``capacity``.  Negative samples
    don't count.  The row of the highest ``count`` is the latest.

    Tasks first pack what they read by key, so a trigger's rows neither travel nor meet in the
    key's task, however many there are; a pack is as late as the latest of its rows.
    """
    # In this order, without repeated names; NaN counts as missing.
    named = {**{k: F.col(k) for k in key}, event_time: F.col(event_time)}
    for name in (*order, "seconds"):
        value = F.col(name)
        named.setdefault(name, F.when(~F.isnan(value), value) if samples.schema[name].dataType
                         == T.DoubleType() else value)
    named[CLOCK] = F.unix_millis(event_time)
    kinds = {f.name: f for f in samples.schema.fields}
    schema = T.StructType([*[kinds[k] for k in key], kinds[event_time],
                           T.StructField(PACKED, T.BinaryType())])
    packs = samples.select(*[c.alias(n) for n, c in named.items()]).mapInArrow(
        _packs(key, order, event_time, capacity, pack_rows), schema)
    return _driven(packs.withWatermark(event_time, delay),
                   RecentSamples(key, order, event_time, end_ms, capacity), RECENT_SCHEMA)
