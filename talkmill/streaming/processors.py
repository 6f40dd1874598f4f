"""Structured Streaming forms of the ordered rules.

One stateful operator drives any :class:`~talkmill.operators.ordered.Fold`: the state of a
key is a small JSON text and rows of a micro-batch are folded in order.  An event-time timer
gives out what is pending when a key pauses, without forgetting what was emitted; a second,
later one ends the key and frees its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from talkmill.operators.ordered import Fold

END = "end_of_session"


#: Event time in whole milliseconds, as the processors see it.
CLOCK = "_ms"
PACKED = "_row"


def with_clock(stream: DataFrame, key: Sequence[str], event_time: str | None,
               delay: str) -> DataFrame:
    """The stream with its watermark, ready for a processor: key, event time and the rest of
    a row as one JSON text, since Python pays for every value of a row that it is handed.
    Event times are in it as whole milliseconds; NaN counts as missing."""
    rest = []
    for f in stream.schema.fields:
        if f.name not in (*key, event_time):
            value = F.col(f.name)
            rest.append((F.when(~F.isnan(value), value) if f.dataType == T.DoubleType() else value)
                        .alias(f.name))
    if event_time:
        stream = stream.withWatermark(event_time, delay)
        rest.append(F.unix_millis(event_time).alias(CLOCK))
    return stream.select(*key, *([event_time] if event_time else []),
                         F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(PACKED))


def ordered_rows(rows: Iterator[Row], order: Sequence[str]) -> Iterator[dict]:
    """A key's rows of one micro-batch in order, without those that have no place in it.
    The trigger's rate limit bounds their number."""
    first, held = order[0], []
    for packed in rows:
        row = json.loads(packed[PACKED])
        if row[first] is not None:
            held.append(row)
    held.sort(key=lambda r: [(r[c] is None, 0 if r[c] is None else r[c]) for c in order])
    yield from held


def move_timer(handle, before: int | None, at: int | None) -> int | None:
    """See that a key wakes at ``at`` or earlier; returns when its one timer is.

    A timer that is early stays, which costs nothing per batch: who is woken before anything
    is due sets the timer again."""
    if before is not None and at is not None and before <= at:
        return before
    if before is not None:
        handle.deleteTimer(before)
    if at is not None:
        handle.registerTimer(at)
    return at


def expired(timer_values, info) -> int:
    """How far event time is known to have come when a timer expires."""
    return max(info.getExpiryTimeInMs(), timer_values.getCurrentWatermarkInMs())


class FoldProcessor(StatefulProcessor):
    """Runs a fold per key.  Rows with a true ``end_of_session`` close the key."""

    def __init__(self, fold: Fold, key: Sequence[str], order: Sequence[str],
                 event_time: str | None, quiet_ms: int | None, ttl_ms: int | None,
                 end_ms: int | None = None) -> None:
        self.fold, self.key, self.order = fold, list(key), list(order)
        self.event_time, self.quiet_ms, self.ttl_ms = event_time, quiet_ms, ttl_ms
        self.end_ms = end_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [f.name for f in self.fold.schema.fields]
        self.result = Row(*self.key, *self.names)
        schema = T.StructType([T.StructField("state", T.StringType()),
                               T.StructField("latest", T.LongType()),
                               T.StructField("wake", T.LongType())])
        self.state = (handle.getValueState("fold", schema, self.ttl_ms) if self.ttl_ms
                      else handle.getValueState("fold", schema))

    def _current(self) -> tuple[dict, int | None, int | None]:
        """The fold's state, the latest event time of the key and its timer, in ms."""
        found = self.state.get()
        if found is None:
            return self.fold.initial(), None, None
        text, latest, wake = found
        return {**self.fold.initial(), **json.loads(text)}, latest, wake

    def _emit(self, key, rows: list[dict]) -> Iterator[Row]:
        for row in rows:
            yield self.result(*key, *[row.get(n) for n in self.names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, latest, wake = self._current()
        heard, known, out, ended = latest, latest is not None, [], False
        for row in ordered_rows(rows, self.order):
            now = row.get(CLOCK)
            if self.quiet_ms is not None and None not in (heard, now) and \
                    now - heard >= self.quiet_ms:
                # The pause that a timer would have seen, had this row come in a later batch.
                state, emitted = self._paused(state, now - heard)
                out += emitted
            if now is not None:
                # A late batch must not move the timer back.
                heard = now if heard is None else max(heard, now)
            known = True
            if row.get(END):
                ended = True
                continue
            state, emitted = self.fold.step(state, row)
            out += emitted
        if not known:
            return  # rows that only move the watermark
        if ended:
            out += self.fold.finish(state)
        timed = self.quiet_ms is not None and heard is not None
        wake = move_timer(self.handle, wake, heard + self.quiet_ms) if timed and not ended else (
            move_timer(self.handle, wake, None))
        if ended:
            self.state.clear()
        else:
            self.state.update((json.dumps(state, ensure_ascii=False), heard, wake))
        yield from self._emit(key, out)

    def _paused(self, state: dict, silence: int) -> tuple[dict, list[dict]]:
        if self.end_ms is not None and silence >= self.end_ms:
            return self.fold.initial(), self.fold.finish(state)
        return self.fold.quiet(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, latest, _ = self._current()
        if latest is None:
            return
        now, pause = expired(timerValues, expiredTimerInfo), latest + self.quiet_ms
        if now < pause:
            self._keep(state, latest, pause)
            return
        end = None if self.end_ms is None else latest + self.end_ms
        rows: list[dict] = []
        if end is None or max(pause, expiredTimerInfo.getExpiryTimeInMs()) < end:
            state, rows = self.fold.quiet(state)
        if end is not None and now >= end:
            self.state.clear()
            rows = [*rows, *self.fold.finish(state)]
        else:
            self._keep(state, latest, end)
        yield from self._emit(key, rows)

    def _keep(self, state: dict, latest: int, wake: int | None) -> None:
        """Store the state of a key whose timer has expired, and its next timer."""
        self.state.update((json.dumps(state, ensure_ascii=False), latest,
                           move_timer(self.handle, None, wake)))

    def close(self) -> None:
        pass


def stream_fold(events: DataFrame, fold: Fold, key: Sequence[str], order: Sequence[str],
                event_time: str | None = None, delay: str = "10 seconds",
                quiet_ms: int | None = None, ttl_ms: int | None = None,
                end_ms: int | None = None) -> DataFrame:
    """Apply a fold to a keyed stream, append mode.

    With ``event_time`` and ``quiet_ms`` a key gives out what it holds once its rows pause for
    that much, which the next row shows or else the watermark, and goes on where it was when
    it is heard again; ``end_ms`` after its last row (no less than ``quiet_ms``) it ends and
    its state goes.  A row without a value in the order column only moves the watermark.
    Without timers ``ttl_ms`` drops abandoned state (processing time).
    """
    kinds = {f.name: f for f in events.schema.fields}
    out = T.StructType([kinds[k] for k in key] + list(fold.schema.fields))
    timers = event_time is not None and quiet_ms is not None
    mode = "EventTime" if timers else ("ProcessingTime" if ttl_ms else "None")
    return with_clock(events, key, event_time, delay).groupBy(*key).transformWithState(
        statefulProcessor=FoldProcessor(fold, key, order, event_time, quiet_ms,
                                        None if timers else ttl_ms, end_ms),
        outputStructType=out, outputMode="Append", timeMode=mode)


def final_events(events: DataFrame) -> DataFrame:
    """The stream without retractable partial results."""
    return events.where(F.col("event_type") != "ASR_PARTIAL")


def deduplicated(events: DataFrame, event_time: str, delay: str, key: Sequence[str]
                 ) -> DataFrame:
    """One row per key within the watermark; later ones are dropped as late."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def sliding_latency(samples: DataFrame, event_time: str, delay: str = "10 minutes",
                    window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Latency per stage over sliding event-time windows."""
    return (samples.withWatermark(event_time, delay)
            .groupBy(F.window(event_time, window, slide), "stage")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"),
                 F.max("seconds").alias("worst")))


def utterances(samples: DataFrame, event_time: str, key: Sequence[str], pause: str,
               delay: str = "10 minutes") -> DataFrame:
    """Utterances as session windows closed by a silence gap."""
    return (samples.withWatermark(event_time, delay)
            .groupBy(*key, F.session_window(event_time, pause))
            .agg(F.count(F.lit(1)).alias("n")))
