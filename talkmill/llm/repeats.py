"""Long byte strings that repeat anywhere in the corpus, by suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import at_most
from talkmill.session import cut, discard

#: Bytes of a repeated string, and of the anchors that sort strings into shards.
LENGTH = 200
ANCHOR = 32
#: Bytes of a text handled at once; places inside fit PLACE_BITS.
PIECE = 1 << 20
PLACE_BITS = 23
#: Bytes of context that one suffix array is built over.
SHARD_BYTES = 1_000_000
#: Texts of a batch handled at once, and stretches in a row that may be one of period.
TEXTS = 500
PERIODS = 8
#: Distinct contexts of one anchor that stay together; more are dealt over several shards.
TOGETHER = 2_000

#: Rows of a set of repeated anchors, or of segment names, that may be broadcast.
BROADCAST_ANCHORS = 2_000_000
BROADCAST_NAMES = 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def drop_repeated_bytes(segments: DataFrame, folder: str, length: int = LENGTH,
                        shard_bytes: int = SHARD_BYTES, together: int = TOGETHER,
                        broadcast_rows: tuple[int, int] = (BROADCAST_ANCHORS, BROADCAST_NAMES)
                        ) -> DataFrame:
    """Remove every byte inside a string of ``length`` bytes that also starts elsewhere.

    Reads ``sequence_id`` and ``text``; texts are UTF-8 bytes and strings never cross
    segments.  Overlapping occurrences count, and strings are judged on the texts as they
    are read.  Returns one row per row read: ``sequence_id, n_bytes, n_removed, n_spans``
    (runs removed) and ``kept`` (bytes left).  ``folder`` is new and shared by all executors;
    what is written there is deleted once the spans are known.

    1. Each window of ``length`` bytes picks the anchor (32 bytes) of least hash inside it.
       Equal windows pick equal anchors at equal offsets, so only windows whose anchor occurs
       twice can repeat.  Windows in a row with one anchor form a stretch, whose bytes are
       its context: one narrow row.  A periodic passage has an anchor in every period; it is
       two rows, the passage without its last and without its first period, which are equal.
    2. Contexts are counted map-side by (anchor, context hash).  All windows of a context
       that occurs twice repeat, so copies in any number are settled by counting.
    3. One of each context whose anchor has several goes with its bytes to a shard by anchor.
       A shard's suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai) give
       the windows that repeat inside it.  Anchors with more than ``together`` contexts are
       dealt over shards; those shards publish the hashes of their distinct windows, and
       each finds the ones it shares with others by binary search.

    Null text is empty; texts shorter than ``length`` lose nothing.  Rows are told apart by
    id and text; rows equal in both are copies of each other and lose the same bytes.  An
    empty table gives an empty result.
    """
    spark = segments.sparkSession
    kind = segments.schema["sequence_id"].dataType.simpleString()
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = segments.select("sequence_id", F.xxhash64(data).alias("version"),
                            data.alias("text"))
    texts.mapInArrow(_stretches(length), f"sequence_id {kind}, version bigint, anchor bigint, "
                     "context bigint, start bigint, windows bigint").write.parquet(
        f"{folder}/stretches")
    found = spark.read.parquet(f"{folder}/stretches")
    again = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select("anchor"))
    side = F.broadcast(again) if at_most(again, broadcast_rows[0]) else again
    found.join(side, "anchor", "left_semi").write.parquet(f"{folder}/candidates")
    discard(spark, f"{folder}/stretches")
    candidates = spark.read.parquet(f"{folder}/candidates")
    contexts = cut(candidates.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("sequence_id", "version", "start", "windows")).alias("pick")))
    copied = candidates.join(contexts.where("copies > 1").select("anchor", "context"),
                             ["anchor", "context"], "left_semi")
    spans = copied.select("sequence_id", "version", "start", (
        F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    varied = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where(
        "contexts > 1")
    wanted = cut(contexts.join(varied, "anchor").select(
        "anchor", "copies", "contexts", "pick.*"))
    spans = spans.unionByName(_by_suffix_array(texts, wanted, length, shard_bytes, together,
                                               broadcast_rows[1]))
    out = f"sequence_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    per = cut(spans.groupBy("sequence_id", "version").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")))
    discard(spark, f"{folder}/candidates")
    if not at_most(per, broadcast_rows[1]):
        whole = texts.join(per.hint("shuffle_hash"), _same(texts, per), "left").select(
            texts["sequence_id"], texts["text"], "spans.start", "spans.stop")
        return whole.mapInArrow(_remove, out)
    # Texts without a span are finished where they are read.
    names = F.broadcast(per.select("sequence_id", "version"))
    hit = texts.join(names, _same(texts, names), "left_semi")
    clean = texts.join(names, _same(texts, names), "left_anti")
    none = F.array().cast("array<bigint>")
    whole = hit.join(per.hint("shuffle_hash"), _same(hit, per)).select(
        hit["sequence_id"], hit["text"], "spans.start", "spans.stop")
    return whole.unionByName(clean.select("sequence_id", "text", none.alias("start"),
                                          none.alias("stop"))).mapInArrow(_remove, out)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["sequence_id"].eqNullSafe(b["sequence_id"])) & (a["version"] == b["version"])


def _remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the union of its spans out of every text."""
    for part in parts:
        sizes, removed, runs, kept = [], [], [], []
        for text, start, stop in zip(part.column(1), part.column(2), part.column(3),
                                     strict=True):
            data = text.as_py()
            begin = np.array(start.as_py() or [], np.int64)
            end = np.array(stop.as_py() or [], np.int64)
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
            opens = np.concatenate(([True], begin[1:] > end[:-1])) if len(begin) else begin > 0
            first = np.flatnonzero(opens)
            begin = begin[first]
            end = end[np.concatenate((first[1:], [len(end)])) - 1] if len(first) else end[:0]
            edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            sizes.append(len(data))
            removed.append(len(data) - len(rest))
            runs.append(len(begin))
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)],
             pa.array(kept, pa.binary())],
            ["sequence_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _stretches(length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(at, TEXTS) for whole in parts
                     for at in range(0, whole.num_rows, TEXTS)):
            found = [stretches(text.as_py(), length) for text in part.column(2)]
            rows = np.concatenate([*found, np.zeros((0, 4), np.int64)])
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(owner), part.column(1).take(owner),
                 *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)]],
                ["sequence_id", "version", "anchor", "context", "start", "windows"])
    return run


def stretches(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Rows ``anchor hash, context hash, start, windows`` that cover all windows of a text."""
    out = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[at:at + PIECE + length - 1]
        if len(piece) >= length:
            rows = _stretches_of(piece, length)
            rows[:, 2] += at
            out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def _stretches_of(data: bytes, length: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8)
    size = min(ANCHOR, length)
    hashes = _rolling(values, size)
    # Least hash first, then first place: the place is in the low bits.
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - size + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.concatenate((first, [len(place)])))
    first, count, anchor = _periodic(data, first, count, hashes[place[first]], length)
    digest = xxhash.xxh3_64_intdigest
    context = np.array([digest(data[s:s + n + length - 1])
                        for s, n in zip(first.tolist(), count.tolist(), strict=True)], np.uint64)
    return np.stack([anchor.view(np.int64), context.view(np.int64), first, count], axis=1)


def _periodic(data: bytes, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, length: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with those of a periodic passage replaced by two long ones of equal bytes."""
    alike = (anchor[1:] == anchor[:-1]) & (count[1:] == count[:-1])
    opens = np.flatnonzero(np.concatenate(([True], ~alike)))
    many = np.diff(np.append(opens, len(first)))
    keep, extra = np.ones(len(first), bool), []
    for at, k in zip(opens[many >= PERIODS].tolist(), many[many >= PERIODS].tolist(),
                     strict=True):
        start, period = int(first[at]), int(count[at])
        windows = (k - 1) * period
        stop = start + windows + length - 1
        if data[start:stop] == data[start + period:stop + period]:
            keep[at:at + k] = False
            extra += [(start, windows, anchor[at]), (start + period, windows, anchor[at])]
    if not extra:
        return first, count, anchor
    begin, windows, hashes = zip(*extra, strict=True)
    return (np.concatenate((first[keep], np.array(begin, first.dtype))),
            np.concatenate((count[keep], np.array(windows, count.dtype))),
            np.concatenate((anchor[keep], np.array(hashes, anchor.dtype))))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes: differences of a polynomial's prefix sums,
    brought to one scale by the inverse powers of its base, then mixed."""
    n = len(values)
    if not _POWERS or len(_POWERS[0][0]) < n:
        top = 1 << max(12, int(n - 1).bit_length())
        base = np.full(top, _BASE, np.uint64)
        back = np.full(top, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        base[0] = back[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[0] = (np.multiply.accumulate(base), np.multiply.accumulate(back))
    power, inverse = _POWERS[0]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        out = (sums[size:] - sums[:-size]) * inverse[:n - size + 1]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(29))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes or more, by Larsson-Sadakane
    refinement: sorted by eight bytes first, then only groups still equal are sorted by the
    rank of the suffix as far on as is sorted already, which doubles that length."""
    n = len(data)
    key = _eight(data)
    order = np.argsort(key)
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    ranks[order] = _group_starts(key[order])
    # Past the end, padding looks like zero bytes; no window opens there.
    sorted_to = 8
    while sorted_to < depth:
        groups = ranks[order]
        alike = np.concatenate((groups[1:] == groups[:-1], [False]))
        alike |= np.concatenate(([False], alike[:-1]))
        at = np.flatnonzero(alike)
        if not len(at):
            break
        some = order[at]
        ahead = ranks[np.minimum(some + sorted_to, n)]
        pair = groups[at] * np.int64(n + 2) + ahead + 1
        by = np.argsort(pair)
        order[at] = some[by]
        pair = pair[by]
        change = np.concatenate(([True], pair[1:] != pair[:-1]))
        ranks[order[at]] = at[np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))]
        sorted_to *= 2
    return order


def _group_starts(keys: np.ndarray) -> np.ndarray:
    change = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.maximum.accumulate(np.where(change, np.arange(len(keys)), 0))


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that the suffix at each place shares with the one sorted before it.

    Kasai's rule in text order: where a suffix and its neighbour are both one byte on from
    the suffix at the place before and its neighbour, and share that byte, they share one
    byte less.  Only the other places are compared, eight bytes a step."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = ((before[:-1] >= 0) & (before[1:] - 1 == before[:-1])
                   & (data[np.maximum(before[:-1], 0)] == data[:-1]))
    words = _eight(data)
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(~follows & (before >= 0))
    while len(left):
        a, b = left + shared[left], before[left] + shared[left]
        room = np.minimum(n - a, n - b)
        same = (room >= 8) & (words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)])
        last = left[~same]
        for _ in range(8):
            a, b = last + shared[last], before[last] + shared[last]
            equal = (a < n) & (b < n)
            equal &= data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)]
            last = last[equal]
            shared[last] += 1
        left = left[same]
        shared[left] += 8
    place = np.arange(n)
    lead = np.maximum.accumulate(np.where(follows, 0, place))
    return np.where(follows, shared[lead] - (place - lead), shared)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(data)]
    return out


# -- shards ----------------------------------------------------------------------------

_SPANS = "version bigint, start bigint, stop bigint"


def _by_suffix_array(texts: DataFrame, wanted: DataFrame, length: int, shard_bytes: int,
                     together: int, few: int) -> DataFrame:
    """Spans of the repeated windows of contexts that occur once."""
    kind = texts.schema["sequence_id"].dataType.simpleString()
    total = wanted.agg(F.sum(F.col("windows") + length)).head()[0] or 0
    shards = int(max(wanted.sparkSession.sparkContext.defaultParallelism,
                     -(-total // shard_bytes)))
    dealt = F.col("contexts") > together
    # A dealt anchor's contexts go anywhere, all others follow their anchor.
    shard = F.pmod(F.when(dealt, F.xxhash64("anchor", "sequence_id", "version", "start"))
                   .otherwise(F.xxhash64("anchor")), F.lit(shards))
    per = wanted.select("sequence_id", "version", F.struct(
        shard.alias("shard"), "start", "windows", "copies", dealt.alias("dealt")).alias("c"))
    per = cut(per.groupBy("sequence_id", "version").agg(F.collect_list("c").alias("wanted")))
    if at_most(per, few):
        names = F.broadcast(per.select("sequence_id", "version"))
        texts = texts.join(names, _same(texts, names), "left_semi")
    held = texts.join(per.hint("shuffle_hash"), _same(texts, per)).select(
        texts["sequence_id"], texts["version"], "text", F.explode("wanted").alias("c"))
    piece = F.expr("substring(text, cast(c.start AS int) + 1, "
                   f"cast(c.windows AS int) + {length - 1})")
    contexts = held.select("c.shard", "sequence_id", "version", "c.start", "c.copies",
                           "c.dealt", piece.alias("bytes"))
    sharded = cut(contexts.repartition(shards, "shard").sortWithinPartitions("shard"))
    spans = f"sequence_id {kind}, {_SPANS}"
    inside = sharded.mapInPandas(_each_shard(length), spans)
    across = sharded.where("dealt")
    if across.isEmpty():
        return inside
    hashes = cut(across.groupBy("shard").applyInPandas(
        _distinct_windows(length), "shard bigint, h1 bigint, h2 bigint"))
    common = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    owed = hashes.join(common.select("h1", "h2"), ["h1", "h2"])
    return inside.unionByName(across.groupBy("shard").cogroup(owed.groupBy("shard"))
                              .applyInPandas(_found_elsewhere(length), spans))


class _Shard:
    """Contexts laid end to end; a window opens where its bytes lie in one context."""

    def __init__(self, rows: pd.DataFrame, length: int) -> None:
        # Rows read twice with equal id and text bring their contexts twice.
        rows = rows.drop_duplicates(["sequence_id", "version", "start"]).reset_index(drop=True)
        pieces = [bytes(b) for b in rows["bytes"]]
        self.rows, self.length = rows, length
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.offset = np.cumsum(sizes) - sizes
        self.context = np.repeat(np.arange(len(pieces)), sizes)
        self.opens = (np.arange(len(self.data)) - self.offset[self.context]
                      <= (sizes - length)[self.context])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows in suffix order, and the number of each one's group of
        equal windows."""
        order = suffix_array(self.data, self.length)
        shared = common_prefixes(self.data, order)
        number = np.cumsum(shared[order] < self.length)
        opens = self.opens[order]
        return order[opens], number[opens]

    def spans(self, places: np.ndarray) -> pd.DataFrame:
        """The windows at these places as spans of their texts, neighbours as one."""
        places = np.sort(places)
        context = self.context[places]
        new = np.concatenate(([True], (np.diff(places) != 1) | (np.diff(context) != 0)))[
            :len(places)]
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(places)]))[:len(first)] - 1
        which = context[first]
        at = self.rows["start"].to_numpy()[which] - self.offset[which]
        return pd.DataFrame({
            "sequence_id": self.rows["sequence_id"].iloc[which].to_list(),
            "version": self.rows["version"].iloc[which].to_list(),
            "start": places[first] + at, "stop": places[last] + at + self.length})


def _each_shard(length: int):
    """Spans of the windows that repeat inside a shard; shards come one after another."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        shard = _Shard(rows, length)
        places, number = shard.groups()
        return shard.spans(places[np.bincount(number)[number] > 1])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            last = held["shard"].iloc[-1] if len(held) else None
            for _, rows in held[held["shard"] != last].groupby("shard"):
                yield work(rows)
            held = held[held["shard"] == last]
        if held is not None and len(held):
            yield work(held)
    return run


def _hash_pairs(shard: _Shard, places: np.ndarray) -> np.ndarray:
    data, digest = shard.data.tobytes(), xxhash.xxh3_128_digest
    joined = b"".join(digest(data[p:p + shard.length]) for p in places.tolist())
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def _distinct_windows(length: int):
    """A shard's distinct windows, as hashes."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        shard = _Shard(rows, length)
        places, number = shard.groups()
        pairs = _hash_pairs(shard, places[np.unique(number, return_index=True)[1]])
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "h1": pairs[:, 0],
                             "h2": pairs[:, 1]})
    return work


def _found_elsewhere(length: int):
    """Spans of the windows whose hashes other shards hold too, by binary search."""
    def work(rows: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(owed):
            return pd.DataFrame({"sequence_id": [], "version": [], "start": [], "stop": []})
        shard = _Shard(rows, length)
        places = np.flatnonzero(shard.opens)
        pairs = _hash_pairs(shard, places)
        owed = owed.sort_values("h1")
        known = owed["h1"].to_numpy()
        both = set(zip(owed["h1"], owed["h2"], strict=True))
        at = np.searchsorted(known, pairs[:, 0])
        hit = known[np.minimum(at, len(known) - 1)] == pairs[:, 0]
        hit[hit] = [(a, b) in both for a, b in pairs[hit].tolist()]
        return shard.spans(places[hit])
    return work
