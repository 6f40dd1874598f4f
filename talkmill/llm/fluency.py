"""Text quality by a Kneser-Ney model of trusted segments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import at_most
from talkmill.operators import quantiles
from talkmill.session import cut, discard, shared_folder

#: Bytes of a gram; every byte is predicted from the ORDER - 1 bytes before it.
ORDER = 6
#: Share of the held-out trusted segments that each of a language's two thresholds lets pass.
QUANTILE = 0.99
#: Nats beyond which a byte is a surprise.
SURPRISE = 6.0
#: One in so many trusted segments is held out of the model, for the threshold.
HELD_OUT = 4
#: Entries of the model that go to every task; a larger model is joined by gram.
LOCAL_ENTRIES = 6_000_000
#: Grams of one shard of such a join; bytes of text looked up at once in a task, and distinct
#: grams that it counts before some leave it.
SHARD_GRAMS = 1_000_000
GRAMS_AT_ONCE = 1 << 18
COUNTED_AT_ONCE = 2_000_000
#: Trusted names that may be broadcast, and values of a language in one sort.
BROADCAST_NAMES = 1_000_000
BROADCAST_LANGUAGES = 100_000
ROWS_PER_SORT = 20_000

OTHER, LEARNED, UNSEEN = 0, 1, 2


def judge_fluency(segments: DataFrame, trusted: DataFrame, order: int = ORDER,
                  quantile: float = QUANTILE, held_out: int = HELD_OUT,
                  local_entries: int = LOCAL_ENTRIES, shard_grams: int = SHARD_GRAMS
                  ) -> DataFrame:
    """Perplexity of every segment under a model of its language's trusted segments.

    Reads ``sequence_id, text, language`` of ``segments`` and ``sequence_id`` of ``trusted``.
    Returns one row per row read: ``sequence_id, language, perplexity`` (per byte),
    ``threshold`` (the language's quantile of trusted perplexities), ``surprise``,
    ``surprise_threshold`` (its quantile) and ``kept`` (above neither).  ``surprise`` is what
    bytes cost beyond ``SURPRISE`` nats, over the root of the number of bytes: a few strange
    words hardly move a mean over a long text, but they do that.

    One in ``held_out`` trusted segments, by hash of their ids, is not learned from: their
    perplexities are those of unseen trusted text and give the thresholds.  (A language
    without any takes all its trusted segments for it.)  All segments are scored by the one
    model of the others.

    A scan of the trusted text counts byte grams per language, combined in each task.  The
    model is tables by (language, gram), one of probabilities and one of back-off weights per
    order, made by joins order by order; their size follows the trusted text.  A model of up
    to ``local_entries`` entries goes to every task, which then prices texts by itself.  Of a
    larger one only the most frequent grams do; what a text holds beside them comes out as
    arrays per text and shard of grams, is priced once per distinct gram by joins with the
    model, and is summed up shard by shard.  The tables lie in the shared folder until all
    texts are scored.

    A missing language is a language of its own.  A language without learned text, or a text
    without bytes, has no perplexity, hence nothing against it, and stays.  Null text counts
    as empty.  Rows that repeat an id are judged each by its own text.
    """
    rows = segments.select("sequence_id", F.coalesce("language", F.lit("")).alias("language"),
                           F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    names = cut(trusted.select(F.col("sequence_id").alias("_name")).distinct())
    side = F.broadcast(names) if at_most(names, BROADCAST_NAMES) else names.hint("shuffle_hash")
    role = F.when(F.col("_name").isNull(), OTHER).when(
        F.pmod(F.xxhash64("_name"), F.lit(held_out)) == 0, UNSEEN).otherwise(LEARNED)
    marked = rows.join(side, rows["sequence_id"] == F.col("_name"), "left").select(
        "sequence_id", "language", F.xxhash64("language").alias("lang"), role.alias("role"), "text")
    learned = rows.join(side, rows["sequence_id"] == F.col("_name")).where(role == LEARNED)
    counts = learned.select(F.xxhash64("language").alias("lang"), "text").mapInArrow(
        _count_grams(order), "lang bigint, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    folder = f"{shared_folder(segments.sparkSession)}/models/{uuid.uuid4().hex}"
    model = gram_model(counts, order, folder)
    known = _small(model.seen[1].select(F.col("lang").alias("_known")).distinct())
    asked = marked.join(known, marked["lang"] == F.col("_known"), "left").select(
        "sequence_id", "language", "role", F.col("_known").alias("lang"), "text")
    spoken = (F.col("bytes") > 0) & F.col("total").isNotNull()
    judged = cut(_scored(asked, model, order, local_entries, shard_grams).select(
        "sequence_id", "language", "role",
        F.when(spoken, F.exp(-F.col("total") / F.nullif("bytes", F.lit(0)))).alias("perplexity"),
        F.when(spoken, F.col("beyond") / F.sqrt(F.nullif("bytes", F.lit(0)))).alias("surprise")))
    discard(segments.sparkSession, folder)
    good = judged.where((F.col("role") != OTHER) & F.col("perplexity").isNotNull())
    unseen = good.where(F.col("role") == UNSEEN)
    without = good.join(_small(unseen.select("language").distinct()), "language", "left_anti")
    basis = unseen.unionByName(without)
    limits = [quantiles.linear(basis, ["language"], value, ROWS_PER_SORT, limit=quantile).select(
        F.col("language").alias("_language"), F.col("limit").alias(name))
        for value, name in (("perplexity", "threshold"), ("surprise", "surprise_threshold"))]
    limits = limits[0].join(limits[1], "_language")
    kept = F.coalesce((F.col("perplexity") <= F.col("threshold"))
                      & (F.col("surprise") <= F.col("surprise_threshold")), F.lit(True))
    return judged.join(limits, F.col("language") == F.col("_language"), "left").select(
        "sequence_id", "language", "perplexity", "threshold", "surprise", "surprise_threshold",
        kept.alias("kept"))


def _small(by_language: DataFrame) -> DataFrame:
    """A table of one row per language, sent to all tasks unless there are too many."""
    table = cut(by_language)
    return F.broadcast(table) if at_most(table, BROADCAST_LANGUAGES) else table


# -- grams -------------------------------------------------------------------------------------

def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each text, as a number (zeros precede a text), and
    the texts' sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = bytes(order - 1)
    data = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.uint64)
    out = np.zeros(len(data) - order + 1 if len(data) >= order else 0, np.uint64)
    for i in range(order):
        out = (out << np.uint64(8)) | data[i:i + len(out)]
    # Between two texts lie the grams that end in the gap.
    keep = np.ones(len(out), bool)
    ends = np.cumsum(sizes + order - 1)
    for i in range(order - 1):
        at = ends[:-1] - (order - 1) + i
        keep[at[at < len(keep)]] = False
    return out[keep], sizes


def _slices(texts: list, most: int = GRAMS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a text is never split."""
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= most):
            held += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _count_grams(order: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        many = 0
        for part in parts:
            by: dict[int, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                by.setdefault(lang, []).append(text.as_py())
            for lang, texts in by.items():
                for at, stop in _slices(texts):
                    found = np.unique(grams_of(texts[at:stop], order)[0], return_counts=True)
                    held.setdefault(lang, []).append(found)
                    many += len(found[0])
                    # Counts of a task's texts are combined before any leave it.
                    if many > COUNTED_AT_ONCE:
                        held = {k: [_combined(v)] for k, v in held.items()}
                        many = sum(len(v[0][0]) for v in held.values())
                        if many > COUNTED_AT_ONCE // 2:
                            yield from _tallied(held)
                            held, many = {}, 0
        yield from _tallied({k: [_combined(v)] for k, v in held.items()})
    return run


def _combined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([n for _, n in found]), len(values))
    return values, counts.astype(np.int64)


def _tallied(held: dict) -> Iterator[pa.RecordBatch]:
    for lang, found in held.items():
        for values, counts in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), lang, np.int64)), pa.array(values.astype(np.int64)),
                 pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


# -- the model ---------------------------------------------------------------------------------

@dataclass
class GramModel:
    """Per order: ``seen`` (``lang, gram, n, p``), the probability of grams that were counted,
    and ``spread`` (``lang, context, weight``), what a context gives to the order below."""

    order: int
    seen: dict[int, DataFrame]
    spread: dict[int, DataFrame]

    def entries(self) -> DataFrame:
        """``key, value``: logarithms by the hash of language, kind and gram or context."""
        out = None
        for k in range(1, self.order + 1):
            for kind, table, gram, value in ((2 * k, self.seen[k], "gram", "p"),
                                             (2 * k + 1, self.spread[k], "context", "weight")):
                rows = table.select(_key(kind, gram).alias("key"), F.log(value).alias("value"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def prices(self, asked: DataFrame) -> DataFrame:
        """``lang, gram, logp`` of distinct grams asked for, seen or not: order by order, from
        the bytes' equal chances up.  A context never seen passes its order by."""
        below = None
        for k in range(1, self.order + 1):
            kinds = asked if k == self.order else asked.select(
                "lang", _suffix(k).alias("gram")).distinct()
            rows = (kinds.withColumn("context", _context(k))
                    .join(self.seen[k].select("lang", "gram", "p"), ["lang", "gram"], "left")
                    .join(self.spread[k], ["lang", "context"], "left"))
            if below is None:
                rows = rows.withColumn("lower", F.lit(1 / 256))
            else:
                rows = rows.withColumn("_suffix", _suffix(k - 1)).join(below.select(
                    "lang", F.col("gram").alias("_suffix"), F.col("p").alias("lower")),
                    ["lang", "_suffix"])
            below = cut(rows.select("lang", "gram", F.coalesce(
                "p", F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p")))
        return below.select("lang", "gram", F.log("p").alias("logp"))


def _key(kind: int, gram: str) -> Column:
    return F.xxhash64(F.col("lang"), F.lit(kind).cast("bigint"), F.col(gram))


def _suffix(order: int, gram: str = "gram") -> Column:
    """A gram's last ``order`` bytes."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * order) - 1))


def _context(order: int) -> Column:
    return F.shiftright("gram", 8) if order > 1 else F.lit(0).cast("bigint")


def gram_model(counts: DataFrame, order: int, folder: str) -> GramModel:
    """Interpolated, modified Kneser-Ney from ``lang, gram, n``, as tables in ``folder``.

    Of the highest order raw counts are used, below it the number of distinct bytes that
    precede a gram.  Each order subtracts the three Kneser-Ney discounts, estimated per
    language and order from its counts of counts, and gives what they free, per context, to
    the order below; below one byte all bytes are equally likely.
    """
    spark = counts.sparkSession

    def saved(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    of = {order: saved(counts, f"counts{order}")}
    for k in range(order - 1, 0, -1):
        of[k] = saved(of[k + 1].select("lang", _suffix(k).alias("gram")).groupBy(
            "lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"counts{k}")
    seen, spread = {}, {}
    for k in range(1, order + 1):
        discount = F.when(F.col("n") == 1, F.col("d1")).when(
            F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        held = of[k].join(_small(_discounts(of[k])), "lang").select(
            "lang", "gram", "n", _context(k).alias("context"),
            F.least(discount, F.col("n").cast("double")).alias("freed"))
        whole = held.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.sum("freed").alias("freed_all"))
        spread[k] = saved(whole.select("lang", "context", "total", (
            F.col("freed_all") / F.col("total")).alias("weight")), f"spread{k}")
        rows = held.join(spread[k], ["lang", "context"])
        if k == 1:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("_suffix", _suffix(k - 1)).join(seen[k - 1].select(
                "lang", F.col("gram").alias("_suffix"), F.col("p").alias("lower")),
                ["lang", "_suffix"])
        p = (F.col("n") - F.col("freed")) / F.col("total") + F.col("weight") * F.col("lower")
        seen[k] = saved(rows.select("lang", "gram", "n", p.alias("p")), f"seen{k}")
        spread[k] = spread[k].drop("total")
    return GramModel(order, seen, spread)


def _discounts(counts: DataFrame) -> DataFrame:
    """Discounts of counts of one, two, and three or more, per language."""
    of = counts.groupBy("lang").agg(*[
        F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def amount(i: int) -> Column:
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        # Small samples may lack a count; half of it is then subtracted.
        return F.greatest(F.lit(0.05), F.least(F.coalesce(raw, F.lit(i / 2)), F.lit(i - 0.05)))

    return of.select("lang", *[amount(i).alias(f"d{i}") for i in (1, 2, 3)])


# -- entries in a task -------------------------------------------------------------------------

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of longs, as the SQL function has it; a hash is the next column's seed."""
    h = seed.astype(np.uint64) + _P5 + np.uint64(8)
    h = h ^ (_turned(values.astype(np.uint64) * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class Entries:
    """Values by 64-bit key, in open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 1.4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size)
        keys = np.maximum(keys.view(np.uint64), np.uint64(1))
        slot = self._home(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.values[slot[here]] = values[here]
            keys, values, slot = keys[~here], values[~here], (slot[~here] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and their values (0 for the others)."""
        keys = np.maximum(keys, np.uint64(1))
        slot = self._home(keys)
        there = self.keys[slot]
        found = there == keys
        values = np.where(found, self.values[slot], 0.0)
        left = np.flatnonzero(~found & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            found[left[hit]] = True
            values[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return found, values


class Packed:
    """Keys and values on their way to the tasks, each of whose workers lays them out once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.entries = keys, values, None

    def laid_out(self) -> Entries:
        if self.entries is None:
            self.entries = Entries(self.keys, self.values)
            self.keys = self.values = None
        return self.entries


def _priced(entries: Entries, lang: np.ndarray, gram: np.ndarray, order: int, whole: bool
            ) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of grams, and which of them are known: all if the entries are the
    ``whole`` model, else those of the highest order that are there."""
    def key(kind: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        first = hashed(lang[at], np.full(len(at), 42, np.uint64))
        return hashed(values, hashed(np.full(len(at), kind), first))

    total, left = np.zeros(len(gram)), np.arange(len(gram))
    for k in range(order, 0, -1):
        values = gram[left] & np.uint64((1 << 8 * k) - 1)
        found, value = entries.get(key(2 * k, left, values))
        total[left] += value
        left, values = left[~found], values[~found]
        if not whole:
            known = np.ones(len(gram), bool)
            known[left] = False
            return total, known
        total[left] += entries.get(key(2 * k + 1, left, values >> np.uint64(8)))[1]
    total[left] -= np.log(256)
    return total, np.ones(len(gram), bool)


# -- scores ------------------------------------------------------------------------------------

_HEAD = ["row", "sequence_id", "language", "role", "bytes", "total", "beyond"]


def _scored(asked: DataFrame, model: GramModel, order: int, local_entries: int,
            shard_grams: int) -> DataFrame:
    """``sequence_id, language, role, bytes, total`` (log-probability) and ``beyond`` (what is
    over ``SURPRISE``) of every row."""
    spark = asked.sparkSession
    kind = asked.schema["sequence_id"].dataType.simpleString()
    entries = model.entries()
    whole = at_most(entries, local_entries)
    if not whole:
        entries = model.seen[order].where(F.col("n") >= _least_count(
            model.seen[order], local_entries)).select(
            _key(2 * order, "gram").alias("key"), F.log("p").alias("value"))
    table = entries.toArrow()
    local = spark.sparkContext.broadcast(Packed(
        table.column("key").to_numpy(), table.column("value").to_numpy()))
    del table
    shards = 1 if whole else max(1, -(-model.seen[order].count() // shard_grams))
    found = asked.mapInArrow(_score(local, order, whole, shards), (
        f"row bigint, sequence_id {kind}, language string, role int, bytes bigint, "
        "total double, beyond double, lang bigint, shard int, grams array<bigint>, "
        "counts array<int>"))
    if whole:
        return found.select(*_HEAD)
    # A row's head, and one row per shard that it has grams of.
    found = cut(found)
    rest = found.where(F.col("shard").isNotNull()).select("row", "lang", "shard", "grams", "counts")
    one = rest.select("lang", F.explode("grams").alias("gram")).distinct()
    price = model.prices(cut(one)).select(
        F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int").alias("shard"), "lang", "gram", "logp")
    sums = _by_shard(price, rest).groupBy("row").agg(F.sum("total").alias("_total"),
                                                     F.sum("beyond").alias("_beyond"))
    heads = found.where(F.col("shard").isNull()).select(*_HEAD)
    return heads.join(sums, "row", "left").withColumns({
        c: F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)) for c in ("total", "beyond")}).select(*_HEAD)


def _least_count(seen: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` grams are counted so often."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r["level"]: r["n"] for r in seen.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    least, total = 63, 0
    for at in range(62, -1, -1):
        total += sizes.get(at, 0)
        if total > most:
            break
        least = at
    return (1 << least) - (least == 63)


def _score(local, order: int, whole: bool, shards: int):
    """One row per text: the logarithms of the grams that the task knows.  Of others, rows of
    its distinct grams and their numbers, by shard."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, number = local.value.laid_out(), TaskContext.get().partitionId() << 40
        for part in parts:
            texts = part.column(4).to_pylist()
            langs = part.column(3).to_pylist()
            part = part.drop_columns(["text"])
            for at, stop in _slices(texts):
                some = part.slice(at, stop - at)
                spoken = [t if lang is not None else b"" for t, lang in
                          zip(texts[at:stop], langs[at:stop], strict=True)]
                gram, sizes = grams_of(spoken, order)
                owner = np.repeat(np.arange(len(spoken)), sizes)
                lang = np.array([x or 0 for x in langs[at:stop]], np.int64)
                total, known = _priced(entries, lang[owner], gram, order, whole)
                sums = np.bincount(owner, total, len(spoken))
                beyond = np.bincount(owner, _beyond(total) * known, len(spoken))
                rows = np.arange(number, number + len(spoken))
                number += len(spoken)
                none = np.array([x is None for x in langs[at:stop]])
                nothing = pa.nulls(len(spoken))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), *some.columns[:3],
                     pa.array([len(t) for t in texts[at:stop]], pa.int64()),
                     pa.array(sums, pa.float64(), mask=none), pa.array(beyond, pa.float64()), some.column(3),
                     nothing.cast(pa.int32()),
                     nothing.cast(pa.list_(pa.int64())), nothing.cast(pa.list_(pa.int32()))],
                    [*_HEAD, "lang", "shard", "grams", "counts"])
                if not known.all():
                    yield _unknown(some, rows, lang, owner[~known], gram[~known], shards)
    return run


def _beyond(logs: np.ndarray) -> np.ndarray:
    return np.maximum(-logs - SURPRISE, 0.0)


def _unknown(some: pa.RecordBatch, rows: np.ndarray, lang: np.ndarray, owner: np.ndarray,
             gram: np.ndarray, shards: int) -> pa.RecordBatch:
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    at = np.flatnonzero(np.concatenate((
        [True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]))))
    owner, gram, counts = owner[at], gram[at], np.diff(np.append(at, len(gram)))
    place = hashed(gram, np.full(len(gram), 42, np.uint64)).view(np.int64) % shards
    order = np.lexsort((place, owner))
    owner, gram, counts, place = owner[order], gram[order], counts[order], place[order]
    at = np.flatnonzero(np.concatenate((
        [True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1]))))
    edges = pa.array(np.append(at, len(gram)), pa.int32())
    who, empty = owner[at], pa.nulls(len(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[who]), some.column(0).take(pa.array(who)), some.column(1).take(pa.array(who)),
         some.column(2).take(pa.array(who)), empty.cast(pa.int64()), empty.cast(pa.float64()),
         empty.cast(pa.float64()), pa.array(lang[who]), pa.array(place[at].astype(np.int32)),
         pa.ListArray.from_arrays(edges, pa.array(gram.astype(np.int64))),
         pa.ListArray.from_arrays(edges, pa.array(counts.astype(np.int32)))],
        [*_HEAD, "lang", "shard", "grams", "counts"])


def _by_shard(price: DataFrame, rest: DataFrame) -> DataFrame:
    """``row, total, beyond``: the rows' grams of a shard against its prices, which come
    first."""
    both = price.select("shard", F.lit(0).alias("kind"), "lang", "gram", "logp").unionByName(
        rest.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    laid = both.repartition("shard").sortWithinPartitions("shard", "kind").select(
        "shard", "kind", "lang", "gram", "logp", "row", "grams", "counts")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, keys, logs = None, None, [], []
        for part in parts:
            shard, kind = (part.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    now, entries, keys, logs = shard[a], None, [], []
                some = part.slice(a, b - a)
                lang = some.column(2).to_numpy().astype(np.int64)
                if kind[a] == 0:
                    gram = some.column(3).to_numpy().astype(np.int64)
                    keys.append(hashed(gram, hashed(lang, np.full(len(lang), 42, np.uint64))))
                    logs.append(some.column(4).to_numpy())
                    continue
                if entries is None:
                    entries = Entries(np.concatenate([*keys, np.zeros(0, np.uint64)]),
                                      np.concatenate([*logs, np.zeros(0)]))
                gram = some.column(6).flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(some)), np.diff(some.column(6).offsets.to_numpy()))
                key = hashed(gram, hashed(lang[owner], np.full(len(owner), 42, np.uint64)))
                value, many = entries.get(key)[1], some.column(7).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [some.column(5), *[pa.array(np.bincount(owner, v * many, len(some)), pa.float64())
                                       for v in (value, _beyond(value))]],
                    ["row", "total", "beyond"])

    return laid.mapInArrow(run, "row bigint, total double, beyond double")
