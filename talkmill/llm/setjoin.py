"""Segments linked by the Jaccard similarity of their word n-grams, by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import at_most
from talkmill.llm.components import components
from talkmill.session import cut, discard

SHINGLE = 4
#: Sets link from this many hundredths of their union.
PERCENT = 85
#: A band's largest size over its smallest, about.
BAND = 1.5
#: Row numbers, and signatures, that may be broadcast.
BROADCAST_ROWS = 500_000
#: Members of a bucket that are compared with each other at a time.
BLOCK = 2048
#: Texts or sets, and part sums, that a task holds at a time.
ROWS_AT_ONCE = 1000
PARTS_AT_ONCE = 1 << 20
#: Fewest bits of the marks that bound a difference from below.
LEAST_BITS = 256


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` shingles, and how pairs whose smaller set is one of them
    are found: their shingles differ by ``differ`` at most.

    The shingles' domain is cut into ``firsts`` parts and each of these into ``seconds``.  A
    pair has ``spare`` + 1 parts or more with no more than ``within`` differences each, and in
    such a part agrees on one of the subsets of ``seconds - within`` of its cells.
    """

    number: int
    low: int
    high: int
    percent: int

    @cached_property
    def differ(self) -> int:
        both = self.high + 100 * self.high // self.percent
        return (100 - self.percent) * both // (100 + self.percent)

    @cached_property
    def within(self) -> int:
        return self.differ if self.differ <= 4 else 1

    @cached_property
    def seconds(self) -> int:
        return {0: 1, 1: 3, 2: 5, 3: 6, 4: 7}[self.within]

    @cached_property
    def spare(self) -> int:
        return 0 if self.differ <= 4 else math.ceil((self.differ // 2 + 1) / 8)

    @cached_property
    def firsts(self) -> int:
        return self.differ // (self.within + 1) + 1 + self.spare

    @cached_property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.seconds), self.seconds - self.within))


def bands(largest: int, percent: int = PERCENT) -> list[Band]:
    out, low = [], 1
    while not out or out[-1].high < largest:
        high = max(low, int(low * BAND))
        out.append(Band(len(out), low, high, percent))
        low = high + 1
    return out


def similar_segments(segments: DataFrame, folder: str, percent: int = PERCENT,
                     broadcast_rows: int = BROADCAST_ROWS, block: int = BLOCK) -> DataFrame:
    """Group segments whose sets of four-word shingles share ``percent`` % of their union.

    Reads ``sequence_id`` and ``text``; ``folder`` is a shared one, which holds the sets until
    all links are known.  Returns one row per row read: ``sequence_id``, ``n_shingles`` and ``component_id`` (smallest ``sequence_id``
    reachable over links, itself included).

    Words lie between ASCII white space, A-Z lower-cased.  With fewer than four words the
    whole sequence is the one shingle; null texts and texts without words have none and link
    with nothing.  Equal sets are one class from the start.  A null id takes part, but is
    smallest only where all are null; repeated rows are rows of their own.

    Candidates are classes that share a signature.  Those of a bucket of signatures are
    first compared with its smallest and its largest row; where that leaves them in several
    components, all its pairs of different components are bounded by their marks in blocks,
    and what passes is compared too.  So no link between components is lost, and a group of
    copies of any size takes two comparisons a member and signature at most.
    """
    spark = segments.sparkSession
    shingle_sets(segments).withColumn("row", F.monotonically_increasing_id()).write.parquet(
        f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")
    rows = cut(sets.drop("shingles"))
    classes = cut(rows.where("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("row"), F.min("sequence_id").alias("least")))
    largest = rows.agg(F.max("n_shingles")).head()[0] or 0
    several = rows.where("n_shingles > 0").join(
        classes.select("row"), "row", "left_anti").select("row")
    leaders = _among(sets.where("n_shingles > 0"), classes.select("row"), several,
                     broadcast_rows)
    links = _links(leaders, sets, bands(largest, percent), percent, broadcast_rows, block)
    discard(spark, f"{folder}/sets")
    roots = components(links, "a", "b")
    rooted = cut(classes.join(roots, F.col("row") == F.col("node"), "left").select(
        "h1", "h2", "least", F.coalesce("root", "row").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("h1", "h2", "component_id"))
    linked = rows.where("n_shingles > 0").join(named, ["h1", "h2"]).select(
        "sequence_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select(
        "sequence_id", "n_shingles", F.col("sequence_id").alias("component_id"))
    return linked.unionByName(alone)


def _among(sets: DataFrame, wanted: DataFrame, rest: DataFrame, few: int) -> DataFrame:
    """The wanted rows; the sets stay where they are read if either list of rows is short."""
    if at_most(rest, few):
        return sets.join(F.broadcast(rest), "row", "left_anti")
    if at_most(wanted, few):
        return sets.join(F.broadcast(wanted), "row", "left_semi")
    return sets.join(wanted, "row", "left_semi")


def shingle_set(data: bytes) -> np.ndarray:
    """Hashes of a UTF-8 text's distinct shingles, in order."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    return np.unique(np.array([digest(text[s:e]) for s, e in spans], np.uint64).view(np.int64))


def shingle_sets(segments: DataFrame) -> DataFrame:
    """``sequence_id, n_shingles, h1, h2, shingles``: the set and its 128-bit hash."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _smaller(parts):
            found = [shingle_set(t.as_py() or b"") for t in part.column(1)]
            sizes = np.array([len(s) for s in found], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found)
            marks = np.frombuffer(digests, "<i8").reshape(-1, 2)
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), pa.array(flat))],
                ["sequence_id", "n_shingles", "h1", "h2", "shingles"])

    kind = segments.schema["sequence_id"].dataType.simpleString()
    return segments.select("sequence_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"sequence_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, "
        "shingles array<bigint>")


def _smaller(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, ROWS_AT_ONCE):
            yield part.slice(at, ROWS_AT_ONCE)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


# -- signatures --------------------------------------------------------------------------------

def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter 64-bit numbers (the usual xor-multiply finaliser)."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_signatures(band: Band, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets in a band: index of the set, signature.

    A subset without shingles says nothing, and sets would meet in it by chance; it is left
    out unless so many parts of the set have one that the guarantee rests on them: of
    ``spare`` + 1 parts that have few differences, one has shingles in every subset if no
    more than ``spare`` parts of either set have an empty one.
    """
    many, first, second = len(sets), band.firsts, band.seconds
    cells = first * second
    sizes = np.array([len(s) for s in sets], np.int64)
    shingles = np.concatenate(sets).view(np.uint64)
    cell = (mixed(shingles, 2 * band.number) % np.uint64(cells)).astype(np.int64)
    slot = np.repeat(np.arange(many), sizes) * cells + cell
    total = np.zeros(many * cells, np.uint64)
    np.add.at(total, slot, mixed(shingles, 2 * band.number + 1))
    count = np.bincount(slot, minlength=many * cells).reshape(many, first, second)
    total = total.reshape(many, first, second)
    held = [count[:, :, s].sum(axis=2) > 0 for s in map(list, band.subsets)]
    poor = (~np.logical_and.reduce(held)).sum(axis=1) > band.spare
    rows, out = [], []
    for at, subset in enumerate(band.subsets):
        use, part = np.nonzero(held[at] | poor[:, None])
        name = mixed(part + at * first, 1_000_003 * (band.number + 1))
        rows.append(use)
        out.append(mixed(total[:, :, list(subset)].sum(axis=2, dtype=np.uint64)[use, part] ^ name))
    return np.concatenate(rows), np.concatenate(out).view(np.int64)


def instances(sizes: np.ndarray, every: list[Band]) -> list[tuple[Band, np.ndarray]]:
    """Which sets take part in which band: those in it, and larger ones that may still be
    similar to its largest.  Bands whose pairs may not differ need no signature."""
    out = []
    for band in every:
        reach = 100 * band.high // band.percent
        at = np.flatnonzero((sizes >= band.low) & (sizes <= reach))
        if band.differ and len(at):
            out.append((band, at))
    return out


def signatures(sets: DataFrame, every: list[Band]) -> DataFrame:
    """``sig, row`` for every signature of every set."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _smaller(parts):
            rows = part.column(0).to_numpy()
            found = _arrays(part.column(1))
            sizes = np.array([len(s) for s in found], np.int64)
            for band, at in instances(sizes, every):
                step = max(1, PARTS_AT_ONCE // (band.firsts * band.seconds))
                for k in range(0, len(at), step):
                    some = at[k:k + step]
                    which, sigs = band_signatures(band, [found[i] for i in some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sigs), pa.array(rows[some[which]])], ["sig", "row"])

    return sets.select("row", "shingles").mapInArrow(run, "sig bigint, row bigint")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy()
    edges = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]


# -- candidates and links ----------------------------------------------------------------------

def _links(leaders: DataFrame, sets: DataFrame, every: list[Band], percent: int, few: int,
           block: int) -> DataFrame:
    """Links ``a, b`` of row numbers that connect all similar classes."""
    posts = signatures(leaders, every)
    buckets = cut(posts.repartition("sig").groupBy("sig").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
        .where("low < high"))
    large = buckets.where("n > 2").select("sig")
    known = F.broadcast(large) if at_most(large, few) else large
    members = cut(posts.join(known, "sig", "left_semi").distinct())
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    pairs = pairs.unionByName(members.join(buckets.select("sig", "low"), "sig").select(
        F.col("low").alias("a"), F.col("row").alias("b")))
    links = cut(verified(pairs, sets, percent, few))
    rooted = _rooted(members, links)
    # The buckets that are still in several components, from their other end.
    open_ = cut(_unsettled(rooted))
    last = open_.groupBy("sig").agg(F.max(F.struct("row", "root")).alias("high"))
    other = open_.join(last, "sig").where(F.col("root") != F.col("high.root")).select(
        F.col("row").alias("a"), F.col("high.row").alias("b"))
    links = cut(links.unionByName(verified(other, sets, percent, few)).distinct())
    open_ = cut(_unsettled(_rooted(members, links)))
    if open_.isEmpty():
        return links
    wanted = open_.select("row").distinct()
    wanted = F.broadcast(wanted) if at_most(wanted, few) else wanted
    rest = close_pairs(_gathered(open_, few), sets.join(wanted, "row", "left_semi"), percent, block)
    return cut(links.unionByName(verified(rest, sets, percent, few)).distinct())


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links, "a", "b")
    return members.join(roots, F.col("row") == F.col("node"), "left").select(
        "sig", "row", F.coalesce("root", "row").alias("root"))


def _unsettled(rooted: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    mixed_ = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                       F.count(F.lit(1)).alias("n")).where("x < y")
    return rooted.join(mixed_.select("sig", "n"), "sig")


def _gathered(members: DataFrame, few: int) -> DataFrame:
    """``sig, whole, row, root, n``: buckets most of whose rows are of the same component become
    one (``whole``, named by the component) where it has no more pairs than they have together.

    Copies share many buckets; this way most of their pairs are compared and given once.
    """
    shares = members.groupBy("sig", "n", "root").agg(F.count(F.lit(1)).alias("share"))
    buckets = cut(shares.groupBy("sig", "n").agg(F.max(F.struct("share", "root")).alias("most"))
                  .select("sig", "n", F.col("most.root").alias("main")))
    rows = members.join(buckets.select("sig", "main"), "sig").select("main", "row").distinct()
    square = F.col("n").cast("double") * F.col("n")
    whole = buckets.groupBy("main").agg(F.sum(square).alias("pairs"), F.count(F.lit(1)).alias("k"))
    whole = cut(rows.groupBy("main").agg(F.count(F.lit(1)).alias("size")).join(whole, "main").where(
        "k > 1 AND size * double(size) <= pairs").select("main", "size"))
    dealt = buckets.join(F.broadcast(whole) if at_most(whole, few) else whole, "main", "left")
    name = dealt.select(
        "sig", F.when(F.col("size").isNotNull(), F.col("main")).otherwise(F.col("sig")).alias("as"),
        F.col("size").isNotNull().alias("whole"), F.coalesce("size", "n").alias("n"))
    return members.drop("n").join(name, "sig").select(
        F.col("as").alias("sig"), "whole", "row", "root", "n").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int, few: int) -> DataFrame:
    """The pairs ``a, b`` that are similar: those that their sizes and marks don't rule out,
    by their whole sets."""
    pairs = cut(pairs.where("a < b").distinct())
    known = cut(marked(_within(sets, pairs, few)))
    both = pairs.join(_named(known, "a"), "a").join(_named(known, "b"), "b")
    pairs = cut(both.mapInArrow(_possible(percent), "a bigint, b bigint"))
    sets = _within(sets, pairs, few)
    one = sets.select(F.col("row").alias("a"), F.col("shingles").alias("_x"))
    two = sets.select(F.col("row").alias("b"), F.col("shingles").alias("_y"))
    shared = F.size(F.array_intersect("_x", "_y"))
    # As 100 * shared >= percent * (sizes - shared).
    return pairs.join(one, "a").join(two, "b").where(
        (100 + percent) * shared >= percent * (F.size("_x") + F.size("_y"))).select("a", "b")


def _within(sets: DataFrame, pairs: DataFrame, few: int) -> DataFrame:
    """The sets of the pairs, where they are read if the pairs are few."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    return sets.join(F.broadcast(ids), "row", "left_semi") if at_most(ids, few) else sets


def _named(known: DataFrame, side: str) -> DataFrame:
    return known.select(F.col("row").alias(side), F.col("size").alias(f"size_{side}"),
                        F.col("mark").alias(f"mark_{side}"))


def _possible(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = part.to_pydict()
            keep = []
            for n, m, x, y in zip(found["size_a"], found["size_b"], found["mark_a"],
                                  found["mark_b"], strict=True):
                width = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                keep.append(100 * min(n, m) >= percent * max(n, m)
                            and apart * (100 + percent) <= (100 - percent) * (n + m))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def marks(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per residue: two sets differ by no less than their marks do.
    The number of residues is a power of two, so longer marks fold into shorter ones."""
    bits = max(LEAST_BITS, 1 << max(0, len(shingles) - 1).bit_length())
    found = np.bincount((shingles.view(np.uint64) % np.uint64(bits)).astype(np.int64),
                        minlength=bits) & 1
    return np.packbits(found.astype(np.uint8)).tobytes()


def folded(mark: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(mark, np.uint64)
    while len(out) * 8 > size:
        out = out[:len(out) // 2] ^ out[len(out) // 2:]
    return out


def marked(sets: DataFrame) -> DataFrame:
    """``row, size, mark`` of every set."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _smaller(parts):
            found = _arrays(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in found], pa.int64()),
                 pa.array([marks(s) for s in found], pa.binary())], ["row", "size", "mark"])

    return sets.select("row", "shingles").mapInArrow(run, "row bigint, size bigint, mark binary")


def close_pairs(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of a bucket, of different components, that their sizes and marks don't rule out.

    A bucket of more than ``block`` members is dealt into blocks, and a task compares two
    blocks at a time: what it holds does not grow with the bucket.
    """
    known = cut(marked(sets))
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("row", F.lit(7)), blocks)
    dealt = members.withColumns({"own": own, "blocks": blocks}).select(
        "sig", "whole", "row", "root", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("sig", "whole", "row", "root", "own", F.least("own", "o").alias("i"),
                         F.greatest("own", "o").alias("j")).join(known, "row")
    group = ["i", "j", "sig", "whole"]
    laid = dealt.repartition(*group).sortWithinPartitions(*group).select(
        *group, "row", "root", "own", "size", "mark")
    return laid.mapInArrow(_compared(percent), "a bigint, b bigint").distinct()


def _compared(percent: int):
    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        i, j = rows[0][:2]
        width = min(len(r[8]) for r in rows)
        row, root, own, size = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6, 7))
        mark = np.array([folded(r[8], width) for r in rows])
        for at in range(len(rows)):
            # Within a block every pair once, between two blocks from the first to the second.
            if i == j:
                others = np.arange(at + 1, len(rows))
            else:
                others = np.flatnonzero(own == j) if own[at] == i else np.zeros(0, np.int64)
            others = others[root[others] != root[at]]
            both = size[others] + size[at]
            small = np.minimum(size[others], size[at])
            others = others[(100 * small >= percent * (both - small)) & (
                np.bitwise_count(mark[others] ^ mark[at]).sum(axis=1, dtype=np.int64)
                * (100 + percent) <= (100 - percent) * both)]
            if len(others):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(row[others], row[at])),
                     pa.array(np.maximum(row[others], row[at]))], ["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            for r in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if held and held[0][:4] != r[:4]:
                    yield from compare(held)
                    held = []
                held.append(r)
        if held:
            yield from compare(held)
    return run
