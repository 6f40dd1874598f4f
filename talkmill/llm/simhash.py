"""Near copies of segments by SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.components import components
from talkmill.session import cut

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BYTES = 8
#: Postings of up to so many fingerprints are paired; larger ones go the other exact way.
PAIRED = 64
#: Two fingerprints that differ in MAX_BITS bits share at least so many positional bytes.
LEAST_SHARED = BYTES - MAX_BITS


def near_copies(segments: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Fingerprint every segment and group those linked by 2 or fewer differing bits.

    Reads ``sequence_id`` and ``text``.  Returns one row per row read: ``sequence_id``,
    ``fingerprint`` (16 hex digits) and ``component_id`` (smallest ``sequence_id`` reachable
    over links, itself included).

    Equal fingerprints are one class from the start, so a group of any number of copies is
    one entry of the index.  Null, empty and white-space texts have fingerprint zero and are
    linked like any other.  A null id takes part, but is smallest only where all are null.
    """
    rows = cut(fingerprints(segments))
    classes = rows.groupBy("fp").agg(F.min("sequence_id").alias("least"))
    roots = components(links(classes.select("fp"), paired), "fp", "near")
    rooted = cut(classes.join(roots, F.col("fp") == F.col("node"), "left")
                 .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        "sequence_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def fingerprint(data: bytes) -> int:
    """SimHash of a UTF-8 text: words between ASCII white space, A-Z lower-cased, every
    shingle of three words counted as often as it occurs; a bit is set if over half of the
    shingles' hashes have it."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    hashes = np.array([digest(text[s:e], SEED) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, BYTES), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def fingerprints(segments: DataFrame) -> DataFrame:
    """``sequence_id, fp`` (as a signed long) of every segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64())], ["sequence_id", "fp"])

    kind = segments.schema["sequence_id"].dataType.simpleString()
    return segments.select("sequence_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"sequence_id {kind}, fp bigint")


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links ``fp, near`` that connect all distinct fingerprints within MAX_BITS bits.

    The index posts a fingerprint under its positional bytes.  A posting of one byte would
    hold a 256th of all fingerprints, so bytes are posted two by two twice over: of the four
    pairs of bytes, two differing bits leave at least two pairs equal, hence six postings
    per fingerprint, each under four positional bytes.  Fingerprints that meet in a posting
    have their equal positional bytes tallied, need LEAST_SHARED of them, and are then
    verified bit by bit.

    Postings of more than ``paired`` fingerprints are not paired, as pairs grow with the
    square.  Their members are posted under themselves and each of their 64 one-bit
    neighbours instead: two differ in at most two bits exactly if they meet there.  Such a
    posting has at most 65 members, which are linked in a star.
    """
    pair = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    slots = [F.struct(F.lit(i).alias("slot"), (F.shiftleft(pair[a], 16).bitwiseOR(pair[b]))
                      .alias("bytes")) for i, (a, b) in enumerate(combinations(range(4), 2))]
    posts = fps.select("fp", F.explode(F.array(*slots)).alias("_p")).select(
        "fp", F.col("_p.slot").alias("slot"), F.col("_p.bytes").alias("bytes"))
    sizes = posts.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(posts.join(sizes, ["slot", "bytes"]))
    one = shared.where(F.col("n") <= paired).select("slot", "bytes", "fp")
    two = one.withColumnRenamed("fp", "near")
    differing = F.col("fp").bitwiseXOR(F.col("near"))
    near = (one.join(two, ["slot", "bytes"]).where(
        (F.col("fp") < F.col("near")) & (equal_bytes(differing) >= LEAST_SHARED)
        & (F.bit_count(differing) <= MAX_BITS)).select("fp", "near"))
    large = shared.where(F.col("n") > paired).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])
    met = (large.select("fp", F.explode(around).alias("spot")).groupBy("spot")
           .agg(F.array_sort(F.collect_list("fp")).alias("members")).where(F.size("members") > 1))
    stars = (met.select(F.col("members")[0].alias("fp"), F.explode("members").alias("near"))
             .where(F.col("fp") != F.col("near")))
    return near.unionByName(stars).distinct()


def equal_bytes(differing: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    total = F.lit(0)
    for i in range(BYTES):
        same = F.shiftrightunsigned(differing, 8 * i).bitwiseAND(F.lit(0xFF)) == 0
        total = total + same.cast("int")
    return total


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)
