"""Lines that repeat across transcripts, kept in levelled sorted runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import at_most
from talkmill.session import cut, discard

MIN_SEGMENTS = 10
FANOUT = 2
BATCHES = 4
#: Settled keys that may be handed to every task.
SHIPPED_KEYS = 200_000


class LineRuns:
    """How many segments hold each line, as immutable sorted runs in a shared folder.

    A run holds ``h1, h2`` (128-bit hash of a line's key) and ``n``, the segments of its
    batches that hold the line, as a table of ``buckets`` by hash, each sorted.  So a new
    batch, counted and dealt the same way, is merge-joined with the runs bucket by bucket,
    and no run is shuffled again.  The batch is anti-joined with the settled keys (those
    found in ``minimum`` segments already); what is left becomes a run of level 0.
    ``fanout`` runs of a level are compacted into one of the next, which drops keys settled
    meanwhile, so a key is rewritten once a level.  ``runs`` and ``settled`` name the folders
    that make up the state; a batch that failed half way has not changed them, and a later
    session goes on with them if it names as many buckets.
    """

    def __init__(self, spark, folder: str, minimum: int = MIN_SEGMENTS, fanout: int = FANOUT,
                 buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.minimum, self.fanout = minimum, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.settled: list[str] = []

    def add(self, keys: DataFrame) -> None:
        """Add a batch: rows ``h1, h2``, one per segment and distinct line."""
        fresh = cut(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
                    .join(self.settled_keys(), ["h1", "h2"], "left_anti"))
        held = fresh
        for _, run in self.runs:
            held = held.unionByName(self.met(run, fresh))
        total = held.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        now = self._write(total.where(F.col("n") >= self.minimum))
        self.settled = [*self.settled, now]
        left = fresh.join(self._read(now), ["h1", "h2"], "left_anti")
        self.runs = [*self.runs, (0, self._write(left))]
        self._compact()

    def met(self, run: str, fresh: DataFrame) -> DataFrame:
        """The rows of a run whose keys a batch has."""
        return self._read(run).join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"],
                                    "left_semi")

    def settled_keys(self) -> DataFrame:
        """``h1, h2`` of all lines found in ``minimum`` segments or more."""
        keys = self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        for part in self.settled:
            keys = keys.unionByName(self._read(part).select("h1", "h2"))
        return keys

    def _compact(self) -> None:
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = self._read(full[0][1])
            for _, run in full[1:]:
                merged = merged.unionByName(self._read(run))
            merged = (merged.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
                      .join(self.settled_keys(), ["h1", "h2"], "left_anti"))
            new = self._write(merged)
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, new)]
            for _, run in full:
                self.spark.sql(f"DROP TABLE IF EXISTS {run}")
                discard(self.spark, f"{self.folder}/{run}")
            level += 1

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.repartition(self.buckets, "h1", "h2").write.format("parquet")
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def _read(self, run: str) -> DataFrame:
        if not self.spark.catalog.tableExists(run):
            self.spark.sql(
                f"CREATE TABLE {run} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY "
                f"(h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.folder}/{run}'")
        return self.spark.table(run)

    def discard(self) -> None:
        """Forget all runs and delete their files."""
        for run in [*self.settled, *[r for _, r in self.runs]]:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs, self.settled = [], []
        discard(self.spark, self.folder)


def line_keys(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """Lines of a UTF-8 text and their keys' hashes as pairs of longs.  A key is the line
    without ASCII white space at its ends, A-Z lower-cased; an empty key hashes to (0, 0)."""
    lines = data.split(b"\n")
    digest = xxhash.xxh3_128_digest
    keys = [line.strip() for line in data.lower().split(b"\n")]
    joined = b"".join(digest(key) if key else bytes(16) for key in keys)
    return lines, np.frombuffer(joined, "<i8").reshape(-1, 2)


def distinct_line_keys(segments: DataFrame, batches: int) -> DataFrame:
    """``batch, h1, h2``: once per segment and distinct line with a key."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            numbers, hashes = [], []
            for number, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                keys = np.unique(line_keys(text.as_py() or b"")[1], axis=0)
                keys = keys[(keys != 0).any(axis=1)]
                numbers.append(np.full(len(keys), number, np.int32))
                hashes.append(keys)
            keys = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(numbers) if numbers else [], pa.int32()),
                 pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["batch", "h1", "h2"])

    batch = F.pmod(F.xxhash64("sequence_id"), F.lit(batches)).cast("int").alias("batch")
    return segments.select(batch, F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "batch int, h1 bigint, h2 bigint")


def drop_repeated_lines(segments: DataFrame, folder: str, minimum: int = MIN_SEGMENTS,
                        batches: int = BATCHES, fanout: int = FANOUT,
                        shipped: int = SHIPPED_KEYS) -> DataFrame:
    """Drop every line whose key is found in ``minimum`` segments or more.

    Reads ``sequence_id`` and ``text``.  Returns one row per row read: ``sequence_id,
    n_lines, n_dropped, text`` (the lines that stay, joined by a line feed).  ``folder`` is
    new, on storage that all executors share, and holds the line runs until all are counted;
    the segments are added to them in ``batches`` by hash of the id, as they would arrive.

    A line of any number of segments is counted map-side.  If at most ``shipped`` keys are
    settled (checked), every task gets them and segments do not move; beyond that, lines are
    joined with them by hash and only places of dropped lines come back to a segment.

    Lines end at line feeds only.  A null or empty text is one empty line; lines of white
    space have no key and stay.  Every row counts as a segment of its own, also rows that
    repeat an id.
    """
    runs = LineRuns(segments.sparkSession, folder, minimum, fanout)
    keys = cut(distinct_line_keys(segments, batches))
    for number in range(batches):
        runs.add(keys.where(F.col("batch") == number).select("h1", "h2"))
    settled = cut(runs.settled_keys())
    runs.discard()
    kind = segments.schema["sequence_id"].dataType.simpleString()
    schema = f"sequence_id {kind}, n_lines bigint, n_dropped bigint, text binary"
    texts = segments.select("sequence_id", F.col("text").cast("binary").alias("text"))
    if at_most(settled, shipped):
        pairs = np.array([tuple(r) for r in settled.collect()], np.int64).reshape(-1, 2)
        out = texts.mapInArrow(_dropper(frozenset(p.tobytes() for p in pairs)), schema)
    else:
        out = _placed(texts, settled).mapInArrow(_dropper(None), schema)
    return out.withColumn("text", F.col("text").cast("string"))


def _dropper(settled: frozenset | None):
    """Applies shipped keys, or else the places in a third column."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, dropped, texts = [], [], []
            for i, text in enumerate(part.column(1)):
                data = text.as_py() or b""
                if settled is None:
                    lines, gone = data.split(b"\n"), set(part.column(2)[i].as_py() or ())
                else:
                    lines, keys = line_keys(data)
                    gone = {n for n, k in enumerate(keys) if k.tobytes() in settled}
                counts.append(len(lines))
                dropped.append(len(gone))
                texts.append(data if not gone else b"\n".join(
                    line for n, line in enumerate(lines) if n not in gone))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(texts, pa.binary())], ["sequence_id", "n_lines", "n_dropped", "text"])
    return run


def _placed(texts: DataFrame, settled: DataFrame) -> DataFrame:
    """Texts with the places of their lines to drop."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for own, text in zip(part.column(0), part.column(1), strict=True):
                keys = line_keys(text.as_py() or b"")[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.as_py()] * len(keys), own.type),
                     pa.array(np.arange(len(keys))), pa.array(keys[:, 0]),
                     pa.array(keys[:, 1])], ["own", "place", "h1", "h2"])

    # Rows of equal id and text lose the same lines, so the two identify a row well enough.
    own = F.sha2(F.concat(F.coalesce(F.col("sequence_id").cast("string"), F.lit("")).cast("binary"), F.lit("|").cast("binary"), F.coalesce("text", F.lit(b""))), 256)
    found = (texts.select(own.alias("own"), "text")
             .mapInArrow(run, "own string, place bigint, h1 bigint, h2 bigint")
             .join(settled, ["h1", "h2"], "left_semi")
             .groupBy("own").agg(F.collect_set("place").alias("places")))
    return (texts.withColumn("own", own).join(found, "own", "left")
            .select("sequence_id", "text", "places"))
