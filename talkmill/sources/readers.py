"""Sources: manifests, corpora, media folders, reports, event logs, truth sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.sources.media import media_files

ITEM_FIELDS = ["id", "audio", "source_language", "target_language", "reference_text",
               "reference_translation", "category"]
ITEM_SCHEMA = ", ".join(f"{f} string" for f in ITEM_FIELDS)


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Benchmark items from JSON manifests: a bare list, or ``{version, items}``.

    The two shapes are read with one schema; a file of the other shape has nulls there.
    Relative media paths are resolved against the manifest's folder.
    """
    item = "struct<" + ", ".join(f"{f}: string" for f in ITEM_FIELDS) + ">"
    raw = (spark.read.schema(f"version string, items array<{item}>, {ITEM_SCHEMA}")
           .json(paths, multiLine=True).withColumn("_file", F.col("_metadata.file_path")))
    own = F.struct(*ITEM_FIELDS)
    rows = raw.select("_file", F.explode(F.when(
        F.col("items").isNotNull(), F.col("items")).otherwise(F.array(own))).alias("r"))
    rows = rows.select("_file", "r.*").where(F.col("id").isNotNull())
    folder = F.regexp_replace(F.regexp_extract("_file", r"^(.*)/[^/]*$", 1), "^file:/*", "/")
    media = F.when(F.coalesce("audio", F.lit("")) == "", "").when(
        F.col("audio").startswith("/"), F.col("audio")).otherwise(
        F.concat(folder, F.lit("/"), F.col("audio")))
    return rows.withColumns({"audio": media, "category": F.coalesce(
        "category", F.lit("speech"))}).withColumnRenamed("_file", "manifest")


def content_version(content: Column) -> Column:
    """First twelve hex digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 12)


def manifest_versions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", content_version(F.col("content")).alias("version"))


def read_corpus(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated corpus lines without quoting; the first line of every id stays.

    Lines keep their place (file, byte order within it) through ``monotonically_increasing_id``
    taken directly at the scan, before anything moves them.
    """
    from talkmill.operators.joins import first_per_id

    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.csv(path, sep="\t", quote="", schema=schema)
    placed = rows.withColumn("_line", F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id()))
    return first_per_id(placed, columns[0], "_line").drop("_line")


def scan_media(spark: SparkSession, root: str, source: str, target: str,
               suffixes: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Media files under a folder as items: the file stem is the id.

    Only names are read.  ``limit`` keeps the first files in path order (Spark's bounded
    top-n).
    """
    files = media_files(spark, root, 0, suffixes or list(dims.MEDIA_TYPES)).select("path")
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        F.regexp_extract(name, r"^(.*)\.[^.]+$", 1).alias("id"), F.col("path").alias("audio"),
        F.lit(source).alias("source_language"), F.lit(target).alias("target_language"))


def container_type(head: Column) -> Column:
    """Coarse container type from the first bytes, or null."""
    code = F.hex(F.substring(head, 1, 12))
    at = lambda first, count: F.substring(code, 2 * first + 1, 2 * count)
    # Magic numbers of the containers.
    sync = (at(0, 1) == "FF") & at(1, 1).rlike("^[EF]")
    return (F.when((at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "wav")
            .when((at(0, 3) == "494433") | sync, "mp3")
            .when(at(4, 4) == "66747970", "isobmff")
            .when(at(0, 4) == "1A45DFA3", "matroska")
            .when(at(0, 4) == "664C6143", "flac")
            .when(at(0, 4) == "4F676753", "ogg"))


def audit_verdict(name: Column, size: Column, head: Column, max_bytes: int) -> Column:
    """Why a media file is refused, or null: type, content, size, emptiness."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in dims.MEDIA_TYPES.items() for x in kv])
    expected = F.try_element_at(table, suffix)
    return (F.when(expected.isNull(), "unsupported_type")
            .when(~container_type(head).eqNullSafe(expected), "content_mismatch")
            .when(size > max_bytes, "too_large").when(size == 0, "empty"))


def audit_media(spark: SparkSession, root: str, max_bytes: int = 2048 << 20) -> DataFrame:
    """Audit a media folder: container type by content against the extension.

    Twelve bytes of a file are read at most; a file of zero bytes has a row like any other,
    and no container.  A file over the limit is refused by its name and size alone.
    """
    small = F.col("length") <= max_bytes
    head = F.when(small, F.col("head"))
    known = F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).isin(list(dims.MEDIA_TYPES))
    refused = F.when(known, "too_large").otherwise("unsupported_type")
    return media_files(spark, root).select(
        "path", "length", container_type(head).alias("container"),
        F.when(small, audit_verdict(F.col("path"), F.col("length"), head, max_bytes))
        .otherwise(refused).alias("error"))


REPORT_SCHEMA = "title string, environment map<string,string>, results array<map<string,string>>"


def read_reports(spark: SparkSession, root: str,
                 names: str = "{benchmark,comparison}.json") -> DataFrame:
    """One row per result of every benchmark or comparison report under ``root``.

    Unreadable files are skipped; per-item data and hypotheses are dropped.
    """
    raw = (spark.read.schema(REPORT_SCHEMA + ", _bad string")
           .option("recursiveFileLookup", "true")
           .option("pathGlobFilter", names)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .json(root, multiLine=True).withColumn("path", F.col("_metadata.file_path")))
    good = raw.where(F.col("_bad").isNull())
    row = F.map_filter(F.col("r"), lambda k, v: ~k.isin("per_item", "hypothesis"))
    keep = ["cpu", "ram_gb", "device", "gpu", "commit", "torch"]
    return good.select("path", "title", F.col("environment")["timestamp"].alias("timestamp"),
                       F.map_filter("environment", lambda k, v: k.isin(keep)).alias("environment"),
                       F.explode("results").alias("r")).withColumn("result", row).drop("r")


EVENT_SCHEMA = "session_id string, sequence_id bigint, event_type string, timestamp double"


def parse_events(lines: DataFrame, value: str = "value", unreadable: str | None = None
                 ) -> DataFrame:
    """Flattened event envelopes (JSON text) -> fixed fields and the rest as JSON text.

    ``unreadable`` names a column for lines that are no envelopes, whole; without it they
    are rows of nulls.
    """
    text = F.col(value)
    fixed = F.from_json(text, EVENT_SCHEMA.replace("event_type", "event") + ", _bad string",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, v: ~k.isin(
        "session_id", "sequence_id", "event", "timestamp"))
    bad = F.col("e._bad").isNotNull() | F.col("e.event").isNull()
    more = [] if unreadable is None else [F.when(bad, text).alias(unreadable)]
    return lines.select(fixed.alias("e"), F.to_json(rest).alias("payload"), text).select(
        "e.session_id", "e.sequence_id", F.col("e.event").alias("event_type"),
        F.timestamp_micros((F.col("e.timestamp") * 1e6).cast("bigint")).alias("ts"),
        F.when(~bad, F.col("payload")).alias("payload") if more else F.col("payload"), *more)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream over a folder of JSON lines; lines that are no envelopes come
    whole in ``unreadable``."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
             .load(path))
    return parse_events(lines, unreadable="unreadable")


def truth_timeline(pieces: DataFrame, key: list[str], order: list[str], blk: str | None
                   ) -> DataFrame:
    """Ground-truth spans from pieces with durations: each starts where the last ended."""
    from talkmill.operators.ordered import Scan, scan

    run = scan(pieces, key, order, blk, _end=Scan("sum", F.col("duration"), inclusive=True))
    return run.withColumns({
        "start_s": F.round(F.col("_end") - F.col("duration"), 3),
        "end_s": F.round("_end", 3)}).drop("_end")
