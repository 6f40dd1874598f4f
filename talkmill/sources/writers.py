"""Sinks: subtitles, reports, event logs, job records, metrics exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators.ordered import Scan, scan
from talkmill.operators.rules import timed_lines
from talkmill.operators.timeline import trim_cues


# -- subtitles -----------------------------------------------------------------------------

def subtitle_cues(lines: DataFrame, key: list[str], order: list[str], blk: str | None,
                  dual: bool = False, width: int = 42) -> DataFrame:
    """Cues of translated lines: wrapped text, no overlap, numbered per media file."""
    kept = timed_lines(lines)
    body = X.dual_body(X.wrap("translated_text", width), F.col("source_text"), dual)
    cues = kept.withColumn("body", body)
    place = ["start_s", *order]
    return scan(trim_cues(cues, key, place, blk), key, place, blk, cue=Scan("number"))


def live_cues(lines: DataFrame, dual: bool = False, minimum: float = 0.8) -> DataFrame:
    """Cues as a live writer makes them: speaker prefix, own floor for a zero length."""
    end = F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + minimum).otherwise(
        F.col("end_s"))
    prefix = F.coalesce(F.concat(F.lit("[Speaker "), F.col("speaker").cast("string"),
                                 F.lit("] ")), F.lit(""))
    said = F.concat(prefix, X.strip(F.coalesce("translated_text", F.lit(""))))
    original = X.strip(F.coalesce("source_text", F.lit("")))
    body = F.when(original == "", said).otherwise(F.concat_ws("\n", said, original)) \
        if dual else said
    return lines.withColumns({"end_s": end, "body": body})


def cue_block(style: str, number: Column | str = "cue") -> Column:
    """Text of one cue in ``srt`` or ``vtt`` form."""
    mark = "," if style == "srt" else "."
    times = F.concat(X.timestamp("start_s", mark), F.lit(" --> "), X.timestamp("end_s", mark),
                     F.lit("\n"), F.col("body"), F.lit("\n"))
    return times if style == "vtt" else F.concat(
        X.col(number).cast("string"), F.lit("\n"), times)


def documents(cues: DataFrame, key: list[str], style: str, number: str = "cue") -> DataFrame:
    """One subtitle document per media file.

    A document is one file and so one value; its cues are bounded by the media's length.
    For a feed without such a bound write :func:`cue_block` rows sorted instead.
    """
    blocks = cues.select(*key, number, cue_block(style, number).alias("_b"))
    joined = blocks.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct(number, "_b"))), lambda x: x["_b"]), "\n").alias("document"))
    if style == "vtt":
        joined = joined.withColumn("document", F.concat(F.lit("WEBVTT\n\n"), "document"))
    return joined


def write_documents(docs: DataFrame, path: str, key: str, column: str = "document") -> None:
    """Write one text file per key, in its own partition folder.

    A document is one row, so no shuffle is needed.  The text sink ends the file with the
    line break that a document ends with.
    """
    docs.select(key, F.regexp_replace(column, "\n$", "").alias("value")).write.mode(
        "overwrite").partitionBy(key).text(path)


def write_cues(cues: DataFrame, path: str, key: str, style: str, number: str = "cue") -> None:
    """Write cues without building documents: for feeds of any length.

    Cues are range-partitioned by (key, number), so a long feed becomes several part files
    whose order is the cue order; a WebVTT reader adds the header line.
    """
    cues.select(key, number, cue_block(style, number).alias("value")).repartitionByRange(
        key, number).sortWithinPartitions(key, number).drop(number).write.mode(
        "overwrite").partitionBy(key).text(path)


# -- flat reports --------------------------------------------------------------------------

def flatten(df: DataFrame, skip: tuple[str, ...] = ("per_item",)) -> DataFrame:
    """One level of structs to ``a.b`` columns; lists, maps and deeper structs go."""
    plain = lambda t: not isinstance(t, (T.ArrayType, T.MapType, T.StructType))
    out = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}")
                    for g in f.dataType.fields if plain(g.dataType)]
        elif plain(f.dataType):
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def union_rows(*parts: DataFrame) -> DataFrame:
    """Component rows of different shapes as one table with the columns of all."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_reports(results: DataFrame, path: str) -> None:
    """Full rows as JSON lines and flat rows as CSV with sorted columns."""
    results.write.mode("overwrite").json(f"{path}/json")
    flat = flatten(results)
    flat.select(*[F.col(f"`{c}`") for c in sorted(flat.columns)]).write.mode(
        "overwrite").csv(f"{path}/csv", header=True)


def cell(value: Column, kind: T.DataType) -> Column:
    """Table text: ``-`` for null, three decimals below 100, else one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = F.when(F.abs(value) < 100, F.format_string("%.3f", value)).otherwise(
            F.format_string("%.1f", value))
        return F.when(value.isNull(), "-").otherwise(shown)
    if isinstance(kind, T.BooleanType):
        value = F.initcap(value.cast("string"))
    return F.coalesce(value.cast("string"), F.lit("-"))


def markdown_rows(results: DataFrame, component: str) -> DataFrame:
    """The ``line`` of every result in the component's table."""
    flat = flatten(results)
    kinds = {f.name: f.dataType for f in flat.schema.fields}
    cells = [cell(F.col(f"`{name}`"), kinds[name]) if name in kinds else F.lit("-")
             for _, name in dims.REPORT_COLUMNS[component]]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return flat.where(F.col("component") == component).withColumn("line", line)


def markdown_table(results: DataFrame, component: str, order: list[str]) -> DataFrame:
    """The whole table as one text; results are a few rows per model."""
    heads = [h for h, _ in dims.REPORT_COLUMNS[component]]
    top = ("| " + " | ".join(heads) + " |\n" + "| " + " | ".join("---" for _ in heads) + " |")
    rows = markdown_rows(results, component)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        *[F.col(f"`{o}`") for o in order], F.col("line")))), lambda r: r["line"]), "\n")
    return rows.agg(F.concat(F.lit(f"## {component}\n\n{top}\n"), lines).alias("markdown"))


# -- event log, jobs, metrics ----------------------------------------------------------------

def envelopes(events: DataFrame) -> DataFrame:
    """Event rows -> flattened JSON envelopes.

    The payload object is spliced in as text after the fixed fields, so its values keep
    their types and win over a fixed field of the same name.
    """
    head = F.to_json(F.struct(
        F.col("event_type").alias("event"), "session_id", "sequence_id",
        (F.unix_micros("ts") / 1e6).alias("timestamp")))
    body = F.regexp_extract(F.coalesce("payload", F.lit("{}")), r"(?s)^\s*\{(.*)\}\s*$", 1)
    open_head = F.left(head, F.char_length(head) - 1)
    value = F.concat(open_head, F.when(F.trim(body) == "", "").otherwise(
        F.concat(F.lit(","), body)), F.lit("}"))
    return events.select("session_id", "sequence_id", value.alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines, every file sorted by session and sequence."""
    envelopes(events).repartitionByRange("session_id", "sequence_id").sortWithinPartitions(
        "session_id", "sequence_id").select("value").write.mode("overwrite").text(path)


def job_records(jobs: DataFrame, payload: str = "payload") -> DataFrame:
    """Job rows with the selected input fields only, as one JSON text per job."""
    data = F.from_json(payload, "map<string,string>")
    chosen = F.map_filter(data, lambda k, v: k.isin(dims.JOB_INPUT_FIELDS))
    names = [c for c in jobs.columns if c != payload]
    return jobs.select("job_id", "status", F.to_json(F.struct(
        *names, chosen.alias("input"))).alias("record"))


def write_jobs(jobs: DataFrame, path: str) -> None:
    job_records(jobs).write.mode("overwrite").partitionBy("status").json(path)


def exposition(metrics: DataFrame, prefix: str = "talkmill") -> DataFrame:
    """Metric rows (name, type, quantile, value) -> exposition text lines in order."""
    name = F.concat(F.lit(prefix + "_"), "name")
    tag = F.when(F.col("quantile").isNotNull(), F.concat(
        F.lit('{quantile="'), "quantile", F.lit('"}'))).otherwise("")
    number = F.when(F.col("quantile").isNotNull(), F.format_string("%.6f", F.col("value"))
                    ).otherwise(F.col("value").cast("bigint").cast("string"))
    return metrics.select("name", "quantile", F.concat(
        F.lit("# TYPE "), name, F.lit(" "), "type").alias("header"),
        F.concat(name, tag, F.lit(" "), number).alias("line"))
