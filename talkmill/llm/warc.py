"""Web archives (WARC) written and read as plain Spark jobs.

The dialogue records of this library hold no web pages, so these operators take any table of
``page_id``, ``url`` and ``html``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.common import at_most, whole
from talkmill.operators.ordered import Scan, scan
from talkmill.session import cut

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 100
#: Repeated payloads whose first page may be broadcast.
BROADCAST_REPEATED = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES,
                  date: str = DATE, broadcast_repeated: int = BROADCAST_REPEATED) -> None:
    """Write one WARC/1.0 record per row of ``page_id, url, html`` as files of ``folder``.

    Of rows with equal payloads of ``least_bytes`` bytes or more, that with the smallest
    ``page_id`` is a response and the others are revisits without payload that refer to it;
    rows that repeat that id and payload are responses too.  A record is a row of Spark's text
    writer with the blank lines that end a record as separator, so tasks write, retry and
    commit whole files on any file system.

    Only payloads that do repeat are looked up: their digests are counted map-side, and
    their first pages are broadcast if they are few (checked), else joined by digest.  Null
    html is an empty payload, a null url has no target line, a null id gives an empty one,
    which sorts last.
    """
    body = whole("html")
    rows = pages.select("page_id", "url", "html", F.octet_length(body).cast("bigint").alias("_n"),
                        F.sha2(body, 256).alias("_digest"))
    repeated = cut(rows.where(F.col("_n") >= least_bytes).groupBy("_digest")
                   .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
                   .where(F.col("_copies") > 1).drop("_copies"))
    if at_most(repeated, broadcast_repeated):
        repeated = F.broadcast(repeated)
    again = (F.col("_first").isNotNull() & (F.col("_n") >= least_bytes)
             & ~F.col("page_id").eqNullSafe(F.col("_first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("_n").cast("string"), F.lit(BLANK))
    block = F.when(again, http).otherwise(F.concat(http, body))
    lines = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        _line("WARC-Record-ID", _urn("page_id")), _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")),
                   F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(again, F.concat(_line("WARC-Refers-To", _urn("_first")),
                               _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit(BLANK), block)
    (rows.join(repeated, "_digest", "left").select(lines.alias("value"))
     .write.option("lineSep", BLANK).text(folder))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def _urn(column: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")),
                    F.lit(">"))


def read_archive(spark: SparkSession, folder: str,
                 broadcast_others: int = BROADCAST_REPEATED) -> DataFrame:
    """Read uncompressed WARC/1.0 files: one row per record, ``page_id`` (text), ``url``,
    ``record_type``, ``payload_bytes`` and ``payload_digest`` (hex SHA-256, computed from the
    bytes read; of a revisit as its record states them), ``stated_digest``, ``refers_to`` and
    ``payload`` (bytes; null for a revisit).

    The files are split at every occurrence of the version line, also over split boundaries
    of large files, and bytes stay as they are.  Such a candidate may lie inside a payload.
    Each task turns its candidates into (offset, offset of the successor by the stated
    length); the chain of lengths from offset 0 of each file keeps exactly the records that
    it passes through (see :func:`chained`).  A record whose payload holds version lines is
    put together from its fragments.

    An empty file has no records.  Where a length is damaged the chain of that file ends.
    """
    raw = (spark.read.option("lineSep", MAGIC).text(folder)
           .select(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("seq"), "value"))
    parsed = _parsed(raw)
    narrow = cut(parsed.select("file", "block", "seq", "_bytes", "_whole"))
    placed = scan(narrow, ["file"], ["seq"], "block", _before=Scan(
        "sum", F.col("_bytes") + len(MAGIC), default=F.lit(0)))
    at = F.col("_before") - len(MAGIC)
    candidates = cut(placed.select("file", "block", "seq", at.alias("at"), "_bytes", (
        at + len(MAGIC) + F.col("_whole")).alias("next")).where(F.col("at") >= 0))
    real = cut(chained(candidates.where(F.col("next").isNotNull())))
    end = F.col("at") + len(MAGIC) + F.col("_bytes")
    intact = real.where(F.col("next") == end)
    broken = real.where(F.col("next") > end)
    # Nearly all fragments are whole records, so the others are taken out, which moves no
    # payload as long as they are few (checked).
    place = ["file", "block", "seq"]
    other = cut(narrow.select(*place).join(intact.select(*place), place, "left_anti"))
    if at_most(other, broadcast_others):
        out = _records(parsed.join(F.broadcast(other), place, "left_anti"))
    else:
        out = _records(parsed.join(intact.select(*place), place))
    if not broken.isEmpty():
        out = out.unionByName(_records(_parsed(_joined(raw, candidates, broken))))
    return out


def chained(candidates: DataFrame, few: int = BROADCAST_REPEATED) -> DataFrame:
    """The ``candidates`` (``file, block, seq, at, next``) that the chain ``at`` -> ``next``
    reaches from offset 0 of each file.

    Candidates whose ``next`` is the following candidate form runs, told by a prefix scan; a
    chain that enters a run goes on to its end.  So only the jumps from the ends of runs are
    left: none in an intact file, one past each version line inside a payload.  Over these,
    pointer jumping reaches all runs within 2^k jumps after k rounds, so rounds grow with the
    logarithm of the jumps of a file.  Tables are checkpointed.
    """
    linked = scan(candidates, ["file"], ["seq"], "block", _from=Scan("lag", F.col("next")))
    opens = F.coalesce(F.col("_from") != F.col("at"), F.lit(True)).cast("bigint")
    runs = cut(scan(linked, ["file"], ["seq"], "block", run=Scan("sum", opens, inclusive=True))
               .drop("_from"))
    ends = cut(runs.groupBy("file", "run").agg(
        F.min("at").alias("first"), F.max_by("next", "at").alias("next")))
    side = F.broadcast(ends) if at_most(ends, few) else ends
    jump = cut(runs.select("file", "at", F.col("run").alias("to")).join(
        side.select("file", "run", F.col("next").alias("at")), ["file", "at"])
        .select("file", "run", "to", F.col("at").alias("entry")))
    reached = ends.where("first = 0").select("file", "run", F.col("first").alias("entry"))
    far = jump
    known = cut(reached.select("file", "run"))
    while not far.isEmpty():
        ahead = known.join(far, ["file", "run"]).select("file", F.col("to").alias("run"))
        known = cut(known.unionByName(ahead).distinct())
        onward = far.select("file", F.col("run").alias("to"), F.col("to").alias("_far"))
        far = cut(far.join(onward, ["file", "to"]).select("file", "run", F.col("_far").alias("to")))
    # A run is entered where the end of a reached one leads, once at most.
    entered = cut(reached.unionByName(jump.join(known, ["file", "run"]).select(
        "file", F.col("to").alias("run"), "entry")))
    side = F.broadcast(entered) if at_most(entered, few) else entered
    return runs.join(side, ["file", "run"]).where(F.col("at") >= F.col("entry")).drop("run", "entry")


def _parsed(raw: DataFrame) -> DataFrame:
    """Header of the record that would start at each fragment, and its whole length."""
    head = F.substring_index("value", BLANK, 1)
    size = F.octet_length("value").cast("bigint")
    has_head = F.octet_length(head) < size
    length = F.when(has_head, _field("_head", "Content-Length", r"(\d{1,18})").cast("bigint"))
    return (raw.withColumn("_bytes", size).withColumn("_head", head)
            .withColumn("_length", length)
            .withColumn("_whole", F.octet_length("_head") + 2 * len(BLANK) + F.col("_length")))


def _field(head: str, name: str, value: str = r"([^\r\n]*?)") -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*{value}[ \t]*(?:\r\n|$)", 1)
    return F.nullif(found, F.lit(""))


def _records(parsed: DataFrame) -> DataFrame:
    block = F.expr("substring(cast(value AS binary), octet_length(_head) + 5, "
                   "cast(_length AS int))")
    http = F.substring_index(F.col("_block").cast("string"), BLANK, 1)
    wrapped = F.coalesce(_field("_head", "Content-Type").startswith("application/http"),
                         F.lit(False))
    payload = F.when(wrapped, F.expr("substring(_block, octet_length(_http) + 5)")
                     ).otherwise(F.col("_block"))
    rows = (parsed.withColumn("_block", block).withColumn("_http", http)
            .withColumn("record_type", _field("_head", "WARC-Type")))
    again = F.col("record_type") == "revisit"
    stated = F.regexp_replace(_field("_head", "WARC-Payload-Digest"), "^sha256:", "")
    rows = rows.withColumn("payload", F.when(again, F.lit(None)).otherwise(payload))
    return rows.select(
        _named("WARC-Record-ID").alias("page_id"),
        _field("_head", "WARC-Target-URI").alias("url"), "record_type",
        F.when(again, _field("_http", "Content-Length").cast("bigint"))
        .otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(again, stated).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        stated.alias("stated_digest"), _named("WARC-Refers-To").alias("refers_to"), "payload")


def _named(name: str) -> Column:
    return F.nullif(F.regexp_extract(_field("_head", name), "^<urn:page:(.*)>$", 1), F.lit(""))


def _joined(raw: DataFrame, candidates: DataFrame, broken: DataFrame) -> DataFrame:
    """Records with version lines inside, put together from their fragments in file order.
    Only their fragments are read again; a record is as large a value as it was before."""
    spans = broken.select("file", F.col("at").alias("owner"), F.col("next").alias("stop"))
    marked = scan(candidates.join(spans, (candidates["file"] == spans["file"])
                                  & (candidates["at"] == spans["owner"]), "left")
                  .select(candidates["file"], "block", "seq", "at", "owner", "stop"),
                  ["file"], ["seq"], "block",
                  _owner=Scan("max", F.col("owner"), inclusive=True),
                  _stop=Scan("max", F.col("stop"), inclusive=True))
    parts = marked.where(F.col("at") < F.col("_stop")).select(
        "file", "block", "seq", F.col("_owner").alias("owner"))
    whole_value = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("seq_no", "value"))), lambda p: p["value"]), MAGIC)
    numbered = raw.join(parts, ["file", "block", "seq"]).select(
        "file", "owner", F.struct("block", "seq").alias("seq_no"), "value")
    return numbered.groupBy("file", "owner").agg(whole_value.alias("value")).select(
        "file", F.lit(0).alias("block"), F.col("owner").alias("seq"), "value")
