"""Secret scans of transcript revisions with a ledger of scanned texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import at_most, whole
from talkmill.session import cut

#: Name of the rules below; raise it with every change, so that old blobs are scanned again.
RULES = "base-1"

_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
                for word in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind -> (pattern, a cheaper pattern that any valid match contains, shortest valid length,
#: group measured).
BASE = {
    "assign": (rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
               rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{12}}", 12, 2),
    # A match runs to the end of its letters, so asking for the length finds the same ones.
    "access": (r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}", 18, 0),
    "hex": (r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 16, 0),
}
#: Blobs that may be broadcast to pick the revisions to scan.
BROADCAST_BLOBS = 200_000
LEDGER_SCHEMA = ("blob string, rules string, n_assign bigint, n_access bigint, n_hex bigint, "
                 "spans string")


def scan_revisions(revisions: DataFrame, ledger: str, rules: str = RULES,
                   broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """Find secrets in every revision of every transcript, scanning each text once.

    Reads ``session_id``, ``revision`` and ``text`` of all historical versions.  Returns one
    row per row read: ``session_id, revision, blob`` (SHA-256 of the text), ``n_assign,
    n_access, n_hex`` and ``spans``: ``kind:start:end`` of all findings by start, then kind
    as listed in :data:`BASE`, comma-joined; code points, end exclusive.

    ``ledger`` is a folder on storage that all executors share.  It holds one row per scanned
    (blob, rule version).  Only pairs that are not there are scanned: one revision of each
    unseen blob is picked with a map-side aggregate, so a text that a third of all revisions
    share is read once.  Texts are scanned where they are read as long as the blobs that
    repeat or are known (or those that are new) are at most ``broadcast_blobs``.  The new rows are appended to the ledger (a failed append leaves no
    part of it) and findings are joined back to all revisions; only blobs with findings take
    part in that join, clean ones need no row.

    Null text counts as empty; null or repeated ids are carried as they are; the ledger may
    be missing at first.
    """
    spark = revisions.sparkSession
    named = revisions.select("session_id", "revision", whole().alias("text"),
                             F.sha2(whole(), 256).alias("blob"))
    known = _read(spark, ledger).where(F.col("rules") == rules).select("blob")
    copy = F.struct("session_id", "revision")
    blobs = cut(named.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"), F.min(copy).alias("copy"))
                .join(known.distinct().withColumn("known", F.lit(True)), "blob", "left"))
    unseen = _unseen(named, blobs, broadcast_blobs).select("blob", "text")
    fresh = base_findings(unseen).select("blob", F.lit(rules).alias("rules"), "n_assign",
                                         "n_access", "n_hex", "spans")
    fresh.write.mode("append").parquet(ledger)
    # Cut, so that both sides of the join are plain shuffles and a hot blob can be split.
    found = cut(_read(spark, ledger).where((F.col("rules") == rules) & (F.col("spans") != ""))
                .drop("rules").dropDuplicates(["blob"]))
    counts = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
              for n in ("n_assign", "n_access", "n_hex")]
    return (named.drop("text").join(found, "blob", "left")
            .select("session_id", "revision", "blob", *counts,
                    F.coalesce("spans", F.lit("")).alias("spans")))


def _unseen(named: DataFrame, blobs: DataFrame, few: int) -> DataFrame:
    """One revision of every blob that the ledger doesn't have.

    Texts stay where they are read if either the blobs that need a decision (repeated or
    known ones) or those to be scanned are few; else they are shuffled by blob."""
    wanted = blobs.where(F.col("known").isNull())
    special = blobs.where((F.col("copies") > 1) | F.col("known").isNotNull())
    mine = (F.col("session_id").eqNullSafe(F.col("copy.session_id"))
            & F.col("revision").eqNullSafe(F.col("copy.revision")))
    if at_most(special, few):
        told = named.join(F.broadcast(special), "blob", "left")
        return told.where(F.col("copies").isNull() | (F.col("known").isNull() & mine))
    side = F.broadcast(wanted) if at_most(wanted, few) else wanted.hint("shuffle_hash")
    return named.join(side.select("blob", "copy"), "blob").where(mine)


def _read(spark, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def base_findings(blobs: DataFrame) -> DataFrame:
    """Findings per blob (``blob``, ``text``), also for blobs without any.

    A pattern's matches and the text between them are split off; a running sum of their
    lengths gives the positions.  The sum is a window per (blob, kind), so a text with a
    million matches is sorted, not folded in a row.
    """
    may = {kind: F.col("text").rlike(rule[1]) for kind, rule in BASE.items()}
    marked = blobs.select("blob", "text", *[hit.alias(f"_{kind}") for kind, hit in may.items()])
    pieces = [F.when(F.col(f"_{kind}"), _pieces(kind)).otherwise(F.array().cast(_PIECES))
              for kind in BASE]
    # One row per text without findings too: the ledger records that it was scanned.
    each = marked.select("blob", F.posexplode_outer(F.concat(*pieces)).alias("_i", "_p"))
    # Rows that repeat an id and text are both scanned; they count once.
    each = each.dropDuplicates(["blob", "_i"])
    along = Window.partitionBy("blob", "_p.rank").orderBy("_i")
    ends = each.withColumn(
        "_end", F.sum(F.col("_p.gap") + F.col("_p.size")).over(along))
    names = F.element_at(F.array(*[F.lit(kind) for kind in BASE]), F.col("_p.rank"))
    span = F.struct((F.col("_end") - F.col("_p.size")).alias("start"), F.col("_p.rank"),
                    F.concat_ws(":", names, (F.col("_end") - F.col("_p.size")).cast("string"),
                                F.col("_end").cast("string")).alias("span"))
    valid = F.col("_p.valid")
    per_kind = [F.count(F.when(valid & (F.col("_p.rank") == i + 1), 1)).alias(f"n_{kind}")
                for i, kind in enumerate(BASE)]
    return ends.groupBy("blob").agg(
        *per_kind, F.array_join(F.transform(F.array_sort(F.collect_list(F.when(valid, span))),
                                            lambda s: s["span"]), ",").alias("spans"))


_PIECES = "array<struct<rank:int,gap:int,size:int,valid:boolean>>"


def _pieces(kind: str) -> Column:
    """Lengths of every match and of the text in front of it."""
    pattern, _, shortest, group = BASE[kind]
    rank = list(BASE).index(kind) + 1
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    gaps = F.split("text", pattern)
    return F.transform(
        F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match"),
                              measured.alias("measured")), lambda x: x["match"].isNotNull()),
        lambda x: F.struct(F.lit(rank).alias("rank"), F.char_length(x["gap"]).alias("gap"),
                           F.char_length(x["match"]).alias("size"),
                           (F.char_length(x["measured"]) >= shortest).alias("valid"))
    ).cast(_PIECES)
