"""Benchmark items that reappear in training segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import ascii_lower, at_most, whole, word_array
from talkmill.session import cut

#: Words of a window, and distinct benchmark windows that may be broadcast.
WINDOW = 13
BROADCAST_WINDOWS = 400_000
#: Words after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return word_array(ascii_lower(text), WORDS)


def item_windows(bench_items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items' reference texts: ``length``, ``gram`` (its words) and
    ``ids`` of the items that hold it.  An item of fewer words is one window; an item
    without words has none.  Reads ``id`` and ``reference_text``."""
    words = bench_items.select("id", words_of(whole("reference_text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    grams = (words.where(F.size("w") > 0)
             .select("id", F.least(F.size("w"), F.lit(window)).alias("length"),
                     "w", F.explode(starts).alias("at"))
             .select("id", "length",
                     F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ")
                     .alias("gram")))
    return grams.groupBy("length", "gram").agg(F.collect_set("id").alias("ids"))


def overlapping_words(segments: DataFrame, bench_items: DataFrame, window: int = WINDOW,
                      broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Count each segment's words that lie inside an occurrence of a benchmark window.

    Segments give ``sequence_id`` and ``text``; items ``id`` and ``reference_text``.  Returns
    one row per row read: ``sequence_id``, ``n_words``, ``n_hit``, ``runs`` (the hit runs of
    words as ``start, length``, to remove spans) and ``ids`` (sorted as strings, of the items
    that occur).

    One scan: every word position hashes the window that starts there and probes the set of
    benchmark windows; equal words are verified before a hit counts.  The set is broadcast
    if it has at most ``broadcast_windows`` windows (checked), else the windows are shuffled
    and joined.  A position without a hit goes no further than its task, except the first of
    a segment, which carries the word count.

    Null or wordless texts have no words and no hits; null items have no windows; a null id
    is carried as it is; rows that repeat an id are judged each by its own text.
    """
    windows = cut(item_windows(bench_items, window))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    words = segments.select("sequence_id", F.xxhash64(whole()).alias("_v"),
                            words_of(whole()).alias("_w"))
    # Words are hashed once; a window's hash is that of its words' hashes.
    places = words.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).select(
        "sequence_id", "_v", "_w", "_h", F.size("_w").alias("_n"),
        F.posexplode_outer("_h").alias("_at", "_word"))
    hits = cut(_hits(places, windows, lengths or [window], at_most(windows, broadcast_windows)))
    # Equal rows share a group, whose hits are the same, and are told apart again below.
    per = hits.where("_first").groupBy("sequence_id", "_v").agg(
        F.max("_n").alias("n_words"), F.count(F.lit(1)).cast("int").alias("_rows"))
    kept = hits.where(F.col("_length").isNotNull())
    runs = _runs(kept)
    named = kept.groupBy("sequence_id", "_v").agg(F.array_sort(F.array_distinct(F.flatten(
        F.collect_set(F.transform("ids", lambda i: i.cast("string")))))).alias("ids"))
    for side in (runs, named):
        per = per.join(side, per["sequence_id"].eqNullSafe(side["sequence_id"])
                       & (per["_v"] == side["_v"]), "left").select(
            per["*"], *[side[c] for c in side.columns if c not in ("sequence_id", "_v")])
    none = F.array().cast("array<struct<start:int,length:int>>")
    return per.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(
        "sequence_id", F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("runs", none).alias("runs"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def _runs(hits: DataFrame) -> DataFrame:
    """``runs`` and ``n_hit`` of every segment with hits: where a hit starts behind all that
    come before it, a run opens."""
    text = Window.partitionBy("sequence_id", "_v").orderBy("_at", "_length")
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    upto = text.rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_at") + F.col("_length")
    opened = hits.select("sequence_id", "_v", "_at", "_length", end.alias("_end"), F.coalesce(
        F.col("_at") > F.max(end).over(before), F.lit(True)).cast("int").alias("_opens"))
    numbered = opened.withColumn("_run", F.sum("_opens").over(upto))
    each = numbered.groupBy("sequence_id", "_v", "_run").agg(
        F.min("_at").alias("start"), F.max("_end").alias("_end")).withColumn(
        "length", F.col("_end") - F.col("start"))
    return each.groupBy("sequence_id", "_v").agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"),
        F.sum("length").alias("n_hit"))


def _hits(places: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    def words(n: int) -> list[Column]:
        return [F.get("_h", F.col("_at") + i) for i in range(n)]

    # Of the windows of several lengths that start at a word, each is its own probe.
    probes = [F.struct(F.lit(n).alias("length"), F.xxhash64(*words(n)).alias("hash"))
              for n in lengths]
    if len(lengths) == 1:
        probed = places.withColumn("_probe", probes[0]).withColumn("_lead", F.lit(True))
    else:
        probed = places.select("*", F.posexplode(F.array(*probes)).alias("_k", "_probe")
                               ).withColumn("_lead", F.col("_k") == 0)
    here = F.col("_lead") & (F.coalesce(F.col("_at"), F.lit(0)) == 0)
    split = F.split("gram", " ")
    hashed = F.coalesce(*[F.when(F.col("length") == n, F.xxhash64(
        *[F.xxhash64(F.get(split, F.lit(i))) for i in range(n)])) for n in lengths])
    table = windows.select(F.col("length").alias("_length"), "gram", "ids",
                           hashed.alias("_hash"))
    gram = F.array_join(F.slice("_w", F.coalesce(F.col("_at"), F.lit(0)) + 1,
                                F.col("_probe.length")), " ")
    if small:
        joined = probed.join(F.broadcast(table), (F.col("_probe.hash") == F.col("_hash"))
                             & (F.col("_probe.length") == F.col("_length"))
                             & (gram == F.col("gram")), "left")
    else:
        joined = (probed.select("sequence_id", "_v", "_n", "_at", "_probe", "_lead",
                                gram.alias("_gram"))
                  .join(table, (F.col("_probe.hash") == F.col("_hash"))
                        & (F.col("_gram") == F.col("gram")), "left"))
    return joined.where(F.col("_length").isNotNull() | here).select(
        "sequence_id", "_v", "_n", "_at", "_length", "ids", here.alias("_first"))
