"""The corpus pipeline: documents to a mix of clean, distinct training documents.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
the documents that it keeps, with the columns they came with, whatever those are; the last
one returns the mix.  :func:`run` applies all to ``documents`` and writes each result to the
shared folder in between, so that a lost executor costs part of a stage.

All stages judge rows one by one, by ``doc_id`` and a hash of the text: a row's verdict does
not touch other texts of its id, or other rows without an id.  Of rows that are equal in both,
the copies stages keep one.  Null texts are empty texts.  An empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.llm.bytenet import UNKNOWN, WINDOW, detect_language, learn_languages
from talkmill.llm.common import at_most, whole
from talkmill.llm.copies import exact_copies
from talkmill.llm.mixing import mix_sessions
from talkmill.llm.queries_corpus import documents, judged_overlap, segments_of
from talkmill.llm.simhash import near_copies
from talkmill.session import cut, shared_folder

#: Rows to drop that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of the mix that may be broadcast to the texts.
BROADCAST_USED = 250_000


def _key(*more: Column) -> Column:
    """Names rows by id and text; sorts rows without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"),
                    F.xxhash64(whole()).alias("version"), *more)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Documents as segments named by their keys."""
    return segments_of(docs.withColumn("doc_id", _key(*more)))


def _without(docs: DataFrame, dropped: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` whose key is not in the first column of ``dropped``."""
    key = F.col(dropped.columns[0])
    gone = cut(dropped.select(key["id"].alias("_id"), key["version"].alias("_version"))
               .distinct())
    side = F.broadcast(gone) if at_most(gone, few) else gone.hint("shuffle_hash")
    return docs.join(side, (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_version"])
                     & docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One of the rows of every key.  Only texts whose key repeats are shuffled."""
    repeated = cut(docs.select(_key().alias("_key")).groupBy("_key").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"))
    if at_most(repeated, 0):
        return docs
    gone = repeated.select(F.col("_key.version").alias("_version"),
                           F.col("_key.id").alias("_id"))
    side = F.broadcast(gone) if at_most(gone, BROADCAST_ROWS) else gone.hint("shuffle_hash")
    some = docs.join(side, (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_version"])
                     & docs["doc_id"].eqNullSafe(gone["_id"]), "left_semi")
    # A row is held whole beside its key, so no name of the input can clash with the key's.
    one = some.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      _key().alias("key")).dropDuplicates(["key"]).select("row.*")
    return _without(docs, repeated).unionByName(one)


#: Labelled documents below the language stage's bar would be this few, were it their quantile.
LOWEST_SHARE = 0.001


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which the network, learned from their labels, reads languages.

    A document goes if it has no letter, or if the network's confidence (the mean of what
    each window gives to its own best language) is nearer to a guess than to what the least
    clear of the labelled documents have: below the middle between 1 / languages and the
    ``LOWEST_SHARE`` quantile of their confidences.  A text shorter than a window is too
    little for that and stays, as does one in several languages, which is read window by
    window.  Without labels there is no network, and all documents stay.
    """
    net = learn_languages(segments_of(docs))
    if net is None:
        return docs
    marks = (F.col("lang").isNotNull().alias("labelled"),
             (F.octet_length(whole()) >= WINDOW).alias("enough"))
    found = cut(detect_language(_keyed(docs, *marks), net))
    enough = F.col("sequence_id.enough")
    known = found.where(F.col("sequence_id.labelled") & enough & (F.col("detected") != UNKNOWN))
    least = known.agg(F.percentile_approx("confidence", LOWEST_SHARE, 100_000)).head()[0]
    guess = 1 / len(net.languages)
    bar = 0.0 if least is None or len(net.languages) == 1 else (guess + least) / 2
    return _without(docs, found.where(
        (F.col("detected") == UNKNOWN) | (enough & (F.col("confidence") < bar))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest, then first, of documents that are equal without white space."""
    return _one_of_each(_without(docs, exact_copies(_keyed(docs)).where(~F.col("kept"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by SimHash."""
    found = near_copies(_keyed(docs))
    return _one_of_each(_without(docs, found.where(
        ~F.col("sequence_id").eqNullSafe(F.col("component_id")))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which benchmark passages make up less than a twentieth."""
    found = judged_overlap(docs.withColumn("doc_id", _key()), spark, sf_dir)
    return _without(docs, found.where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with ``taken`` (words, repeats counted) and ``place``; columns
    of these names, in any case, are not taken over from the input.

    A mix of up to ``BROADCAST_USED`` rows is handed to the texts; a larger one is joined."""
    rows, mix = mix_sessions(segments_of(docs))
    names = ["sequence_id", "session_id", "version"]
    used = mix.groupBy(*names, "row").agg(F.sum("words").alias("taken"),
                                          F.min("place").alias("place"))
    repeated = cut(rows.where(F.col("row").isNotNull()).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select(*names))
    own = [c for c in docs.columns if c.lower() not in ("taken", "place")]

    def same(other: DataFrame) -> Column:
        return ((F.xxhash64(docs["text"]) == other["version"])
                & docs["doc_id"].eqNullSafe(other["sequence_id"])
                & docs["source"].eqNullSafe(other["session_id"]))

    def placed(side: DataFrame) -> DataFrame:
        if at_most(side, BROADCAST_USED):
            return F.broadcast(side)
        return side.hint("shuffle_hash")

    def chosen(side: DataFrame, *more: Column) -> DataFrame:
        return side.select(*[docs[f"`{c}`"] for c in own], *more)

    if at_most(repeated, 0):
        used = cut(used)
        return chosen(docs.join(placed(used), same(used)),
                      used["taken"], used["place"])
    # Rows that are equal in id, source and text are numbered, each to get its own words.
    again = repeated.select(*[F.col(c).alias(f"_{c}") for c in names])
    here = ((used["version"] == again["_version"])
            & used["sequence_id"].eqNullSafe(again["_sequence_id"])
            & used["session_id"].eqNullSafe(again["_session_id"]))
    single = used.join(again, here, "left_anti")
    several = used.join(again, here, "left_semi").withColumn(
        "_number", F.row_number().over(Window.partitionBy(*names).orderBy("row")))
    numbered = docs.join(repeated, same(repeated), "left_semi").withColumn(
        "_nth", F.row_number().over(Window.partitionBy(
            "doc_id", "source", F.xxhash64("text")).orderBy(F.lit(1))))
    single = cut(single)
    return chosen(docs.join(placed(single), same(single)),
                  single["taken"], single["place"]).unionByName(
        chosen(numbered.join(several, same(several) & (F.col("_nth") == F.col("_number"))),
               several["taken"], several["place"]))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources)]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipelines/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
