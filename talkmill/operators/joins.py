"""Lookups, routing and overlays as joins.  Join strategies are left to Spark, which
broadcasts a side only when its size is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import text as X


def first_per_id(rows: DataFrame, ident: str, line: str) -> DataFrame:
    """The first line of every id (a corpus has several speakers per sentence)."""
    others = [c for c in rows.columns if c != ident]
    return rows.groupBy(ident).agg(
        F.min_by(F.struct(*others), F.col(line)).alias("_r")).select(ident, "_r.*")


def parallel_corpus(source: DataFrame, target: DataFrame, ident: str, text: str,
                    first: int | None = None) -> DataFrame:
    """Sentence pairs by id in numeric id order; ``first`` keeps the first n (a report
    option: Spark runs sort and limit together as a bounded top-n)."""
    pairs = source.select(ident, F.col(text).alias("reference_text")).join(
        target.select(ident, F.col(text).alias("reference_translation")), ident)
    if first is None:
        return pairs
    return pairs.orderBy(F.col(ident).cast("bigint")).limit(first)


def usable(items: DataFrame) -> DataFrame:
    """Items with both references."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return items.where(full("reference_text") & full("reference_translation"))


def one_per_key(rows: DataFrame, key: list[str], values: list[str], order: str | None = None
                ) -> DataFrame:
    """One row per key, so that a lookup never multiplies lines: the last by ``order``, or
    where there is none the greatest values, so that reruns agree."""
    held = F.struct(*values)
    return rows.groupBy(*key).agg(F.max_by(held, F.col(order) if order else held).alias("_r")
                                  ).select(*key, "_r.*")


def route_provider(requests: DataFrame, overrides: DataFrame, default: str) -> DataFrame:
    """Explicit choice, else the override of the target language, else the default."""
    o = one_per_key(overrides.select(F.col("language").alias("target_language"),
                                     F.col("provider").alias("_override")),
                    ["target_language"], ["_override"])
    return requests.join(o, "target_language", "left").withColumn(
        "provider", F.coalesce("explicit", "_override", F.lit(default))).drop("_override")


def route_by_language(requests: DataFrame, engines: DataFrame, fallback: str) -> DataFrame:
    """The primary engine when it lists the language or lists none, else the fallback."""
    e = one_per_key(engines.select(F.col("name").alias("primary"), "languages"),
                    ["primary"], ["languages"])
    serves = (F.size("languages") == 0) | F.array_contains("languages", F.col("language"))
    return requests.join(e, "primary", "left").withColumn("engine", F.when(
        F.coalesce(serves, F.lit(False)), F.col("primary")).otherwise(fallback)
        ).drop("languages")


def supports(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """Add ``supported``: the engine's pair list decides, else its two language lists."""
    pair = F.concat_ws(">", "source_language", "target_language")
    lists = (((F.size("sources") == 0) | F.array_contains("sources", F.col("source_language")))
             & ((F.size("targets") == 0) | F.array_contains("targets", F.col("target_language"))))
    ok = F.when(F.size("pairs") > 0, F.array_contains("pairs", pair)).otherwise(lists)
    engines = one_per_key(engines, ["engine"], ["pairs", "sources", "targets"])
    return (requests.join(engines, "engine", "left")
            .withColumn("supported", F.coalesce(ok, F.lit(False)))
            .drop("pairs", "sources", "targets"))


def voice_for(lines: DataFrame, voices: DataFrame, default: str) -> DataFrame:
    v = one_per_key(voices.select("speaker", F.col("voice").alias("_voice")),
                    ["speaker"], ["_voice"])
    return lines.join(v, "speaker", "left").withColumn(
        "voice", F.coalesce("_voice", F.lit(default))).drop("_voice")


def overlay(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Key-by-key merge: a value given in ``changes`` wins, new keys are added."""
    names = [c for c in base.columns if c != key]
    c = changes.select(F.col(key), *[F.col(n).alias(f"_new_{n}") for n in names
                                     if n in changes.columns])
    merged = base.join(c, key, "full_outer")
    return merged.select(key, *[
        F.coalesce(f"_new_{n}", n).alias(n) if n in changes.columns else F.col(n)
        for n in names])


def pair_catalogue(pairs: DataFrame, languages: DataFrame) -> DataFrame:
    """Language pairs with names; an unknown code is its own name."""
    named = lambda side: languages.select(
        F.col("code").alias(side), F.col("name").alias(f"_{side}"))
    return (pairs.join(named("source"), "source", "left").join(named("target"), "target", "left")
            .select("source", "target", F.coalesce("_source", "source").alias("source_name"),
                    F.coalesce("_target", "target").alias("target_name"), "tier"))


def from_memory(lines: DataFrame, memory: DataFrame) -> DataFrame:
    """Look lines up in a translation memory; unknown ones are marked with the target tag."""
    key = ["source_language", "target_language", "source_text"]
    m = one_per_key(memory.select(*key, F.col("translation").alias("_found")), key, ["_found"])
    marked = F.concat(F.lit("["), "target_language", F.lit("] "), "source_text")
    return lines.join(m, key, "left").withColumn(
        "translated_text", F.coalesce("_found", marked)).withColumn(
        "known", F.col("_found").isNotNull()).drop("_found")


def drop_echo(lines: Column, known: Column) -> Column:
    """Output lines that are not earlier translations; if none is left, the last line."""
    bare = lambda ln: X.strip(F.regexp_replace(ln, "^[=> ]+", ""))
    fresh = F.filter(lines, lambda ln: ~F.array_contains(known, bare(ln)))
    return F.when(F.size(lines) <= 1, lines).when(F.size(fresh) > 0, fresh).otherwise(
        F.slice(lines, -1, 1))
