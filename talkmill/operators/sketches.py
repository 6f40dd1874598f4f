"""Latency percentiles from mergeable sketches.

Exact percentiles need all samples of a range at hand.  Here every hour and stage keeps one
quantile sketch of bounded size, and any range of hours is answered by merging theirs: a
dashboard over a year reads a few thousand rows per stage, whatever the traffic was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch: ranks are off by some 0.7 % of the samples, a few kilobytes.
SKETCH_K = 400
#: The rank error to rely on, with a margin.
RANK_ERROR = 0.02


def hourly_sketches(samples: DataFrame, by: list[str], event_time: str, value: str,
                    k: int = SKETCH_K) -> DataFrame:
    """One row per hour and group: ``hour``, ``n``, ``total``, ``low``, ``high``, ``sketch``.

    Null and NaN samples don't count.  Sketches are built on the map side and merged.
    """
    known = samples.where(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(F.date_trunc("hour", event_time).alias("hour"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"),
        F.max(value).alias("high"), F.kll_sketch_agg_double(F.col(value), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of one granularity merged to a coarser one, with the same columns."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_summary(sketches: DataFrame, by: list[str], **shares: float) -> DataFrame:
    """Count, mean and approximate quantiles (``p50=0.5``) of merged sketches per group."""
    return merged_sketches(sketches, by).select(
        *by, "n", (F.col("total") / F.col("n")).alias("mean"), "low", "high", *[
            F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(name)
            for name, share in shares.items()])


def rank_bounds(summary: DataFrame, samples: DataFrame, by: list[str], value: str,
                *names: str) -> DataFrame:
    """The share of samples below, and up to, every quantile of a summary: what the sketch
    says against what is there, as ``<name>_below`` and ``<name>_upto``."""
    met = samples.where(F.col(value).isNotNull() & ~F.isnan(value)).join(
        summary.select(*by, *names), by)
    return met.groupBy(*by).agg(*[
        F.avg((F.col(value) < F.col(n)).cast("double")).alias(f"{n}_below") for n in names], *[
        F.avg((F.col(value) <= F.col(n)).cast("double")).alias(f"{n}_upto") for n in names])
