"""Exact quantiles by rank selection.

Spark's exact ``percentile`` keeps all distinct values of a group in one buffer.  Here
equal values are counted first (partial aggregation on the map side), the running count
over the sorted distinct values gives every value its ranks, and only the rows that hold a
wanted rank go on.  A group with too many distinct values is split like any hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.operators.ordered import ROWS_PER_BLOCK, Scan, scan, split_hot


def _ranked(df: DataFrame, by: Sequence[str], value: str, rows: int) -> DataFrame:
    counted = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
               .agg(F.count(F.lit(1)).alias("_c")))
    counted, blk = split_hot(counted, by, value, rows)
    ranked = scan(counted, by, [value], blk, _upto=Scan("sum", F.col("_c"), inclusive=True))
    if blk is None:
        everything = Window.partitionBy(*by)
        return ranked.withColumn("_n", F.sum("_c").over(everything))
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    return ranked.join(sizes, list(by))


def _at(value: str, rank: Column) -> Column:
    holds = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
    return F.max(F.when(holds, F.col(value)))


def linear(df: DataFrame, by: Sequence[str], value: str, rows: int = ROWS_PER_BLOCK,
           **shares: float) -> DataFrame:
    """Linearly interpolated quantiles, e.g. ``p50=0.5``; one row per group."""
    by = list(by)
    ranked = _ranked(df, by, value, rows)
    aggs = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        aggs += [_at(value, F.floor(place)).alias(f"_lo_{name}"),
                 _at(value, F.ceil(place)).alias(f"_hi_{name}")]
    picked = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        picked = picked.withColumn(name, low + (high - low) * (place - F.floor(place)))
    return picked.select(*by, *shares)


def nearest(df: DataFrame, by: Sequence[str], value: str, rows: int = ROWS_PER_BLOCK,
            **percents: float) -> DataFrame:
    """Nearest-rank percentiles: the value at index ``round_half_even(p/100*(n-1))``."""
    by = list(by)
    ranked = _ranked(df, by, value, rows)
    return ranked.groupBy(*by).agg(*[
        _at(value, F.bround(F.lit(p / 100.0) * (F.col("_n") - 1)).cast("bigint")).alias(name)
        for name, p in percents.items()])


def nearest_index(percent: float, n: int) -> int:
    """The same index for ``n`` sorted values that are at hand."""
    return min(n - 1, max(0, round(percent / 100.0 * (n - 1))))


def upper_median(df: DataFrame, by: Sequence[str], value: str,
                 rows: int = ROWS_PER_BLOCK, name: str = "median") -> DataFrame:
    """The value at index ``n div 2`` of the sorted values."""
    ranked = _ranked(df, list(by), value, rows)
    return ranked.groupBy(*by).agg(
        _at(value, F.floor(F.col("_n") / 2)).alias(name))
