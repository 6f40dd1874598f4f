"""Order-dependent operators that hold when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Here a key
with too many rows is first cut into blocks along its order (:func:`split_hot`).  The
scans then run inside each (key, block), and only one total per block travels between
blocks.  When no key is hot -- checked with one aggregate -- the plan stays a plain
window, which is the cheaper plan for ordinary data.  Both plans give the same rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talkmill.session import cut

#: Rows of one key that may share a window task before the key is split.
ROWS_PER_BLOCK = 1_000_000
#: Rows of one key that may be handed to one Python fold.
ROWS_PER_FOLD = 200_000
#: Split points per hot key, and the number of split points that may be broadcast.
MAX_BLOCKS = 4096
BROADCAST_CUTS = 1_000_000
#: Split points that a row is compared with at a time.
COARSE = 64

BLOCK = "_blk"


def split_hot(df: DataFrame, key: Sequence[str], order: str,
              rows: int = ROWS_PER_BLOCK) -> tuple[DataFrame, str | None]:
    """Add a block number to ``df`` when some key has more than ``rows`` rows.

    ``order`` must be numeric and not null.  Returns ``(df, None)`` when no key is hot.
    Split points are quantiles of the hot keys only, so bursts and gaps do not matter;
    rows equal in ``order`` always share a block.
    """
    key = list(key)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    found = sizes.agg(F.count(F.lit(1)).alias("keys"), F.max("_n").alias("largest")).head()
    if not found["keys"]:
        return df, None
    pieces = min(MAX_BLOCKS, max(2, math.ceil(2 * found["largest"] / rows)))
    hot = df.join(sizes.select(*key), key, "left_semi")
    shares = [i / pieces for i in range(1, pieces)]
    # A sketch may differ between two runs of the same plan, so its result is fixed on disk.
    cuts = cut(hot.groupBy(*key).agg(
        F.array_distinct(F.percentile_approx(order, shares, 10_000)).alias("_cuts")))
    if found["keys"] * pieces <= BROADCAST_CUTS:
        cuts = F.broadcast(cuts)
    # Every 64th cut point first, then those between two of them.
    coarse = F.filter("_cuts", lambda c, i: i % COARSE == COARSE - 1)
    cuts = cuts.withColumn("_coarse", coarse)
    passed = F.size(F.filter("_coarse", lambda c: c < F.col(order))) * COARSE
    near = F.slice("_cuts", passed + 1, F.lit(COARSE))
    blocks = df.join(cuts, key, "left").withColumn(BLOCK, F.when(
        F.col("_cuts").isNull(), 0).otherwise(
        passed + F.size(F.filter(near, lambda c: c < F.col(order)))))
    return blocks.drop("_cuts", "_coarse"), BLOCK


@dataclass(frozen=True)
class Scan:
    """One ordered column: ``sum``/``max`` over the rows before (or up to) a row, the
    ``lag``/``lead`` value, or the row ``number`` from 1."""

    kind: str
    column: Column | None = None
    inclusive: bool = False
    default: Column | None = None


def scan(df: DataFrame, key: Sequence[str], order: Sequence[str], blk: str | None,
         **outputs: Scan) -> DataFrame:
    """Add ordered columns per key. ``order`` must be a total order inside a key."""
    key, order = list(key), list(order)
    inner = Window.partitionBy(*key, *([blk] if blk else [])).orderBy(*order)
    source = df
    for name, spec in outputs.items():
        if spec.column is not None:
            source = source.withColumn(f"_in_{name}", spec.column)
    out = source
    for name, spec in outputs.items():
        out = out.withColumn(f"_loc_{name}", _local(name, spec, inner))
    if blk is None:
        for name, spec in outputs.items():
            out = out.withColumn(name, _final(name, spec, None))
        return out.drop(*_scratch(outputs))

    position = F.struct(*order)
    totals = source.groupBy(*key, blk).agg(
        *[_total(name, spec, position).alias(f"_tot_{name}") for name, spec in outputs.items()])
    before = Window.partitionBy(*key).orderBy(blk)
    carry = totals.select(*key, blk, *[
        _between(name, spec, before).alias(f"_car_{name}") for name, spec in outputs.items()])
    out = out.join(carry, [*key, blk], "left")
    for name, spec in outputs.items():
        out = out.withColumn(name, _final(name, spec, F.col(f"_car_{name}")))
    return out.drop(*_scratch(outputs), *[f"_car_{n}" for n in outputs])


def _scratch(outputs: dict[str, Scan]) -> list[str]:
    return [f"_{part}_{n}" for n in outputs for part in ("in", "loc")]


def _local(name: str, spec: Scan, w) -> Column:
    value = F.col(f"_in_{name}") if spec.column is not None else None
    upto = w.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    if spec.kind == "sum":
        return F.sum(value).over(upto)
    if spec.kind == "max":
        return F.max(value).over(upto)
    if spec.kind == "number":
        return F.row_number().over(w).cast("bigint")
    # The struct tells "no such row" from "the row holds null".
    shifted = F.struct(value.alias("v"))
    return (F.lag(shifted) if spec.kind == "lag" else F.lead(shifted)).over(w)


def _total(name: str, spec: Scan, position: Column) -> Column:
    value = F.col(f"_in_{name}") if spec.column is not None else None
    if spec.kind == "sum":
        return F.sum(value)
    if spec.kind == "max":
        return F.max(value)
    if spec.kind == "number":
        return F.count(F.lit(1))
    pick = F.max_by if spec.kind == "lag" else F.min_by
    return pick(F.struct(value.alias("v")), position)


def _between(name: str, spec: Scan, w) -> Column:
    total = F.col(f"_tot_{name}")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind in ("sum", "number"):
        return F.sum(total).over(earlier)
    if spec.kind == "max":
        return F.max(total).over(earlier)
    return (F.lag(total) if spec.kind == "lag" else F.lead(total)).over(w)


def _final(name: str, spec: Scan, carry: Column | None) -> Column:
    local = F.col(f"_loc_{name}")
    if spec.kind in ("sum", "number"):
        whole = local if carry is None else (
            F.when(local.isNull() & carry.isNull(), None)
            .otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))))
    elif spec.kind == "max":
        whole = local if carry is None else F.greatest(local, carry)
    else:
        row = local if carry is None else F.coalesce(local, carry)
        if spec.default is None:
            return row["v"]
        return F.when(row.isNull(), spec.default).otherwise(row["v"])
    return whole if spec.default is None else F.coalesce(whole, spec.default)


def islands(df: DataFrame, key: Sequence[str], order: Sequence[str], blk: str | None,
            starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a row where ``starts`` is true opens a new run."""
    return scan(df, key, order, blk,
                **{name: Scan("sum", starts.cast("bigint"), inclusive=True)})


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank", salts: int = 64) -> DataFrame:
    """First ``k`` rows per key.  A salted first round keeps a hot key off one task:
    each of its shares sends at most ``k`` rows to the second round."""
    key = list(key)
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)))
    first = Window.partitionBy(*key, "_salt").orderBy(*order)
    second = Window.partitionBy(*key).orderBy(*order)
    return (salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
            .drop("_r", "_salt")
            .withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= k))


# -- folds whose state depends on their own output -------------------------------------

@dataclass(frozen=True)
class Fold:
    """A sequential rule.

    ``step(state, row) -> (state, rows)`` and ``finish(state) -> rows`` are pure;
    ``state`` is a dict of plain values and stays small; ``row`` and the emitted rows are
    dicts.  The same object drives batch groups and streaming state.  ``counters`` names the
    parts of the state that only count what was emitted and decide nothing.  ``quiet(state)
    -> (state, rows)`` gives out what is pending when a stream's key pauses.
    """

    initial: Callable[[], dict]
    step: Callable[[dict, dict], tuple[dict, list[dict]]]
    schema: T.StructType
    finish: Callable[[dict], list[dict]] = lambda state: []
    counters: tuple[str, ...] = ()
    quiet: Callable[[dict], tuple[dict, list[dict]]] = lambda state: (state, [])


def run_fold(df: DataFrame, fold: Fold, key: Sequence[str], order: Sequence[str],
             blk: str | None = None) -> DataFrame:
    """Fold every key in order; emitted rows carry the key columns.

    Rows are shuffled by key, sorted by Spark (which spills) and folded as they stream by
    in Arrow batches, so memory does not grow with a key.

    With blocks, all blocks first run at once from the initial state.  A block whose true
    incoming state (the end state of the block before it) differs from the one it used is
    run again, until nothing differs.  Counters run from zero in every block and get the
    sum of the blocks before as an offset at the end; without them the rules forget what
    lies a pause or a limit back, so the rounds do not grow with the blocks.
    """
    key, order = list(key), list(order)
    out_schema = T.StructType([df.schema[k] for k in key] + list(fold.schema.fields))
    if blk is None:
        def whole(head: dict) -> _Replay:
            return _Replay(fold, fold.initial(), {k: head[k] for k in key}, finish=True)
        return _by_group(df, key, order, whole, out_schema)

    group = [*key, blk]
    data = cut(df)
    state_schema = T.StructType([df.schema[k] for k in group]
                                + [T.StructField("used", T.StringType()),
                                   T.StructField("reached", T.StringType()),
                                   T.StructField("counted", T.ArrayType(T.LongType()))])

    def advance(head: dict) -> _Replay:
        return _Replay(fold, _load(fold, head["_used"]), {k: head[k] for k in group},
                       used=head["_used"])

    def settle(head: dict) -> _Replay:
        state = _load(fold, head["_used"])
        state.update(zip(fold.counters, head["_counted"] or (), strict=False))
        return _Replay(fold, state, {k: head[k] for k in key}, finish=head["_last"])

    start = _dump(fold.initial(), fold.counters)
    states = cut(_by_group(data.withColumn("_used", F.lit(start)), group, order, advance,
                           state_schema))
    chain = Window.partitionBy(*key).orderBy(blk)
    while True:
        wanted = states.withColumn(
            "wanted", F.coalesce(F.lag("reached").over(chain), F.lit(start)))
        stale = wanted.where(F.col("wanted") != F.col("used"))
        if stale.isEmpty():
            break
        again = _by_group(data.join(stale.select(*group, F.col("wanted").alias("_used")), group),
                          group, order, advance, state_schema)
        states = cut(states.join(stale.select(*group), group, "left_anti").unionByName(again))
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.array(*[F.coalesce(F.sum(F.col("counted")[i]).over(earlier), F.lit(0))
                        for i in range(len(fold.counters))]).cast("array<bigint>")
    handed = states.select(*group, F.col("used").alias("_used"), counted.alias("_counted"),
                           F.lead(blk).over(chain).isNull().alias("_last"))
    return _by_group(data.join(handed, group), group, order, settle, out_schema)


class _Replay:
    """One group's run through a fold."""

    def __init__(self, fold: Fold, state: dict, head: dict, finish: bool = False,
                 used: str | None = None) -> None:
        self.fold, self.state, self.head = fold, state, head
        self.finish, self.used = finish, used

    def row(self, row: dict) -> list[dict]:
        self.state, rows = self.fold.step(self.state, row)
        return [] if self.used is not None else [{**self.head, **r} for r in rows]

    def end(self) -> list[dict]:
        if self.used is not None:
            counters = self.fold.counters
            return [{**self.head, "used": self.used, "reached": _dump(self.state, counters),
                     "counted": [self.state[c] for c in counters]}]
        return [{**self.head, **r} for r in self.fold.finish(self.state)] if self.finish else []


def _by_group(df: DataFrame, group: list[str], order: list[str],
              begin: Callable[[dict], _Replay], schema: T.StructType) -> DataFrame:
    """Stream sorted groups through ``begin(first row)`` replays."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replay, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                ident = tuple(row[g] for g in group)
                if replay is None or ident != now:
                    if replay is not None:
                        out += replay.end()
                    now, replay = ident, begin(row)
                out += replay.row(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if replay is not None and (last := replay.end()):
            yield pa.RecordBatch.from_pylist(last, schema=arrow)

    return (df.repartition(*group).sortWithinPartitions(*group, *order)
            .mapInArrow(run, schema))


def _dump(state: dict, counters: Sequence[str] = ()) -> str:
    return json.dumps({**state, **dict.fromkeys(counters, 0)}, sort_keys=True,
                      ensure_ascii=False)


def _load(fold: Fold, text: str) -> dict:
    return {**fold.initial(), **json.loads(text)}


def plain_rows(pdf: pd.DataFrame) -> Iterable[dict]:
    """Rows as dicts of plain Python values, with None for missing ones."""
    names = list(pdf.columns)
    columns = []
    for name in names:
        values = pdf[name].tolist()
        columns.append([None if isinstance(v, float) and math.isnan(v) else v for v in values])
    for values in zip(*columns, strict=True):
        yield dict(zip(names, values, strict=True))
