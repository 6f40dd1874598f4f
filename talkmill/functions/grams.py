"""How many n-grams two sequences share, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sequence items whose grams are counted at once in a task.
ITEMS_AT_ONCE = 1 << 19


def _scattered(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, spread out by the usual xor-multiply finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray,
           order: int) -> np.ndarray:
    """Sizes of the multiset intersections of the 1- to ``order``-grams of pairs of sequences,
    laid end to end: one row per pair, one column per length.

    A gram is its 64-bit hash, which grows by one item a length; two grams of a batch have
    the same one by chance in some 10^-8 of all batches.
    """
    many = len(left_sizes)
    sides = []
    for items, sizes in ((left, left_sizes), (right, right_sizes)):
        row = np.repeat(np.arange(many), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        item = _scattered(items.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        sides.append([item, row, end, _scattered(row.astype(np.uint64) + np.uint64(1)),
                      np.arange(len(item))])
    out = np.zeros((many, order), np.int64)
    for k in range(1, order + 1):
        grams, rows = [], []
        for side in sides:
            item, row, end, gram, start = side
            # Only grams that still end inside their sequence grow.
            at = np.flatnonzero(start + k - 1 < end[start])
            start = start[at]
            gram = _scattered(gram[at] + item[start + k - 1])
            side[3:] = [gram, start]
            grams.append(gram)
            rows.append(row[start])
        key = np.concatenate(grams)
        if not len(key):
            break
        mark = np.repeat([1, 0], [len(grams[0]), len(grams[1])])
        by = np.argsort(key)
        first = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
        ours = np.add.reduceat(mark[by], first)
        theirs = np.diff(np.append(first, len(key))) - ours
        out[:, k - 1] = np.bincount(np.concatenate(rows)[by[first]], np.minimum(ours, theirs),
                                    many).astype(np.int64)
    return out


def _slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of about so many items."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        held = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, held + ITEMS_AT_ONCE, "right")))
        out.append((at, stop))
        at = stop
    return out


def _counted(items: list[np.ndarray], sizes: list[np.ndarray], order: int) -> pa.Array:
    edges = [np.concatenate(([0], np.cumsum(s))) for s in sizes]
    found = [np.zeros((0, order), np.int64)]
    for a, b in _slices(sizes[0] + sizes[1]):
        found.append(shared(*[x for side in (0, 1) for x in (
            items[side][edges[side][a]:edges[side][b]], sizes[side][a:b])], order))
    flat = np.concatenate(found).ravel()
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, len(flat) + 1, order), pa.int32()), pa.array(flat))


def shared_character_grams(left: Column, right: Column, order: int) -> Column:
    """Per row an array: the character 1- to ``order``-grams that two texts share."""
    @F.arrow_udf(returnType=T.ArrayType(T.LongType()))
    def count(one: pa.Array, two: pa.Array) -> pa.Array:
        items, sizes = [], []
        for texts in (one, two):
            found = [t or "" for t in texts.to_pylist()]
            items.append(np.frombuffer("".join(found).encode("utf-32-le"), np.uint32))
            sizes.append(np.array([len(t) for t in found], np.int64))
        return _counted(items, sizes, order)

    return count(left, right)


def shared_word_grams(left: Column, right: Column, order: int) -> Column:
    """The same of two arrays of words."""
    @F.arrow_udf(returnType=T.ArrayType(T.LongType()))
    def count(one: pa.Array, two: pa.Array) -> pa.Array:
        words = pa.concat_arrays([one.flatten(), two.flatten()]).dictionary_encode()
        number = words.indices.to_numpy(zero_copy_only=False)
        sizes = [pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(
            np.int64) for s in (one, two)]
        middle = int(sizes[0].sum())
        return _counted([number[:middle], number[middle:]], sizes, order)

    return count(left, right)
