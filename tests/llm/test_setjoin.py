"""The set join against all pairs of sets in plain Python."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import setjoin
from talkmill.llm.registry import registered
from talkmill.llm.setjoin import bands, instances, similar_segments
from tests.llm.edge import classes, edge_segments, lowered

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    size = min(4, len(words))
    return {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def linked(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)


def expected(rows):
    """``id, n_shingles, component_id`` of rows of id and text; ids may repeat or be null."""
    sets = [shingles(t) for _, t in rows]
    root = classes(len(rows), lambda a, b: linked(sets[a], sets[b]))
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root, strict=True))


def grouped(spark, rows, folder, **options):
    df = spark.createDataFrame(rows, "sequence_id bigint, text string")
    return Counter(tuple(r) for r in similar_segments(df, str(folder), **options).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_set_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        f"{SF}/documents.parquet").collect()]
    got = registered()[0]["op12_ngram_jaccard_join"](spark, SF).select(
        "doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == expected(rows)


def test_awkward_rows(spark, tmp_path):
    df = edge_segments(spark)
    rows = [(r["sequence_id"], r["text"]) for r in df.collect()]
    out = similar_segments(df, str(tmp_path / "a"))
    assert Counter(tuple(r) for r in out.collect()) == expected(rows)
    assert similar_segments(df.where(F.lit(False)), str(tmp_path / "b")).count() == 0


def variants(seed, bases, each, words, edits):
    """Near copies around the threshold, a chain of them, and copies of one passage in texts
    that are not similar."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[:len(copy) - rng.randint(0, max(1, len(copy) // 12))]
            rows.append(" ".join(copy))
        for _ in range(each):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(" ".join(base))
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows += [" ".join([rng.choice(vocabulary) for _ in range(40)] + passage) for _ in range(each)]
    return list(enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "block": 3}])
def test_copies_around_the_threshold(spark, tmp_path, options):
    """Also where nothing is broadcast, and buckets are compared in small blocks."""
    rows = variants(1, 3, 14, (20, 40), 3) + [
        (i + 1000, t) for i, t in variants(2, 2, 14, (90, 200), 7)]
    rows += [(2000 + i, "a b c d e f g h " + "x" * i) for i in range(12)]
    assert grouped(spark, rows, tmp_path / "c", **options) == expected(rows)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}])
def test_a_link_between_rows_at_no_end_of_a_bucket(spark, tmp_path, options):
    """The two similar texts meet only in buckets whose first and last rows link with nothing."""
    base = " ".join(f"w{i}" for i in range(15))
    ends = [f"{base} x{i} y{i}" for i in range(160)]
    rows = list(enumerate([*ends[:80], f"{base} p", f"{base} q", *ends[80:]]))
    want = expected(rows)
    assert want[(81, 13, 80)] == 1 and len({c for _, _, c in want}) == len(rows) - 1
    assert grouped(spark, rows, tmp_path / "d", **options) == want


def test_similar_sets_share_a_signature():
    """The guarantee itself, for sizes from one shingle to thousands, at the very threshold."""
    rng = np.random.default_rng(9)
    every = bands(40_000)
    for size in [*range(1, 60), 100, 271, 999, 5000, 20_000]:
        for _ in range(12 if size < 200 else 3):
            x = rng.integers(-2**62, 2**62, size)
            extra = rng.integers(0, size // 5 + 2)
            fresh = rng.integers(-2**62, 2**62, extra)
            gone = rng.integers(0, size // 5 + 2)
            y = np.unique(np.concatenate([x[gone:], fresh]))
            x = np.unique(x)
            both = np.intersect1d(x, y)
            if 100 * len(both) < 85 * (len(x) + len(y) - len(both)) or np.array_equal(x, y):
                continue
            seen = [set(), set()]
            for band, at in instances(np.array([len(x), len(y)]), every):
                which, sigs = setjoin.band_signatures(band, [[x, y][i] for i in at])
                for w, s in zip(at[which], sigs, strict=True):
                    seen[w].add((band.number, int(s)))
            assert seen[0] & seen[1], (size, len(both))


def test_marks_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.unique(rng.integers(-2**62, 2**62, rng.integers(1, 900)))
        y = np.unique(np.concatenate([x[rng.integers(0, 40):], rng.integers(0, 2**60, 30)]))
        a, b = setjoin.marks(x), setjoin.marks(y)
        width = min(len(a), len(b))
        apart = int(np.bitwise_count(setjoin.folded(a, width) ^ setjoin.folded(b, width)).sum())
        assert apart <= len(np.setxor1d(x, y))
