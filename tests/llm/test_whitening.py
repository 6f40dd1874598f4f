"""Whitening against plain integer and dense arithmetic."""

import os

import numpy as np
import pytest

from talkmill.llm.registry import registered
from talkmill.llm.whitening import deviations, jacobi_davidson, scaled, whiten

SF = "/root/testdata/sf0.001"


def expected(vectors):
    """``n, deviation`` per vector and the covariance's spectrum, from exact integers."""
    import math

    x = [[math.floor(float(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    c = np.array(off, float) / n
    return n, [sum(a * a for a in v) for v in off], c, c.T @ c / n


def check(rows, ids, vectors, components):
    n, deviation, centred, cov = expected(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == len(ids) * components
    got = np.array([[by[i, k + 1]["whitened"] for k in range(components)] for i in ids], float)
    for i, d in zip(ids, deviation, strict=True):
        assert {by[i, k + 1]["deviation"] for k in range(components)} == {d}
        assert by[i, 1]["n"] == n
    for k in range(components):
        assert by[ids[0], k + 1]["explained"] == pytest.approx(
            values[k] / np.trace(cov), rel=1e-10, abs=1e-14)
    live = [k for k in range(components) if values[k] > 1e-9 * max(values[0], 1)]
    w = got[:, live]
    assert np.abs(w.T @ w / n - np.eye(len(live))).max() < 1e-9
    assert rows[0]["identity_error"] < 1e-9
    # Whitened columns are projections on eigenvectors: undo them and compare spaces.
    back = centred.T @ w / n * 1.0
    assert np.allclose(cov @ (back / np.linalg.norm(back, axis=0)),
                       back / np.linalg.norm(back, axis=0) * values[live],
                       atol=1e-9 * max(values[0], 1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = registered()[0]["op13_embedding_whitening"](spark, SF).collect()
    ids, vectors = zip(*[(r["vec_id"], r["embedding"]) for r in table
                         if r["embedding"] is not None], strict=True)
    check(rows, ids, vectors, 8)


def test_awkward_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in v] for v in rng.normal(size=(40, 5)).round(3)]
    rows = [(i, v) for i, v in enumerate(good)] + [
        (100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]),
        (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id bigint, vector array<double>, n string, component int")
    out = whiten(df, str(tmp_path / "a")).collect()
    check(out, list(range(40)), good, 5)
    twice = spark.createDataFrame([(None, [1.0, 2.0])] * 2 + [(1, [3.0, 5.0])],
                                  "vec_id bigint, vector array<float>")
    same = whiten(twice, str(tmp_path / "b"), 3).collect()
    assert len(same) == 6 and {r["n"] for r in same} == {3}
    assert [r["whitened"] is None for r in same if r["component"] == 2] == [True] * 3
    one = whiten(twice.where("vec_id = 1"), str(tmp_path / "c")).collect()
    assert [r["whitened"] for r in one] == [None, None] and one[0]["identity_error"] == 0.0
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0])],
                                 "vec_id bigint, vector array<double>")
    assert whiten(huge, str(tmp_path / "f")).count() == 4
    none = whiten(df.where("vec_id > 99 AND vec_id < 103"), str(tmp_path / "d"))
    assert none.count() == 0 and none.columns == whiten(df, str(tmp_path / "e")).columns


def test_deviations_of_large_entries_are_exact():
    x = scaled(np.array([[1e300, -1e300], [1.0, 2.0], [1e9, 5.0]]))
    sums = tuple(sum(int(v) for v in c) for c in x.T)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert deviations(x, 3, sums) == want


@pytest.mark.parametrize("spectrum", [[5.0] * 3 + [1.0] * 30, [4.0, 3.0, 2.0] + [0.0] * 20,
                                      list(np.linspace(1, 2, 90)), [0.0] * 10, [7.0]])
def test_eigenpairs_of_hard_spectra(spectrum):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))[0]
    a = q @ np.diag(spectrum) @ q.T
    k = min(8, len(spectrum))
    values, vectors, residuals = jacobi_davidson(lambda u: a @ u, len(a), k)
    scale = max(max(spectrum), 1.0)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-12 * scale)
    assert residuals.max() < 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
