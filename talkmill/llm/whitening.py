"""Whitening of embedding vectors along their leading principal directions.

The project's records hold no vectors (its speaker embeddings stay inside the speech models),
so the operator is general: rows of ``vec_id`` and ``vector``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: Vectors of one packed block.
BLOCK_ROWS = 4096
#: Scaled entries stay within this, so that they are longs.
LARGEST = 1 << 61
#: Inner steps of a correction equation, and how far they reduce its residual.
INNER_STEPS = 8
INNER_GAIN = 0.03
#: Ritz vectors beyond the wanted ones, which keep close eigenvalues apart.
SPARE = 4
#: Columns of the search space before it is restarted from its best Ritz vectors.
SEARCH_COLUMNS = 64
EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenpairs of the covariance, with the exact integer sums they rest on."""

    count: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def whiten(vectors: DataFrame, folder: str, components: int = COMPONENTS) -> DataFrame:
    """Project every vector on the leading eigenvectors of the covariance of all of them.

    Reads ``vec_id`` and ``vector`` (an array of numbers); packed blocks go to ``folder``,
    which all executors share.  An entry c becomes the long ``floor(1024 * c) + 100000``.
    Returns per vector and component ``vec_id``, ``component`` (from 1 by falling
    eigenvalue), ``n``, ``deviation`` (``sum((n * x - S)^2)``, exact, a decimal; null beyond
    38 digits), ``whitened`` (the centred vector along the component, over the root of its
    eigenvalue), ``explained`` (the eigenvalue's share of the trace) and ``identity_error``
    (largest entry of the covariance of ``whitened`` minus the identity).

    Vectors that are null, empty or hold a null or non-finite entry are dropped, as are
    those that are not of the commonest length (of the longest one among ties).  Entries
    beyond the range of longs count as 2^61.  A row that repeats, or has no id, is a vector
    of its own.  There are no more components than entries; where a direction has no
    variance ``whitened`` is null, and ``identity_error`` covers the others (0 for none).
    An empty table gives an empty result.

    Only arrays of the vectors' width, times the number of components, reach the driver.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(
        (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c)
                                           & (F.abs(c) < F.lit(math.inf))))
    width = (rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), F.desc("width")).head())
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == width["width"])
    rows.select("vector").mapInArrow(_packed(width["width"]), "x binary, many int").write.parquet(
        folder)
    blocks = spark.read.schema("x binary, many int").parquet(folder)
    spectrum = leading(blocks, width["width"], components)
    return rows.mapInArrow(_projected(spectrum, identity_error(blocks, spectrum)), schema)


def scaled(vectors: np.ndarray) -> np.ndarray:
    x = np.floor(vectors * SCALE) + SHIFT
    return np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _packed(width: int):
    """Blocks of integer vectors; four bytes an entry where that holds them."""
    def block(x: np.ndarray) -> pa.RecordBatch:
        small = len(x) and np.abs(x).max() < 1 << 31
        data = x.astype("<i4" if small else "<i8").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([data], pa.binary()), pa.array([len(x)], pa.int32())], ["x", "many"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in parts:
            held.append(scaled(_matrix(part.column(0), width)))
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield block(np.concatenate(held))
    return run


def _unpacked(part: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for data, many in zip(part.column(0), part.column(1).to_pylist(), strict=True):
        raw = data.as_py()
        kind = "<i4" if len(raw) == 4 * many * width else "<i8"
        yield np.frombuffer(raw, kind).reshape(many, width).astype(np.int64)


def _cells(blocks: DataFrame, size: int, work: Callable[[pa.RecordBatch], np.ndarray]
           ) -> np.ndarray:
    """Sum ``work``'s arrays of ``size`` numbers over all blocks: one row per cell and task
    is shuffled, and one per cell reaches the driver."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in parts:
            total += work(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    out = np.zeros(size)
    for row in blocks.mapInArrow(run, "cell int, value double").groupBy("cell").agg(
            F.sum("value").alias("value")).collect():
        out[row["cell"]] = row["value"]
    return out


def exact_sums(blocks: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """How many vectors there are, and the sum of every entry, exactly."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for part in parts:
            for x in _unpacked(part, width):
                wide = x if np.abs(x).max() < 1 << 31 else x.astype(object)
                found = [len(x), *wide.sum(axis=0).tolist()]
                total = [a + b for a, b in zip(total, found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["cell", "value"])

    found = {r["cell"]: int(r["value"]) for r in blocks.mapInArrow(
        run, "cell int, value decimal(38,0)").groupBy("cell").agg(
        F.sum("value").cast("decimal(38,0)").alias("value")).collect()}
    return found[0], tuple(found[i + 1] for i in range(width))


def centred(x: np.ndarray, count: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S / n``; the whole part of the mean is taken off before anything is rounded."""
    whole = np.array([s // count for s in sums], np.int64)
    rest = np.array([(s % count) / count for s in sums])
    return (x - whole) - rest


def leading(blocks: DataFrame, width: int, components: int = COMPONENTS) -> Spectrum:
    """Leading eigenpairs of the covariance of all blocks, by Jacobi-Davidson.

    The covariance is never formed: each step multiplies a few columns by it in one
    distributed pass over the centred vectors.
    """
    count, sums = exact_sums(blocks, width)

    def spread(part: pa.RecordBatch) -> np.ndarray:
        return np.array([sum(float((centred(x, count, sums) ** 2).sum())
                             for x in _unpacked(part, width))])

    trace = float(_cells(blocks, 1, spread)[0]) / count
    passes = 0

    def product(columns: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        shape = columns.shape

        def work(part: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(shape)
            for x in _unpacked(part, width):
                c = centred(x, count, sums)
                total += c.T @ (c @ columns)
            return total.ravel()
        return _cells(blocks, shape[0] * shape[1], work).reshape(shape) / count

    values, vectors, residuals = jacobi_davidson(product, width, min(components, width))
    return Spectrum(count, sums, trace, values, vectors, residuals, passes)


def jacobi_davidson(product: Product, width: int, wanted: int
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a symmetric product, and their residuals.

    Every round takes Ritz pairs from the search space, locks leading ones whose residual
    has reached double precision, and adds the solutions of the projected correction
    equations of the others, which MINRES solves for all columns at once.  A residual is
    done at the rounding error of the product itself, or where no direction is left.
    """
    rng = np.random.default_rng(0)
    locked = np.zeros((width, 0))
    search = _orthonormal(rng.standard_normal((width, min(width, wanted + SPARE))), locked)
    image = product(search)
    size, before = 0.0, np.inf
    while locked.shape[1] < wanted:
        theta, inner = np.linalg.eigh(_symmetric(search.T @ image))
        order = np.argsort(-theta)
        theta, inner = theta[order], inner[:, order]
        search, image = search @ inner, image @ inner
        size = max(size, float(np.abs(theta).max()))
        rest = image - search * theta
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        left = wanted - locked.shape[1]
        full = locked.shape[1] + search.shape[1] >= width
        floor = 4 * EPS * size * math.sqrt(width)
        # Rounding differs from pass to pass, so a residual near the floor may stop falling.
        still = norms[0] > before / 2 and norms[0] <= 64 * floor
        done = 0
        while done < min(left, len(norms)) and (
                full or norms[done] <= floor or (done == 0 and still)):
            done += 1
        before = np.inf if done else norms[0]
        if done:
            locked = np.hstack([locked, search[:, :done]])
            search, image = search[:, done:], image[:, done:]
            theta, rest = theta[done:], rest[:, done:]
            left -= done
            if not left:
                break
        few = min(left, search.shape[1])
        steps = _corrections(product, locked, search[:, :few], theta[:few], rest[:, :few])
        keep = 2 * wanted + SPARE
        if search.shape[1] + few > SEARCH_COLUMNS and search.shape[1] > keep:
            search, image = search[:, :keep], image[:, :keep]
        fresh = _orthonormal(steps, np.hstack([locked, search]))
        if not fresh.shape[1]:
            fresh = _orthonormal(rng.standard_normal((width, 1)), np.hstack([locked, search]))
        search, image = np.hstack([search, fresh]), np.hstack([image, product(fresh)])
    image = product(locked)
    values, inner = np.linalg.eigh(_symmetric(locked.T @ image))
    order = np.argsort(-values)
    values, vectors = values[order], locked @ inner[:, order]
    # Either sign will do; the largest entry is positive.
    at = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[at, np.arange(wanted)] < 0, -1.0, 1.0)
    residuals = np.linalg.norm(product(vectors) - vectors * values, axis=0)
    return values, vectors, residuals


def _corrections(product: Product, locked: np.ndarray, ritz: np.ndarray, theta: np.ndarray,
                 rest: np.ndarray) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(A - theta)(I - QQ') t = -r for every Ritz pair,
    Q being the locked vectors and the pair's own: MINRES, one product a step for all."""
    def projected(t: np.ndarray) -> np.ndarray:
        t = t - locked @ (locked.T @ t)
        return t - ritz * (ritz * t).sum(axis=0)

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * b).sum(axis=0)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)

    target = projected(-rest)
    start = np.sqrt(dot(target, target))
    v, v_old = over(target, start), np.zeros_like(target)
    beta, answer = np.zeros_like(start), np.zeros_like(target)
    d, d_old = np.zeros_like(target), np.zeros_like(target)
    c, c_old, s, s_old = (np.ones_like(start), np.ones_like(start), np.zeros_like(start),
                          np.zeros_like(start))
    left = start.copy()
    for _ in range(INNER_STEPS):
        moved = projected(product(v) - v * theta)
        alpha = dot(v, moved)
        w = projected(moved - v * alpha - v_old * beta)
        beta_new = np.sqrt(dot(w, w))
        # The tridiagonal column through the two last Givens rotations, then its own.
        r3 = s_old * beta
        r2 = s * alpha + c * c_old * beta
        r1 = c * alpha - s * c_old * beta
        norm = np.hypot(r1, beta_new)
        c_new, s_new = over(r1, norm), over(beta_new, norm)
        d, d_old = over(v - d * r2 - d_old * r3, norm), d
        answer += d * (c_new * left)
        left = -s_new * left
        v, v_old, beta = over(w, beta_new), v, beta_new
        c_old, s_old, c, s = c, s, c_new, s_new
        if np.all(np.abs(left) <= INNER_GAIN * start):
            break
    return projected(answer)


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The part of the columns outside ``against``, orthonormal; what vanishes is left out."""
    kept = against
    for column in columns.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        t = column / size
        for _ in range(3):
            t = t - kept @ (kept.T @ t)
            size = np.linalg.norm(t)
            if size < 1e-10:
                break
            t = t / size
        else:
            kept = np.hstack([kept, t[:, None]])
    return kept[:, against.shape[1]:]


def _weights(spectrum: Spectrum) -> np.ndarray:
    """Columns that whiten; a direction without variance has a column of NaN."""
    floor = 64 * EPS * max(spectrum.trace, 0.0)
    roots = np.sqrt(np.where(spectrum.values > floor, spectrum.values, np.nan))
    return spectrum.vectors / roots


def identity_error(blocks: DataFrame, spectrum: Spectrum) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity."""
    weights = _weights(spectrum)
    weights = weights[:, ~np.isnan(weights).any(axis=0)]
    width, k = weights.shape
    count, sums = spectrum.count, spectrum.sums
    if not k:
        return 0.0

    def work(part: pa.RecordBatch) -> np.ndarray:
        total, first = np.zeros((k, k)), np.zeros(k)
        for x in _unpacked(part, width):
            w = centred(x, count, sums) @ weights
            total += w.T @ w
            first += w.sum(axis=0)
        return np.concatenate([total.ravel(), first])

    cells = _cells(blocks, k * k + k, work) / count
    mean = cells[k * k:]
    return float(np.abs(cells[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, count: int, sums: tuple[int, ...]) -> list[int]:
    """``sum((n * x - S)^2)`` of every vector, exactly: from the whole part of the mean and
    the remainder, whose products stay within longs for ordinary entries."""
    whole = [s // count for s in sums]
    rest = [s % count for s in sums]
    small = np.abs(x).max(initial=0) < 1 << 25 and max(map(abs, whole)) < 1 << 25 and count < 1 << 30
    kind = np.int64 if small else object
    z = x.astype(kind) - np.array(whole, kind)
    r = np.array(rest, kind)
    squares, mixed = (z * z).sum(axis=1).tolist(), (z * r).sum(axis=1).tolist()
    last = sum(a * a for a in rest)
    return [count * count * q - 2 * count * m + last
            for q, m in zip(squares, mixed, strict=True)]


def _projected(spectrum: Spectrum, error: float):
    """Rows of every vector and component."""
    weights = _weights(spectrum)
    width, k = weights.shape
    shares = np.maximum(spectrum.values, 0.0) / spectrum.trace if spectrum.trace > 0 else (
        np.zeros(k))
    count, sums = spectrum.count, spectrum.sums

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = scaled(_matrix(part.column(1), width))
            w = (centred(x, count, sums) @ weights).ravel()
            far = pa.array([Decimal(d) if d < 10 ** 38 else None
                            for d in deviations(x, count, sums)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            many = len(x) * k
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(many, count, np.int64)), far.take(each),
                pa.array(w, mask=np.isnan(w)), pa.array(np.tile(shares, len(x))),
                pa.array(np.full(many, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained",
                 "identity_error"])
    return run
