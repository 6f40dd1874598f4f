"""Language of a segment by a small byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators.ordered import top_k

#: Widths of the filters, filters per width, bytes of a window.
WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 256
#: Segments per language that the network learns from, windows of each, and languages.
SAMPLE = 400
SAMPLE_WINDOWS = 6
LANGUAGES = 200
EPOCHS = 12
UNKNOWN = "und"
#: Windows evaluated at once; bounds the memory of a task.
BATCH = 256


@dataclass
class ByteNet:
    """Filters as one table per tap: the response of a filter at a byte is the sum over its
    taps of ``taps[width][tap, byte, filter]``, which is a convolution over byte embeddings
    with embedding and filter multiplied out."""

    languages: list[str]
    taps: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filter responses of ``(n, WINDOW)`` bytes."""
        return self._pool(windows)[0]

    def _pool(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, at = [], []
        for width, table in self.taps.items():
            length = windows.shape[1] - width + 1
            response = table[0][windows[:, :length]]
            for tap in range(1, width):
                response = response + table[tap][windows[:, tap:tap + length]]
            best = response.argmax(axis=1)
            at.append(best)
            pooled.append(np.take_along_axis(response, best[:, None, :], 1)[:, 0, :])
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0), at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = self.pooled(windows) @ self.weights + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """The whole text as windows of WINDOW bytes; the last one is filled with zeros."""
    count = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(count * WINDOW, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(count, WINDOW)


def sample_windows(data: bytes, many: int = SAMPLE_WINDOWS) -> np.ndarray:
    """At most so many windows of a text, spread evenly over it."""
    found = windows_of(data)
    return found[np.unique(np.linspace(0, len(found) - 1, many).round().astype(int))]


def fit(texts: Sequence[bytes], labels: Sequence[str], epochs: int = EPOCHS, seed: int = 7
        ) -> ByteNet:
    """Train by gradient descent (Adam) on at most ``SAMPLE_WINDOWS`` windows of each of the
    labelled texts; reruns agree."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        some = sample_windows(text)
        xs.append(some)
        ys += [languages.index(label)] * len(some)
    x, y = np.concatenate(xs), np.array(ys)
    net = ByteNet(languages,
                  {w: rng.normal(0, .3 / w, (w, 256, FILTERS)).astype(np.float32)
                   for w in WIDTHS},
                  np.full(len(WIDTHS) * FILTERS, .1, np.float32),
                  rng.normal(0, .1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rounds = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rounds += 1
            _descend(net, x[order[at:at + 64]], y[order[at:at + 64]], state, rounds)
    return net


def _descend(net: ByteNet, x: np.ndarray, y: np.ndarray, state: dict, rounds: int) -> None:
    pooled, places = net._pool(x)
    scores = pooled @ net.weights + net.offset
    error = np.exp(scores - scores.max(axis=1, keepdims=True))
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    back = (error @ net.weights.T) * (pooled > 0)
    grads = {"weights": pooled.T @ error, "offset": error.sum(0), "bias": back.sum(0)}
    filters = np.arange(FILTERS)
    for i, (width, table) in enumerate(net.taps.items()):
        grad = np.zeros_like(table)
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        for tap in range(width):
            seen = np.take_along_axis(x, places[i] + tap, axis=1)
            np.add.at(grad[tap], (seen, filters[None, :]), part)
        grads[f"taps{width}"] = grad
    for name, grad in grads.items():
        value = net.taps[int(name[4:])] if name.startswith("taps") else getattr(net, name)
        first, second = state.get(name, (np.zeros_like(value), np.zeros_like(value)))
        first = .9 * first + .1 * grad
        second = .999 * second + .001 * grad * grad
        state[name] = (first, second)
        value -= .01 * (first / (1 - .9 ** rounds)
                        / (np.sqrt(second / (1 - .999 ** rounds)) + 1e-7)).astype(np.float32)


def learn_languages(segments: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES
                    ) -> ByteNet | None:
    """Fit a network on labelled segments (``sequence_id, text, language``).

    Learns from at most ``sample`` segments of each of the ``languages`` commonest languages
    (others are never predicted), the first by hash of their ids (of rows that repeat an id,
    one), and of each from at most ``SAMPLE_WINDOWS`` windows of ``WINDOW`` bytes, which are
    cut out in the tasks: the sample is bounded by the product of these and is all that
    reaches the driver.  Segments without a language or text are no labels.  None if there
    are no labels.
    """
    kind = segments.schema["sequence_id"].dataType.simpleString()
    labelled = segments.where(F.col("language").isNotNull() & F.col("text").isNotNull())
    narrow = labelled.select("language", "sequence_id").withColumn(
        "_order", F.xxhash64("sequence_id"))
    common = narrow.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "language").limit(languages)
    picked = top_k(narrow.join(F.broadcast(common.select("language")), "language"),
                   ["language"], [F.col("_order"), F.col("sequence_id")], sample)
    rows = (labelled.join(F.broadcast(picked.select("language", "sequence_id").distinct()),
                          ["language", "sequence_id"], "left_semi")
            .select("language", "sequence_id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(_cut_windows, f"language string, sequence_id {kind}, text binary")
            .groupBy("language", "sequence_id").agg(F.min("text").alias("text")).collect())
    rows = sorted(rows, key=lambda r: (r["language"], r["sequence_id"], bytes(r["text"])))
    if not rows:
        return None
    return fit([bytes(r["text"]) for r in rows], [r["language"] for r in rows])


def _cut_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        some = [sample_windows(t.as_py()).tobytes().rstrip(b"\0") for t in part.column(2)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(some, pa.binary())],
            ["language", "sequence_id", "text"])


def detect_language(segments: DataFrame, net: ByteNet | None) -> DataFrame:
    """Language of every segment: ``sequence_id, detected, score, confidence``, one row per
    row read.

    Reads only ``sequence_id`` and ``text``; a label or session never reaches the network.
    The whole text is cut into fixed windows, evaluated ``BATCH`` at a time, and the
    windows' probabilities are averaged by their bytes; ``score`` is that of ``detected``.
    ``confidence`` averages what each window gives to its own best language, so it is high
    for a text in several languages too.  A null text, one without any letter, or a missing
    network gives ``und`` with score and confidence 0.  Ties go to the language that sorts
    first.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = _detected(net, [t.as_py() for t in part.column(1)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.string()),
                 *[pa.array([f[k] for f in found], pa.float64()) for k in (1, 2)]],
                ["sequence_id", "detected", "score", "confidence"])

    kind = segments.schema["sequence_id"].dataType.simpleString()
    # Texts without a letter come as null.
    spoken = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary"))
    return segments.select("sequence_id", spoken.alias("text")).mapInArrow(
        run, f"sequence_id {kind}, detected string, score double, confidence double")


def _detected(net: ByteNet | None, texts: list[bytes | None]
              ) -> list[tuple[str, float, float]]:
    if net is None:
        return [(UNKNOWN, 0.0, 0.0)] * len(texts)
    # The last column sums up what windows give to their own best languages.
    sums = np.zeros((len(texts), len(net.languages) + 1))
    pending, owners, held = [], [], 0
    for i, text in enumerate(texts):
        if text is None:
            continue
        pending.append(windows_of(text))
        owners.append(np.full(len(pending[-1]), i))
        held += len(pending[-1])
        if held >= BATCH:
            _add(net, sums, pending, owners)
            pending, owners, held = [], [], 0
    if held:
        _add(net, sums, pending, owners)
    best = sums[:, :-1].argmax(axis=1)
    return [(UNKNOWN, 0.0, 0.0) if text is None else
            (net.languages[b], *[float(min(1.0, row[k] / max(1, len(text)))) for k in (b, -1)])
            for text, row, b in zip(texts, sums, best, strict=True)]


def _add(net: ByteNet, sums: np.ndarray, pending: list, owners: list) -> None:
    windows, owner = np.concatenate(pending), np.concatenate(owners)
    for at in range(0, len(windows), BATCH):
        some = windows[at:at + BATCH]
        # A window weighs as many bytes as it has; only the last of a text is filled up.
        size = np.maximum(1, WINDOW - (some[:, ::-1] != 0).argmax(axis=1))
        found = net.probabilities(some)
        found = np.hstack([found, found.max(axis=1, keepdims=True)])
        np.add.at(sums, owner[at:at + BATCH], found * size[:, None])
