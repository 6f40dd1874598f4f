"""How two tokenizers cut the same segment: links between their tokens, and how common each is.

Recognisers and translators of one pipeline have vocabularies of their own; a byte-level BPE
(A) and a sentence-piece model (B) are aligned over the bytes of a segment's text.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import at_most
from talkmill.session import cut

#: Bytes of text that are tokenized and multiplied at a time.
SLICE_BYTES = 1 << 19
#: Products of one step of a sparse product.
STEP = 1 << 21
#: Counted id pairs that may be broadcast.
BROADCAST_PAIRS = 1_000_000

COMMA, BAR, SEMICOLON = b",|;"


@dataclass(frozen=True)
class Csr:
    """A sparse 0/1 matrix by rows: row i has the columns ``cols[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    cols: np.ndarray
    width: int

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.starts) - 1), self.sizes)
        if len(self.cols) and (self.cols[1:] < self.cols[:-1]).any():
            row = row[np.argsort(self.cols, kind="stable")]
        return Csr(_starts(np.bincount(self.cols, minlength=self.width)), row,
                   len(self.starts) - 1)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def runs(sizes: np.ndarray) -> Csr:
    """The incidence of consecutive runs: row i covers the next ``sizes[i]`` columns."""
    starts = _starts(sizes)
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def gustavson(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Non-zero ``row, column, value`` of a product, row by row: the rows of ``b`` that a row
    of ``a`` names are merged into one.  Rows of ``a`` are taken some at a time, so memory is
    bounded by a row's products."""
    work = _starts(b.sizes[a.cols])[a.starts]
    first = 0
    while first < len(a.starts) - 1:
        last = max(first + 1, int(np.searchsorted(work, work[first] + STEP, "right")) - 1)
        named = a.cols[a.starts[first]:a.starts[last]]
        sizes = b.sizes[named]
        row = np.repeat(np.repeat(np.arange(first, last), a.sizes[first:last]), sizes)
        inside = np.arange(len(row)) - np.repeat(_starts(sizes)[:-1], sizes)
        col = b.cols[np.repeat(b.starts[named], sizes) + inside]
        key = row * b.width + col
        if (key[1:] < key[:-1]).any():
            key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
        yield key[at] // b.width, key[at] % b.width, np.diff(np.append(at, len(key)))
        first = last


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes and decimal digits by id, and the encoder of a batch of texts."""

    encode: object
    tokens: list[bytes]
    sizes: np.ndarray
    digits: np.ndarray
    digit_count: np.ndarray


def _vocabulary(encode, tokens: list[bytes]) -> Vocabulary:
    names = [str(i).encode() for i in range(len(tokens))]
    wide = len(names[-1]) + 1
    table = np.array(names, f"S{wide}").view(np.uint8).reshape(-1, wide)
    return Vocabulary(encode, tokens, np.array([len(t) for t in tokens]), table,
                      np.array([len(n) for n in names]))


#: How byte-level files of this kind cut a text into words (a fixed value of the format).
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file; special tokens inside a text are plain text.

    Where a merge's place in the file is its token's rank by id, as usual, the file's ids are
    the ranks of a faster encoder with the same result; else the file's own library reads it.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    # The printable stand-in of every byte: itself where it prints, else the next free code.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens") or ()}
    vocab = model["model"]["vocab"]
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        tokens[i] = (bytes(byte_of[c] for c in token) if all(c in byte_of for c in token)
                     else token.encode())
    for token, i in special.items():
        tokens[i] = token.encode()
    cut_up = model.get("pre_tokenizer") or {}
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    made = [vocab["".join(m)] for m in parts]
    if (model["model"]["type"] == "BPE" and cut_up.get("type") == "ByteLevel"
            and not cut_up.get("add_prefix_space") and cut_up.get("use_regex", True)
            and not model.get("normalizer") and made == sorted(set(made))):
        import tiktoken

        ranks = {tokens[i]: i for t, i in vocab.items() if t not in special}
        tool = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            return [tool.encode_ordinary(" " + t) for t in texts]
    else:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in slow.encode_batch([" " + t for t in texts],
                                                     add_special_tokens=False)]
    return _vocabulary(encode, tokens)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Vocabulary:
    """A sentence-piece file, which puts a space before the text itself."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(tool.id_to_piece(i)[3:5], 16)]) if tool.is_byte(i)
              else tool.id_to_piece(i).replace("▁", " ").encode()
              for i in range(tool.get_piece_size())]
    return _vocabulary(lambda texts: tool.encode(texts, num_threads=1), tokens)


@dataclass(frozen=True)
class Alignment:
    """Texts of a slice, their tokens laid end to end."""

    a: np.ndarray
    b: np.ndarray
    per_text: dict[str, np.ndarray]
    groups: list[str]
    pairs: Csr
    times: np.ndarray


def align(texts: list[str], one: Vocabulary, two: Vocabulary) -> Alignment:
    """Token ids, links and groups of texts; one without tokens has zeros."""
    ids = [[], []]
    for a, b, text in zip(one.encode(texts), two.encode(texts), texts, strict=True):
        want = b" " + text.encode()
        same = text and (b"".join([one.tokens[i] for i in a]) == want
                         and b"".join([two.tokens[i] for i in b]) == want)
        ids[0].append(a if same else [])
        ids[1].append(b if same else [])
    n_a, n_b = (np.array([len(x) for x in side]) for side in ids)
    a, b = (np.array([i for x in side for i in x], np.int64) for side in ids)
    text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    many = len(texts)

    # Overlap links: A B' over bytes.
    in_a, in_b = runs(one.sizes[a]), runs(two.sizes[b])
    n_links = np.zeros(many, np.int64)
    keys = []
    wide = len(one.tokens) * len(two.tokens)
    for i, j, _ in gustavson(in_a, in_b.transposed()):
        n_links += np.bincount(text_a[i], minlength=many)
        keys.append(text_a[i] * wide + a[i] * len(two.tokens) + b[j])
    found, times = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
    pairs = Csr(_starts(np.bincount(found // wide, minlength=many)), found % wide, wide)

    # Groups end where tokens of both end; shared-group links: G_A' G_B over groups.
    end_a, end_b = in_a.starts[1:], in_b.starts[1:]
    ends = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    by_a = runs(np.bincount(group_a, minlength=len(ends)))
    by_b = runs(np.bincount(group_b, minlength=len(ends)))
    n_shared = np.zeros(many, np.int64)
    for i, _, _ in gustavson(by_a.transposed(), by_b):
        n_shared += np.bincount(text_a[i], minlength=many)
    n_groups = np.bincount(text_a[by_a.starts[1:] - 1], minlength=many)

    # Groups as text: A's ids, then B's, in the order of the groups.
    order_a = np.arange(len(a)) + by_b.starts[group_a]
    order_b = np.arange(len(b)) + by_a.starts[group_b + 1]
    last_a = np.zeros(len(a), bool)
    last_b = np.zeros(len(b), bool)
    last_a[by_a.starts[1:] - 1] = True
    last_b[by_b.starts[1:] - 1] = True
    wide = max(one.digits.shape[1], two.digits.shape[1])
    shown = np.zeros((len(a) + len(b), wide), np.uint8)
    length = np.zeros(len(a) + len(b), np.int64)
    for order, side, vocabulary, last, mark in ((order_a, a, one, last_a, BAR),
                                                (order_b, b, two, last_b, SEMICOLON)):
        shown[order, :vocabulary.digits.shape[1]] = vocabulary.digits[side]
        size = vocabulary.digit_count[side]
        shown[order, size] = np.where(last, mark, COMMA)
        length[order] = size + 1
    joined = shown[np.arange(wide) < length[:, None]].tobytes().decode()
    edges = _starts(length)[_starts(n_a + n_b)]
    groups = [joined[s:max(s, e - 1)] for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return Alignment(a, b, {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                            "n_shared": n_shared}, groups, pairs, times)


def align_segments(segments: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Tokenize every segment with both tokenizers and link the tokens.

    Reads ``sequence_id`` and ``text``; the two paths name tokenizer files that every
    executor has.  A sees a space and the text, B the text, to which it adds the space.
    Returns per row ``sequence_id``, the tokens ``n_a`` and ``n_b``, ``n_groups`` (the parts
    between byte offsets at which tokens of both end), ``n_links`` (token pairs whose bytes
    overlap), ``n_shared`` (token pairs of one group), ``groups`` (``a1,a2|b1;a3|b2,b3``) and
    the id pairs that it links: ``pairs`` (``a * |B| + b``, distinct) and ``times``.

    A null or empty text, and one that A or B doesn't give back byte for byte, has no
    tokens: zeros, an empty string and no pairs.  Repeated rows, and rows without an id, are
    rows like any other.  Texts are taken whole, about half a megabyte at a time.
    """
    kind = segments.schema["sequence_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(byte_bpe), pieces(piece_model)
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < SLICE_BYTES):
                    size += len(texts[stop])
                    stop += 1
                found = align(texts[at:stop], one, two)
                starts = pa.array(found.pairs.starts, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).slice(at, stop - at),
                    *[pa.array(v, pa.int64()) for v in found.per_text.values()],
                    pa.array(found.groups, pa.string()),
                    pa.ListArray.from_arrays(starts, pa.array(found.pairs.cols, pa.int64())),
                    pa.ListArray.from_arrays(starts, pa.array(found.times, pa.int32()))],
                    ["sequence_id", *found.per_text, "groups", "pairs", "times"])
                at = stop

    return segments.select("sequence_id", "text").mapInArrow(
        run, f"sequence_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "n_shared bigint, groups string, pairs array<bigint>, times array<int>")


def vocabulary_size(piece_model: str) -> int:
    """|B|, which splits a pair into its two ids."""
    return len(pieces(piece_model).tokens)


def score_links(aligned: DataFrame, size_b: int, folder: str,
                broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Count in how many segments each id pair is linked, and score every segment by it.

    ``aligned`` has ``pairs`` and ``times`` of :func:`align_segments`; it is written to
    ``folder`` once, so texts are tokenized once.  All its other columns come back, with
    ``n_best`` (links whose pair is counted highest among the pairs of its A id, ties
    included) and ``count_sum`` (the counts over all links).  Pairs that are no more than
    ``broadcast_pairs`` are handed to every task; beyond that they are joined by pair.
    """
    spark = aligned.sparkSession
    aligned.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    counts = (rows.select(F.explode("pairs").alias("pair")).groupBy("pair")
              .agg(F.count(F.lit(1)).alias("count")))
    counts = cut(counts.withColumn("a", F.expr(f"pair DIV {size_b}")))
    best = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = cut(counts.join(best, "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("is_best")))
    side = F.broadcast(counts) if at_most(counts, broadcast_pairs) else counts
    links = rows.select("_row", F.expr("inline(arrays_zip(pairs, times))")).join(
        side, F.col("pairs") == F.col("pair"))
    scores = links.groupBy("_row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(scores, "_row", "left")
    return out.drop("_row").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
                                         for c in ("n_best", "count_sum")})
