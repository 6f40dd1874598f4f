"""Token alignment against a plain token-by-token version."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm.alignment import (Csr, align_segments, byte_level, gustavson, pieces,
                                    score_links, vocabulary_size)
from talkmill.llm.queries_links import TOKENIZERS
from talkmill.llm.registry import registered
from tests.llm.edge import edge_segments, sha

SF = "/root/testdata/sf0.001"
A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no vocabulary files here")


def plain(texts):
    """Per text ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups, n_shared``."""
    one, two = byte_level(A), pieces(B)
    docs = []
    for text in texts:
        text = text or ""
        a, b = one.encode([text])[0], two.encode([text])[0]
        want = (" " + text).encode()
        if not text or b"".join(one.tokens[i] for i in a) != want or \
                b"".join(two.tokens[i] for i in b) != want:
            docs.append(([], [], [], [], 0))
            continue
        spans = []
        for ids, vocabulary in ((a, one), (b, two)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + len(vocabulary.tokens[i]), i))
                at = side[-1][1]
            spans.append(side)
        links = []
        low = 0
        for s, e, i in spans[0]:
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, shared, before = [], 0, 0
        for end in both:
            cut = [[str(i) for s, e, i in side if before < e <= end] for side in spans]
            shared += len(cut[0]) * len(cut[1])
            groups.append("|".join(",".join(c) for c in cut))
            before = end
        docs.append((a, b, links, groups, shared))
    count = Counter(p for _, _, links, _, _ in docs for p in set(links))
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    return [(len(a), len(b), len(groups), len(links),
             sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links),
             ";".join(groups), shared) for a, b, links, groups, shared in docs]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_alignment_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        f"{SF}/documents.parquet").where("n_chars < 20000").collect()]
    every = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = {r["doc_id"]: r for r in registered()[0]["op11_token_alignment"](spark, SF).collect()}
    assert len(rows) == every
    names = ("n_a", "n_b", "n_groups", "n_links")
    for (i, _), want in zip(docs, plain([t for _, t in docs]), strict=True):
        assert tuple(rows[i][c] for c in names) == want[:4] and rows[i]["n_shared"] == want[7]
        assert rows[i]["groups_sha256"] == (sha(want[6]) if want[6] else "")


def scored(spark, segments, folder, **options):
    return score_links(align_segments(segments, A, B), vocabulary_size(B), folder, **options)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_counts_of_awkward_rows(spark, tmp_path, few):
    """With pairs broadcast, and with pairs joined."""
    extra = [(50, "s", "<|endoftext|> <s> </s> <unk>", "en"), (51, "s", "ﬁ ﬀ ½ Ａ", "en"),
             (52, "s", "naïve  café​ 👩‍👩‍👧 \x00\x01", None), (53, "s", " lead  two ", "en"),
             (54, "s", "x" * 3000, "en"), (55, "s", "日本語のテキスト " * 50, "ja"), (56, "s", "▁", "en")]
    df = edge_segments(spark).unionByName(
        spark.createDataFrame(extra, "sequence_id bigint, session_id string, text string, "
                                     "language string"), allowMissingColumns=True)
    texts = [r["text"] for r in df.collect()]
    got = Counter(tuple(r) for r in scored(spark, df, str(tmp_path / "x"), broadcast_pairs=few)
                  .select("sequence_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                          "count_sum", "groups", "n_shared").collect())
    want = Counter((i, *w) for i, w in zip([r["sequence_id"] for r in df.collect()],
                                           plain(texts), strict=True))
    assert got == want
    empty = scored(spark, df.where(F.lit(False)), str(tmp_path / "y"))
    assert empty.count() == 0 and "count_sum" in empty.columns


def test_encoder_equals_the_library_of_the_file(spark):
    """Over every code point in several places, and over awkward texts."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b {c} {c}{c}1{c}\n{c} x" for c in signs[::7]] + [
        "<|endoftext|>", "it's  we'LL\t\n  ", "x" * 30_000, "a b\u00a0c\u200b d", "ab" * 20_000]
    want = [e.ids for e in tool.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert byte_level(A).encode(texts) == want


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, m, k = rng.integers(1, 9, 3)
        left, right = rng.random((n, m)) < 0.4, rng.random((m, k)) < 0.4

        def sparse(x):
            return Csr(np.concatenate(([0], np.cumsum(x.sum(1)))), np.nonzero(x)[1], x.shape[1])
        out = np.zeros((n, k), int)
        for i, j, v in gustavson(sparse(left), sparse(right)):
            out[i, j] += v
        assert (out == left.astype(int) @ right.astype(int)).all()
        flipped = sparse(left).transposed()
        assert (flipped.starts == sparse(left.T).starts).all()
        assert (flipped.cols == sparse(left.T).cols).all()
