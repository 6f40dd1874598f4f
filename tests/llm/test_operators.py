"""Every training-data operator on awkward rows, against plain Python."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import (EDGE, classes, edge_segments, lowered, repeated_bytes,
                            secret_spans, sha, simhash)


def ids(rows):
    return sorted(rows, key=repr)


def empty(spark):
    return edge_segments(spark, [])


# -- exact copies ----------------------------------------------------------------------

def plain_copies(rows):
    groups = defaultdict(list)
    for i, _, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, len(text or "")))
    out = []
    for i, _, text, _ in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[key], key=lambda g: (-g[1], g[0] is None, g[0] or 0))[0]
        out.append((i, keep, len(groups[key]), i == keep, sha(key)))
    return ids(out)


@pytest.mark.parametrize("frequent", [1, 1000])
def test_exact_copies(spark, frequent):
    from talkmill.llm.copies import exact_copies

    found = exact_copies(edge_segments(spark).repartition(3), frequent=frequent)
    assert ids(tuple(r) for r in found.collect()) == plain_copies(EDGE)
    assert exact_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("frequent", [0, 1000])
def test_exact_copies_that_repeat_an_id(spark, frequent):
    """Of one id's texts that differ in white space only, the longest stays, and only it."""
    from talkmill.llm.copies import exact_copies

    rows = [(1, "s", "a b", "en"), (1, "s", "a  b", "en"), (2, "s", "ab", "en"),
            (3, "s", "c d", "en"), (3, "s", "c\td", "en"), (3, "s", "c d", "en")]
    found = exact_copies(edge_segments(spark, rows), frequent=max(frequent, 1)).collect()
    kept = [r for r in found if r["kept"]]
    assert {r["keep_id"] for r in found} == {1, 3} and {r["group_size"] for r in found} == {3}
    assert sum(r["sequence_id"] == 1 for r in kept) == 1
    assert sum(r["sequence_id"] == 3 for r in kept) in (1, 2) and not any(
        r["sequence_id"] == 2 for r in kept)


def test_exact_copies_of_one_large_group(spark):
    from talkmill.llm.copies import exact_copies

    rows = [(i, "s", "hot text" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    found = exact_copies(edge_segments(spark, rows))
    assert ids(tuple(r) for r in found.collect()) == plain_copies(rows)


# -- mixing ----------------------------------------------------------------------------

def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, unfilled, target = 1.5 * sum(sizes.values()), set(names), {}
    while unfilled:
        level = left / sum(weight[n] for n in unfilled)
        full = [n for n in unfilled if level * weight[n] > 2 * sizes[n]]
        if not full:
            target |= {n: level * weight[n] for n in unfilled}
            break
        for n in full:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
            unfilled.discard(n)
    return target


def test_mix_sessions(spark):
    from talkmill.llm.mixing import mix_sessions

    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", "b", "b", "b", "c", "é", None]),
             "w " * rnd.randint(0, 30), "en") for i in range(600)]
    rows += [(1000, "d", None, None), (1001, "e", " \n", "en")]
    segments, mix = mix_sessions(edge_segments(spark, rows))
    sizes = defaultdict(int)
    for _, session, text, _ in rows:
        sizes[session] += len((text or "").split())
    want = plain_targets(sizes)
    got = segments.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["session_id"]])
        assert r["source_size"] == sizes[r["session_id"]]
    copies = mix.collect()
    session = {i: s for i, s, _, _ in rows}
    size = {i: len((t or "").split()) for i, _, t, _ in rows}
    taken, served = Counter(), Counter()
    for r in copies:
        taken[r["sequence_id"]] += r["words"]
        served[session[r["sequence_id"]]] += r["words"]
    assert all(0 < taken[i] <= 2 * size[i] for i in taken)
    assert all(abs(served[s] - want[s]) <= 1 for s in sizes)
    by_place = sorted(copies, key=lambda r: r["place"])
    assert [r["place"] for r in by_place] == list(range(1, len(copies) + 1))
    assert all(a["finish"] <= b["finish"] for a, b in zip(by_place, by_place[1:], strict=False))
    again = mix_sessions(edge_segments(spark, rows).repartition(5))[1]
    assert ids(map(tuple, again.collect())) == ids(map(tuple, copies))


def test_mix_of_awkward_rows(spark):
    from talkmill.llm.mixing import mix_sessions

    segments, mix = mix_sessions(edge_segments(spark))
    assert segments.count() == len(EDGE)
    assert mix.where(F.col("words") < 1).count() == 0
    segments, mix = mix_sessions(empty(spark))
    assert segments.count() == 0 and mix.count() == 0


# -- secrets ---------------------------------------------------------------------------

@pytest.mark.parametrize("few", [0, 2, 200_000])
def test_secret_scan_uses_the_ledger(spark, tmp_path, few):
    from functools import partial

    from talkmill.llm import secrets

    scan_revisions = partial(secrets.scan_revisions, broadcast_blobs=few)

    def revisions(rows):
        return edge_segments(spark, rows).drop("session_id").select(
            F.col("sequence_id").alias("session_id"), F.lit(1).alias("revision"), "text",
            F.lit("x").alias("spans"))

    ledger = str(tmp_path / "ledger")
    hard = [(20, None, "token=secret: abcdefghijklmnop", None),
            (21, None, "tokeN='" + "a1b2" * 40 + "' " + "f" * 15 + " " + "f" * 16, None),
            (22, None, "é AKIAAKIA" + "B" * 14 + " api_key:= x==============", None)]
    rows = EDGE + hard
    found = {}
    for r in scan_revisions(revisions(rows), ledger).collect():
        found.setdefault(r["blob"], set()).add((r["n_assign"], r["n_access"], r["n_hex"],
                                                r["spans"]))
    for _, _, text, _ in rows:
        spans = secret_spans(text or "")
        kinds = Counter(k for k, _, _ in spans)
        assert found[sha(text or "")] == {(kinds["assign"], kinds["access"], kinds["hex"], ",".join(
            f"{k}:{s}:{e}" for k, s, e in spans))}
    blobs = spark.read.parquet(ledger).count()
    assert blobs == len({text or "" for _, _, text, _ in rows})
    more = [*rows, (30, None, "secret=0123456789abcdef", None)]
    assert scan_revisions(revisions(more), ledger).where("spans <> ''").count() == 1 + sum(
        bool(secret_spans(t or "")) for _, _, t, _ in rows)
    assert spark.read.parquet(ledger).count() == blobs + 1
    scan_revisions(revisions(more), ledger, rules="other").count()
    assert spark.read.parquet(ledger).count() == 2 * (blobs + 1)
    assert scan_revisions(revisions([]), str(tmp_path / "none")).count() == 0


# -- benchmark overlap -----------------------------------------------------------------

def plain_overlap(texts, items, window=13):
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for i, text in items:
        words = rule.findall(lowered(text or ""))
        for s in range(max(len(words) - window, 0) + 1):
            if words:
                grams[tuple(words[s:s + window])].add(i)
    out = []
    for text in texts:
        words, hit, names = rule.findall(lowered(text or "")), set(), set()
        for gram, owners in grams.items():
            for s in range(len(words) - len(gram) + 1):
                if tuple(words[s:s + len(gram)]) == gram:
                    hit |= set(range(s, s + len(gram)))
                    names |= owners
        out.append((len(words), len(hit), sorted(map(str, names))))
    return out


@pytest.mark.parametrize("few", [0, 1000])
def test_overlapping_words(spark, few):
    from talkmill.llm.overlap import overlapping_words

    items = [(1, "the quick brown fox jumps over the lazy dog and runs far away into"),
             (2, "Jack a dull BOY"), (3, None), (4, " !! "), (5, "漢字"), (10, "jack, a dull boy"),
             (6, "far away into the dark wood the quick brown fox jumps over the lazy dog")]
    rows = EDGE
    bench = spark.createDataFrame(items, "id bigint, reference_text string").withColumn(
        "gram", F.lit("x"))
    found = overlapping_words(edge_segments(spark, rows), bench, broadcast_windows=few)
    got = found.select("sequence_id", "n_words", "n_hit", "ids").collect()
    want = plain_overlap([t for _, _, t, _ in rows], items)
    assert ids(map(tuple, got)) == ids((i, *w) for (i, _, _, _), w in zip(rows, want, strict=True))
    long_one = found.where("sequence_id = 12").head()
    assert sum(r["length"] for r in long_one["runs"]) == long_one["n_hit"] > 0
    assert overlapping_words(empty(spark), bench).count() == 0
    none = overlapping_words(edge_segments(spark, rows), bench.where("false"))
    assert none.agg(F.sum("n_hit")).head()[0] == 0


# -- lines -----------------------------------------------------------------------------

def plain_lines(texts, minimum):
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = Counter()
    for text in texts:
        held.update({key(line) for line in (text or "").split("\n")} - {""})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not key(line) or held[key(line)] < minimum]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("shipped", [0, 1000])
def test_repeated_lines(spark, tmp_path, shipped):
    from talkmill.llm.lines import drop_repeated_lines

    rnd = random.Random(3)
    rows = EDGE + [(100 + i, "s", "\n".join(rnd.choice(
        ["Terms apply", " terms APPLY\t", f"line {i}", "", "äb", "Äb", f"n {rnd.randint(0, 9)}"])
        for _ in range(8)), "en") for i in range(60)]
    found = drop_repeated_lines(edge_segments(spark, rows), str(tmp_path / "runs"), minimum=4,
                                batches=5, shipped=shipped)
    want = plain_lines([t for _, _, t, _ in rows], 4)
    assert ids(map(tuple, found.collect())) == ids(
        (i, *w) for (i, _, _, _), w in zip(rows, want, strict=True))
    assert drop_repeated_lines(empty(spark), str(tmp_path / "none")).count() == 0


def test_runs_are_levelled(spark, tmp_path):
    from talkmill.llm.lines import LineRuns

    runs = LineRuns(spark, str(tmp_path / "runs"), minimum=3, fanout=2)
    for number in range(4):
        runs.add(spark.createDataFrame([(1, 1), (number, 7)], "h1 bigint, h2 bigint"))
    assert [level for level, _ in runs.runs] == [2]
    assert [tuple(r) for r in runs.settled_keys().collect()] == [(1, 1)]
    held = {tuple(r) for r in spark.table(runs.runs[0][1]).collect()}
    assert held == {(n, 7, 1) for n in range(4)}
    # Another session finds the runs by their folders.
    spark.sql(f"DROP TABLE {runs.runs[0][1]}")
    assert {tuple(r) for r in runs._read(runs.runs[0][1]).collect()} == held
    runs.discard()
    assert not os.path.exists(tmp_path / "runs")


def test_a_batch_meets_runs_bucket_by_bucket(spark, tmp_path):
    """Only the batch is shuffled: the runs lie as the merge join wants them."""
    from talkmill.llm.lines import LineRuns

    runs = LineRuns(spark, str(tmp_path / "runs"), fanout=9)
    keys = spark.range(5000).select("id", (F.col("id") * 7).alias("h2")).withColumnRenamed("id", "h1")
    runs.add(keys)
    batch = keys.where("h1 % 3 = 0")
    met = runs.met(runs.runs[0][1], batch)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan
    assert met.count() == 1667
    runs.discard()


# -- repeated bytes --------------------------------------------------------------------

@pytest.mark.parametrize("together,rows", [(2000, (10 ** 6, 10 ** 6)), (1, (0, 0))])
def test_repeated_bytes(spark, tmp_path, together, rows):
    from talkmill.llm.repeats import drop_repeated_bytes

    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(rnd.choices(vocabulary, k=60)) for _ in range(4)]
    table = list(EDGE)
    for i in range(40):
        own = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 50))) for _ in range(3)]
        some = rnd.choice(passages)[rnd.randint(0, 60):]
        table.append((100 + i, "s", own[0] + some + own[1] + "x" * rnd.choice([0, 230]) + own[2],
                      "en"))
    found = drop_repeated_bytes(edge_segments(spark, table), str(tmp_path / "r"),
                                shard_bytes=5000, together=together, broadcast_rows=rows)
    want = repeated_bytes([(t or "").encode() for _, _, t, _ in table], 200)
    assert ids((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.collect()) == ids(
        (i, *w) for (i, _, _, _), w in zip(table, want, strict=True))
    assert drop_repeated_bytes(empty(spark), str(tmp_path / "e")).count() == 0


def test_suffix_array_and_common_prefixes():
    from talkmill.llm.repeats import common_prefixes, suffix_array

    rnd = random.Random(2)
    for text in (b"banana" * 20, b"a" * 90, bytes(rnd.choices(b"ab", k=300)), b"x"):
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(data, len(text))
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
        shared = common_prefixes(data, order)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def test_long_texts_are_cut_into_pieces(monkeypatch):
    from talkmill.llm import repeats

    rnd = random.Random(4)
    text = bytes(rnd.choices(b"abcdefgh ", k=3000))
    monkeypatch.setattr(repeats, "PIECE", 700)
    rows = repeats.stretches(text)
    covered = sorted(p for _, _, s, n in rows.tolist() for p in range(s, s + n))
    assert covered == list(range(len(text) - 199))


# -- near copies -----------------------------------------------------------------------

@pytest.mark.parametrize("paired", [64, 1])
def test_near_copies(spark, paired):
    from talkmill.llm.simhash import near_copies

    rnd = random.Random(9)
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(400)]
    rows = [r for r in EDGE if r[0] is not None]
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(400)] = f"z{rnd.randint(0, 5)}"
        rows.append((100 + i, "s", " ".join(words), "en"))
    marks = [simhash(t or "") for _, _, t, _ in rows]
    want = classes(len(rows), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    least = defaultdict(lambda: 10 ** 9)
    for c, (i, _, _, _) in zip(want, rows, strict=True):
        least[c] = min(least[c], i)
    got = near_copies(edge_segments(spark, rows), paired=paired)
    assert ids(map(tuple, got.collect())) == ids(
        (i, f"{m:016x}", least[c]) for (i, _, _, _), m, c in zip(rows, marks, want, strict=True))
    assert len({least[c] for c in want}) < len(rows)
    assert near_copies(empty(spark)).count() == 0
    assert near_copies(edge_segments(spark)).count() == len(EDGE)


def test_components_of_a_long_chain(spark):
    from talkmill.llm.components import components

    links = spark.range(200).select("id", (F.col("id") + 1).alias("next")).where("id % 50 <> 49")
    roots = defaultdict(set)
    for node, root in components(links, "id", "next").collect():
        roots[root].add(node)
    assert sorted(map(sorted, roots.values())) == [list(range(a, a + 50)) for a in (0, 50, 100, 150)]


# -- language --------------------------------------------------------------------------

def test_language(spark):
    from talkmill.llm.bytenet import detect_language, learn_languages

    rnd = random.Random(1)
    words = {"en": "the and of that with have this from they which".split(),
             "de": "der und nicht über für schön mit auf eine große".split()}
    rows = [(i, "s", " ".join(rnd.choices(words[k], k=40)), k)
            for i in range(160) for k in [rnd.choice(["en", "de"])]]
    segments = edge_segments(spark, rows)
    net = learn_languages(segments.where("sequence_id % 2 = 0"))
    again = learn_languages(segments.where("sequence_id % 2 = 0").repartition(5))
    assert all(np.array_equal(net.taps[w], again.taps[w]) for w in net.taps)
    found = {r["sequence_id"]: r for r in detect_language(segments, net).collect()}
    truth = {i: k for i, _, _, k in rows}
    held = [i for i in truth if i % 2]
    assert sum(found[i]["detected"] == truth[i] for i in held) >= 0.95 * len(held)
    odd = detect_language(edge_segments(spark), net).collect()
    assert len(odd) == len(EDGE)
    assert {r["sequence_id"] for r in odd if r["detected"] == "und"} == {3, 4, 5, 16, None}
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert learn_languages(empty(spark)) is None
    assert {r["detected"] for r in detect_language(segments, None).collect()} == {"und"}


def test_periodic_text_is_a_few_stretches(spark, tmp_path):
    """Texts of one byte or of a short period, alone and beside ones that share a window."""
    from talkmill.llm.repeats import drop_repeated_bytes, stretches

    assert len(stretches(b"a" * 300_000)) == 2
    assert len(stretches(b"abcdefg" * 50_000)) < 10
    texts = ["a" * 5000, "a" * 199, "b" * 200, "xyz " * 700, "q" * 90 + "xyz " * 60, "c" * 207,
             "".join(chr(97 + i * i % 23) for i in range(900)), "d" * 400 + "e" * 400 + "d" * 250,
             "-" * 201 + " end", "start " + "b" * 210, "xyz" + " xyz" * 49 + " "]
    rows = [(i, "s", t, "en") for i, t in enumerate(texts)]
    for size in (1 << 20, 700):
        want = repeated_bytes([t.encode() for t in texts], 200)
        got = {r["sequence_id"]: tuple(r)[1:] for r in drop_repeated_bytes(
            edge_segments(spark, rows), str(tmp_path / f"p{size}"), shard_bytes=size).collect()}
        assert got == {i: (w[0], w[1], w[2], bytearray(w[3])) for i, w in enumerate(want)}


# -- archives --------------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    from talkmill.llm.warc import MAGIC, read_archive, write_archive

    body = "<p>" + "ä" * 80
    fake = (MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\n"
            "Content-Length: 5\r\n\r\nhello\r\n\r\n")
    html = {1: body, 2: body, 3: "short", 4: "short", 5: None, 6: "", 7: MAGIC, 8: fake + body,
            9: "x" * 70 + fake + MAGIC + fake, 10: fake * 3, 11: "\r\n\r\n" * 5, 12: body,
            13: "big " * 40000 + fake}
    rows = [(i, f"http://host/{i}" if i % 4 else None, h) for i, h in html.items()]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn(
        "value", F.lit(1)).repartition(3)
    first = {}
    for i, h in sorted(html.items()):
        first.setdefault(h or "", i)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for few, split in ((1000, old), (0, "3000")):
        folder = str(tmp_path / f"w{few}")
        write_archive(pages, folder, broadcast_repeated=few)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {int(r["page_id"]): r for r in read_archive(spark, folder, few).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert set(got) == set(html)
        for i, h in html.items():
            data, r = (h or "").encode(), got[i]
            again = len(data) >= 100 and first[h] != i
            assert r["record_type"] == ("revisit" if again else "response")
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == sha(data)
            assert r["refers_to"] == (str(first[h]) if again else None)
            assert r["payload"] == (None if again else data)
            assert r["url"] == (f"http://host/{i}" if i % 4 else None)
    empty_pages = pages.where("false")
    write_archive(empty_pages, str(tmp_path / "none"))
    assert read_archive(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_chains_reach_what_lengths_lead_to(spark, few):
    """Random candidates, some of which lead past or into runs of others, in several blocks."""
    from talkmill.llm.warc import chained

    rnd = random.Random(few)
    rows, want = [], set()
    for f in range(12):
        places = [0, *sorted(rnd.sample(range(1, 300), 60))] if f else [5, 9, 14]
        ends = [*places[1:], 400]
        leads = {a: b if rnd.random() < 0.8 else rnd.choice([p for p in [*ends, 401] if p > a])
                 for a, b in zip(places, ends, strict=True)}
        rows += [(f"f{f}", a // 100, i, a, b) for i, (a, b) in enumerate(leads.items())]
        at = 0
        while at in leads:
            want.add((f"f{f}", at))
            at = leads[at]
    df = spark.createDataFrame(rows, "file string, block bigint, seq bigint, at bigint, next bigint")
    got = [(r["file"], r["at"]) for r in chained(df, few).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# -- quality ---------------------------------------------------------------------------

def plain_probability(counts, order, vocabulary=256):
    """Interpolated modified Kneser-Ney over byte grams, straight from its definition."""
    levels = {order: Counter(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(level):
        n = [sum(1 for c in level.values() if c == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        out = []
        for i in (1, 2, 3):
            raw = i / 2 if y is None or not n[i] else i - (i + 1) * y * n[i + 1] / n[i]
            out.append(max(0.05, min(raw, i - 0.05)))
        return out

    d = {k: discounts(v) for k, v in levels.items()}

    def p(gram):
        if not gram:
            return 1 / vocabulary
        level, k = levels[len(gram)], len(gram)
        beside = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:])
        if not beside:
            return lower
        off = {g: min(d[k][min(c, 3) - 1], c) for g, c in beside.items()}
        own = beside.get(gram, 0) - off.get(gram, 0)
        return (own + sum(off.values()) * lower) / sum(beside.values())

    return p


def test_gram_probabilities(spark, tmp_path):
    """Joined prices and those that a task works out by itself, against the definition."""
    from talkmill.llm import fluency as Y

    rnd = random.Random(8)
    text = bytes(rnd.choices(b"aab", k=60)) + b"abcabd"
    counts = Counter(text[i:i + 3] for i in range(len(text) - 2))
    asked = [bytes(g) for g in ([97, 97, 97], [99, 99, 99], [122, 97, 98], [97, 122, 97],
                                *map(list, counts))]
    asked = list(dict.fromkeys(asked))
    number = {g: int.from_bytes(g, "big") for g in [*asked, *counts]}
    model = Y.gram_model(spark.createDataFrame(
        [(5, number[g], n) for g, n in counts.items()], "lang bigint, gram bigint, n bigint"), 3,
        str(tmp_path / "model"))
    p = plain_probability(counts, 3)
    want = {number[g]: pytest.approx(np.log(p(g))) for g in asked}
    got = model.prices(spark.createDataFrame([(5, number[g]) for g in asked],
                                             "lang bigint, gram bigint"))
    assert {r["gram"]: r["logp"] for r in got.collect()} == want
    table = model.entries().toArrow()
    entries = Y.Entries(table.column("key").to_numpy(), table.column("value").to_numpy())
    grams = np.array([number[g] for g in asked], np.uint64)
    logs, known = Y._priced(entries, np.full(len(grams), 5), grams, 3, True)
    assert known.all() and dict(zip(grams.tolist(), logs.tolist(), strict=True)) == want


def test_grams_end_at_every_byte():
    from talkmill.llm.fluency import grams_of

    texts = [b"", b"a", b"abcdefgh", b"", bytes([255] * 7), b"xy", b""]
    found, sizes = grams_of(texts, 6)
    want = [int.from_bytes((bytes(5) + t)[i:i + 6], "big") for t in texts for i in range(len(t))]
    assert found.tolist() == want and sizes.tolist() == [len(t) for t in texts]
    assert grams_of([], 6)[0].tolist() == [] and grams_of([b""], 6)[0].tolist() == []


def test_entries_hold_every_key():
    from talkmill.llm.fluency import Entries

    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate((rng.integers(0, 2**63, 5000), [0, 7], np.arange(90) << 57)))
    entries = Entries(keys, np.arange(len(keys), dtype=float))
    found, values = entries.get(keys.view(np.uint64))
    assert found.all() and values.tolist() == list(range(len(keys)))
    missing = np.setdiff1d(rng.integers(0, 2**63, 5000), keys).view(np.uint64)
    found, values = entries.get(missing)
    assert not found.any() and not values.any()


#: The whole model in every task; a part of it; nothing of it, and several shards.
PLACES = [{}, {"local_entries": 40, "shard_grams": 50}, {"local_entries": 0, "shard_grams": 7}]


@pytest.mark.parametrize("place", PLACES)
def test_fluency(spark, place):
    """Every perplexity against the definition, from what is held out to the thresholds."""
    from talkmill.llm.fluency import judge_fluency

    rnd = random.Random(6)
    words = "the and of that with have this from they which".split()
    rows = [(i, "s", " ".join(rnd.choices(words, k=12)), "en") for i in range(60)]
    rows += [(100, "s", "QXJ ZZV!! KQ#% WVX 0x99 " * 5, "en"), (101, "s", None, "en"),
             (102, "s", "no trusted text here", "fr"), (103, "s", "nor here", None),
             (104, "s", "the and of", "en"), (104, "s", "the and of", "en")]
    rows += [(i, "s", "und die den " + "der " * (i % 5), "de") for i in range(200, 212)]
    trusted = [*range(0, 60, 2), *range(200, 208)]
    segments = edge_segments(spark, rows)
    names = spark.createDataFrame([(i, "x") for i in trusted], "sequence_id bigint, text string")
    found = judge_fluency(segments, names, order=4, **place).collect()
    assert len(found) == len(rows)
    unseen = {r["sequence_id"] for r in names.where("pmod(xxhash64(sequence_id), 4) = 0").collect()}
    assert unseen & set(range(60)) and set(trusted) - unseen
    for language in ("en", "de"):
        mine = {i: (t or "").encode() for i, _, t, tag in rows if tag == language}
        counts = Counter()
        for i in set(trusted) - unseen:
            data = bytes(3) + mine.get(i, b"")
            counts.update(data[k:k + 4] for k in range(len(data) - 3))
        p = plain_probability(counts, 4)
        want, odd = {}, {}
        for i, data in mine.items():
            logs = [np.log(p((bytes(3) + data)[k:k + 4])) for k in range(len(data))]
            want[i] = float(np.exp(-np.mean(logs))) if logs else None
            odd[i] = (sum(max(0, -v - 6) for v in logs) / len(logs) ** 0.5) if logs else None
        got = {r["sequence_id"]: r["perplexity"] for r in found if r["language"] == language}
        assert got == {i: v if v is None else pytest.approx(v) for i, v in want.items()}
        held = [i for i in mine if i in unseen] or [i for i in mine if i in trusted]
        for r in found:
            if r["language"] == language:
                assert r["threshold"] == pytest.approx(np.quantile([want[i] for i in held], 0.99))
                assert r["surprise_threshold"] == pytest.approx(
                    np.quantile([odd[i] for i in held], 0.99), abs=1e-12)
                assert r["surprise"] == (odd[r["sequence_id"]] and pytest.approx(
                    odd[r["sequence_id"]]))
                assert r["kept"] == (r["perplexity"] is None or (
                    r["perplexity"] <= r["threshold"] and r["surprise"] <= r["surprise_threshold"]))
    by = {r["sequence_id"]: r for r in found}
    assert not by[100]["kept"] and by[100]["perplexity"] > 3 * by[100]["threshold"]
    assert by[101]["perplexity"] is None and by[102]["perplexity"] is None
    assert by[101]["kept"] and by[102]["kept"] and by[103]["kept"]


@pytest.mark.parametrize("place", PLACES[::2])
def test_fluency_of_nothing(spark, place):
    from talkmill.llm.fluency import judge_fluency

    rows = [(1, "s", "some text", "en"), (2, "s", "", "de"), (3, "s", None, None)]
    names = spark.createDataFrame([(1,), (2,)], "sequence_id bigint")
    assert judge_fluency(empty(spark), names, **place).count() == 0
    nobody = judge_fluency(edge_segments(spark, rows), names.where("false"), **place)
    assert nobody.where("kept").count() == len(rows)
    assert judge_fluency(edge_segments(spark), names, **place).count() == edge_segments(spark).count()


def test_fluency_sees_whole_words(spark):
    """Words strange in order, of letter sequences that are all common, cost more."""
    from talkmill.llm.fluency import judge_fluency

    rnd = random.Random(4)
    rows = [(i, "s", " ".join(rnd.choices(["abcdef", "bcdxyz"], k=40)), "en") for i in range(40)]
    rows += [(100, "s", " ".join(["abcdxyz"] * 40), "en")]
    trusted = spark.createDataFrame([(i, "x") for i in range(40)],
                                    "sequence_id bigint, text string")
    by = {r["sequence_id"]: r for r in
          judge_fluency(edge_segments(spark, rows), trusted).collect()}
    assert by[100]["perplexity"] > 1.2 * by[100]["threshold"]
