"""Registered training-data queries on the smallest tables, and the pipeline's stages."""

import os

import pytest
from pyspark.sql import functions as F

from talkmill.llm.registry import registered
from tests.compare import compare, connection
from tests.llm.edge import classes, repeated_bytes, sha, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES, SQL = registered()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, connection(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def test_near_copies_query(spark):
    docs = texts(spark)
    marks = [simhash(t) for _, t in docs]
    want = classes(len(docs), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    assert got == {docs[i][0]: (f"{marks[i]:016x}", docs[want[i]][0]) for i in range(len(docs))}


def test_repeated_bytes_query(spark):
    docs = texts(spark)
    want = repeated_bytes([t.encode() for _, t in docs], 200)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
           for r in QUERIES["op9_suffix_array_dedup"](spark, SF).collect()}
    assert got == {i: (*w[:3], sha(w[3])) for (i, _), w in zip(docs, want, strict=True)}


def test_language_query_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_quality_query_keeps_labelled_quality(spark):
    """On the next larger tables; the smallest have nine labelled documents of no quality."""
    larger = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = QUERIES["op3_quality_perplexity"](spark, larger).join(labels, "doc_id")
    share = {r["quality"]: r["share"] for r in rows.where("toxic = 0").groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[1] >= 0.97 and share.get(0, 0) <= 0.3


def test_quality_query_drops_low_quality_and_some_toxic(spark):
    """Kept shares of all labels, toxic ones too, on tables with enough labels."""
    large = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    rows = QUERIES["op3_quality_perplexity"](spark, large).join(labels, "doc_id")
    share = {(r["quality"], r["toxic"]): r["share"] for r in rows.groupBy("quality", "toxic")
             .agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[1, 0] >= 0.98 and share[0, 0] <= 0.08 and share[1, 1] <= 0.7


def test_pipeline(spark, tmp_path):
    """Each stage against its own operator's rule, on what the stage before it kept."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"),
        "lang", "source", "n_chars")).withColumn("_gone", F.lit(1)).withColumn("kept", F.lit(0))
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
        if name != "mix_sources":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name == "language_id":
            assert docs.where("text is null").isEmpty()
        if name == "exact_dedup":
            bare = F.regexp_replace("text", r"[ \t-\r]", "")
            assert docs.count() == docs.select(bare).distinct().count() == (
                before.select(bare).distinct().count())
        if name == "near_dedup":
            rows = [r["text"] for r in docs.select("text").collect()]
            marks = [simhash(t) for t in rows]
            assert len(set(classes(len(marks), lambda a, b: (
                marks[a] ^ marks[b]).bit_count() <= 2))) == len(marks)
        if name == "decontaminate":
            again = pipeline.judged_overlap(before, spark, SF).where("contaminated")
            assert before.count() - docs.count() == again.count() > 0
    assert {"taken", "place"} <= set(docs.columns)
    assert docs.select("place").distinct().count() == docs.count()
    assert pipeline.run(spark, SF).count() > 0


def rows_of(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, source string, text string, lang string")


def test_pipeline_judges_rows_one_by_one(spark):
    """Clean texts without an id, or under a repeated id, beside rejected ones."""
    import corpus_pipeline as pipeline

    clean = ["the first clean text about rivers and old bridges",
             "another clean text which speaks of winter trains", "a third one on cooking soup"]
    docs = rows_of(spark, [(None, "a", None, "en"), (None, "a", clean[0], "en"),
                           (None, "b", clean[1], "en"), (7, "a", "123 456", "en"),
                           (7, "a", clean[2], "en")])
    for stage in (pipeline.language_id, pipeline.exact_dedup, pipeline.near_dedup):
        kept = stage(spark, docs, SF)
        assert sorted(r["text"] for r in kept.collect() if r["text"] in clean) == sorted(clean)
    copies = rows_of(spark, [(None, "a", clean[0], "en"), (None, "b", clean[0], "en"),
                             (None, "a", clean[1], "en"), (3, "a", clean[2], "en"),
                             (3, "a", clean[2], "en"), (4, "b", clean[2], "en")])
    for stage in (pipeline.exact_dedup, pipeline.near_dedup):
        kept = stage(spark, copies, SF).collect()
        assert sorted(r["text"] for r in kept) == sorted(clean)
        assert {r["doc_id"] for r in kept} == {None, 3}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()
    marked = rows_of(spark, [(None, "a", item["text"], "en"), (None, "a", clean[0], "en")])
    kept = pipeline.decontaminate(spark, marked, SF).collect()
    assert [r["text"] for r in kept] == [clean[0]]


def test_pipeline_without_labels_and_on_nothing(spark):
    """No label: no network and nothing to reject by.  An empty table passes every stage."""
    import corpus_pipeline as pipeline

    bare = rows_of(spark, [(i, "a", f"text number {i} of some words", None) for i in range(20)])
    assert pipeline.language_id(spark, bare, SF).count() == 20
    for _, stage in pipeline.STAGES:
        out = stage(spark, bare.where(F.lit(False)), SF)
        assert out.count() == 0 and set(bare.columns) <= set(out.columns)


def test_pipeline_language_stage_rejects_by_confidence(spark, monkeypatch):
    """What windows of a text look like decides, not whether it has letters."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text", "lang")
    seen = []

    def spy(segments, net):
        found = detect_language(segments, net)
        seen.append(found)
        return found.withColumn("confidence", F.when(
            F.col("sequence_id.id") == -5, 0.3).otherwise(F.col("confidence")))

    detect_language = pipeline.detect_language
    monkeypatch.setattr(pipeline, "detect_language", spy)
    more = docs.unionByName(rows_of(spark, [(-5, "m", "unclear " * 40, None), (-6, "m", "the and of", None)]))
    kept = {r["doc_id"] for r in pipeline.language_id(spark, more, SF).collect()}
    assert -5 not in kept and -6 in kept
    labelled = {r["doc_id"] for r in docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'").collect()}
    assert labelled <= kept
    row = seen[0].where("sequence_id.id = -6").first()
    assert 0 < row["score"] <= row["confidence"] <= 1


def test_pipeline_takes_any_column_name(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "a", "one text here", "en", 1, 2, 3)] * 2 + [(2, "a", "another text there", "de", 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, lang string, "
                                       "_pipeline_key int, `a.b` int, key int")
    for stage in (pipeline.exact_dedup, pipeline.near_dedup):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted(tuple(r) for r in kept.collect()) == sorted({tuple(r) for r in rows})


def test_pipeline_of_texts_of_megabytes(spark):
    import corpus_pipeline as pipeline

    long = "the quick brown fox runs over the lazy dog and on " * 60_000
    rows = [(1, "a", long, "en"), (2, "a", long + " ", "en"), (3, "b", "a short text of words", "en"),
            (4, "b", "der kurze Text hat Worte", "de")]
    docs = rows_of(spark, rows)
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {2, 3, 4}
    assert pipeline.STAGES[4][1](spark, docs, SF).where("taken > 0").count() > 0


def test_pipeline_keeps_texts_in_several_languages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "source", "text", "lang")
    parts = {r["lang"]: r["text"] for r in docs.where("length(text) > 1000").groupBy("lang").agg(
        F.min_by("text", "doc_id").alias("text")).collect()}
    assert len(parts) >= 3
    mixed = "".join(t[:400] for t in list(parts.values()) * 3)
    more = docs.unionByName(rows_of(spark, [(-1, "m", mixed, None), (-2, "m", "ok so", None)]))
    kept = pipeline.language_id(spark, more, SF).where("doc_id < 0").collect()
    assert {r["doc_id"] for r in kept} == {-1, -2}


def test_mix_counts_every_row_once(spark, tmp_path):
    """Null and repeated ids: no row beyond its passes, no source beyond its target."""
    import corpus_pipeline as pipeline

    rows = [(None, "a", "one two three", "en")] * 3 + [(None, "b", f"w{i} x", "en")
                                                       for i in range(9)]
    rows += [(5, "c", "four five six seven", "en")] * 4 + [(5, "c", "eight nine", "en"),
                                                          (6, None, "ten", "en"),
                                                          (None, "a", None, "en")]
    docs = rows_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op2_source_mix"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in found)
    mix = pipeline.mix_sources(spark, docs, SF).collect()
    target = {r["source"]: r["target"] for r in pipeline.mix_sessions(
        pipeline.segments_of(docs))[0].withColumnRenamed("session_id", "source").collect()}
    assert all(r["taken"] <= 2 * len(r["text"].split()) for r in mix)
    for source, want in target.items():
        assert abs(sum(r["taken"] for r in mix if r["source"] == source) - want) <= 1
    assert sum(r["taken"] for r in found) == sum(r["taken"] for r in mix)
    assert len({r["place"] for r in mix}) == len(mix)
