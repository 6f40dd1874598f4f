"""Whole-table queries of copies, mixing, secrets and benchmark overlap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.copies import exact_copies
from talkmill.llm.lines import drop_repeated_lines
from talkmill.llm.mixing import mix_sessions
from talkmill.llm.overlap import overlapping_words
from talkmill.llm.registry import query
from talkmill.llm.secrets import scan_revisions
from talkmill.llm.simhash import near_copies
from talkmill.session import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def segments_of(docs: DataFrame) -> DataFrame:
    """Documents as transcript segments."""
    return docs.select(F.col("doc_id").alias("sequence_id"), F.col("source").alias("session_id"),
                       "text", F.col("lang").alias("language"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(documents(spark, sf_dir))


@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256
      ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    max(n) OVER (PARTITION BY text_sha256) AS longest,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = longest AS kept,
  text_sha256 FROM g
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(segments(spark, sf_dir)).withColumnRenamed("sequence_id", "doc_id")


@query("op2_source_mix", r"""
WITH d AS (SELECT doc_id, source, md5('mix|' || doc_id) AS o,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS p FROM s0),
s2 AS (SELECT *, [3, 1, 2][(p - 1) % 3 + 1] AS weight FROM s1),
s3 AS (SELECT *, (2 * source_size)::DOUBLE / weight AS dry FROM s2),
s4 AS (SELECT *, (1.5e0 * sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY dry, p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY dry, p
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS reached FROM s3),
s5 AS (SELECT *, coalesce(max(CASE WHEN reached <= dry THEN reached END) OVER (),
    max(dry) OVER ()) AS level FROM s4),
s AS (SELECT source, weight, source_size,
    least((2 * source_size)::DOUBLE, level * weight) AS target FROM s5),
q AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.weight, d.o, d.source,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (SELECT q.*, k AS pass_no, greatest(0, least(size, round(target)::BIGINT
    - (upto + (k - 1) * source_size - size))) AS words,
    (upto + (k - 1) * source_size)::DOUBLE / weight AS finish
  FROM q, (VALUES (1), (2)) AS passes(k)),
m AS (SELECT *, row_number() OVER (ORDER BY finish,
    coalesce('s' || source, 'n'), o, pass_no) AS place FROM c WHERE words > 0)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::BIGINT AS taken,
  x.first_place
FROM q LEFT JOIN (SELECT doc_id, sum(words) AS taken, min(place) AS first_place
  FROM m GROUP BY doc_id) x USING (doc_id)
""")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mix = mix_sessions(segments(spark, sf_dir))
    used = mix.groupBy("session_id", "row").agg(F.sum("words").alias("taken"),
                                                F.min("place").alias("first_place"))
    return (rows.join(used, rows["session_id"].eqNullSafe(used["session_id"])
                      & (rows["row"] == used["row"]), "left")
            .select(rows["sequence_id"].alias("doc_id"), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
                    F.col("first_place").cast("bigint")))


@query("op6_secret_scan", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r(rank, kind, pattern, grp, shortest) AS (VALUES
  (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (2, 'access', 'AKIA[A-Z0-9]+', 0, 18), (3, 'hex', '[0-9a-f]+', 0, 16)),
m AS (
  SELECT doc_id, 1 AS rank, 'assign' AS kind, 12 AS shortest,
    string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS matches,
    regexp_extract_all(text, p, 2) AS measured
  FROM d, (SELECT pattern AS p FROM r WHERE rank = 1)
  UNION ALL SELECT doc_id, 2, 'access', 18, string_split_regex(text, 'AKIA[A-Z0-9]+'),
    regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 3, 'hex', 16, string_split_regex(text, '[0-9a-f]+'),
    regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM d),
e AS (SELECT doc_id, rank, kind, shortest, unnest(range(len(matches))) AS i,
    unnest(gaps[1:len(matches)]) AS gap, unnest(matches) AS hit, unnest(measured) AS measured
  FROM m WHERE len(matches) > 0),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM e),
f AS (SELECT doc_id, count(*) FILTER (WHERE rank = 1) AS n_assign,
    count(*) FILTER (WHERE rank = 2) AS n_access, count(*) FILTER (WHERE rank = 3) AS n_hex,
    string_agg(kind || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT, ','
      ORDER BY stop - length(hit), rank) AS spans
  FROM p WHERE length(measured) >= shortest GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM documents LEFT JOIN f USING (doc_id)
""")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a transcript with one revision; the ledger starts empty."""
    revisions = documents(spark, sf_dir).select(
        F.col("doc_id").alias("session_id"), F.lit(1).alias("revision"), "text")
    ledger = f"{shared_folder(spark)}/secret-ledgers/{uuid.uuid4().hex}"
    return scan_revisions(revisions, ledger).select(
        F.col("session_id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2("spans", 256).alias("base_sha256"), "spans")


@query("op8_benchmark_overlap", r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
    array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS s
    FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(len(w))) AS s FROM dw),
dg AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS gram
  FROM dp, (SELECT DISTINCT n FROM ig) WHERE s + n <= len(w)),
h AS (SELECT dg.doc_id, dg.s, dg.n, ig.item_id FROM dg JOIN ig USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""")
def op8_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_overlap(documents(spark, sf_dir), spark, sf_dir)


def judged_overlap(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("id"), F.col("text").alias("reference_text"))
    found = overlapping_words(segments_of(docs), items)
    return found.select(
        F.col("sequence_id").alias("doc_id"), "n_words", "n_hit",
        F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .alias("contaminated"))


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''),
      '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), ''))
    AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/line-runs/{uuid.uuid4().hex}"
    return drop_repeated_lines(segments(spark, sf_dir), folder).select(
        F.col("sequence_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2("text", 256).alias("kept_sha256"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(segments(spark, sf_dir)).withColumnRenamed("sequence_id", "doc_id")
