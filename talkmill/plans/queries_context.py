"""C2-C12, C14-C17, F14, F15 and J7: glossaries, context, routing and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators import context as C
from talkmill.operators import joins as J
from talkmill.plans import bindings as B
from talkmill.plans.queries_rules import TRANS, translations
from talkmill.plans.registry import query

KEY = ["session_id"]


# -- glossaries --------------------------------------------------------------------------

#: Words of fewer letters are left to the lines themselves.
LETTERS = 5


def _words(spark, sf_dir):
    """Every word of every benchmark text with the one before and the one after it."""
    words = B.table(spark, sf_dir, "benchmark").select("item_id", F.split("text", r"\s+").alias("w"))
    at = words.select("item_id", "w", F.posexplode("w").alias("p", "word"))
    near = lambda k: F.coalesce(F.get("w", F.col("p") + k), F.lit(""))
    return at.where(F.char_length("word") >= LETTERS).select(
        (F.col("item_id") * 4096 + F.col("p")).alias("idx"), "word", near(-1).alias("before"),
        near(1).alias("after"))


def global_terms(spark, sf_dir):
    """The long words of all benchmark texts as terms; some rows are malformed."""
    n = F.col("idx")
    return _words(spark, sf_dir).select(
        F.when(n % 10 == 9, " ").otherwise(F.col("word")).alias("source"),
        F.concat(F.lit("<"), "before", F.lit(">")).alias("target"),
        F.when(n % 2 == 0, F.concat(F.lit("~"), "word")).alias("romanized"),
        F.when(n % 3 == 1, "en").when(n % 3 == 2, "ja").alias("source_language"), "idx")


def job_terms(spark, sf_dir):
    """Each with the word after it; some have no target."""
    return _words(spark, sf_dir).select(
        F.concat_ws(" ", "word", "after").alias("source"),
        F.when(F.col("idx") % 8 == 1, "").otherwise(F.col("after")).alias("target"),
        F.lit("").alias("romanized"), F.lit("").alias("source_language"), "idx")


def all_terms(spark, sf_dir):
    """Global and job terms in this order."""
    return C.glossary(global_terms(spark, sf_dir), job_terms(spark, sf_dir))


TERMS = f"""
word AS (SELECT * FROM (SELECT item_id * 4096 + p AS idx, w[p + 1] AS word, coalesce(w[p], '') AS before,
    coalesce(w[p + 2], '') AS after FROM (SELECT item_id, w, unnest(range(len(w))) AS p FROM (
      SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark))) WHERE length(word) >= {LETTERS}),
raw_terms AS (
  SELECT CASE WHEN idx % 10 = 9 THEN ' ' ELSE word END AS source,
    '<' || before || '>' AS target, CASE WHEN idx % 2 = 0 THEN '~' || word END AS romanized,
    CASE idx % 3 WHEN 1 THEN 'en' WHEN 2 THEN 'ja' END AS source_language, 0 AS part, idx FROM word
  UNION ALL
  SELECT word || ' ' || after, CASE WHEN idx % 8 = 1 THEN '' ELSE after END, NULL, NULL, 1, idx
  FROM word),
terms AS (SELECT trim(source) AS source, trim(target) AS target, romanized, source_language,
    part, idx FROM raw_terms WHERE trim(source) <> '' AND trim(target) <> '')
"""
PLACED_TERMS = B.SEG + "," + TERMS + """
, lang AS (SELECT DISTINCT language FROM seg),
ranked AS (SELECT l.language, t.*, row_number() OVER (PARTITION BY l.language
    ORDER BY length(t.source) DESC, part, idx) - 1 AS place
  FROM lang l JOIN terms t ON t.source_language IS NULL OR t.source_language = l.language)
"""


@query("c06_glossary", f"""
WITH {TERMS}
SELECT source, target, coalesce(romanized, '') AS romanized,
  coalesce(source_language, '') AS source_language, part::BIGINT AS part, idx FROM terms""")
def glossary(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return all_terms(spark, sf_dir).select(
        "source", "target", blank("romanized"), blank("source_language"), "part", "idx")


def _lines(spark, sf_dir):
    seg, blk = B.segments(spark, sf_dir)
    return seg.select("session_id", "seq", *([blk] if blk else []), "text", "language",
                      "speaker"), blk


def with_terms(spark, sf_dir, limit=C.AUTOMATON_TERMS):
    lines, blk = _lines(spark, sf_dir)
    return C.attach_terms(lines, all_terms(spark, sf_dir), ["session_id", "seq"], "text",
                          "language", limit), blk


@query("c02_applicable_terms", f"""
WITH {PLACED_TERMS}
SELECT language, count(*) AS n, max(place) AS last_place,
  string_agg(source, '|' ORDER BY place) AS sources FROM ranked GROUP BY language""")
def applicable(spark, sf_dir):
    """Terms of each language spoken in the sessions, longest first."""
    lines, _ = _lines(spark, sf_dir)
    fits = C.per_language(all_terms(spark, sf_dir), lines, "language", "language")
    ordered = fits.groupBy("language").agg(F.array_sort(F.collect_list(F.struct(
        (-F.char_length("source")).alias("n"), "part", "idx", "source"))).alias("t"))
    return ordered.select(
        "language", F.size("t").cast("bigint").alias("n"),
        (F.size("t") - 1).cast("bigint").alias("last_place"),
        F.array_join(F.transform("t", lambda t: t["source"]), "|").alias("sources"))


@query("c02_term_places", f"""
WITH {PLACED_TERMS}
SELECT language, place, source, target, coalesce(romanized, '') AS romanized FROM ranked""")
def term_places(spark, sf_dir):
    """The same, a row per term: no row and no task holds a language's whole glossary."""
    lines, _ = _lines(spark, sf_dir)
    placed = C.placed_terms(all_terms(spark, sf_dir), lines, "language", "language")
    return placed.select("language", F.col("place").cast("bigint"), "source", "target",
                         F.coalesce("romanized", F.lit("")).alias("romanized"))


_RELEVANT = PLACED_TERMS + """
, hits AS (SELECT s.session_id, s.seq, string_agg(r.place || ':' || r.source, '|' ORDER BY r.place)
    AS found, count(*) AS n
  FROM seg s JOIN ranked r ON r.language = s.language AND contains(s.text, r.source)
  GROUP BY s.session_id, s.seq)
SELECT session_id, seq, n, found FROM hits
"""


def _relevant(df):
    return df.where(F.size("terms") > 0).select(
        "session_id", "seq", F.size("terms").cast("bigint").alias("n"),
        F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["place"], t["source"])),
                     "|").alias("found"))


@query("c03_relevant_terms", f"WITH {_RELEVANT}")
def relevant(spark, sf_dir):
    return _relevant(with_terms(spark, sf_dir)[0])


@query("c03_relevant_terms_joined", f"WITH {_RELEVANT}")
def relevant_joined(spark, sf_dir):
    """The same answer through the join that serves glossaries too large for one array."""
    return _relevant(with_terms(spark, sf_dir, limit=0)[0])


_PROTECT = PLACED_TERMS + """
, mine AS (SELECT s.session_id, s.seq, s.text, list({'p': r.place, 's': r.source, 't': r.target,
      'r': r.romanized} ORDER BY r.place) AS ts
  FROM seg s LEFT JOIN ranked r ON r.language = s.language AND contains(s.text, r.source) GROUP BY ALL),
swapped AS (SELECT session_id, seq, text, list_reduce(list_filter(ts, lambda t: t.s IS NOT NULL), lambda st, t:
    CASE WHEN contains(st.x, t.s) THEN {'x': replace(st.x, t.s, 'VBX' || t.p || 'X'),
      'm': list_append(st.m, t)} ELSE st END,
    {'x': text, 'm': []::STRUCT(p BIGINT, s VARCHAR, t VARCHAR, r VARCHAR)[]}) AS st FROM mine)
"""


@query("c04_protected_text", f"""
WITH {_PROTECT}
SELECT session_id, seq, st.x AS protected,
  array_to_string(list_transform(st.m, lambda t: t.s || '>' || t.t), '|') AS used FROM swapped""")
def protected(spark, sf_dir):
    df, _ = with_terms(spark, sf_dir)
    return df.withColumn("p", C.protect(F.col("text"), F.col("terms"))).select(
        "session_id", "seq", F.col("p.text").alias("protected"),
        F.array_join(F.transform("p.used", lambda t: F.concat_ws(">", t["source"], t["target"])),
                     "|").alias("used"))


_BACK = lambda how: (
    "CASE WHEN len(st.m) = 0 THEN y WHEN regexp_matches(" + how + ", 'VBX[0-9]+X') THEN "
    "trim(regexp_replace(regexp_replace(" + how
    + ", 'VBX[0-9]+X', '', 'g'), '\\s{2,}', ' ', 'g')) ELSE " + how + " END")
_PUT = lambda v: (
    "list_reduce(st.m, lambda a, t: {'x': replace(a.x, 'VBX' || t.p || 'X', " + v
    + ")}, {'x': y}).x")


@query("c05_restored_text", f"""
WITH {_PROTECT}, said AS (SELECT *, CASE WHEN seq % 6 = 0 THEN lower(st.x) || ' VBX99X  end'
    ELSE 'So ' || st.x END AS y FROM swapped)
SELECT session_id, seq, {_BACK(_PUT('t.t'))} AS translated, {_BACK(_PUT('t.s'))} AS preserved,
  {_BACK(_PUT("t.s || ' (' || coalesce(t.r, t.t) || ')'"))} AS romanized FROM said""")
def restored(spark, sf_dir):
    df, _ = with_terms(spark, sf_dir)
    p = df.withColumn("p", C.protect(F.col("text"), F.col("terms"))).withColumn(
        "y", F.when(F.col("seq") % 6 == 0, F.concat(F.lower("p.text"), F.lit(" VBX99X  end")))
        .otherwise(F.concat(F.lit("So "), F.col("p.text"))))
    back = lambda how, name: C.restore(F.col("y"), F.col("p.used"), how).alias(name)
    return p.select("session_id", "seq", back("translate", "translated"),
                    back("preserve", "preserved"), back("preserve_and_romanize", "romanized"))


# -- corpora, routing --------------------------------------------------------------------

@query("c07_parallel_corpus", """
SELECT c.turn * 1000000 + c.conv_id AS id, c.text AS reference_text,
  d.text AS reference_translation
FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id + 1 AND d.turn = c.turn
ORDER BY id LIMIT 200""")
def parallel(spark, sf_dir):
    """Turn t of one session next to turn t of the following one, first 200 by id."""
    c = B.table(spark, sf_dir, "conversations")
    ident = lambda conv: (F.col("turn") * 1_000_000 + conv).cast("string").alias("id")
    source = c.select(ident(F.col("conv_id")), "text")
    target = c.select(ident(F.col("conv_id") - 1), "text")
    return J.parallel_corpus(source, target, "id", "text", 200).withColumn(
        "id", F.col("id").cast("bigint"))


@query("c08_usable_items", """
WITH item AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS r,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lower(text) END AS t FROM documents)
SELECT i.id, r AS reference_text, t AS reference_translation, quality FROM item i
JOIN labels l ON l.doc_id = i.id WHERE r <> '' AND t <> ''""")
def usable_items(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    items = d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text"))
        .alias("reference_text"),
        F.when(F.col("doc_id") % 4 != 0, F.lower("text"))
        .alias("reference_translation"))
    labels = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return J.usable(items).join(labels, "id").select(
        "id", "reference_text", "reference_translation", "quality")


@query("c09_provider_routing", f"""
WITH {TRANS}, ov(language, provider) AS (
  SELECT target_language, 'contextual_' || count(*) % 7 FROM trans WHERE target_language <> 'en'
  GROUP BY target_language)
SELECT session_id, seq, coalesce(CASE WHEN seq % 4 = 1 THEN 'named' END, provider, 'opus_mt')
  AS provider FROM trans LEFT JOIN ov ON language = target_language""")
def provider_routing(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    overrides = (t.where(F.col("target_language") != "en").groupBy("target_language").count()
                 .select(F.col("target_language").alias("language"), F.concat(
                     F.lit("contextual_"), (F.col("count") % 7).cast("string")).alias("provider")))
    asked = t.withColumn("explicit", F.when(F.col("seq") % 4 == 1, "named"))
    return J.route_provider(asked, overrides, "opus_mt").select("session_id", "seq", "provider")


@query("c10_language_routing", f"""
WITH {TRANS}, e(name, languages) AS (VALUES ('a', ['en','ja']), ('b', []::VARCHAR[]), ('c', ['ko']))
SELECT session_id, seq, CASE WHEN len(languages) = 0 OR list_contains(languages, target_language)
  THEN name ELSE 'fallback' END AS engine
FROM trans JOIN e ON name = ['a','b','c'][seq % 3 + 1]""")
def language_routing(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    engines = spark.createDataFrame([("a", ["en", "ja"]), ("b", []), ("c", ["ko"])],
                                    "name string, languages array<string>")
    asked = t.select("session_id", "seq", F.col("target_language").alias("language"),
                     F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")),
                                  (F.col("seq") % 3 + 1).cast("int")).alias("primary"))
    return J.route_by_language(asked, engines, "fallback").select("session_id", "seq", "engine")


@query("c11_pair_support", f"""
WITH {TRANS}, e(engine, pairs, sources, targets) AS (VALUES
  ('a', ['ja>ko','en>ja'], []::VARCHAR[], []::VARCHAR[]),
  ('b', []::VARCHAR[], ['en','ja'], []::VARCHAR[]), ('c', []::VARCHAR[], []::VARCHAR[], ['en']))
SELECT session_id, seq, e.engine, coalesce(CASE WHEN len(pairs) > 0
    THEN list_contains(pairs, source_language || '>' || target_language)
  ELSE (len(sources) = 0 OR list_contains(sources, source_language))
    AND (len(targets) = 0 OR list_contains(targets, target_language)) END, false) AS supported
FROM trans JOIN e ON e.engine = ['a','b','c'][seq % 3 + 1]""")
def pair_support(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    engines = spark.createDataFrame(
        [("a", ["ja>ko", "en>ja"], [], []), ("b", [], ["en", "ja"], []), ("c", [], [], ["en"])],
        "engine string, pairs array<string>, sources array<string>, targets array<string>")
    asked = t.withColumn("engine", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")),
                                                (F.col("seq") % 3 + 1).cast("int")))
    return J.supports(asked, engines).select("session_id", "seq", "engine", "supported")


@query("c12_voice_map", f"""
WITH {B.SEG}
SELECT session_id, seq, CASE speaker WHEN 0 THEN 'deep' ELSE 'source' END AS voice FROM seg""")
def voice_map(spark, sf_dir):
    seg, _ = B.segments(spark, sf_dir)
    voices = spark.createDataFrame([(0, "deep")], "speaker int, voice string")
    return J.voice_for(seg.select("session_id", "seq", "speaker"), voices, "source").select(
        "session_id", "seq", "voice")


@query("c14_matrix_overlay", """
WITH base AS (SELECT p_partkey AS key, p_brand AS provider, p_type AS kind,
    p_retailprice AS price FROM part WHERE p_partkey % 5 <> 0),
chg AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) END AS provider,
    p_retailprice + 1 AS price FROM part WHERE p_partkey % 2 = 0)
SELECT key, coalesce(c.provider, b.provider, '') AS provider, coalesce(kind, '') AS kind,
  round(coalesce(c.price, b.price), 2) AS price FROM base b FULL JOIN chg c USING (key)""")
def matrix_overlay(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = p.where(k % 5 != 0).select(k.alias("key"), F.col("p_brand").alias("provider"),
                                      F.col("p_type").alias("kind"),
                                      F.col("p_retailprice").alias("price"))
    changes = p.where(k % 2 == 0).select(
        k.alias("key"), F.when(k % 3 == 0, F.upper("p_name")).alias("provider"),
        (F.col("p_retailprice") + 1).alias("price"))
    out = J.overlay(base, changes, "key")
    return out.select("key", F.coalesce("provider", F.lit("")).alias("provider"),
                      F.coalesce("kind", F.lit("")).alias("kind"),
                      F.round("price", 2).alias("price"))


_LANGS = ", ".join(f"('{c}', '{n}')" for c, n in dims.LANGUAGE_NAMES.items())
_TIERS = ", ".join(f"('{a}', '{b}', {t})" for a, b, t in dims.PAIRS)


@query("c15_pair_catalogue", f"""
WITH {TRANS}, langs(code, name) AS (VALUES {_LANGS}), tiers(source, target, tier) AS (VALUES {_TIERS}),
asked AS (SELECT source_language AS source, target_language AS target, count(*) AS lines
  FROM trans GROUP BY ALL)
SELECT a.source, a.target, coalesce(s.name, a.source) AS source_name,
  coalesce(t.name, a.target) AS target_name, coalesce(tier, 0) AS tier, lines
FROM asked a LEFT JOIN tiers USING (source, target) LEFT JOIN langs s ON s.code = a.source
LEFT JOIN langs t ON t.code = a.target""")
def pair_catalogue(spark, sf_dir):
    """Pairs in use with names, tier and line counts."""
    t, _ = translations(spark, sf_dir)
    asked = t.groupBy(F.col("source_language").alias("source"),
                      F.col("target_language").alias("target")).agg(F.count("*").alias("lines"))
    tiers = asked.join(dims.language_pairs(spark), ["source", "target"], "left").withColumn(
        "tier", F.coalesce("tier", F.lit(0)))
    named = J.pair_catalogue(tiers.drop("lines"), dims.languages(spark))
    return named.join(asked, ["source", "target"])


@query("c16_translation_memory", f"""
WITH {TRANS}, memory AS (SELECT source_language, target_language, source_text,
    min('= ' || lower(source_text)) AS translation FROM trans WHERE seq % 2 = 1 GROUP BY 1, 2, 3)
SELECT session_id, seq, coalesce(translation, '[' || t.target_language || '] ' || t.source_text)
  AS translated_text, translation IS NOT NULL AS known
FROM trans t LEFT JOIN memory USING (source_language, target_language, source_text)""")
def translation_memory(spark, sf_dir):
    t, _ = translations(spark, sf_dir)
    lines = t.drop("translated_text")
    memory = (t.where(F.col("seq") % 2 == 1)
              .groupBy("source_language", "target_language", "source_text")
              .agg(F.min(F.concat(F.lit("= "), F.lower("source_text"))).alias("translation")))
    return J.from_memory(lines, memory).select("session_id", "seq", "translated_text", "known")


@query("c17_echo_removal", """
WITH c AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls
  FROM conversations),
k AS (SELECT conv_id, turn, list_transform(ls, lambda x: '=> ' || trim(x)) AS ls,
  list_filter(list_transform(ls, lambda x: trim(x)), lambda x: length(x) % 2 = 0
    OR length(x) < 40) AS known FROM c),
f AS (SELECT *, list_filter(ls, lambda x: NOT list_contains(known,
    trim(regexp_replace(x, '^[=> ]+', '')))) AS fresh FROM k)
SELECT conv_id, turn, array_to_string(CASE WHEN len(ls) <= 1 THEN ls WHEN len(fresh) > 0 THEN fresh
  ELSE ls[len(ls):] END, '|') AS kept FROM f""")
def echo_removal(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    ls = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    k = c.select("conv_id", "turn", ls.alias("ls")).select(
        "conv_id", "turn",
        F.transform("ls", lambda x: F.concat(F.lit("=> "), F.trim(x))).alias("ls"),
        F.filter(F.transform("ls", F.trim), lambda x: (F.char_length(x) % 2 == 0)
                 | (F.char_length(x) < 40)).alias("known"))
    return k.select("conv_id", "turn", F.array_join(
        J.drop_echo(F.col("ls"), F.col("known")), "|").alias("kept"))


# -- rolling context ---------------------------------------------------------------------

def _tok(c: str) -> str:
    narrow = (f"length(regexp_replace({c}, '[\\x{{0900}}-\\x{{097f}}\\x{{3040}}-\\x{{30ff}}"
              f"\\x{{3400}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]', '', 'g'))")
    return f"(length({c}) - {narrow} + {narrow} // 4 + 1)"


CONTEXT = TRANS + f"""
, ctx0 AS (SELECT *, trim(translated_text) <> '' AS ok, {_tok('source_text')} AS own,
    {_tok('source_text')} + {_tok('translated_text')} AS cost FROM trans),
ctx1 AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session_id
    ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0 FROM ctx0),
acc AS (SELECT session_id, n0 AS p, source_text AS s, translated_text AS t, speaker AS k, cost
  FROM ctx1 WHERE ok),
held AS (SELECT c.session_id, c.seq, any_value(c.own) AS own,
    list({{'s': a.s, 't': a.t, 'k': a.k, 'c': a.cost}} ORDER BY a.p)
      FILTER (a.p IS NOT NULL) AS h
  FROM ctx1 c LEFT JOIN acc a ON a.session_id = c.session_id AND a.p < c.n0 AND a.p >= c.n0 - 32
  GROUP BY c.session_id, c.seq),
split AS (SELECT session_id, seq, own, coalesce(h, []) AS h,
    list_reverse(list_slice(coalesce(h, []), greatest(1, len(coalesce(h, [])) - 7), len(coalesce(h, [])))) AS newest,
    list_slice(coalesce(h, []), 1, greatest(0, len(coalesce(h, [])) - 8)) AS older FROM held),
picked AS (SELECT session_id, seq, older, list_reduce(newest, lambda st, e:
    CASE WHEN st.u + e.c > {{budget}} - own THEN {{{{'u': st.u, 'k': st.k, 'd': list_prepend(e, st.d)}}}}
      ELSE {{{{'u': st.u + e.c, 'k': list_prepend(e, st.k), 'd': st.d}}}} END,
    {{{{'u': 0::BIGINT, 'k': list_slice(newest, 1, 0), 'd': list_slice(newest, 1, 0)}}}}) AS st FROM split),
context AS (SELECT session_id, seq, st.k AS kept,
    array_to_string(list_filter(list_transform(list_concat(older, st.d), lambda e: trim(e.t)),
      lambda t: t <> ''), ' ') AS said FROM picked)
"""
_CTX = CONTEXT.replace("{{", "{").replace("}}", "}").replace("{budget}", "120")


def context(spark, sf_dir, **limits):
    t, blk = translations(spark, sf_dir)
    return C.rolling_context(t, KEY, ["seq"], blk, accepted=~X.blank("translated_text"),
                             **limits), blk


@query("f14_rolling_context", f"""
WITH {_CTX}
SELECT session_id, seq, array_to_string(list_transform(kept, lambda e: e.s || ' => ' || e.t), '|')
  AS previous, CASE WHEN length(said) > 400 THEN '...' || right(said, 400) ELSE said END AS summary
FROM context""")
def rolling_context(spark, sf_dir):
    df, _ = context(spark, sf_dir, max_tokens=120)
    return df.select("session_id", "seq", F.array_join(F.transform(
        "previous", lambda e: F.concat_ws(" => ", e["source"], e["translated"])), "|")
        .alias("previous"), "summary")


@query("f15_bounded_window", f"""
WITH {TRANS}, w AS (SELECT session_id, seq, list(source_text) OVER (PARTITION BY session_id
    ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ts FROM trans),
f AS (SELECT session_id, seq, list_reduce(list_reverse(ts), lambda st, t:
    CASE WHEN st.o AND st.u + length(t) <= 150
      THEN {{'u': st.u + length(t), 'o': true, 'k': list_prepend(t, st.k)}}
      ELSE {{'u': st.u, 'o': false, 'k': st.k}} END,
    {{'u': 0::BIGINT, 'o': true, 'k': []::VARCHAR[]}}) AS st FROM w)
SELECT session_id, seq, array_to_string(st.k, '|') AS kept FROM f""")
def bounded_window(spark, sf_dir):
    t, blk = translations(spark, sf_dir)
    out = C.bounded_window(t, KEY, ["seq"], blk, max_segments=4, max_characters=150)
    return out.select("session_id", "seq", F.array_join("window", "|").alias("kept"))


@query("i10_prompts", f"""
WITH {_CTX}, {TERMS},
lang AS (SELECT DISTINCT source_language AS language FROM trans),
ranked AS (SELECT l.language, t.*, row_number() OVER (PARTITION BY l.language
    ORDER BY length(t.source) DESC, part, idx) AS place
  FROM lang l JOIN terms t ON t.source_language IS NULL OR t.source_language = l.language),
hay AS (SELECT c.session_id, c.seq, t.source_text, t.source_language, t.target_language, t.speaker,
    c.kept, c.said, t.source_text || array_to_string(list_transform(c.kept, lambda e: e.s), '') AS hay
  FROM context c JOIN trans t USING (session_id, seq)),
found AS (SELECT h.session_id, h.seq, string_agg(r.source || ' => ' || r.target, chr(10)
    ORDER BY r.place) AS g FROM hay h JOIN ranked r ON r.language = h.source_language
    AND contains(h.hay, r.source) GROUP BY h.session_id, h.seq),
blocks AS (SELECT h.*, g, CASE WHEN length(said) > 400 THEN '...' || right(said, 400) ELSE said END AS summary
  FROM hay h LEFT JOIN found f USING (session_id, seq))
SELECT session_id, seq, concat_ws(chr(10) || chr(10),
  CASE WHEN summary <> '' THEN '<summary>Earlier in this conversation: ' || summary || '</summary>' END,
  CASE WHEN len(kept) > 0 THEN '<context>' || chr(10) || array_to_string(list_transform(kept, lambda e:
    CASE WHEN e.k IS NULL THEN '' ELSE '[speaker ' || e.k || '] ' END || e.s || chr(10) || '  => ' || e.t),
    chr(10)) || chr(10) || '</context>' END,
  '<glossary>' || chr(10) || g || chr(10) || '</glossary>',
  '<current>' || CASE WHEN speaker IS NULL THEN '' ELSE '[speaker ' || speaker || '] ' END
    || trim(source_text) || '</current>') AS user_prompt,
  CASE source_language WHEN 'en' THEN 'English' WHEN 'ja' THEN 'Japanese' WHEN 'ko' THEN 'Korean'
    WHEN 'hi' THEN 'Hindi' ELSE 'Chinese' END || '>' || CASE target_language WHEN 'en' THEN 'English'
    WHEN 'ja' THEN 'Japanese' ELSE 'Korean' END AS pair
FROM blocks""")
def prompt_table(spark, sf_dir):
    df, _ = context(spark, sf_dir, max_tokens=120)
    hay = F.concat("source_text", F.array_join(F.transform(
        "previous", lambda e: e["source"]), ""))
    df = C.attach_terms(df.withColumn("_hay", hay), all_terms(spark, sf_dir),
                        ["session_id", "seq"], "_hay", "source_language")
    out = C.prompts(df)
    pair = F.concat_ws(">", F.regexp_extract("system", r"working on (\w+) to (\w+)", 1),
                       F.regexp_extract("system", r"working on (\w+) to (\w+)", 2))
    return out.select("session_id", "seq", F.col("user").alias("user_prompt"), pair.alias("pair"))
