"""Translation context: glossaries, rolling history, prompts."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims
from talkmill.functions import text as X
from talkmill.operators.ordered import Scan, scan, split_hot

#: Placed terms (over all languages), and characters of terms, that may travel to every task;
#: beyond it terms are joined by their starts.
AUTOMATON_TERMS = 100_000
AUTOMATON_CHARS = 4_000_000


# -- glossary --------------------------------------------------------------------------------

def glossary(*parts: DataFrame) -> DataFrame:
    """Concatenate glossaries in order; rows without a source or target term are skipped.

    Each part has source, target, romanized, source_language and ``idx`` (its order).
    """
    out = None
    for number, part in enumerate(parts):
        cleaned = part.select(
            X.strip(F.coalesce("source", F.lit(""))).alias("source"),
            X.strip(F.coalesce("target", F.lit(""))).alias("target"),
            F.nullif(F.col("romanized"), F.lit("")).alias("romanized"),
            F.nullif(F.col("source_language"), F.lit("")).alias("source_language"),
            F.lit(number).cast("bigint").alias("part"), F.col("idx").cast("bigint").alias("idx"))
        out = cleaned if out is None else out.unionAll(cleaned)
    return out.where((F.col("source") != "") & (F.col("target") != ""))


def _rank(t: Column) -> Column:
    """Longest source first, then the given order."""
    return F.struct((-F.char_length(t["source"])).alias("n"), t["part"].alias("part"),
                    t["idx"].alias("idx"), t["source"].alias("source"),
                    t["target"].alias("target"), t["romanized"].alias("romanized"),
                    t["source_language"].alias("source_language"))


def per_language(terms: DataFrame, lines: DataFrame, language: str, name: str) -> DataFrame:
    """Every term once per spoken language it applies to (``''`` stands for no language).

    The languages in use are a short list, so terms are exploded over it; a term without a
    language applies to all lines, and a line without one takes all terms.
    """
    spoken = lines.agg(F.collect_set(F.coalesce(language, F.lit("")))).scalar()
    listed = terms.withColumn("_spoken", spoken)
    return listed.withColumn(name, F.explode(F.filter("_spoken", lambda tag: (
        (tag == "") | F.col("source_language").isNull()
        | (tag == F.col("source_language")))))).drop("_spoken")


def placed_terms(terms: DataFrame, lines: DataFrame, language: str, name: str) -> DataFrame:
    """``name, place, source, target, romanized``: the terms of every spoken language, with
    their places from 0, longest first and then in the given order."""
    sized = terms.withColumn("_t", _rank(F.struct(*[F.col(c) for c in (
        "source", "target", "romanized", "source_language", "part", "idx")])))
    placed = per_language(sized, lines, language, name).select(
        name, "_t", "source", "target", "romanized", F.col("_t.n").alias("_n"))
    # A language may hold most terms, and most terms one length, so places are numbered like
    # any hot key's rows, along the length and then the given order.
    placed = placed.withColumn("_n", F.col("_n") * (1 << 40) + F.least(
        F.col("_t.part") * (1 << 32) + F.col("_t.idx"), F.lit((1 << 40) - 1)))
    placed, blk = split_hot(placed, [name], "_n")
    ranked = scan(placed, [name], ["_t"], blk, place=Scan("number"))
    return ranked.select(name, (F.col("place") - 1).alias("place"), "source", "target", "romanized")


def attach_terms(lines: DataFrame, terms: DataFrame, key: list[str], haystack: str,
                 language: str, limit: int = AUTOMATON_TERMS) -> DataFrame:
    """Add ``terms``: the applicable glossary terms that occur in ``haystack``, longest
    first, each with ``place``, its index among all applicable terms of that language.

    A glossary of bounded size is one automaton in every task, which finds all terms in one
    pass over a line.  A larger one is joined: every line offers hashes of the substrings
    that can begin a term.
    """
    # A blank language is none: all terms apply, in both plans.
    lines = lines.withColumn("_tag", F.nullif(F.col(language), F.lit("")))
    size = terms.limit(limit + 1).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_language").alias("langs"),
        F.coalesce(F.sum(F.char_length("source") + F.char_length("target") + F.coalesce(
            F.char_length("romanized"), F.lit(0))), F.lit(0)).alias("chars")).head()
    if size["n"] * (size["langs"] + 2) > limit or size["chars"] > AUTOMATON_CHARS:
        return _join_terms(lines, terms, key, haystack, "_tag").drop("_tag")
    found = _term_finder([tuple(t) for t in terms.select(
        "source", "target", "romanized", "source_language", "part", "idx").collect()])
    return lines.withColumn("terms", found(F.col(haystack), F.col("_tag"))).drop("_tag")


_TERMS = T.ArrayType(T.StructType([
    T.StructField("place", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("romanized", T.StringType())]))


_FOUND = pa.struct([("place", pa.int64()), ("source", pa.string()), ("target", pa.string()),
                    ("romanized", pa.string())])


class TermFinder:
    """A glossary as one automaton, a trie of its sources with failure links, and per language
    the places of the terms that apply.  Both are built in the task, on first use."""

    def __init__(self, terms: list[tuple]) -> None:
        # As ranked in the join: longest first, then the given order.
        self.terms = sorted(terms, key=lambda t: (
            -len(t[0]), *t[4:6], t[0], t[1], t[2] or "", t[3] or ""))
        self.languages = {t[3] for t in terms}
        self.number = {s: i for i, s in enumerate(dict.fromkeys(t[0] for t in self.terms))}
        self.trie, self.places = None, {}

    def applicable(self, tag: str | None) -> dict[int, list[tuple]]:
        """Terms that apply to a language, by the number of their source."""
        # Languages without terms of their own share what applies to all.
        tag = tag if tag is None or tag in self.languages else ""
        if tag not in self.places:
            out: dict[int, list[tuple]] = {}
            fit = [t for t in self.terms if tag is None or t[3] is None or t[3] == tag]
            for place, (source, target, romanized, *_) in enumerate(fit):
                out.setdefault(self.number[source], []).append((place, source, target, romanized))
            self.places[tag] = out
        return self.places[tag]

    def find(self, text: str | None, tag: str | None) -> list[tuple]:
        """The terms of a line by place, from one pass over it."""
        if not text or not self.terms:
            return []
        if self.trie is None:
            import ahocorasick

            self.trie = ahocorasick.Automaton()
            for source, i in self.number.items():
                self.trie.add_word(source, i)
            self.trie.make_automaton()
        fit = self.applicable(tag)
        return sorted(t for i in {i for _, i in self.trie.iter(text)} for t in fit.get(i, ()))


def _term_finder(terms: list[tuple]):
    """An Arrow function of text and language that lists the terms of a line."""
    finder = TermFinder(terms)

    @F.arrow_udf(returnType=_TERMS)
    def find(texts: pa.Array, tags: pa.Array) -> pa.Array:
        sizes, flat = [0], []
        for text, tag in zip(texts.to_pylist(), tags.to_pylist(), strict=True):
            flat += finder.find(text, tag)
            sizes.append(len(flat))
        columns = [pa.array([t[k] for t in flat], f.type) for k, f in enumerate(_FOUND)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(
            columns, fields=list(_FOUND)))

    return find


def _join_terms(lines: DataFrame, terms: DataFrame, key: list[str], haystack: str,
                language: str) -> DataFrame:
    """The join for large glossaries.

    A term is found by its first 2^k characters, the largest such start it has; a line
    offers hashes of its distinct substrings of those few lengths.  Only keys and hashes are
    shuffled; the terms that a line may hold come back to it once, and are checked there
    against its whole text.
    """
    ranked = placed_terms(terms, lines, language, "_lang")
    power = lambda n: F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("int")
    ranked = ranked.withColumn("_start", F.xxhash64(
        F.left("source", power(F.char_length("source")))))
    lengths = terms.agg(F.collect_set(power(F.char_length("source")))).scalar()
    text = F.col(haystack)
    pieces = F.array_distinct(F.flatten(F.transform("_lengths", lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - n + 1)),
        lambda i: F.xxhash64(F.substring(text, i, n))))))
    offers = (lines.where(F.char_length(text) > 0)
              .select(*key, F.coalesce(language, F.lit("")).alias("_lang"), haystack)
              .withColumn("_lengths", lengths)
              .select(*key, "_lang", F.explode(pieces).alias("_start")))
    term = F.struct("place", "source", "target", "romanized")
    maybe = offers.join(ranked.select("_lang", "_start", term.alias("_term")), ["_lang", "_start"]
                        ).groupBy(*key).agg(F.collect_list("_term").alias("_maybe"))
    empty = F.array().cast("array<struct<place:bigint,source:string,target:string,"
                           "romanized:string>>")
    return lines.join(maybe, key, "left").withColumn("terms", F.coalesce(F.array_sort(F.filter(
        "_maybe", lambda t: F.contains(text, t["source"]))), empty)).drop("_maybe")


def protect(text: Column, terms: Column) -> Column:
    """Struct (text, used): terms replaced by sentinels, longest first."""
    start = F.struct(text.alias("text"), F.array().cast(
        "array<struct<mark:string,source:string,target:string,romanized:string>>").alias("used"))

    def swap(s: Column, t: Column) -> Column:
        mark = F.concat(F.lit("VBX"), t["place"].cast("string"), F.lit("X"))
        return F.when(F.contains(s["text"], t["source"]), F.struct(
            F.replace(s["text"], t["source"], mark).alias("text"),
            F.array_append(s["used"], F.struct(
                mark.alias("mark"), t["source"].alias("source"), t["target"].alias("target"),
                t["romanized"].alias("romanized"))).alias("used"))).otherwise(s)

    return F.aggregate(terms, start, swap)


def restore(text: Column, used: Column, rendering: str = "translate") -> Column:
    """Put terms back for their sentinels; sentinels that survive are removed."""
    def value(t: Column) -> Column:
        if rendering == "preserve":
            return t["source"]
        if rendering == "preserve_and_romanize":
            name = F.coalesce(F.nullif(t["romanized"], F.lit("")), t["target"])
            return F.when(name == "", t["source"]).otherwise(
                F.concat(t["source"], F.lit(" ("), name, F.lit(")")))
        return t["target"]

    put = F.aggregate(used, text, lambda s, t: F.replace(s, t["mark"], value(t)))
    left = X.strip(F.regexp_replace(
        F.regexp_replace(put, "VBX[0-9]+X", ""), f"[{X.SPACE}]{{2,}}", " "))
    done = F.element_at(F.transform(F.array(put), lambda p: F.when(
        p.rlike("VBX[0-9]+X"), left).otherwise(p)), 1)
    return F.when(F.size(used) == 0, text).otherwise(done)


# -- rolling history --------------------------------------------------------------------------

def _history(pairs: DataFrame, key: list[str], order: list[str], blk: str | None,
             entry: Column, size: int, accepted: Column | None) -> DataFrame:
    """Add ``_held``: the last ``size`` accepted entries before each row, oldest first.

    The frame counts accepted rows only, through their running number.  Across blocks the
    last ``size`` accepted rows of a block are handed to the blocks after it.
    """
    ok = F.lit(True) if accepted is None else accepted
    e = pairs.withColumn("_e", F.when(ok, entry))
    if accepted is None and blk is None:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-size, -1)
        return e.withColumn("_held", F.collect_list("_e").over(w))
    ranked = scan(e, key, order, blk, _at=Scan("sum", ok.cast("bigint"), default=F.lit(0)))
    if blk is None:
        w = Window.partitionBy(*key).orderBy("_at").rangeBetween(-size, -1)
        return ranked.withColumn("_held", F.collect_list("_e").over(w)).drop("_at")
    # Cells of ``size`` accepted rows: a row needs its own cell and the one before it.
    celled = ranked.withColumn("_cell", F.floor(F.col("_at") / size))
    copies = celled.where(F.col("_e").isNotNull()).select(
        *key, "_at", "_e", F.explode(F.array("_cell", F.col("_cell") + 1)).alias("_cell"),
        F.lit(True).alias("_copy"))
    rows = celled.withColumn("_copy", F.lit(False)).unionByName(
        copies, allowMissingColumns=True)
    w = Window.partitionBy(*key, "_cell").orderBy("_at").rangeBetween(-size, -1)
    held = F.collect_list(F.when(F.col("_copy"), F.col("_e"))).over(w)
    return rows.withColumn("_held", held).where(~F.col("_copy")).drop("_cell", "_copy", "_at")


def rolling_context(pairs: DataFrame, key: list[str], order: list[str], blk: str | None,
                    max_segments: int = 8, max_tokens: int = 2048, summary_chars: int = 400,
                    accepted: Column | None = None) -> DataFrame:
    """Add ``previous`` (array of kept pairs, oldest first) and ``summary``.

    The last ``4 * max_segments`` accepted pairs are held.  Of the newest ``max_segments``
    those within the token budget are kept, newest first; one that does not fit is passed
    over.  All others are folded, oldest first, into the summary's tail.
    """
    entry = F.struct(F.col("source_text").alias("source"),
                     F.col("translated_text").alias("translated"),
                     F.col("speaker").alias("speaker"),
                     (X.estimate_tokens("source_text") + X.estimate_tokens("translated_text"))
                     .alias("cost"))
    held = _history(pairs, key, order, blk, entry, 4 * max_segments, accepted)
    n = F.size("_held")
    recent = F.slice("_held", F.greatest(F.lit(1), n - max_segments + 1), F.lit(max_segments))
    older = F.slice("_held", F.lit(1), F.greatest(F.lit(0), n - max_segments))
    budget = F.lit(max_tokens) - X.estimate_tokens("source_text")
    kinds = "array<struct<source:string,translated:string,speaker:int,cost:int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kinds).alias("kept"),
                     F.array().cast(kinds).alias("dropped"))

    def pick(s: Column, e: Column) -> Column:
        over = s["used"] + e["cost"] > F.col("_budget")
        return F.struct(
            F.when(over, s["used"]).otherwise(s["used"] + e["cost"]).alias("used"),
            F.when(over, s["kept"]).otherwise(F.concat(F.array(e), s["kept"])).alias("kept"),
            F.when(over, F.concat(F.array(e), s["dropped"])).otherwise(s["dropped"])
            .alias("dropped"))

    chosen = held.withColumns({"_recent": recent, "_older": older, "_budget": budget})
    chosen = chosen.withColumn("_pick", F.aggregate(F.reverse("_recent"), start, pick))
    said = F.filter(F.transform(F.concat(F.col("_older"), F.col("_pick.dropped")),
                                lambda e: X.strip(e["translated"])), lambda t: t != "")
    chosen = chosen.withColumn("_said", F.array_join(said, " "))
    summary = F.when(F.char_length("_said") > summary_chars, F.concat(
        F.lit("..."), F.right(F.col("_said"), F.lit(summary_chars)))).otherwise(F.col("_said"))
    return (chosen.withColumn("previous", F.col("_pick.kept")).withColumn("summary", summary)
            .drop("_held", "_recent", "_older", "_budget", "_pick", "_said", "_e"))


def bounded_window(pairs: DataFrame, key: list[str], order: list[str], blk: str | None,
                   max_segments: int = 4, max_characters: int = 600) -> DataFrame:
    """Add ``window``: source texts of the last segments up to and with this one, within
    both bounds (the newest that fit; a segment too long by itself empties the window)."""
    entry = F.struct(F.col("source_text").alias("source"))
    # "Before this row" over a shifted frame: own text is appended to the earlier ones.
    held = _history(pairs, key, order, blk, entry, max_segments - 1, None)
    texts = F.concat(F.transform("_held", lambda e: e["source"]), F.array("source_text"))
    held = held.withColumn("_texts", texts)
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"),
                     F.array().cast("array<string>").alias("kept"))

    def take(s: Column, t: Column) -> Column:
        fits = s["open"] & (s["used"] + F.char_length(t) <= max_characters)
        return F.struct(
            F.when(fits, s["used"] + F.char_length(t)).otherwise(s["used"]).alias("used"),
            fits.alias("open"),
            F.when(fits, F.concat(F.array(t), s["kept"])).otherwise(s["kept"]).alias("kept"))

    return held.withColumn("window", F.aggregate(
        F.reverse("_texts"), start, take)["kept"]).drop("_held", "_texts", "_e")


# -- prompts -----------------------------------------------------------------------------------

def _speaker(s: Column) -> Column:
    return F.coalesce(F.concat(F.lit("[speaker "), s.cast("string"), F.lit("] ")), F.lit(""))


def prompts(lines: DataFrame, policy: str = "natural_english", style: str | None = None
            ) -> DataFrame:
    """Add ``system`` and ``user`` prompt texts for an instruction-following translator.

    Needs source_text, source_language, target_language, speaker, previous, summary, terms.
    """
    system = F.lit(dims.PROMPT_TEMPLATE)
    for mark, value in {
            "{src}": X.language_name("source_language"),
            "{tgt}": X.language_name("target_language"),
            "{honorifics}": X.policy_instruction(F.lit(policy), F.col("source_language")),
            "{style}": F.lit(f"- Style: {style}." if style else "")}.items():
        system = F.replace(system, F.lit(mark), value)
    earlier = F.array_join(F.transform("previous", lambda e: F.concat(
        _speaker(e["speaker"]), e["source"], F.lit("\n  => "), e["translated"])), "\n")
    listed = F.array_join(F.transform("terms", lambda t: F.concat(
        t["source"], F.lit(" => "), t["target"])), "\n")
    block = lambda name, body: F.concat(F.lit(f"<{name}>\n"), body, F.lit(f"\n</{name}>"))
    user = F.concat_ws(
        "\n\n",
        F.when(F.col("summary") != "", F.concat(
            F.lit("<summary>Earlier in this conversation: "), F.col("summary"),
            F.lit("</summary>"))),
        F.when(F.size("previous") > 0, block("context", earlier)),
        F.when(F.size("terms") > 0, block("glossary", listed)),
        F.concat(F.lit("<current>"), _speaker(F.col("speaker")), X.strip("source_text"),
                 F.lit("</current>")))
    return lines.withColumns({"system": system, "user": user})


