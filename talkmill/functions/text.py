"""Scalar text functions as Spark columns.

Character classes are written out (letters, digits, separators) because ``\\w`` and
``\\s`` are ASCII in Java.  Python is used only where Spark has no built-in (NFKC, zlib,
long-word wrapping), in Arrow batches, and only on the rows that need it.
"""

from __future__ import annotations

import textwrap
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill import dims

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
NOT_ALNUM = r"[^\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def letters_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), NOT_ALNUM, "")


# -- normalisation -----------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _compose_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None
                     else unicodedata.normalize("NFKC", t).casefold())


def normalize(c: Column | str) -> Column:
    """NFKC, case folding, everything but words and spaces to a space, spaces collapsed.

    ASCII text needs neither NFKC nor case folding beyond lower(), so only other rows
    carry a payload to Python.
    """
    text = F.coalesce(col(c), F.lit(""))
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    folded = F.when(ascii_only, F.lower(text)).otherwise(
        _compose_fold(F.when(~ascii_only, text)))
    words = F.regexp_replace(folded, f"[^{WORD}{SPACE}]", " ")
    return strip(F.regexp_replace(words, f"[{SPACE}]+", " "))


def spaced_words(c: Column | str) -> Column:
    """White-space separated words of a normalised text; an empty text has none."""
    text = col(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


# -- loops and repetition ----------------------------------------------------------------

def tokens(c: Column | str) -> Column:
    """Words, and every other visible symbol on its own."""
    return F.regexp_extract_all(col(c), F.lit(f"[{WORD}]+|[^{WORD}{SPACE}]"), F.lit(0))


def adjacent_repetition(c: Column | str) -> Column:
    """Share of neighbouring token pairs that are equal; 0 below four tokens."""
    found = tokens(c)

    def share(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1),
                           lambda a, b: (a == b).cast("int"))
        same = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
        return same / (F.size(t) - 1)

    # A one-element array binds the token list once instead of re-evaluating the regex.
    return F.element_at(F.transform(
        F.array(found), lambda t: F.when(F.size(t) < 4, F.lit(0.0)).otherwise(share(t))), 1)


def ngram_loop_score(c: Column | str) -> Column:
    """Longest run of one 1..6-character unit repeated at least three times, over length.

    A back-reference regex visits runs left to right without overlap, which is exactly the
    greedy scan: a match ends where the repetition ends, a miss moves one character on.
    """
    squeezed = letters_only(c)

    def longest(s: Column, n: int) -> Column:
        runs = F.regexp_extract_all(s, F.lit(r"(.{%d})\1+" % n), F.lit(0))
        return F.coalesce(F.array_max(F.transform(
            runs, lambda r: F.when(F.char_length(r) >= 3 * n, F.char_length(r))
            .otherwise(0))), F.lit(0))

    return F.element_at(F.transform(F.array(squeezed), lambda s: F.when(
        F.char_length(s) < 5, F.lit(0.0)).otherwise(
        F.greatest(*[longest(s, n) for n in range(1, 7)]) / F.char_length(s))), 1)


#: Lengths of the phrases that loops are looked for in, and words of a text with any.
PHRASES = range(2, 9)
LEAST_WORDS = 9


@F.arrow_udf(T.DoubleType())
def _phrase_share(words: pa.Array) -> pa.Array:
    """Texts of a batch at once.  A place's phrase of n words is named by the name of its
    first n - 1 words and the last word; names are numbered anew for every length."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    word = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    many = word.max(initial=0) + 1
    at = np.flatnonzero(sizes[text] >= LEAST_WORDS)
    name = text[at]
    edges = np.zeros(len(word) + 1, np.int64)
    for n in (1, *PHRASES):
        fits = at + n <= ends[text[at]]
        at, name = at[fits], name[fits]
        _, name, count = np.unique(name * many + word[at + n - 1], return_inverse=True,
                                   return_counts=True)
        again = count[name] >= 3
        at, name = at[again], name[again]
        if n > 1:
            np.add.at(edges, at, 1)
            np.add.at(edges, at + n, -1)
    covered = np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=len(sizes))
    share = np.where(sizes >= LEAST_WORDS, covered / np.maximum(sizes, 1), 0.0)
    return pa.array(share, mask=~words.is_valid().to_numpy(zero_copy_only=False))


def phrase_loop_score(c: Column | str) -> Column:
    """Share of words inside a 2..8-word phrase that occurs three or more times.

    Words are split off on the JVM and compared as numbers, by whole Arrow batches.  A longer
    phrase can only repeat where its shorter start does, so each length looks at the starts
    the last one left.
    """
    return _phrase_share(F.regexp_extract_all(F.lower(col(c)), F.lit(f"[{WORD}]+"), F.lit(0)))


@F.pandas_udf(T.DoubleType())
def _deflate_ratio(texts: pd.Series) -> pd.Series:
    def ratio(text: str | None) -> float | None:
        if text is None:
            return None
        raw = text.encode("utf-8")
        return len(raw) / max(1, len(zlib.compress(raw)))
    return texts.map(ratio)


def compression_ratio(c: Column | str, known: Column | None = None) -> Column:
    """The decoder's ratio if it gave one, else zlib's for texts of 24 bytes and more."""
    text = col(c)
    known = F.lit(None).cast("double") if known is None else known
    wanted = F.when(known.isNull() & (F.octet_length(text) >= 24), text)
    return F.coalesce(known, _deflate_ratio(wanted))


def text_density(c: Column | str, seconds: Column) -> Column:
    """Letters and digits per second."""
    return F.char_length(letters_only(c)) / F.greatest(seconds, F.lit(1e-6))


# -- joining -------------------------------------------------------------------------------

_DENSE = r"\x{3000}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}"


def separator(before: Column | str, after: Column | str) -> Column:
    """Space between two transcript pieces, or nothing where the script has none."""
    before, after = col(before), strip(after)
    marks = "".join("\\" + m if m in ")]}'\"." else m for m in dims.CLOSING_MARKS)
    glued = ((after == "") | F.coalesce(before == "", F.lit(True))
             | before.rlike(f"[ \\n{_DENSE}]$") | after.rlike(f"^[{marks}{_DENSE}]"))
    return F.when(glued, "").otherwise(" ")


# -- subtitles -----------------------------------------------------------------------------

def timestamp(seconds: Column | str, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm``; negative times become zero."""
    ms = F.bround(F.greatest(col(seconds), F.lit(0.0)) * 1000).cast("bigint")
    part = lambda div, mod: (F.floor(ms / div) % mod).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("bigint"),
                           part(60_000, 60), part(1000, 60), ms % 1000)


def wrap(c: Column | str, width: int = 42) -> Column:
    """At most two lines of about ``width`` characters; the rest stays on the second."""
    text = strip(F.regexp_replace(col(c), f"[{SPACE}]+", " "))
    # Words longer than a line, and hyphens, follow textwrap's own breaking rules.
    special = text.rlike(f"[^ ]{{{width + 1}}}|-")

    @F.pandas_udf(T.StringType())
    def careful(texts: pd.Series) -> pd.Series:
        def two(text: str | None) -> str | None:
            if text is None:
                return None
            lines = textwrap.wrap(text, width=width)
            return "\n".join(lines[:1] + ([" ".join(lines[1:])] if len(lines) > 1 else []))
        return texts.map(two)

    first = F.regexp_extract(text, f"^(.{{1,{width}}})(?= |$)", 1)
    rest = F.regexp_replace(text, f"^.{{1,{width}}}(?: |$)", "")
    plain = F.when(rest == "", first).otherwise(F.concat(first, F.lit("\n"), rest))
    return (F.when(F.char_length(text) <= width, text).when(~special, plain)
            .otherwise(careful(F.when(special & (F.char_length(text) > width), text))))


def dual_body(translated: Column, source: Column | None, dual: bool = True) -> Column:
    """Wrapped translation, with the source line under it when there is one."""
    if not dual or source is None:
        return translated
    return F.when(F.coalesce(source, F.lit("")) == "", translated).otherwise(
        F.concat_ws("\n", translated, strip(source)))


# -- scripts, tokens, languages ----------------------------------------------------------------

_WIDE = r"[\x{0900}-\x{097f}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"


def estimate_tokens(c: Column | str) -> Column:
    """One token per wide character, one per four others, plus one."""
    length = F.char_length(col(c))
    narrow = F.char_length(F.regexp_replace(col(c), _WIDE, ""))
    return (length - narrow + F.floor(narrow / 4) + 1).cast("int")


def looks_like(c: Column | str, language: Column | str) -> Column:
    """Whether a text has the script its language needs."""
    text, language = col(c), col(language)
    return (F.when(F.coalesce(text, F.lit("")) == "", False)
            .when(language == "ja", text.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"))
            .when(language == "ko", text.rlike(r"[\x{ac00}-\x{d7af}]"))
            .otherwise(True))


def primary_language(tag: Column | str) -> Column:
    """``ja-JP`` and ``ja_JP`` -> ``ja``."""
    return F.element_at(F.split(F.lower(col(tag)), "[-_]"), 1)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def iso_639_2(language: Column | str) -> Column:
    return _lookup(dims.ISO_639_2, col(language))


def language_name(language: Column | str) -> Column:
    return _lookup({k: dims.LANGUAGE_NAMES[k] for k in dims.PROMPT_LANGUAGES}, col(language))


# -- honorifics --------------------------------------------------------------------------------

def honorifics(source: Column | str, language: Column | str) -> Column:
    """Distinct honorific suffixes whose marker occurs in the source text."""
    source = col(source)

    def found(table: dict[str, str]) -> Column:
        hits = [F.when(F.contains(source, F.lit(k)), F.lit(v)) for k, v in table.items()]
        return F.array_distinct(F.array_compact(F.array(*hits)))

    korean = F.coalesce(F.startswith(col(language), F.lit("ko")), F.lit(False))
    return F.when(korean, found(dims.KO_HONORIFICS)).otherwise(found(dims.JA_HONORIFICS))


def strip_honorifics(c: Column | str) -> Column:
    suffixes = {v[1:] for v in [*dims.JA_HONORIFICS.values(), *dims.KO_HONORIFICS.values()]}
    longest_first = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    return F.regexp_replace(
        col(c), f"(?<=[A-Za-z])-(?:{longest_first})(?![{WORD}])", "")


def apply_honorifics(source: Column | str, translated: Column | str, policy: str,
                     language: Column | str) -> Column:
    """``Mr. Tanaka`` -> ``Tanaka-san`` when the source has exactly one honorific."""
    text = col(translated)
    if policy == "remove":
        return strip_honorifics(text)
    if policy != "preserve_honorifics":
        return text
    suffixes = honorifics(source, language)
    only = F.element_at(suffixes, 1)
    scholarly = "Teacher|Professor"
    others = "|".join(t for t in dims.TITLES.split("|") if t not in scholarly.split("|"))
    edge = f"(?<![{WORD}])"
    any_title = F.regexp_replace(
        text, F.lit(f"{edge}(?:{dims.TITLES})\\s+({dims.NAME})"), F.concat(F.lit("$1"), only))
    plain_title = F.regexp_replace(
        text, F.lit(f"{edge}(?<!(?:{scholarly})\\s{{1,8}})(?:{others})\\s+({dims.NAME})"),
        F.concat(F.lit("$1"), only))
    usable = (F.coalesce(col(source), F.lit("")) != "") & (F.size(suffixes) == 1)
    return (F.when(~usable, text).when(only == "-sensei", any_title).otherwise(plain_title))


def policy_instruction(policy: Column | str, language: Column | str) -> Column:
    """How a translator that follows instructions should treat honorifics."""
    policy, language = col(policy), col(language)
    keep = dims.POLICY_TEXT["preserve_honorifics"]

    def examples(table: dict[str, str]) -> Column:
        return F.lit(keep.format(examples=", ".join(sorted(set(table.values())))))

    korean = F.coalesce(F.startswith(language, F.lit("ko")), F.lit(False))
    return (F.when(policy == "preserve_honorifics",
                   F.when(korean, examples(dims.KO_HONORIFICS))
                   .otherwise(examples(dims.JA_HONORIFICS)))
            .when(policy == "remove", F.lit(dims.POLICY_TEXT["remove"]))
            .otherwise(F.lit(dims.POLICY_TEXT["natural_english"])))


# -- model output and names ------------------------------------------------------------------------

def clean_output(raw: Column | str, known: Column | None = None) -> Column:
    """Remove reasoning blocks, tags, labels, quotes and echoed earlier lines."""
    text = F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"(?s)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"</?(?:current|context|summary|glossary)>", "")
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
                                 strip), lambda ln: ln != "")
    bare = lambda ln: strip(F.regexp_replace(ln, "^[=> ]+", ""))

    def fresh(ls: Column) -> Column:
        if known is None:
            return ls
        new = F.filter(ls, lambda ln: ~F.array_contains(known, bare(ln)))
        kept = F.when(F.size(new) > 0, new).otherwise(F.slice(ls, -1, 1))
        return F.when(F.size(ls) > 1, kept).otherwise(ls)

    kept = F.element_at(F.transform(F.array(lines), fresh), 1)
    joined = F.array_join(F.transform(kept, bare), " ")
    label = F.regexp_replace(
        joined, f"(?i)^[{SPACE}]*(?:translation|english|hindi|output|answer)[{SPACE}]*:[{SPACE}]*",
        "")
    said = F.regexp_replace(label, f"^\\[speaker [^\\]]*\\][{SPACE}]*", "")
    quoted = F.regexp_replace(said, r"(?s)^([\"'“”「」])(.*)\1$", "$2")
    return strip(F.regexp_replace(strip(quoted), "^[“”]+|[“”]+$", ""))


def clean_filename(c: Column | str) -> Column:
    """File name safe to store: stem of at most 80 characters and lower-case suffix."""
    base = F.regexp_extract(F.coalesce(col(c), F.lit("media")), r"([^/]*)/*$", 1)
    suffix = F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(base, F.lit(1), F.char_length(base) - F.char_length(suffix))
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"),
                            r"^[._]+|[._]+$", "")
    short = F.left(safe, F.lit(80))
    return F.concat(F.when(short == "", "media").otherwise(short), F.lower(suffix))


def to_number(c: Column | str) -> Column:
    """A number, or null when the text is none."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def iso_time(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd'T'HH:mm:ss")
