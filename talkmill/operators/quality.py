"""Recognition and translation quality.

Per-row statistics are computed inside the row, on the JVM or for n-grams in Arrow batches;
only a few sums per group are shuffled, however long the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill import dims
from talkmill.functions import text as X
from talkmill.functions.grams import shared_character_grams, shared_word_grams


def _letter(index: Column) -> Column:
    """The index-th character from U+10000 on, built from its four UTF-8 bytes."""
    code = (index + 0x10000).cast("bigint")
    low6 = lambda shift: F.lit(0x80).bitwiseOR(
        F.shiftright(code, shift).bitwiseAND(F.lit(63)))
    packed = (F.shiftleft(F.lit(0xF0).cast("bigint").bitwiseOR(F.shiftright(code, 18)), 24)
              .bitwiseOR(F.shiftleft(low6(12).cast("bigint"), 16))
              .bitwiseOR(F.shiftleft(low6(6).cast("bigint"), 8)).bitwiseOR(low6(0)))
    return F.unhex(F.hex(packed)).cast("string")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two word arrays.

    Every distinct word of the pair becomes one character, so the built-in character
    distance gives the word distance.  A pair of more distinct words than there are such
    characters is an error.
    """
    def spell(words: Column, vocabulary: Column) -> Column:
        return F.array_join(F.transform(
            words, lambda w: _letter(F.array_position(vocabulary, w))), "")

    vocabulary = F.array_distinct(F.concat(reference, hypothesis))
    return F.element_at(F.transform(F.array(vocabulary), lambda v: F.when(
        F.size(v) > 0xFFFFF, F.raise_error("too many distinct words for a word distance")
        .cast("int")).otherwise(F.levenshtein(spell(reference, v), spell(hypothesis, v)))), 1)


def with_normal_forms(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add normalised texts ``_r`` and ``_h`` once, for the error rates below."""
    return df.withColumns({"_r": X.normalize(reference), "_h": X.normalize(hypothesis)})


def error_rates(df: DataFrame, reference: str, hypothesis: str, wer: str = "wer",
                cer: str = "cer") -> DataFrame:
    """Add word and character error rates; null where the reference is empty."""
    n = with_normal_forms(df, reference, hypothesis)
    r, h = X.spaced_words("_r"), X.spaced_words("_h")
    n = n.withColumns({"_rw": r, "_hw": h, "_rc": F.replace("_r", F.lit(" "), F.lit("")),
                       "_hc": F.replace("_h", F.lit(" "), F.lit(""))})
    words, chars = F.size("_rw"), F.char_length("_rc")
    return n.withColumns({
        wer: F.when(words > 0, word_distance(F.col("_rw"), F.col("_hw")) / words),
        cer: F.when(chars > 0, F.levenshtein("_rc", "_hc") / chars),
    }).drop("_r", "_h", "_rw", "_hw", "_rc", "_hc")


# -- n-gram overlap ------------------------------------------------------------------------

def tokenize_13a(text: Column) -> Column:
    """The standard evaluation tokens: punctuation apart, except inside numbers."""
    t = F.replace(text, F.lit("<skipped>"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for mark, value in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(mark), F.lit(value))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    # The published patterns of this tokenisation, in order.
    for pattern, put in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
                         (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"),
                         (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, put)
    return F.filter(F.split(t, f"[{X.SPACE}]+"), lambda w: w != "")


def corpus_bleu(df: DataFrame, by: list[str], reference: str, hypothesis: str) -> DataFrame:
    """Corpus BLEU per group: four n-gram orders, one reference, exponential smoothing."""
    n = df.withColumns({"_r": tokenize_13a(F.coalesce(reference, F.lit(""))),
                        "_h": tokenize_13a(F.coalesce(hypothesis, F.lit("")))})
    n = n.withColumn("_shared", shared_word_grams(F.col("_h"), F.col("_r"), 4))
    stats = {"_rl": F.size("_r").cast("bigint"), "_hl": F.size("_h").cast("bigint")}
    for k in range(1, 5):
        stats[f"_c{k}"] = F.col("_shared")[k - 1]
        stats[f"_t{k}"] = F.greatest(F.lit(0), F.size("_h") - (k - 1)).cast("bigint")
    sums = n.select(*by, *[v.alias(k) for k, v in stats.items()]).groupBy(*by).agg(
        *[F.sum(k).alias(k) for k in stats])
    misses, logs = F.lit(0), []
    for k in range(1, 5):
        c, t = F.col(f"_c{k}"), F.col(f"_t{k}")
        misses = misses + F.when((c == 0) & (t > 0), 1).otherwise(0)
        logs.append(F.when(t == 0, F.lit(-9999999999.0)).when(
            c == 0, F.log(100.0 / (F.pow(F.lit(2.0), misses) * t))).otherwise(
            F.log(100.0 * c / t)))
    brevity = F.when(F.col("_hl") >= F.col("_rl"), 1.0).when(F.col("_hl") == 0, 0.0).otherwise(
        F.exp(1.0 - F.col("_rl") / F.col("_hl")))
    hit = F.col("_c1") + F.col("_c2") + F.col("_c3") + F.col("_c4") > 0
    score = F.when(hit, brevity * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4)
                   ).otherwise(0.0)
    return sums.select(*by, F.round(score, 2).alias("bleu"))


def corpus_chrf(df: DataFrame, by: list[str], reference: str, hypothesis: str,
                order: int = 6, beta: int = 2) -> DataFrame:
    """Corpus chrF per group: character n-grams without spaces, recall weighted."""
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"[{X.SPACE}]+", "")
    n = df.select(*by, squeeze(F.col(reference)).alias("_r"), squeeze(F.col(hypothesis)).alias("_h"))
    n = n.withColumn("_shared", shared_character_grams(F.col("_h"), F.col("_r"), order))
    size = lambda c, k: F.greatest(F.lit(0), F.char_length(c) - (k - 1)).cast("bigint")
    stats: dict[str, Column] = {}
    for k in range(1, order + 1):
        refs, hyps = size("_r", k), size("_h", k)
        stats[f"_m{k}"] = F.col("_shared")[k - 1]
        stats[f"_h{k}"] = F.when(refs > 0, hyps).otherwise(0)
        stats[f"_r{k}"] = refs
    sums = n.select(*by, *[v.alias(k) for k, v in stats.items()]).groupBy(*by).agg(
        *[F.sum(k).alias(k) for k in stats])
    used, precision, recall = F.lit(0), F.lit(0.0), F.lit(0.0)
    for k in range(1, order + 1):
        m, h, r = (F.col(f"_{x}{k}") for x in "mhr")
        both = (h > 0) & (r > 0)
        used = used + F.when(both, 1).otherwise(0)
        precision = precision + F.when(both, m / h).otherwise(0.0)
        recall = recall + F.when(both, m / r).otherwise(0.0)
    p, q = precision / F.greatest(used, F.lit(1)), recall / F.greatest(used, F.lit(1))
    weight = beta ** 2
    score = F.when(p + q > 0, 100 * (1 + weight) * p * q / (weight * p + q)).otherwise(0.0)
    return sums.select(*by, F.round(score, 2).alias("chrf"))


# -- recognition benchmark -----------------------------------------------------------------

def spaced(language: Column | str) -> Column:
    """Scripts for which a word error rate makes sense."""
    return ~X.col(language).isin(dims.UNSPACED)


def hypotheses(segments: DataFrame, item: list[str], order: list[str], language: str,
               accepted: Column) -> DataFrame:
    """One text per item from its accepted segments, joined with a space where spaced.

    An item is one recording, whose segments are bounded by its length.
    """
    pieces = F.array_sort(F.collect_list(F.when(accepted, F.struct(*order, "text"))))
    joined = segments.groupBy(*item).agg(F.any_value(language).alias(language),
                                         pieces.alias("_p"))
    texts = F.transform("_p", lambda p: p["text"])
    return joined.select(*item, language, F.when(spaced(language), F.array_join(texts, " "))
                         .otherwise(F.array_join(texts, "")).alias("hypothesis"))


def first_language(segments: DataFrame, item: list[str], order: list[str], language: str
                   ) -> DataFrame:
    """The first known detected language of every item."""
    return segments.groupBy(*item).agg(F.min_by(
        F.col(language), F.when(F.col(language).isNotNull(), F.struct(*order)))
        .alias("detected"))


def recognition_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """Mean WER/CER, hallucination rate and language accuracy per group.

    ``items``: reference_text, hypothesis, source_language, detected, wer, cer.
    """
    silent = F.coalesce("reference_text", F.lit("")) == ""
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.avg(F.when(~silent & spaced("source_language"), F.col("wer"))), 4)
        .alias("wer"),
        F.round(F.avg(F.when(~silent, F.col("cer"))), 4).alias("cer"),
        F.round(F.avg(F.when(silent, (~X.blank("hypothesis")).cast("int"))), 3)
        .alias("hallucination_rate"),
        F.round(F.avg(F.col("detected").eqNullSafe(F.col("source_language")).cast("int")), 3)
        .alias("language_accuracy"),
        F.count_if(~silent).alias("speech_items"))
