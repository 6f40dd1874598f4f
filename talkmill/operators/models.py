"""Hooks for user models, and the translation step around them.

A model is given as a factory; it is built once per Python worker, inside the batch
iterator, and sees Arrow batches.  Filters belong before these calls: Spark does not move
a filter through a Python map.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

from talkmill.functions import text as X
from talkmill.operators import context as C
from talkmill.operators.ordered import Fold

Translate = Callable[[list[str], list[str], list[str]], list[str]]


def translate_with(lines: DataFrame, factory: Callable[[], Translate], batch: int = 8,
                   text: str = "source_text", out: str = "translated_text") -> DataFrame:
    """Batch scoring: ``model(texts, source_languages, target_languages) -> texts``."""
    names = lines.columns
    schema = T.StructType([*lines.schema.fields, T.StructField(out, T.StringType())])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            said: list[str] = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                said += model(part[text].tolist(), part["source_language"].tolist(),
                              part["target_language"].tolist())
            yield frame[names].assign(**{out: said})

    return lines.mapInPandas(score, schema)


def transcribe_with(chunks: DataFrame, key: list[str], payload: str, start: str,
                    factory: Callable[[], Callable[[object], list[dict]]]) -> DataFrame:
    """One chunk -> many segments.  ``model(payload)`` returns dicts with text, start, end
    (relative to the chunk) and optionally language, confidence and decoder signals."""
    signals = ["confidence", "avg_logprob", "no_speech_prob", "compression_ratio",
               "language_probability"]
    schema = T.StructType(
        [chunks.schema[k] for k in key]
        + [T.StructField("part", T.LongType()), T.StructField("text", T.StringType()),
           T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
           T.StructField("language", T.StringType())]
        + [T.StructField(s, T.DoubleType()) for s in signals])

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                for part, seg in enumerate(model(row[payload])):
                    rows.append({**{k: row[k] for k in key}, "part": part, "text": seg["text"],
                                 "start_s": row[start] + seg["start"],
                                 "end_s": row[start] + seg["end"],
                                 "language": seg.get("language"),
                                 **{s: seg.get(s) for s in signals}})
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return chunks.select(*key, start, payload).mapInPandas(decode, schema)


#: Characters of what a session has said that a recogniser is reminded of.
PROMPT_CHARS = 200

_SEGMENT_FIELDS = [("part", T.LongType()), ("place", T.LongType()), ("text", T.StringType()),
                   ("start_s", T.DoubleType()), ("end_s", T.DoubleType()),
                   ("language", T.StringType()), ("confidence", T.DoubleType())]


def register_transcriber(spark: SparkSession, name: str,
                         factory: Callable[[], Callable[[object, str], list[dict]]],
                         prompt_chars: int = PROMPT_CHARS) -> None:
    """Make a recogniser a table function of SQL.

    ``name(payload => 'column', start => 'column', chunks => TABLE(chunks) PARTITION BY session
    ORDER BY seq)`` decodes the chunks of a session in order.  ``payload`` and ``start`` name
    the columns of a chunk's payload and of its start in seconds; all others come back with
    every segment, and
    ``part`` (within the chunk), ``place`` (within the session, from 1), ``text``,
    ``start_s``, ``end_s``, ``language``, ``confidence``.  ``model(payload, prompt)`` gets
    the end of what the session said before, a line each, and returns dicts as in
    :func:`transcribe_with`.  A null payload has no segments.
    """
    class Transcriber:
        @staticmethod
        def analyze(chunks, payload, start):
            names = (payload.value, start.value)
            if not chunks.isTable:
                raise ValueError("the first argument must be a table of chunks")
            have = {f.name: f for f in chunks.dataType.fields}
            gone = [n for n in names if n not in have]
            if gone:
                raise ValueError(f"the table of chunks has no column {', '.join(map(str, gone))}")
            kept = [f for f in chunks.dataType.fields if f.name not in names]
            schema = T.StructType(kept + [T.StructField(n, t) for n, t in _SEGMENT_FIELDS])
            return AnalyzeResult(schema=schema)

        def __init__(self) -> None:
            self.model, self.place, self.said = factory(), 0, ""

        def eval(self, chunks, payload, start):
            if chunks[payload] is None:
                return
            kept = [chunks[c] for c in chunks.__fields__ if c not in (payload, start)]
            begin = chunks[start]
            for part, seg in enumerate(self.model(chunks[payload], self.said)):
                self.place += 1
                self.said = (self.said + seg["text"] + "\n")[-prompt_chars:]
                yield (*kept, part, self.place, seg["text"], begin + seg["start"],
                       begin + seg["end"], seg.get("language"), seg.get("confidence"))

    spark.udtf.register(name, F.udtf(Transcriber))


def score_with(factory: Callable[[], Callable[[list], list[dict]]], batch: int = 8):
    """A scalar function payload -> map of scores, for detectors and classifiers."""
    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for values in batches:
            items = values.tolist()
            found: list[dict] = []
            for at in range(0, len(items), batch):
                found += model(items[at:at + batch])
            yield pd.Series(found)

    return scores


def learned_metric(pairs: DataFrame, by: list[str],
                   factory: Callable[[], Callable[[list, list, list], list[float]]] | None
                   ) -> DataFrame:
    """Mean of an optional learned score per group; null when no model is given.

    ``pairs``: source_text, hypothesis, reference_translation.
    """
    if factory is None:
        return pairs.select(*by).distinct().withColumn("learned", F.lit(None).cast("double"))
    schema = T.StructType([*[pairs.schema[b] for b in by],
                           T.StructField("_score", T.DoubleType())])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            yield frame[by].assign(_score=model(
                frame["source_text"].tolist(), frame["hypothesis"].tolist(),
                frame["reference_translation"].tolist()))

    scored = pairs.select(*by, "source_text", "hypothesis", "reference_translation")
    return scored.mapInPandas(score, schema).groupBy(*by).agg(
        F.round(F.avg("_score"), 4).alias("learned"))


CONTEXT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("translated_text", T.StringType()),
    T.StructField("previous", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType())])

_WIDE = re.compile("[\u0900-\u097f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@lru_cache(maxsize=1 << 14)
def _tokens(text: str) -> int:
    """Each line and its translation stay in the context for some lines, so counts are kept."""
    wide = 0 if text.isascii() else len(_WIDE.findall(text))
    return wide + (len(text) - wide) // 4 + 1


def contextual_fold(factory: Callable[[], Callable[[str, list[tuple[str, str]], str], str]],
                    max_segments: int = 8, max_tokens: int = 2048, summary_chars: int = 400
                    ) -> Fold:
    """Translate line by line when each line's context holds the translations before it.

    ``model(text, previous pairs, summary) -> text``; only non-blank results enter the
    context.  Sessions run side by side; inside one the model's own output decides what
    comes next.  The context rules are those of ``context.rolling_context``.
    """
    loaded: list = []

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if not loaded:
            loaded.append(factory())
        text, pairs = row["source_text"], state["pairs"]
        left = max_tokens - _tokens(text)
        older, kept, dropped = pairs[:-max_segments], [], []
        for pair in reversed(pairs[-max_segments:]):
            cost = _tokens(pair[0]) + _tokens(pair[1])
            if cost > left:
                dropped.insert(0, pair)
            else:
                kept.insert(0, pair)
                left -= cost
        summary = " ".join(t.strip() for _, t in older + dropped if t.strip())
        if len(summary) > summary_chars:
            summary = "..." + summary[-summary_chars:]
        said = loaded[0](text, [tuple(p) for p in kept], summary)
        if said.strip():
            pairs = [*pairs, [text, said]][-4 * max_segments:]
        return {"pairs": pairs}, [{"seq": row["seq"], "translated_text": said,
                                   "previous": [p[0] for p in kept], "summary": summary}]

    return Fold(lambda: {"pairs": []}, step, CONTEXT_SCHEMA)


def translate_lines(lines: DataFrame, terms: DataFrame, key: list[str],
                    translator: Callable[[DataFrame], DataFrame],
                    policy: str = "natural_english", rendering: str = "translate") -> DataFrame:
    """Translate with protected glossary terms; lines already in the target language pass.

    ``translator`` maps a table with ``masked``, ``source_language`` and
    ``target_language`` to the same table with ``said``.
    """
    foreign = ~F.col("source_language").eqNullSafe(F.col("target_language"))
    held = C.attach_terms(lines.where(foreign), terms, key, "source_text", "source_language")
    held = held.withColumn("_p", C.protect(F.col("source_text"), F.col("terms"))).withColumn(
        "masked", F.col("_p.text"))
    back = C.restore(F.col("said"), F.col("_p.used"), rendering)
    done = translator(held).withColumn("_back", back).withColumn(
        "translated_text", X.apply_honorifics("source_text", "_back", policy,
                                              "source_language"))
    kept = [*lines.columns, "translated_text"]
    same = lines.where(~foreign).withColumn("translated_text", F.col("source_text"))
    return done.select(*kept).unionByName(same.select(*kept))


def translate_prompted(lines: DataFrame, terms: DataFrame, key: list[str],
                       translator: Callable[[DataFrame], DataFrame],
                       policy: str = "natural_english", style: str | None = None) -> DataFrame:
    """Translate by prompt.  ``lines`` carry ``previous`` and ``summary``, see
    :func:`talkmill.operators.context.rolling_context`; ``translator`` adds ``said``."""
    from talkmill.operators.context import prompts

    hay = F.concat("source_text", F.array_join(
        F.transform("previous", lambda e: e["source"]), ""))
    held = C.attach_terms(lines.withColumn("_hay", hay), terms, key, "_hay", "source_language")
    known = F.transform("previous", lambda e: X.strip(e["translated"]))
    said = translator(prompts(held, policy, style)).withColumn("_known", known).withColumn(
        "_clean", X.clean_output("said", F.col("_known")))
    result: Column = F.col("_clean")
    if policy in ("remove", "preserve_honorifics"):
        result = X.apply_honorifics("source_text", "_clean", policy, "source_language")
    return said.withColumn("translated_text", result).drop(
        "_hay", "_known", "_clean", "said", "system", "user")
