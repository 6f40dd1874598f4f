"""Helpers that several training-data operators share.

Records are transcript segments: ``sequence_id`` identifies a segment, ``session_id`` the
session it was spoken in, ``text`` and ``language`` are its words and language.  An operator
reads only the columns it names, so other columns of the input, whatever they are called,
can neither clash with its own nor reach its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than so many rows; reads no more than one beyond them."""
    return df.limit(rows + 1).count() <= rows
