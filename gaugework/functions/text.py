"""Text expressions: normalisation, sentence and token rules, renderability."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gaugework.rules import SEPARATOR_CONTROLS, WHITE_SPACE

_SPACE_RUN = f"[{WHITE_SPACE}{SEPARATOR_CONTROLS}]+"


@F.pandas_udf(StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """NFKC then case folding; neither is a Spark built-in."""
    return texts.map(
        lambda text: None if text is None else unicodedata.normalize("NFKC", text).casefold()
    )


@F.pandas_udf(ArrayType(StringType()))
def nfkc_casefold_each(lists: pd.Series) -> pd.Series:
    """The same for every text of an array column."""
    fold = lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold()
    return lists.map(lambda texts: None if texts is None else [fold(t) for t in texts])


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def normalized_text(text: Column) -> Column:
    """NFKC, case fold, collapse white space.

    Only texts with a non-ASCII character travel to Python; for the others
    `lower` is the same function.
    """
    foreign = F.when(text.rlike(r"[^\x{00}-\x{7F}]"), text)
    return collapse_space(F.coalesce(nfkc_casefold(foreign), F.lower(text)))


def normalized_texts(texts: Column) -> Column:
    """Normalised array of texts; only arrays with a non-ASCII text go to Python."""
    foreign = F.exists(
        texts, lambda t: F.coalesce(t.rlike(r"[^\x{00}-\x{7F}]"), F.lit(False))
    )
    folded = F.coalesce(
        nfkc_casefold_each(F.when(foreign, texts)), F.transform(texts, lambda t: F.lower(t))
    )
    return F.transform(folded, collapse_space)


def ascii_normalized_text(text: Column) -> Column:
    return collapse_space(F.lower(text))


def sentence_count(text: Column) -> Column:
    parts = F.split(text, "[.!?]+")
    return F.size(F.filter(parts, lambda p: F.trim(p) != "")).cast("long")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1))


def contains_any(text: Column, terms) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def is_renderable(text: Column, separator_controls_are_space: bool = True) -> Column:
    """At least one character that is not white space."""
    spaces = WHITE_SPACE + (SEPARATOR_CONTROLS if separator_controls_are_space else "")
    return text.rlike(f"[^{spaces}]")
