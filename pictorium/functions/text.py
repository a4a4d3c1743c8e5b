"""Text normalisation and term matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# General terms of image posts that speak for and against artwork, and of offers.
POSITIVE_TERMS = (
    "character design", "reference sheet", "ref sheet", "model sheet", "work in progress", "art trade", "speedpaint", "timelapse", "commission", "sketch", "drawing",
    "illustration", "painting", "comic", "panel", "page", "render", "wip", "request", "adoptable", "process",
)
NEGATIVE_TERMS = (
    "reaction image", "package arrived", "merch arrived", "convention photo", "my cat", "my dog", "lunch", "dinner", "breakfast", "burger", "restaurant", "coffee",
    "selfie", "vacation", "hotel", "screenshot", "meme",
)
ROUTING_TERMS = (
    "commissions open", "commission prices", "price sheet", "terms of service", "tos", "adopt auction", "bidding", "ych", "merch", "print shop", "sticker", "keychain",
)
EXCLUDED_TERMS = ("18+", "explicit", "lewd", "nsfw", "porn", "yiff", "\U0001f51e")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(column: Column) -> Column:
    """NFKC, lower case, runs of blanks as one, none around; NULL counts as empty.

    Only texts with characters outside ASCII go through Python.
    """
    text = F.coalesce(column, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(_nfkc(text)), r"(?U)\s+", " "))


def collapse_blanks(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"(?U)\s+", " "))


def _bounded(term: str) -> str:
    return r"(?U)(?<!\w)\Q" + term + r"\E(?!\w)"


def matched_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur as whole words, the longest first."""
    ordered = sorted(terms, key=len, reverse=True)
    hits = [F.when(text.contains(t) & text.rlike(_bounded(t)), F.lit(t)) for t in ordered]
    return F.array_compact(F.array(*hits))


def match_score(matches: Column) -> Column:
    return F.least(F.lit(1.0), F.size(matches) * F.lit(0.25))


def with_text_scores(df: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """``df`` with positive, negative and net score and the matched terms of a normalised text, or of its first ``most`` characters.

    In steps, so that neither the text nor the terms are worked out again for
    every term and score.
    """
    cut = F.col(text) if most is None else F.substring(text, 1, most)
    terms = {"positive_terms": POSITIVE_TERMS, "negative_terms": NEGATIVE_TERMS, "routing_terms": ROUTING_TERMS}
    found = df.withColumn("_cut", cut).withColumns({name: matched_terms(F.col("_cut"), t) for name, t in terms.items()}).drop("_cut")
    found = found.withColumns({"positive_score": match_score(F.col("positive_terms")), "negative_score": match_score(F.concat("negative_terms", "routing_terms"))})
    return found.withColumn("net_score", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("positive_score") - F.col("negative_score"))))


def contains_term(text: Column, term: str) -> Column:
    """Plain words match as whole words, anything else as a part."""
    return text.rlike(_bounded(term)) if term.isascii() and term.isalnum() else text.contains(term)


def word_set(column: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("([a-z]+)"), 1))


def spreadsheet_safe(column: Column) -> Column:
    """A leading formula sign is quoted."""
    return F.when(column.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), column)).otherwise(column)


def html_safe_json(column: Column) -> Column:
    return F.replace(column, F.lit("</"), F.lit("<\\/"))


def safe_filename(column: Column) -> Column:
    """Kept if it is a harmless name of at most 128 characters, else its hash."""
    return F.when(column.rlike(r"^[A-Za-z0-9._-]{1,128}$"), column).otherwise(F.sha2(column, 256))


def safe_component(column: Column, otherwise: str = "review") -> Column:
    """Runs of other characters as _, dots and _ off the ends; ``otherwise`` where nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(column, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", otherwise).otherwise(cleaned)
