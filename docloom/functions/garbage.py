"""Predicates for text that came out of a broken text layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CID = r"\(cid:\d+\)"


def is_cid_garbage(text: Column) -> Column:
    """Over a fifth of the characters are in glyph codes; short texts are not judged."""
    inside = F.length(text) - F.length(F.regexp_replace(text, CID, ""))
    return F.coalesce((F.length(text) >= 30) & (inside / F.greatest(F.length(text), F.lit(1)) > 0.20), F.lit(False))


def without_cid(text: Column) -> Column:
    return F.regexp_replace(text, CID, "")


#: White space of any script and the four control characters that separate records.
BLANK = r"\s\x1c-\x1f"


def gibberish_signals(text: Column) -> dict[str, Column]:
    """Letters of any script; long runs of one character for 100 characters; vowels among letters; the share of characters other than letters, blanks apart."""
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(F.lower(text), r"[^\p{L}]+", ""))
    vowels = F.length(F.regexp_replace(F.lower(text), r"[^aeiou]+", ""))
    filled = F.length(F.regexp_replace(text, f"(?U)[{BLANK}]+", ""))
    other = F.length(F.regexp_replace(text, rf"(?U)[\p{{L}}{BLANK}]+", ""))
    return {
        "letters": letters,
        "runs": F.regexp_count(text, F.lit(r"(?d)(.)\1{4,}")) * 100.0 / size,
        "vowels": F.when(letters > 0, vowels / letters).otherwise(F.lit(0.0)),
        "other": other / F.greatest(filled, F.lit(1)),
    }


def is_gibberish(text: Column) -> Column:
    """At least two of three signals, or no letters; texts under 80 characters are not judged."""
    s = gibberish_signals(text)
    votes = (s["runs"] > 1.5).cast("int") + (s["vowels"] < 0.15).cast("int") + (s["other"] > 0.45).cast("int")
    return F.coalesce((F.length(text) >= 80) & ((s["letters"] == 0) | (votes >= 2)), F.lit(False))
