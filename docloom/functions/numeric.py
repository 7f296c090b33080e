"""Numbers and identifiers as tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number after currency, parentheses and thousands commas are gone.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def parse_number(cell: Column) -> Column:
    """A cell as double: a currency sign before it (or the letter p and a blank), then parentheses for negative, commas within; null for blanks and all else."""
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(cell, F.lit(""))), r"^(?:[₱$€£¥]\s*|[Pp]\s+)", ""))
    negative = text.rlike(r"(?s)^\(.*\)$")
    text = F.when(negative, F.trim(F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
    text = F.replace(text, F.lit(","), F.lit(""))
    value = F.when(text.rlike(NUMBER), text).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def safe_identifier(name: Column) -> Column:
    """Letters, digits and single underscores, lower case; `col` when nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_]", "_"), r"_+", "_")
    out = F.lower(F.regexp_replace(out, r"^_+|_+$", ""))
    return F.when(out == "", "col").otherwise(out)


def format_value(value: Column, kind: Column, unit: Column) -> Column:
    """Numbers with thousands commas, two decimals unless whole; then the unit."""
    number = value.try_cast("double")
    text = F.when(kind.isin("number", "currency") & number.isNotNull(), F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 2))).otherwise(value)
    return F.concat(text, F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise(""))


def iso_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO 8601 times in UTC; null where one is none."""
    read = lambda c: F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), c))
    return (F.unix_micros(read(end)) - F.unix_micros(read(start))) / 1e6


def display_words(tokens: Column) -> Column:
    """Tokens as words for display: three quarters, half up."""
    return F.floor((tokens * 3 + 2) / 4).cast("long")
