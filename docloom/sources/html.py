"""Web pages as blocks, tables and counts, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT

HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"
BODY = r"(?is)<(p|li|pre|code)\b[^>]*>(.*?)</(?:p|li|pre|code)\s*>"
HIDDEN = r"(?is)<(script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>"
TABLE, ROW, CELL = r"(?is)<table\b[^>]*>(.*?)</table\s*>", r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"
IMAGE = r"(?i)<img\b"
#: The entities that are decoded, `&amp;` last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def visible(html: Column) -> Column:
    """The page without scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")


def inner_text(markup: Column) -> Column:
    """Text without tags, entities decoded, white space collapsed."""
    out = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, level, text): all headings in order, then all paragraphs, list items and code longer than 15 characters, cut to 1000.

    Level is 0 for body text. The headings-first order is the data model's: body text hangs off the last heading.
    """
    page = pages.select(key, visible(F.col(html)).alias("page"))
    pick = lambda pattern, group: F.regexp_extract_all("page", F.lit(pattern), F.lit(group))
    heads = F.zip_with(pick(HEADING, 1), pick(HEADING, 2), lambda level, t: F.struct(level.cast("int").alias("level"), inner_text(t).alias("text")))
    body = F.transform(pick(BODY, 2), lambda t: F.struct(F.lit(0).alias("level"), inner_text(t).alias("text")))
    found = F.concat(
        F.filter(heads, lambda b: b["text"] != ""),
        F.transform(F.filter(body, lambda b: F.length(b["text"]) > DEFAULT.html_least_chars), lambda b: F.struct(b["level"].alias("level"), F.substring(b["text"], 1, DEFAULT.block_chars).alias("text"))),
    )
    return page.select(key, F.posexplode(found).alias("pos", "block")).select(key, F.col("pos").cast("long"), "block.level", "block.text")


def tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_pos, headers, rows) of every table with a row; its first row is the header."""
    page = pages.select(key, F.posexplode(F.regexp_extract_all(visible(F.col(html)), F.lit(TABLE), F.lit(1))).alias("table_pos", "markup"))
    rows = F.transform(F.regexp_extract_all("markup", F.lit(ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), inner_text))
    page = page.withColumn("all", F.filter(rows, lambda r: F.size(r) > 0)).where(F.size("all") > 0)
    return page.select(key, F.col("table_pos").cast("long"), F.col("all")[0].alias("headers"), F.expr("slice(all, 2, greatest(size(all) - 1, 0))").alias("rows"))


def page_stats(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Headings, body tags, images, tables and words of each page; the words are those before any cut."""
    page = visible(F.col(html))
    text = inner_text(page)
    return pages.select(
        key,
        F.regexp_count(page, F.lit(HEADING)).cast("long").alias("headings"),
        F.regexp_count(page, F.lit(BODY)).cast("long").alias("body_tags"),
        F.regexp_count(page, F.lit(IMAGE)).cast("long").alias("images"),
        F.regexp_count(page, F.lit(r"(?i)<table\b")).cast("long").alias("tables"),
        F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long").alias("words"),
    )
