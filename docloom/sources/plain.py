"""Plain text and Markdown as blocks; pages with and without a text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import tokens


def plain_block(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One block of a document, cut to 2000 characters, with the word count of the whole text."""
    return docs.select(key, F.lit(0).cast("long").alias("pos"), F.lit(0).alias("level"), F.substring(text, 1, DEFAULT.plain_chars).alias("text"), F.size(tokens(F.col(text))).cast("long").alias("word_count"))


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, level, text): a line of one to six # and a blank is a heading; other lines make paragraphs, which blank lines and headings end.

    A document without any block gives one of its whole text.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("mark", F.regexp_extract("line", r"^(#{1,6}) ", 1)).withColumn("level", F.length("mark"))
    blank = F.trim(F.regexp_replace("line", r"[\t\r\f]", " ")) == ""
    order = Window.partitionBy(key).orderBy("line_no")
    edge = (blank | (F.col("level") > 0)).cast("int")
    lines = lines.withColumn("island", F.sum(edge).over(order)).where(~blank)
    said = F.when(F.col("level") > 0, F.trim(F.expr("substring(line, level + 2)"))).otherwise(F.trim("line"))
    # a heading is an island of its own: the lines after it share its number, so it is told apart by its level
    parts = lines.groupBy(key, "island", "level").agg(F.min("line_no").alias("first"), F.array_sort(F.collect_list(F.struct("line_no", said.alias("said")))).alias("held"))
    parts = parts.withColumn("text", F.array_join(F.transform("held", lambda x: x["said"]), " ")).where("text <> ''")
    out = parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long").alias("pos"), F.col("level").cast("int"), "text")
    rest = docs.join(out.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("pos"), F.lit(0).alias("level"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return out.unionByName(rest)


def needs_ocr(text: Column) -> Column:
    """A page with hardly any text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < DEFAULT.ocr_least_chars


def sampled_page(page: Column, pages: Column) -> Column:
    """Of a document with at most 200 pages every one; else the first 20, the last 10 and evenly spaced ones between, 170 at most. Pages count from 0."""
    step = F.greatest(F.lit(1), F.ceil((pages - 30) / F.lit(170)))
    return (pages <= 200) | (page < 20) | (page >= pages - 10) | ((page - 20) % step == 0)


def ocr_fraction(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(key, pages_sampled, pages_needing_ocr, ocr_fraction rounded to 3); a page that could not be read (null) needs OCR."""
    counted = pages.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    some = counted.where(sampled_page(F.col(page), F.col("__n")))
    out = some.groupBy(key).agg(F.count("*").alias("pages_sampled"), F.sum(needs_ocr(F.col(text)).cast("long")).alias("pages_needing_ocr"))
    return out.withColumn("ocr_fraction", F.round(F.col("pages_needing_ocr") / F.col("pages_sampled"), 3))
