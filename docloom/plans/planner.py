"""How each document is ingested: parser and steps by rule, over one row of facts about it, and the invariants afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of all steps; a plan keeps those that apply.
STEPS = ["inspect", "parse", "chunk", "describe_tables", "caption_images", "entities", "sql_store", "embed", "finalize"]


def parser(kind: Column, ocr_fraction: Column, pages: Column, cid_coded: Column) -> Column:
    """Office and web files by the office parser. A PDF with a text layer on at least 80 % of its pages natively, else by the unified parser; long scans and glyph codes by vision OCR."""
    pdf = F.when(cid_coded | ((ocr_fraction >= 0.6) & (pages > 30)), "vision").when(ocr_fraction > 0.2, "unified").otherwise("native")
    return F.when(kind == "application/pdf", pdf).when(kind.contains("openxmlformats") | (kind == "text/html"), "office").otherwise("plain")


def plan(inspected: DataFrame) -> DataFrame:
    """(…, mime, pages, ocr_fraction, cid_coded, n_tables, n_images, words, doc_type) -> also parser and steps."""
    made = parser(F.col("mime"), F.coalesce("ocr_fraction", F.lit(0.0)), F.coalesce("pages", F.lit(1)), F.coalesce("cid_coded", F.lit(False)))
    does = {
        "describe_tables": F.col("n_tables") > 0,
        "sql_store": F.col("n_tables") > 0,
        "caption_images": (F.col("n_images") > 0) & ~F.coalesce(F.col("doc_type") == "contract", F.lit(False)) & (F.col("mime") != "text/plain"),
        "entities": F.col("words") >= 500,
    }
    steps = F.array_compact(F.array(*[F.when(F.coalesce(does.get(s, F.lit(True)), F.lit(False)), F.lit(s)) for s in STEPS]))
    return inspected.withColumn("parser", made).withColumn("steps", steps)


def rescue(parsed: DataFrame) -> DataFrame:
    """(doc, parser, words) of every parse: of a document's parses the one with most words, the first parser on a tie; a vision parse counts only if another found under 100 words."""
    best = parsed.groupBy("doc").agg(F.max(F.when(F.col("parser") != "vision", F.col("words"))).alias("other"))
    kept = parsed.join(best, "doc").where((F.col("parser") != "vision") | (F.coalesce("other", F.lit(0)) < 100))
    return kept.groupBy("doc").agg(F.max(F.struct("words", F.when(F.col("parser") == "vision", 0).otherwise(1).alias("o"), "parser")).alias("b")).select("doc", "b.parser", "b.words")


def invariants(tables: DataFrame, summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, table_name) without a summary chunk, and documents without a node: what a repair has to make."""
    missing = tables.select("doc_id", "table_name").join(summaries.select("doc_id", "table_name"), ["doc_id", "table_name"], "left_anti").withColumn("missing", F.lit("summary"))
    bare = tables.select("doc_id").distinct().join(nodes.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("table_name"), F.lit("graph").alias("missing"))
    return missing.unionByName(bare)


def _inspect(spark, sf_dir):
    """Web pages as inspected documents."""
    from docloom.sources import html

    stats = html.page_stats(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return stats.select("page_id", F.when(F.col("page_id") % 4 == 0, "application/pdf").otherwise("text/html").alias("mime"), (F.col("words") / 40).cast("int").alias("pages"), F.round(F.col("page_id") % 10 / 10, 1).alias("ocr_fraction"), (F.col("page_id") % 32 == 0).alias("cid_coded"), F.col("tables").alias("n_tables"), F.col("images").alias("n_images"), "words", F.lit("report").alias("doc_type"))


def _sql() -> str:
    from docloom.operators.quality import QUERIES as Q

    return f"""WITH s AS ({Q['html_text_stats'][1]}),
i AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime, CAST(floor(words / 40) AS INT) AS pages, round(page_id % 10 / 10.0::DOUBLE, 1) AS o, page_id % 32 = 0 AS c, tables, images, words FROM s)
SELECT page_id, CASE WHEN mime = 'text/html' THEN 'office' WHEN c OR (o >= 0.6 AND pages > 30) THEN 'vision' WHEN o > 0.2 THEN 'unified' ELSE 'native' END AS parser,
'inspect,parse,chunk' || CASE WHEN tables > 0 THEN ',describe_tables' ELSE '' END || CASE WHEN images > 0 THEN ',caption_images' ELSE '' END || CASE WHEN words >= 500 THEN ',entities' ELSE '' END || CASE WHEN tables > 0 THEN ',sql_store' ELSE '' END || ',embed,finalize' AS steps FROM i"""


QUERIES = {"ingest_plan": (lambda s, d: plan(_inspect(s, d)).select("page_id", "parser", F.array_join("steps", ",").alias("steps")), _sql())}
