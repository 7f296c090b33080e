"""Smaller operators: image selection, page sets, grouped entities, bars, result blocks, answer records, shared questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import estimate, tokens
from docloom.operators.chunking import EST, W
from docloom.operators.graph import MENTION_SQL, mentions
from docloom.operators.relational import enriched
from docloom.operators.retrieval import within_budget

#: Page renders and embedded images that a document keeps, and the least area of an embedded one.
RENDERS, EMBEDDED, LEAST_AREA = 40, 10, 5000


def select_images(images: DataFrame) -> DataFrame:
    """(doc_id, page, kind render|embedded, width, height): renders of scanned pages first; embedded images that are not small and not on those pages; each kind up to its limit, in order of pages."""
    renders = images.where("kind = 'render'")
    embedded = images.where((F.col("kind") == "embedded") & (F.col("width") * F.col("height") >= LEAST_AREA)).join(renders.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    order = Window.partitionBy("doc_id", "kind").orderBy("page", F.desc(F.col("width") * F.col("height")), "width")
    both = renders.unionByName(embedded.select(*renders.columns)).withColumn("place", F.row_number().over(order).cast("long"))
    return both.where(F.col("place") <= F.when(F.col("kind") == "render", RENDERS).otherwise(EMBEDDED))


def samples(blocks: DataFrame, tables: DataFrame, key: str = "doc_id", most_blocks: int = 25, most_tables: int = 5, most_rows: int = 10, chars: int = 4000) -> DataFrame:
    """(key, sample): the beginning of a document by which it is classified: its first 25 blocks; without any, headers and first 10 rows of its first 5 tables; cut to 4000 characters. blocks: (key, pos, text); tables: (key, table_pos, headers, rows)."""
    first = blocks.where((F.col("pos") < most_blocks) & (F.trim("text") != "")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t")))).alias("b"))
    text = first.select(key, F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))
    line = lambda cells: F.array_join(cells, " | ")
    shown = F.concat(F.when(F.size("headers") > 0, F.array(line(F.col("headers")))).otherwise(F.array().cast("array<string>")), F.transform(F.slice("rows", 1, most_rows), line))
    tabled = tables.where(F.col("table_pos") < most_tables).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("table_pos", F.array_join(shown, "\n").alias("t")))).alias("t"))
    tabled = tabled.select(key, F.array_join(F.transform("t", lambda x: x["t"]), "\n").alias("table_text"))
    both = text.join(tabled, key, "full_outer")
    return both.select(key, F.trim(F.substring(F.coalesce("text", "table_text", F.lit("")), 1, chars)).alias("sample"))


def page_set(*marked: DataFrame) -> DataFrame:
    """(doc_id, page) that any of the lists has, each once."""
    out = marked[0].select("doc_id", "page")
    for df in marked[1:]:
        out = out.union(df.select("doc_id", "page"))
    return out.distinct()


def by_label(found: DataFrame, key: str = "doc_id", most: int = 30) -> DataFrame:
    """(key, label, n, names): a document's distinct entities by kind, at most 30 of a kind in order of place (the extractor's limit), and how many there are."""
    first = found.groupBy(key, "label", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name")).alias("f"))
    held = first.groupBy(key, "label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("f")).alias("fs"))  # of one document
    return held.select(key, "label", "n", F.array_join(F.transform(F.slice("fs", 1, most), lambda x: x["name"]), ", ").alias("names"))


def relative_bar(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each value in percent of the largest of its group, at least 2 where there is one."""
    most = F.max(value).over(Window.partitionBy(*by))
    return rows.withColumn("bar", F.when(F.col(value).isNotNull(), F.greatest(F.lit(2.0), F.round(F.coalesce(F.try_divide(F.col(value) * 100.0, most), F.lit(0.0)), 0))))


def result_block(columns: list[str], null: str = "") -> Column:
    """A row as a line of a result block."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns])


def first_known(*confidences: Column) -> Column:
    return F.coalesce(*confidences)


def valid_descriptions(descriptions: Column, columns: Column, most: int = 300) -> Column:
    """A model's column descriptions: of known columns, not blank, cut to 300 characters."""
    kept = F.map_filter(descriptions, lambda k, v: F.array_contains(columns, k) & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    return F.transform_values(kept, lambda k, v: F.substring(F.trim(v), 1, most))


def shared_questions(questions: DataFrame, pipelines: list[str], most: int = 10) -> DataFrame:
    """The first ten questions, the same for each pipeline."""
    first = questions.orderBy("question_id").limit(most)
    return first.withColumn("pipeline", F.explode(F.array(*map(F.lit, pipelines))))


def answer_record(answers: DataFrame) -> DataFrame:
    """(question_id, q, route, chunk_ids, answer, tokens_in, tokens_out, cost, confidence, judge_score) with the route's trace as one struct."""
    trace = F.struct(F.coalesce("route", F.lit("vector")).alias("route"), F.coalesce(F.size("chunk_ids"), F.lit(0)).alias("n_chunks"), F.col("reason"))
    return answers.withColumn("trace", trace).withColumn("answered", F.coalesce(F.col("answer"), F.lit("")) != "")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _images(spark, sf_dir):
    """Line items as images of orders: flag R a page render, others embedded, quantities and sizes as dimensions."""
    i = _t(spark, sf_dir, "lineitem")
    return i.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("page"), F.when(F.col("l_returnflag") == "R", "render").otherwise("embedded").alias("kind"), (F.col("l_quantity") * 4).cast("long").alias("width"), (F.col("l_orderkey") % 100 + 10).alias("height"))


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 4 + F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)).alias("place"), "role", "turn", "text")


def _metadata(spark, sf_dir):
    """Documents' own keys, which stay, and further ones."""
    own = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    df = enriched(_t(spark, sf_dir, "documents").select("doc_id", "text", own.alias("metadata")), {"lang": F.lit("zz"), "doc_type": F.lit("note"), "token_count": estimate(F.size(tokens(F.col("text"))))})
    return df.select("doc_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))).alias("metadata"))


QUERIES = {
    "image_selection": (
        lambda s, d: select_images(_images(s, d).distinct()),
        f"""WITH i AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS page, CASE WHEN l_returnflag = 'R' THEN 'render' ELSE 'embedded' END AS kind, CAST(l_quantity * 4 AS BIGINT) AS width, l_orderkey % 100 + 10 AS height FROM lineitem),
u AS (SELECT * FROM i WHERE kind = 'render' UNION ALL SELECT * FROM i WHERE kind = 'embedded' AND width * height >= {LEAST_AREA} AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM i WHERE kind = 'render'))
SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY page, width * height DESC, width) AS place FROM u QUALIFY place <= CASE WHEN kind = 'render' THEN {RENDERS} ELSE {EMBEDDED} END""",
    ),
    "page_set_union": (
        lambda s, d: page_set(*[_t(s, d, "lineitem").where(c).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page")) for c in ("l_quantity > 45", "l_discount > 0.08", "l_tax > 0.07")]),
        "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page FROM lineitem WHERE l_quantity > 45 UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.08 UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.07",
    ),
    "entities_by_label": (
        lambda s, d: by_label(mentions(_t(s, d, "documents").select("doc_id", "text"))).select("doc_id", "label", "n", F.md5("names").alias("names_md5")),
        f"""WITH f AS (SELECT doc_id, label, lower(name) AS low, min((pos, name)) AS f FROM ({MENTION_SQL}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY f) AS r FROM f)
SELECT doc_id, label, count(*) AS n, md5(string_agg(f[2], ', ' ORDER BY f) FILTER (r <= 30)) AS names_md5 FROM r GROUP BY ALL""",
    ),
    "relative_bar": (
        lambda s, d: relative_bar(_t(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), ["o_orderpriority"], "total").withColumn("total", F.round("total", 0)),
        "WITH t AS (SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) SELECT o_orderpriority, o_orderstatus, round(total, 0) AS total, greatest(2.0::DOUBLE, round(total * 100.0::DOUBLE / max(total) OVER (PARTITION BY o_orderpriority), 0)) AS bar FROM t",
    ),
    "context_budget": (
        lambda s, d: within_budget(_turns(s, d), "conv_id", "place", budget=400).select("conv_id", "turn", "role"),
        "WITH t AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn * 4 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END ROWS UNBOUNDED PRECEDING) AS s FROM conversations) SELECT conv_id, turn, role FROM t WHERE s - n <= 400",
    ),
    "result_block": (
        lambda s, d: _t(s, d, "supplier").select("s_suppkey", result_block(["s_name", "s_nationkey"], "---").alias("line")),
        "SELECT s_suppkey, coalesce(s_name, '---') || ' | ' || coalesce(CAST(s_nationkey AS VARCHAR), '---') AS line FROM supplier",
    ),
    "metadata_enriched": (
        _metadata,
        f"""SELECT doc_id, '{{"doc_type":"note",' || concat_ws(',', '"lang":"' || coalesce(lang, 'zz') || '"', CASE WHEN source IS NOT NULL THEN '"source":"' || source || '"' END, '"token_count":"' || {EST.format(f"len({W})")} || '"') || '}}' AS metadata FROM documents""",
    ),
}
