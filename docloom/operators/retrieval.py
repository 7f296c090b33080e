"""Confidence of what was retrieved, how its text is put together, and the queries of dense, fused and graph search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import confidence_tier
from docloom.functions.vector import normalise_score
from docloom.operators import bm25, lexical
from docloom.operators.fusion import fused_top, graph_top
from docloom.operators.graph import MENTION_SQL, entities_of
from docloom.operators.vectors import ann_top, dense_top
from docloom.sources.scratch import kept

def confidence(results: DataFrame, query: str = "item_id") -> DataFrame:
    """Confidence of each question's retrieved rows (dense, sparse, graph, has_sql) and its tier."""
    share = lambda c: F.avg(c.cast("double"))
    rows = results.groupBy(query).agg(
        F.count("dense").alias("n"), F.avg("dense").alias("avg_dense"), share((F.col("sparse") > 0.05) | (F.col("graph") > 0)).alias("supported"), share(F.col("dense") > 0.55).alias("strong"), F.max(F.col("has_sql").cast("int")).alias("sql")
    )
    score = F.when(F.col("n") == 0, F.when(F.col("sql") == 1, 0.55).otherwise(0.0)).otherwise(F.round(F.least(F.lit(1.0), 0.5 * F.col("avg_dense") + 0.28 * F.col("supported") + 0.14 * F.col("strong") + 0.08 * F.col("sql")), 3))
    return rows.select(query, score.alias("confidence")).withColumn("tier", confidence_tier(F.col("confidence")))


def mean_score(dense: Column, sparse: Column, graph: Column) -> Column:
    return F.round((dense + sparse + graph) / 3, 4)


def within_budget(blocks: DataFrame, by: str, order: str, text: str = "text", budget: int = DEFAULT.context_chars) -> DataFrame:
    """The first blocks of each group up to a number of characters; the one that crosses it stays."""
    sums = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("__sum", sums).where(F.col("__sum") - F.length(text) <= budget).drop("__sum")


def retrieval_mode(dense: Column, sparse: Column, graph: Column) -> Column:
    """The label of what could be searched."""
    return F.when(dense & sparse & graph, "full_hybrid").when(dense & sparse, "hybrid").when(dense, "hnsw").when(sparse, "bm25").otherwise("none")


def should_rerank(candidates: Column, enabled: Column, sql_rows: Column) -> Column:
    return enabled & (candidates > DEFAULT.top_k) & (sql_rows == 0)


def reranked(order: Column, k: int, available: Column) -> Column:
    """A model's order without repeats and invalid places, at most k; without any left, the original order."""
    valid = F.slice(F.filter(F.array_distinct(order), lambda i: (i >= 0) & (i < available)), 1, k)
    return F.when(F.size(valid) > 0, valid).otherwise(F.sequence(F.lit(0), F.least(F.lit(k), available) - 1))


def context(facts: Column, sql: Column, chunks: Column) -> Column:
    """Facts, then the SQL result, then chunks; empty parts are left out."""
    parts = F.array(facts, sql, F.array_join(chunks, "\n\n---\n\n"))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n====\n\n")


# Queries: benchmark passages over documents; the vector of a passage or document is the one with its number.
CANDIDATES = 50


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dense_topk(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    return dense_top(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), DEFAULT.top_k).withColumn("normalised", F.round(normalise_score(F.col("score")), 4))


def _ann_topk(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    return ann_top(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), DEFAULT.top_k)


def _searched(spark, sf_dir):
    """(index, questions, dense lists). All documents take part: by their words, and those with a vector by that too. Their entities are tags of the index, which holds the words that the questions ask."""
    vectors, docs, asked = _t(spark, sf_dir, "embeddings"), _t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "benchmark")
    with_vector = lambda df, key: df.select(key).join(vectors.select(F.col("vec_id").alias(key), "embedding"), key)
    index = kept(lexical.shards(docs.withColumn("tags", entities_of(F.col("text"))), tags="tags", only=lexical.words_of(asked)), "lexical-index")
    return index, asked, dense_top(with_vector(docs, "doc_id"), with_vector(asked, "item_id"), CANDIDATES, "item_id", "doc_id")


def _rrf(spark, sf_dir):
    return fused_top(*_searched(spark, sf_dir), DEFAULT.retrieve_k, CANDIDATES).select("item_id", "doc_id", "dense_rank", "sparse_rank", F.round("rrf", 6).alias("rrf"), "rank")


def _full(spark, sf_dir):
    return graph_top(*_searched(spark, sf_dir), DEFAULT.top_k, CANDIDATES)


FUSED_SQL = f"""
{bm25.INDEX_SQL},
dn AS (SELECT item_id, doc_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0 AS score
       FROM benchmark JOIN embeddings a ON a.vec_id = item_id CROSS JOIN documents JOIN embeddings b ON b.vec_id = doc_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dn QUALIFY rank <= {CANDIDATES}),
sr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc),
ab AS (SELECT item_id, CAST({CANDIDATES + 1} AS BIGINT) AS absent_dense, (SELECT count(*) FROM sr WHERE sr.item_id = b.item_id) + 1 AS absent_sparse FROM (SELECT DISTINCT item_id FROM benchmark) b),
pa AS (SELECT item_id, doc_id FROM dr UNION SELECT item_id, doc_id FROM sr),
fu AS (SELECT pa.item_id, pa.doc_id, coalesce(dr.score, 0) AS dense, coalesce(sr.score, 0) AS sparse, coalesce(dr.rank, absent_dense) AS dense_rank, coalesce(sr.rank, absent_sparse) AS sparse_rank
       FROM pa JOIN ab USING (item_id) LEFT JOIN dr USING (item_id, doc_id) LEFT JOIN sr USING (item_id, doc_id)),
f1 AS (SELECT *, round(1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + sparse_rank), 9) AS rrf FROM fu),
f2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS rank FROM f1)
"""
FULL_SQL = (
    FUSED_SQL
    + f""", me AS ({MENTION_SQL}), ce AS (SELECT DISTINCT doc_id, entity FROM me),
an AS (SELECT DISTINCT item_id, entity FROM f2 JOIN ce USING (doc_id) WHERE rank <= 3),
az AS (SELECT item_id, count(*) AS anchors FROM an GROUP BY item_id),
mo AS (SELECT DISTINCT item_id, doc_id FROM an JOIN ce USING (entity)),
al AS (SELECT item_id, doc_id, dense, sparse, dense_rank, sparse_rank FROM f2
       UNION ALL SELECT item_id, doc_id, 0, 0, absent_dense, absent_sparse FROM mo JOIN ab USING (item_id) ANTI JOIN f2 USING (item_id, doc_id)),
f3 AS (SELECT *, round(1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + sparse_rank), 9) AS rrf FROM al),
sh AS (SELECT al.item_id, al.doc_id, count(DISTINCT ce.entity) AS shared FROM al JOIN ce USING (doc_id) JOIN an ON an.item_id = al.item_id AND an.entity = ce.entity GROUP BY ALL),
g AS (SELECT f3.item_id, f3.doc_id, dense, sparse, dense_rank, sparse_rank, rrf, round(CASE WHEN anchors > 0 THEN 0.25::DOUBLE * least(1.0::DOUBLE, coalesce(shared, 0) / anchors::DOUBLE) ELSE 0 END, 9) AS graph
      FROM f3 LEFT JOIN az USING (item_id) LEFT JOIN sh USING (item_id, doc_id)),
h AS (SELECT *, round(rrf + graph, 6) AS final FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS rank FROM h)
"""
)
QUERIES = {
    "dense_topk": (
        _dense_topk,
        "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) + 0 AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)"
        " SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score + 1) / 2)), 4) AS normalised FROM s QUALIFY rank <= 5",
    ),
    "ann_topk": (_ann_topk, None),
    "rrf_hybrid": (_rrf, FUSED_SQL + "SELECT item_id, doc_id, dense_rank, sparse_rank, round(rrf, 6) AS rrf, rank FROM f2 WHERE rank <= 15"),
    "full_hybrid": (_full, FULL_SQL + "SELECT * FROM r WHERE rank <= 5"),
    "rag_confidence": (
        lambda s, d: confidence(_full(s, d).withColumn("has_sql", F.col("item_id") % 2 == 0)),
        FULL_SQL
        + """, t AS (SELECT * FROM r WHERE rank <= 5),
c AS (SELECT item_id, round(least(1.0::DOUBLE, 0.5::DOUBLE * avg(dense) + 0.28::DOUBLE * avg(CAST(sparse > 0.05 OR graph > 0 AS INT)) + 0.14::DOUBLE * avg(CAST(dense > 0.55 AS INT)) + 0.08::DOUBLE * max(CAST(item_id % 2 = 0 AS INT))), 3) AS confidence FROM t GROUP BY item_id)
SELECT *, CASE WHEN confidence >= 0.70 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS tier FROM c""",
    ),
}
