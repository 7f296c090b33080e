"""What a BM25 index says of words, and the queries of lexical search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import tokens
from docloom.operators import lexical
from docloom.operators.chunking import W
from docloom.sources.scratch import kept


def terms(text: Column) -> Column:
    return F.transform(tokens(text), F.lower)


def rare_terms(chunks: DataFrame, weights: DataFrame, stopwords: list[str], k: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k terms of each document with the highest idf in `weights` (term, idf): over 4 letters, letters only, no stopwords; of equal ones the first seen."""
    own = chunks.select(key, F.posexplode(F.array_distinct(terms(F.col(text)))).alias("pos", "term")).where((F.length("term") > 4) & F.col("term").rlike(r"^\p{L}+$") & ~F.col("term").isin(stopwords))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("idf", 9)), F.asc("pos")))
    return own.join(weights, "term").withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select(key, "rank", "term")


#: Words of over four letters that make no question.
STOPWORDS = ["their", "which", "would", "there", "other", "about", "using", "within", "under"]


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _index(spark, sf_dir):
    return kept(lexical.shards(_docs(spark, sf_dir)), "lexical-index")


def bm25_topk(spark, sf_dir, k: int = DEFAULT.top_k):
    """Benchmark passages as queries over all documents."""
    return lexical.search(_index(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k)


def _stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    count = lexical.document_counts(index).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return lexical.stats(index).join(F.broadcast(count)).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "postings")


INDEX_SQL = f"""
WITH w AS (SELECT doc_id, list_transform({W}, lambda t: lower(t)) AS w FROM documents),
st AS (SELECT count(*) AS n, sum(len(w)) / greatest(count(*), 1)::DOUBLE AS avgdl FROM w),
po AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
te AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM po, st GROUP BY term),
qb AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_transform({W}, lambda t: lower(t))) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qb JOIN te USING (term) JOIN po USING (term) CROSS JOIN st GROUP BY ALL)
"""
QUERIES = {
    "bm25_topk": (bm25_topk, INDEX_SQL + f"SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {DEFAULT.top_k}"),
    "bm25_index_stats": (_stats, INDEX_SQL + "SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM te) AS terms, (SELECT count(*) FROM po) AS postings FROM st"),
    "bm25_idf": (lambda s, d: lexical.weights(_index(s, d)).select("term", "df", F.round("idf", 6).alias("idf")), INDEX_SQL + "SELECT term, df, round(idf, 6) AS idf FROM te"),
    "keyword_query_terms": (
        lambda s, d: rare_terms(_docs(s, d), lexical.weights(_index(s, d)), STOPWORDS),
        INDEX_SQL + f", fp AS (SELECT doc_id, term, min(i) AS pos FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w) GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(idf, 9) DESC, pos) AS rank, term FROM fp JOIN te USING (term) WHERE length(term) > 4 AND regexp_full_match(term, '\\p{{L}}+') AND term NOT IN ({', '.join(repr(x) for x in STOPWORDS)}) QUALIFY rank <= 6",
    ),
}
