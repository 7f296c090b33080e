"""The joins, set operations and pages that retrieval and ingestion need, and SQL passed through to Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_new(known: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `more` whose key is not known yet are appended."""
    return known.unionByName(more.join(known.select(*by).distinct(), by, "left_anti"), allowMissingColumns=True)


def keep_ordered(wanted: DataFrame, have: DataFrame, by: str, pos: str) -> DataFrame:
    """Rows of `have` in the order of `wanted`, those that are not there left out."""
    return wanted.select(by, pos).join(have, by).orderBy(pos)


def with_descriptions(tables: DataFrame, descriptions: DataFrame, by: list[str]) -> DataFrame:
    """Each table's description by its id, blank where there is none."""
    return tables.join(descriptions, by, "left").withColumn("description", F.coalesce("description", F.lit("")))


def first_available(keys: DataFrame, first: DataFrame, second: DataFrame, by: str, column: str) -> DataFrame:
    """A value from the first store, or else from the second."""
    a, b = first.select(by, F.col(column).alias("__a")), second.select(by, F.col(column).alias("__b"))
    return keys.join(a, by, "left").join(b, by, "left").select(by, F.coalesce("__a", "__b").alias(column))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of a total order; limit and offset are put within bounds."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def distinct_first(df: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def missing_keys(metadata: DataFrame, required: list[str], column: str = "metadata") -> DataFrame:
    """(missing): required keys that no row's map has, sorted."""
    have = metadata.select(F.explode(F.map_keys(column)).alias("k")).agg(F.collect_set("k").alias("have"))  # the keys of the maps, not their rows
    return have.select(F.array_join(F.sort_array(F.array_except(F.array(*map(F.lit, required)), F.col("have"))), ",").alias("missing"))


def enriched(df: DataFrame, values: dict[str, Column], column: str = "metadata") -> DataFrame:
    """A map column with further keys; keys that are there stay as they are."""
    new = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[c.cast("string") for c in values.values()]))
    old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    return df.withColumn(column, F.map_concat(F.map_filter(new, lambda k, v: v.isNotNull() & ~F.map_contains_key(old, k)), old))


def sql(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """SQL over named tables, as Spark reads it."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _star(text: str):
    """A query of the star tables in a dialect that Spark and DuckDB share."""
    names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "events") if n in text.split() or f"{n}," in text or f"{n})" in text]
    return (lambda s, d: sql(s, text, {n: _t(s, d, n) for n in names})), text


_SQL = {
    "sql_inner_join": "SELECT n_name, count(*) AS customers, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT o_orderkey, coalesce(count(l_linenumber), 0) AS n_lines FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "sql_full_join": "SELECT coalesce(s_nationkey, c_nationkey) AS nation_key, coalesce(s, 0) AS suppliers, coalesce(c, 0) AS customers FROM (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY s_nationkey) a FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey) b ON s_nationkey = c_nationkey",
    "sql_semi_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "sql_anti_join": "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)",
    "sql_theta_join": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_union": "SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION SELECT s_nationkey AS k, 'supplier' AS kind FROM supplier",
    "sql_intersect_except": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) UNION ALL (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier)",
    "sql_having": "SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10",
    "sql_window": "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter FROM orders",
    "sql_subquery": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem m WHERE m.l_suppkey = l.l_suppkey)",
    "sql_grouping_sets": "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_group_concat": "SELECT n_regionkey, count(DISTINCT n_name) AS names, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS joined FROM nation GROUP BY n_regionkey",
    "sql_cte_topk": "WITH r AS (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rn FROM part) SELECT p_brand, p_partkey, rn FROM r WHERE rn <= 3",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, CAST(round(avg(l_discount), 6) AS DOUBLE) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus",
}
QUERIES = {name: _star(text) for name, text in _SQL.items()}
QUERIES["sql_group_concat"] = (QUERIES["sql_group_concat"][0], _SQL["sql_group_concat"].replace("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)", "string_agg(n_name, ',' ORDER BY n_name)"))
QUERIES |= {
    "dedup_antijoin": (
        lambda s, d: append_new(_t(s, d, "labels").select("doc_id", F.lit("labels").alias("seen_in")), _t(s, d, "documents").select("doc_id", F.lit("documents").alias("seen_in")), ["doc_id"]),
        "SELECT doc_id, 'labels' AS seen_in FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "ordered_semijoin": (
        lambda s, d: keep_ordered(_t(s, d, "labels").select("doc_id", F.row_number().over(Window.partitionBy("quality").orderBy(F.desc("doc_id"))).cast("long").alias("pos")), _t(s, d, "documents").select("doc_id", "lang"), "doc_id", "pos"),
        "SELECT doc_id, pos, lang FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id DESC) AS pos FROM labels) JOIN documents USING (doc_id)",
    ),
    "prefix_fallback": (
        lambda s, d: first_available(_t(s, d, "nation").select(F.col("n_nationkey").alias("k")), _t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("name")), _t(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("name")), "k", "name"),
        "SELECT n_nationkey AS k, coalesce((SELECT max(s_name) FROM supplier WHERE s_nationkey = n_nationkey), (SELECT max(c_name) FROM customer WHERE c_nationkey = n_nationkey)) AS name FROM nation",
    ),
    "distinct_first": (
        lambda s, d: distinct_first(_t(s, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]),
        "SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    ),
}
