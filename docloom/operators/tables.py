"""Typed tables: inference, profiles, names, questions by template, and the guards of a SQL route."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.numeric import parse_number, safe_identifier

#: Words that ask for an aggregate, and those that mark a number's or a category's column.
AGGREGATE_WORDS = ["sum", "average", "avg", "total", "count", "minimum", "maximum", "highest", "lowest", "compare", "across all", "how many"]
NUMERIC_HINTS = ["amount", "total", "value", "count", "n", "mean", "avg", "score", "rate", "pct", "%", "$", "revenue", "cost", "price", "number", "quantity", "size", "weight", "age", "days", "ratio", "margin", "growth", "sales", "profit", "loss"]
CATEGORY_HINTS = ["group", "type", "category", "segment", "treatment", "arm", "product", "region", "department", "class", "status", "name", "stage", "quarter", "year"]
FORBIDDEN = ["insert", "update", "delete", "drop", "alter", "create", "attach", "replace", "pragma"]


def cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, cell) long form of string columns."""
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("x")).select(key, "x.column", "x.cell")


def infer_types(long: DataFrame, by: list[str]) -> DataFrame:
    """REAL where at least 70 % of the non-empty cells are numbers, else TEXT; with the counts."""
    filled = F.trim(F.coalesce("cell", F.lit(""))) != ""
    out = long.groupBy(*by).agg(F.sum(filled.cast("long")).alias("non_empty"), F.sum((filled & parse_number(F.col("cell")).isNotNull()).cast("long")).alias("numeric"))
    real = (F.col("non_empty") > 0) & (F.col("numeric") >= DEFAULT.numeric_share * F.col("non_empty"))
    return out.withColumn("type", F.when(real, "REAL").otherwise("TEXT"))


def unique_names(headers: DataFrame, by: list[str], pos: str = "pos", header: str = "header") -> DataFrame:
    """Identifiers of a table's headers. Equal ones get _1, _2, … in order; names are unique, also where a header already ends like that."""
    base = headers.withColumn("base", safe_identifier(F.col(header)))
    place = F.row_number().over(Window.partitionBy(*by, "base").orderBy(pos)) - 1
    base = base.withColumn("n", place).withColumn("name", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))))
    clash = F.row_number().over(Window.partitionBy(*by, "name").orderBy(F.col("n") > 0, pos)) - 1
    return base.withColumn("name", F.when(clash == 0, F.col("name")).otherwise(F.concat("name", F.lit("_x"), clash.cast("string")))).drop("base", "n")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns by their inferred types: REAL as double, else as they are."""
    return df.select(*[parse_number(F.col(c)).alias(c) if types.get(c) == "REAL" else F.col(c) for c in df.columns])


def register(spark: SparkSession, tables: dict[int, DataFrame]) -> dict[str, str]:
    """Views `doc_table_<n>` by a table's place in its document; a skipped table leaves a gap."""
    names = {}
    for place, df in tables.items():
        df.createOrReplaceTempView(name := f"doc_table_{place + 1}")
        names[name] = ", ".join(df.columns)
    return names


def numeric_profile(df: DataFrame, column: Column, by: list[str] | None = None) -> DataFrame:
    """Greatest, least and mean (2 places) of a column's numbers, as written in text."""
    value = parse_number(column.cast("string"))
    return df.groupBy(*(by or [])).agg(F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.round(F.avg(value), 2).alias("avg_value"))


def group_profile(df: DataFrame, category: str, column: Column) -> DataFrame:
    """(category, n, avg_value) by mean, highest first."""
    out = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(parse_number(column.cast("string"))), 2).alias("avg_value"))
    return out.orderBy(F.desc("avg_value"), "category")


def hinted(header: Column, hints: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(header), h))


def asks_aggregate(question: Column) -> Column:
    return F.lower(question).rlike("|".join(map(re.escape, AGGREGATE_WORDS)))


def safe_sql(sql: Column) -> Column:
    """A single SELECT without words that change data: begins with select, one statement, none of the words between blanks."""
    text = F.trim(F.regexp_replace(sql, r"[;\s]+$", ""))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(" "))
    return F.lower(text).startswith("select") & ~F.contains(text, F.lit(";")) & ~padded.rlike(" (" + "|".join(FORBIDDEN) + ") ")


def passes_gate(sql: Column, question: Column) -> Column:
    """SQL that aggregates is only for questions that ask for it."""
    return ~F.lower(sql).rlike(r"\b(sum|avg|count|max|min)\s*\(") | asks_aggregate(question)


def near_ratio(value: Column, texts: Column) -> Column:
    """Of the numbers in the texts the ratio of a value to the one nearest it; null without any."""
    numbers = F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)))), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double")), lambda n: n > 0)
    ratios = F.transform(numbers, lambda n: F.abs(value) / n)
    return F.array_min(F.transform(ratios, lambda r: F.struct(F.abs(r - 1).alias("off"), r.alias("r"))))["r"]


def plausible(value: Column, texts: Column) -> Column:
    """A lone number that a query returns must be within a factor of 100 of a number in the retrieved texts, if there is one."""
    ratio = near_ratio(value, texts)
    return ratio.isNull() | ratio.between(0.01, 100)


def overlaps_fact(fact: Column, value: Column) -> Column:
    """A fact that is within 1 % of a query's number, or within a factor of ten, stands for it."""
    ratio = F.try_divide(F.abs(fact), F.abs(value))
    return F.coalesce((F.abs(ratio - 1) < 0.01) | ((ratio > 0.1) & (ratio < 10)), F.lit(False))


REASONS = ["no_registry", "no_schema", "not_routed", "unsafe_sql", "aggregate_not_asked", "execution_failed", "no_rows", "implausible", "covered_by_fact", "ok"]


def refusal(sql: Column, question: Column) -> Column:
    """Why a routed statement is not run, or null."""
    return F.when(F.coalesce(sql, F.lit("")) == "", "not_routed").when(~safe_sql(sql), "unsafe_sql").when(~passes_gate(sql, question), "aggregate_not_asked")


def statement(sql: str) -> str:
    return sql.rstrip("; \n")


def run_statements(spark: SparkSession, statements: list[str], most: int = 25, at_once: int = 8) -> dict[str, tuple[list[str], list, str]]:
    """For each of some statements its columns, its first rows and the reason (ok, no_rows or execution_failed). Each is run once, several at a time, as jobs of the calling job's tags."""

    def one(sql: str):
        try:
            df = spark.sql(statement(sql)).limit(most)
            rows = df.collect()
            return sql, (df.columns, rows, "ok" if rows else "no_rows")
        except Exception as e:  # whatever Spark refuses is an outcome of the route
            return sql, ([], [], f"execution_failed: {type(e).__name__}")

    with ThreadPoolExecutor(at_once) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(one), dict.fromkeys(statements)))


def run_guarded(spark: SparkSession, sql: str, question: str, most: int = 25) -> tuple[DataFrame | None, str]:
    """One routed question's SQL through the guards: its first rows, or None, and the reason."""
    reason = spark.createDataFrame([(sql, question)], "sql string, question string").select(refusal(F.col("sql"), F.col("question"))).first()[0]
    if reason:
        return None, reason
    try:
        out = spark.sql(statement(sql)).limit(most)
        return (out, "ok") if out.take(1) else (None, "no_rows")
    except Exception as e:
        return None, f"execution_failed: {type(e).__name__}"


def table_questions(columns: DataFrame) -> DataFrame:
    """(table_name, column, type) -> one or two questions a table, with their SQL: a numeric column's profile, and its mean by a category."""
    number = F.min(F.when((F.col("type") == "REAL"), F.struct((~hinted(F.col("column"), NUMERIC_HINTS)).alias("no_hint"), "column")))
    category = F.min(F.when((F.col("type") == "TEXT"), F.struct((~hinted(F.col("column"), CATEGORY_HINTS)).alias("no_hint"), "column")))
    picked = columns.groupBy("table_name").agg(number["column"].alias("number"), category["column"].alias("category")).where("number IS NOT NULL")
    one = picked.select("table_name", F.lit("sql").alias("route"), F.format_string("What are the highest, lowest and average %s?", "number").alias("q"), F.format_string("SELECT max(%1$s) AS max_value, min(%1$s) AS min_value, round(avg(%1$s), 2) AS avg_value FROM %2$s", "number", "table_name").alias("sql"))
    two = picked.where("category IS NOT NULL").select("table_name", F.lit("sql").alias("route"), F.format_string("What is the average %s by %s?", "number", "category").alias("q"), F.format_string("SELECT %1$s, count(*) AS n, round(avg(%2$s), 2) AS avg_value FROM %3$s GROUP BY %1$s ORDER BY avg_value DESC", "category", "number", "table_name").alias("sql"))
    return one.unionByName(two)


def schema_block(columns: DataFrame) -> DataFrame:
    """(table_name, column, type, description) -> (table_name, block): what a router is told of each table."""
    line = F.concat(F.lit("  - "), "column", F.lit(" ("), "type", F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    held = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("column", line.alias("line")))).alias("held"))
    return held.select("table_name", F.concat(F.lit("Table "), "table_name", F.lit("\n"), F.array_join(F.transform("held", lambda x: x["line"]), "\n")).alias("block"))


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _order_cells(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    dressed = o.select("o_orderkey", "o_orderstatus", F.concat(F.lit("$ "), F.format_number(F.round("o_totalprice", 2), 2)).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    return cells(dressed, "o_orderkey", ORDER_COLUMNS)


def _parse(spark, sf_dir):
    n = F.round("l_extendedprice", 2)
    styles = [F.format_number(n, 2), F.concat(F.lit("("), F.format_number(n, 2), F.lit(")")), F.concat(F.lit("P "), F.format_number(n, 0)), F.concat(F.lit("€"), F.col("l_quantity").cast("decimal(10,2)").cast("string")), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")), F.lit(" "), F.lit("DECLINED"), F.col("l_returnflag"), F.concat(F.lit("p ("), F.format_number(n, 2), F.lit(")"))]
    cell = F.element_at(F.array(*styles), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(styles) + 1).cast("int"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "cell", F.round(F.coalesce(parse_number(F.col("cell")), F.lit(-1.0e18)), 2).alias("value"))


_FMT = "format('{:,.2f}', CAST(round(%s, 2) AS DOUBLE))"
_CELL_SQL = f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, [{_FMT % 'l_extendedprice'}, '(' || {_FMT % 'l_extendedprice'} || ')', 'P ' || format('{{:,.0f}}', round_even(round(l_extendedprice, 2), 0)),
'€' || CAST(CAST(l_quantity AS DECIMAL(10,2)) AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR) || '%', ' ', 'DECLINED', l_returnflag, 'p (' || {_FMT % 'l_extendedprice'} || ')'][(l_orderkey + l_linenumber) % 9 + 1] AS cell FROM lineitem"""
PARSE_SQL = r"""CASE WHEN regexp_matches({s}, '^\(.*\)$') THEN -1 ELSE 1 END * TRY_CAST(CASE WHEN regexp_matches({t}, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN {t} END AS DOUBLE)"""
#: A cell without its currency sign, and that without parentheses and commas.
_BARE = r"trim(regexp_replace(trim(coalesce({c}, '')), '^([₱$€£¥]\s*|[Pp]\s+)', ''))"
_CLEAN = r"replace(trim(regexp_replace({s}, '^\((.*)\)$', '\1')), ',', '')"


def _parse_sql(c: str) -> str:
    return PARSE_SQL.replace("{t}", _CLEAN).replace("{s}", _BARE).replace("{c}", c)


SQL_CASES = "SELECT * FROM (VALUES ('select 1'), ('SELECT a FROM t;'), ('select 1; drop table t'), ('with x as (select 1) select * from x'), ('select replace(a, 1, 2) from t'), ('select * from t where delete = 1'), (' select insert from t')) v(s)"
QUERIES = {
    "numeric_parse": (_parse, f"WITH c AS ({_CELL_SQL}) SELECT *, round(coalesce({_parse_sql('cell')}, -1.0e18), 2) AS value FROM c"),
    "type_inference": (
        lambda s, d: infer_types(_order_cells(s, d), ["column"]),
        f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, '$ ' || {_FMT % 'o_totalprice'} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders),
l AS (SELECT name AS "column", cell FROM o UNPIVOT INCLUDE NULLS (cell FOR name IN (o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))),
c AS (SELECT "column", CAST(sum(CAST(trim(coalesce(cell, '')) <> '' AS INT)) AS BIGINT) AS non_empty, CAST(sum(CAST(trim(coalesce(cell, '')) <> '' AND {_parse_sql('cell')} IS NOT NULL AS INT)) AS BIGINT) AS numeric FROM l GROUP BY 1)
SELECT *, CASE WHEN non_empty > 0 AND numeric >= 0.7 * non_empty THEN 'REAL' ELSE 'TEXT' END AS type FROM c""",
    ),
    "numeric_profile": (lambda s, d: numeric_profile(_t(s, d, "lineitem"), F.round("l_extendedprice", 2), ["l_returnflag"]), "SELECT l_returnflag, max(round(l_extendedprice, 2)) AS max_value, min(round(l_extendedprice, 2)) AS min_value, round(avg(round(l_extendedprice, 2)), 2) AS avg_value FROM lineitem GROUP BY 1"),
    "group_profile": (lambda s, d: group_profile(_t(s, d, "orders"), "o_orderpriority", F.round("o_totalprice", 2)), "SELECT o_orderpriority AS category, count(*) AS n, round(avg(round(o_totalprice, 2)), 2) AS avg_value FROM orders GROUP BY 1"),
    "safe_identifiers": (
        lambda s, d: _t(s, d, "part").select("p_partkey", safe_identifier(F.col("p_name")).alias("name"), safe_identifier(F.col("p_type")).alias("type")),
        r"SELECT p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'col') AS name, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'col') AS type FROM part",
    ),
    "aggregate_intent": (
        lambda s, d: _t(s, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(asks_aggregate(F.col("text")).cast("long")).alias("aggregate"), F.sum(safe_sql(F.col("text")).cast("long")).alias("safe")),
        f"""SELECT role, count(*) AS turns, CAST(sum(CAST(regexp_matches(lower(text), '{"|".join(AGGREGATE_WORDS)}') AS INT)) AS BIGINT) AS aggregate,
CAST(sum(CAST(starts_with(lower(trim(regexp_replace(text, '[;\\s]+$', ''))), 'select') AS INT)) AS BIGINT) AS safe FROM conversations GROUP BY role""",
    ),
    "unique_headers": (
        lambda s, d: unique_names(_t(s, d, "part").select("p_brand", F.col("p_partkey").alias("pos"), F.col("p_type").alias("header")), ["p_brand"]).select("p_brand", "pos", "name"),
        r"""WITH b AS (SELECT p_brand, p_partkey AS pos, lower(regexp_replace(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY pos) - 1 AS n FROM b) SELECT p_brand, pos, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS name FROM n""",
    ),
}
