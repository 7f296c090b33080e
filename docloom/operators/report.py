"""The report of an evaluation as lines of Markdown and as JSON, and results that a showcase has already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.numeric import display_words, iso_seconds
from docloom.operators.observe import verdict

#: An answer's beginning that the report shows, and rows of a statement that is run anew.
SHOWN_CHARS, SHOWN_ROWS = 500, 8
VERDICTS = ["correct", "partial", "unsupported", "incorrect"]
COLUMNS = {"question_id": "long", "q": "string", "route": "string", "category": "string", "answer": "string", "score": "double", "keyword_pass": "boolean", "cost": "double", "tokens_in": "long", "tokens_out": "long", "wall_ms": "long"}


def _percent(part: Column, whole: Column) -> Column:
    """Half up, in whole numbers."""
    return F.coalesce(F.floor(F.try_divide(part * 200 + whole, whole * 2)), F.lit(0)).cast("string")


def _thousandths(value: Column) -> Column:
    return F.concat(F.floor(value / 1000).cast("string"), F.lit("."), F.lpad((value % 1000).cast("string"), 3, "0"))


def _row(*cells: Column | str) -> Column:
    parts = [F.lit("| ")]
    for i, c in enumerate(cells):
        parts += ([F.lit(" | ")] if i else []) + [F.coalesce(c.cast("string"), F.lit("—")) if isinstance(c, Column) else F.lit(c)]
    return F.concat(*parts, F.lit(" |"))


def report_lines(graded: DataFrame) -> DataFrame:
    """(section, place, line) of the report: 1 totals, 2 verdicts, 3 routes, 4 categories, 5 what is not correct, 6 every answer. graded has COLUMNS; those it lacks are null.

    A score that is missing makes the verdict `error`. Scores count in whole thousandths, so no line depends on
    the order of a sum. A table without rows gives totals and verdicts of zero.
    """
    df = graded.select(*[(F.col(c) if c in graded.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    df = df.withColumns({"verdict": F.when(F.col("score").isNull(), "error").otherwise(verdict(F.col("score"))), "milli": F.round(F.col("score") * 1000).cast("long"), "route": F.coalesce("route", F.lit("?")), "category": F.coalesce("category", F.lit("?"))})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = lambda: [F.count("*").alias("n"), *[total((F.col("verdict") == v).cast("long")).alias(v) for v in [*VERDICTS, "error"]], total(F.col("keyword_pass").cast("long")).alias("kw"), total("milli").alias("milli"), F.count("milli").alias("scored")]
    whole = df.agg(*counts(), total(F.round(F.col("cost") * 10000).cast("long")).alias("cost"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), total("wall_ms").alias("wall_ms"))
    said = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"))
    money = F.concat(F.floor(F.col("cost") / 10000).cast("string"), F.lit("."), F.lpad((F.col("cost") % 10000).cast("string"), 4, "0"))
    totals = [F.lit("# Evaluation"), said("questions", F.col("n")), said("cost in dollars", money), said("tokens read", F.col("tokens_in")), said("tokens written", F.col("tokens_out")), said("milliseconds", F.col("wall_ms"))]
    heads = [F.lit("## Verdicts"), _row("verdict", "answers", "%"), F.lit("|-|-:|-:|"), *[_row(v, F.col(v), _percent(F.col(v), F.col("n"))) for v in [*VERDICTS, "error"]], _row("keywords found", F.col("kw"), _percent(F.col("kw"), F.col("n")))]
    lines = lambda one, section, made: one.select(F.lit(section).alias("section"), F.posexplode(F.array(*made)).alias("pos", "line")).select("section", F.format_string("%03d", "pos").alias("place"), "line")
    once = df.sparkSession.range(1)
    parts = [lines(whole, 1, totals), lines(whole, 2, heads)]
    for section, name in ((3, "route"), (4, "category")):
        parts.append(lines(once, section, [F.lit(f"## By {name}"), _row(name, "n", "correct", "keywords", "mean score"), F.lit("|-|-:|-:|-:|-:|")]))
        mean = _thousandths(F.floor(F.try_divide(F.col("milli") * 2 + F.col("scored"), F.col("scored") * 2)).cast("long"))
        own = df.groupBy(name).agg(*counts())
        parts.append(own.select(F.lit(section).alias("section"), F.concat(F.lit("1"), name).alias("place"), _row(F.col(name), F.col("n"), F.col("correct"), F.col("kw"), mean).alias("line")))
    place = F.concat(F.lit("1"), F.lpad(F.col("question_id").cast("string"), 20, "0"))
    score = _thousandths(F.col("milli"))
    short = F.regexp_replace(F.coalesce("answer", F.lit("")), r"\s+", " ")
    gaps = df.where("verdict <> 'correct'").select(F.lit(5).alias("section"), place.alias("place"), F.concat(F.lit("- "), F.coalesce(F.col("question_id").cast("string"), F.lit("?")), F.lit(" ("), "route", F.lit(") "), "verdict", F.lit(": "), F.regexp_replace(F.coalesce("q", F.lit("")), r"\s+", " "), F.lit(" — "), F.substring(short, 1, SHOWN_CHARS), F.when(F.length(short) > SHOWN_CHARS, "…").otherwise("")).alias("line"))
    every = df.select(F.lit(6).alias("section"), place.alias("place"), _row(F.col("question_id"), F.col("route"), F.col("verdict"), score, F.when(F.col("keyword_pass"), "yes").otherwise("no"), F.col("wall_ms")).alias("line"))
    parts += [lines(once, 5, [F.lit("## Not correct")]), gaps, lines(once, 6, [F.lit("## All answers"), _row("id", "route", "verdict", "score", "keywords", "ms"), F.lit("|-|-|-|-:|-|-:|")]), every]
    return reduce(DataFrame.unionByName, parts)


def write_report(graded: DataFrame, path: str) -> None:
    """`path`/results: every graded answer as a line of JSON; `path`/report: the Markdown, its lines in order over the parts. Earlier ones are replaced."""
    graded.write.mode("overwrite").json(f"{path}/results")
    # a range sort writes the parts in order; no task holds the whole report
    report_lines(graded).orderBy("section", "place", "line").select("line").write.mode("overwrite").text(f"{path}/report")


def reuse_shown(questions: DataFrame, shown: DataFrame, by: str = "idx") -> DataFrame:
    """Questions (by, sql, …) with what a showcase (by, sql_cols, sql_rows) has at the same place, and `rerun`: a statement without columns there, which is to be run for its first 8 rows."""
    held = shown.select(by, "sql_cols", "sql_rows").where(F.size(F.coalesce("sql_cols", F.array().cast("array<string>"))) > 0)
    out = questions.join(held, by, "left")
    return out.withColumn("rerun", F.col("sql").isNotNull() & F.col("sql_cols").isNull())


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graded(spark, sf_dir):
    """Labels as grades of documents; every label without a quality counts as an error."""
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return j.select(F.col("doc_id").alias("question_id"), "source", F.col("lang").alias("route"), F.col("source").alias("category"), F.lit("").alias("q"), F.col("text").alias("answer"), (F.col("quality") * 0.75 + F.col("toxic") * 0.25).alias("score"), (F.col("toxic") == 0).alias("keyword_pass"), n.alias("tokens_in"), (n % 7).alias("tokens_out"), (n * 2).alias("wall_ms"), (n / 10000).alias("cost"))


def _report(spark, sf_dir):
    return report_lines(_graded(spark, sf_dir)).where("section <> 5 AND (section < 5 OR place >= '1')")


def _report_sql() -> str:
    verdicts = [*VERDICTS, "error"]
    sums = ", ".join(f"CAST(sum(CAST(verdict = '{v}' AS INT)) AS BIGINT) AS \"{v}\"" for v in verdicts)
    totals = ["'# Evaluation'", "'- questions: ' || n", "'- cost in dollars: ' || cost // 10000 || '.' || lpad(CAST(cost % 10000 AS VARCHAR), 4, '0')", "'- tokens read: ' || tin", "'- tokens written: ' || tout", "'- milliseconds: ' || ms"]
    row = lambda name, c: f"'| {name} | ' || {c} || ' | ' || ({c} * 200 + n) // (n * 2) || ' |'"
    heads = ["'## Verdicts'", "'| verdict | answers | % |'", "'|-|-:|-:|'", *[row(v, f'"{v}"') for v in verdicts], row("keywords found", "kw")]
    lines = lambda section, made, source: " UNION ALL ".join(f"SELECT {section} AS section, '{i:03d}' AS place, {x} AS line{source}" for i, x in enumerate(made))
    parts = [lines(1, totals, " FROM a"), lines(2, heads, " FROM a")]
    for section, name in ((3, "route"), (4, "category")):
        parts.append(lines(section, [f"'## By {name}'", f"'| {name} | n | correct | keywords | mean score |'", "'|-|-:|-:|-:|-:|'"], ""))
        parts.append(f"SELECT {section}, '1' || {name}, '| ' || {name} || ' | ' || n || ' | ' || c || ' | ' || kw || ' | ' || m // 1000 || '.' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') || ' |' FROM (SELECT {name}, count(*) AS n, CAST(sum(CAST(verdict = 'correct' AS INT)) AS BIGINT) AS c, CAST(sum(CAST(kp AS INT)) AS BIGINT) AS kw, CAST((sum(milli) * 2 + count(*)) // (count(*) * 2) AS BIGINT) AS m FROM g GROUP BY {name})")
    parts.append("SELECT 6, '1' || lpad(CAST(doc_id AS VARCHAR), 20, '0'), '| ' || doc_id || ' | ' || route || ' | ' || verdict || ' | ' || milli // 1000 || '.' || lpad(CAST(milli % 1000 AS VARCHAR), 3, '0') || ' | ' || CASE WHEN kp THEN 'yes' ELSE 'no' END || ' | ' || size * 2 || ' |' FROM g")
    return f"""WITH s AS (SELECT doc_id, coalesce(lang, '?') AS route, coalesce(source, '?') AS category, quality * 750 + toxic * 250 AS milli, toxic = 0 AS kp, coalesce(length(text), 0) AS size FROM documents JOIN labels USING (doc_id)),
g AS (SELECT *, CASE WHEN milli >= 850 THEN 'correct' WHEN milli >= 500 THEN 'partial' WHEN milli >= 200 THEN 'unsupported' ELSE 'incorrect' END AS verdict FROM s),
a AS (SELECT count(*) AS n, {sums}, CAST(sum(CAST(kp AS INT)) AS BIGINT) AS kw, CAST(sum(size) AS BIGINT) AS cost, CAST(sum(size) AS BIGINT) AS tin, CAST(sum(size % 7) AS BIGINT) AS tout, CAST(sum(size * 2) AS BIGINT) AS ms FROM g)
{" UNION ALL ".join(parts)}"""


def _shown(spark, sf_dir):
    """Orders as questions; those with more than 4 line items are on show."""
    o, i = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    asked = o.select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string"))).alias("sql"))
    held = i.groupBy(F.col("l_orderkey").alias("idx")).agg(F.count("*").alias("n"))
    shown = held.select("idx", F.when(F.col("n") > 4, F.array(F.lit("n"))).alias("sql_cols"), F.array(F.array(F.col("n").cast("string"))).alias("sql_rows"))
    return reuse_shown(asked, shown).select("idx", "sql", F.col("sql_rows")[0][0].alias("value"), "rerun")


def _durations(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return e.select("user_id", iso_seconds(iso("a"), F.when(F.col("n") % 5 > 0, iso("b")).otherwise("not yet")).alias("seconds"), display_words(F.col("n")).alias("words"))


QUERIES = {
    "eval_report": (_report, _report_sql()),
    "showcase_reuse": (
        _shown,
        "SELECT o_orderkey AS idx, CASE WHEN o_orderstatus <> 'O' THEN 'SELECT ' || o_orderkey END AS sql, CASE WHEN n > 4 THEN CAST(n AS VARCHAR) END AS value, coalesce(o_orderstatus <> 'O', false) AND coalesce(n, 0) <= 4 AS rerun FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    ),
    "iso_durations": (
        _durations,
        "SELECT user_id, CASE WHEN n % 5 > 0 THEN CAST(date_diff('second', date_trunc('second', a), date_trunc('second', b)) AS DOUBLE) END AS seconds, (n * 3 + 2) // 4 AS words FROM (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY 1)",
    ),
}
