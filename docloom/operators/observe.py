"""Costs, turns, scorecards, evaluation, confidence of an extraction, and what the stores hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import estimated_tokens, keyword_grade
from docloom.operators.chunking import EST, W

#: Prices are whole cents for a million tokens; sums stay whole in these units, so no rounding depends on the order of a sum.
UNITS = 1e8


def _cents(price: float) -> Column:
    return F.lit(round(price * 100)).cast("long")


def cost_units(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column) -> Column:
    """A call's cost in 1e-8 dollars."""
    d = DEFAULT
    return input_tokens * _cents(d.price_input) + output_tokens * _cents(d.price_output) + cache_write * _cents(d.price_cache_write) + cache_read * _cents(d.price_cache_read)


def job_cost(usage: DataFrame, by: list[str]) -> DataFrame:
    """(by…, input, output, cache_write, cache_read, embedding, wall_ms) summed: cost, the cost without a cache, and the share saved.

    usage: provider (llm or embedding), tokens_in, tokens_out, cache_write, cache_read, duration_ms. The
    provider decides the price, not the stage's name.
    """
    llm, none = F.col("provider") == "llm", F.lit(0)
    total = lambda c, name: F.sum(F.when(llm, F.coalesce(c, none)).otherwise(none)).cast("long").alias(name)
    out = usage.groupBy(*by).agg(
        total("tokens_in", "input_tokens"), total("tokens_out", "output_tokens"), total("cache_write", "cache_write_tokens"), total("cache_read", "cache_read_tokens"),
        F.sum(F.when(F.col("provider") == "embedding", F.coalesce("tokens_in", none)).otherwise(none)).cast("long").alias("embedding_tokens"), F.sum(F.coalesce("duration_ms", none)).cast("long").alias("wall_ms"),
    )
    embed = F.col("embedding_tokens") * _cents(DEFAULT.price_embedding)
    spent = cost_units(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_write_tokens"), F.col("cache_read_tokens")) + embed
    plain = cost_units(F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens"), F.col("output_tokens"), none, none) + embed
    out = out.withColumns({"cost": spent / F.lit(UNITS), "cost_without_cache": plain / F.lit(UNITS)})
    return out.withColumn("saved_percent", F.round(F.coalesce(F.try_divide((F.col("cost_without_cache") - F.col("cost")) * 100, F.col("cost_without_cache")), F.lit(0.0)), 1))


def cache_hit_ratio(cache_read: Column, input_tokens: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(cache_read.cast("double"), cache_read + input_tokens), F.lit(0.0)), 3)


def attribute_turns(calls: DataFrame, turn: list[str], order: str, metrics: list[str]) -> DataFrame:
    """A turn's metrics on its first call; zeros on the others."""
    first = F.row_number().over(Window.partitionBy(*turn).orderBy(order)) == 1
    return calls.withColumn("first_in_turn", first).withColumns({m: F.when(F.col("first_in_turn"), F.col(m)).otherwise(F.lit(0)) for m in metrics})


def running(turns: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Running total of a column over the turns."""
    return turns.withColumn(f"cumulative_{column}", F.sum(column).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def scorecard(measures: DataFrame) -> DataFrame:
    """(metric, pipeline, value, lower_is_better) of two pipelines -> (metric, a, b, winner, bar_a, bar_b); no winner of a tie or where one is missing; bars in percent of the larger, 2 at least."""
    wide = measures.groupBy("metric").agg(F.max(F.when(F.col("pipeline") == "a", F.col("value"))).alias("a"), F.max(F.when(F.col("pipeline") == "b", F.col("value"))).alias("b"), F.bool_or("lower_is_better").alias("low"))
    winner = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b")), F.lit(None).cast("string")).when((F.col("a") < F.col("b")) == F.col("low"), "a").otherwise("b")
    bar = lambda c: F.greatest(F.lit(2.0), F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.greatest("a", "b")), F.lit(0.0)), 0)).alias(f"bar_{c}")
    return wide.select("metric", "a", "b", winner.alias("winner"), bar("a"), bar("b"))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.85, "correct").when(score >= 0.50, "partial").when(score >= 0.20, "unsupported").otherwise("incorrect")


def eval_rollup(graded: DataFrame) -> DataFrame:
    """(route, category, score, keyword_pass) -> by route, by category and in all: n, correct, keyword passes, mean score."""
    out = graded.groupingSets([["route"], ["category"], []], "route", "category").agg(
        F.count("*").alias("n"), F.sum((verdict(F.col("score")) == "correct").cast("long")).alias("correct"), F.sum(F.col("keyword_pass").cast("long")).alias("keyword_passes"), F.round(F.avg("score"), 3).alias("avg_score"), F.grouping_id().alias("level")
    )
    kind = F.when(F.col("level") == 1, "route").when(F.col("level") == 2, "category").otherwise("all")
    return out.select(kind.alias("level"), F.coalesce("route", "category", F.lit("all")).alias("value"), "n", "correct", "keyword_passes", "avg_score")


def routing_summary(answers: DataFrame, route: str = "route") -> DataFrame:
    """(kind, answers): by route; what took more than one (joined by +) is hybrid, none is vector."""
    kind = F.when(F.contains(F.col(route), F.lit("+")), "hybrid").otherwise(F.coalesce(F.nullif(route, F.lit("")), F.lit("vector")))
    return answers.groupBy(kind.alias("kind")).agg(F.count("*").alias("answers"))


def answer_totals(answers: DataFrame) -> DataFrame:
    """(answers, tokens_in, tokens_out, cost to 6 places, avg_score to 3, correct, partial, unsupported, incorrect) over answers (tokens_in, tokens_out, cost, score); without a score none of the verdicts."""
    said = F.when(F.col("score").isNotNull(), verdict(F.col("score")))
    count = lambda name: F.count(F.when(said == name, 1)).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return answers.agg(
        F.count("*").alias("answers"), total("tokens_in"), total("tokens_out"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"), F.round(F.avg("score"), 3).alias("avg_score"), *map(count, ("correct", "partial", "unsupported", "incorrect"))
    )


def usage_summary(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by…, calls, tokens, cost): a turn's own measures (turn_tokens, turn_cost) count before the call's (tokens, cost), and a tool's cost is added."""
    tokens, cost = F.coalesce("turn_tokens", "tokens", F.lit(0)), F.coalesce("turn_cost", "cost", F.lit(0.0)) + F.coalesce("tool_cost", F.lit(0.0))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(tokens).cast("long").alias("tokens"), F.sum(cost).alias("cost"))


def stage_costs(usage: DataFrame, by: list[str], stage: str = "stage") -> DataFrame:
    """The rollup of a job stage by stage, in the order of the numbers that the stages' keys end in; the wall time is from the first start to the last end where usage has started and ended, else the sum of durations."""
    rows = job_cost(usage, [*by, stage]).withColumn("place", F.coalesce(F.regexp_extract(stage, r"(\d+)$", 1).try_cast("int"), F.lit(0)))
    if {"started", "ended"} <= set(usage.columns):
        spans = usage.groupBy(*by, stage).agg((F.unix_millis(F.max("ended")) - F.unix_millis(F.min("started"))).alias("span"))
        rows = rows.join(spans, [*by, stage]).withColumn("wall_ms", F.coalesce("span", "wall_ms")).drop("span")
    return rows


def extraction_confidence(parser: Column, words: Column, tables: Column, headings: Column) -> tuple[Column, Column]:
    """How much an extraction can be trusted, by parser, words and structure; and its tier."""
    reliability = F.when(parser == "native", 0.95).when(parser == "office", 0.95).when(parser == "unified", 0.9).when(parser == "vision", 0.75).otherwise(0.6)
    size = F.when(words >= 1000, 1.0).when(words >= 300, 0.85).when(words >= 50, 0.6).otherwise(0.2)
    structure = F.when((tables > 0) & (headings > 0), 1.0).when((tables > 0) | (headings > 0), 0.8).otherwise(0.5)
    score = F.round(0.45 * reliability + 0.35 * size + 0.20 * structure, 3)
    return score, F.when(score >= 0.85, "High").when(score >= 0.65, "Medium").otherwise("Low")


def storage_survey(stores: dict[str, DataFrame], chars: bool = False) -> DataFrame:
    """(store, rows) of every store, and with `chars` the characters of its text columns."""
    out = None
    for name, df in stores.items():
        texts = [F.coalesce(F.length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        size = F.coalesce(F.sum(reduce(lambda a, b: a + b, texts)), F.lit(0)).cast("long") if texts else F.lit(0).cast("long")
        one = df.agg(F.count("*").alias("rows"), *([size.alias("chars")] if chars else [])).withColumn("store", F.lit(name))
        one = one.select("store", "rows", *(["chars"] if chars else []))
        out = one if out is None else out.unionByName(one)
    return out


def breakdown(chunks: DataFrame, kind: str, sample: Column, k: int = 3) -> DataFrame:
    """(kind, n, samples): rows by kind (null is prose), with the first k samples by order."""
    named = chunks.select(F.coalesce(kind, F.lit("prose")).alias("kind"), sample.alias("sample"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("sample"))).where(F.col("r") <= k)
    held = first.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list(F.col("sample").cast("string"))), ",").alias("samples"))
    return named.groupBy("kind").agg(F.count("*").alias("n")).join(held, "kind")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark, sf_dir):
    """Conversations as model calls: a user's or tool's text is read, an assistant's written; every third turn reads from the cache."""
    n = estimated_tokens(F.col("text"))
    written, cached = F.col("role") == "assistant", (F.col("turn") % 3 == 2) & (F.col("role") != "assistant")
    zero = F.lit(0).cast("long")
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", n.alias("tokens"), F.when(F.col("role") == "system", "embedding").otherwise("llm").alias("provider"),
        F.when(~written & ~cached, n).otherwise(zero).alias("tokens_in"), F.when(written, n).otherwise(zero).alias("tokens_out"), zero.alias("cache_write"), F.when(cached, n).otherwise(zero).alias("cache_read"), (n * 3).alias("duration_ms"),
    )


def _ab(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("pipeline", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    held = e.groupBy("event_type", "pipeline").agg(F.round(F.avg("value"), 4).alias("value"))
    return scorecard(held.select(F.col("event_type").alias("metric"), "pipeline", "value", (F.col("event_type") != "purchase").alias("lower_is_better")))


def _eval(spark, sf_dir):
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")
    return eval_rollup(j.select(F.col("lang").alias("route"), F.col("source").alias("category"), (F.col("quality") * 0.9 + F.col("toxic") * 0.05).alias("score"), (F.col("toxic") == 0).alias("keyword_pass")))


KEYWORDS = ["the", "two", "please", "10"]


def _grade(spark, sf_dir):
    ok, missing = keyword_grade(F.col("text"), F.array(*map(F.lit, KEYWORDS)))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", ok.alias("keyword_pass"), F.array_join(missing, ",").alias("missing"))


_N = EST.format(f"len({W})")
_TURN_SQL = f"""WITH t AS (SELECT conv_id, turn, role, {_N} AS tokens FROM conversations),
u AS (SELECT *, CASE WHEN role = 'system' THEN 'embedding' ELSE 'llm' END AS provider, turn % 3 = 2 AND role <> 'assistant' AS cached FROM t)
"""
_DIGITS = "lower(text)"
for _w, _d in (("zero", 0), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10), ("eleven", 11), ("twelve", 12)):
    _DIGITS = f"replace({_DIGITS}, '{_w}', '{_w} {_d}')"
QUERIES = {
    "job_cost_rollup": (
        lambda s, d: job_cost(_turns(s, d), ["conv_id"]),
        _TURN_SQL
        + """, a AS (SELECT conv_id, CAST(sum(CASE WHEN provider = 'llm' AND role <> 'assistant' AND NOT cached THEN tokens ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN provider = 'llm' AND role = 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS output_tokens,
0::BIGINT AS cache_write_tokens, CAST(sum(CASE WHEN provider = 'llm' AND cached THEN tokens ELSE 0 END) AS BIGINT) AS cache_read_tokens, CAST(sum(CASE WHEN provider = 'embedding' AND NOT cached THEN tokens ELSE 0 END) AS BIGINT) AS embedding_tokens, CAST(sum(tokens * 3) AS BIGINT) AS wall_ms FROM u GROUP BY conv_id),
b AS (SELECT *, (input_tokens * 80 + output_tokens * 400 + cache_read_tokens * 8 + embedding_tokens * 13) / 1e8::DOUBLE AS cost, ((input_tokens + cache_read_tokens) * 80 + output_tokens * 400 + embedding_tokens * 13) / 1e8::DOUBLE AS cost_without_cache FROM a)
SELECT *, round(CASE WHEN cost_without_cache = 0 THEN 0 ELSE (cost_without_cache - cost) * 100 / cost_without_cache END, 1) AS saved_percent FROM b""",
    ),
    "turn_attribution": (
        lambda s, d: attribute_turns(_turns(s, d), ["conv_id", "role"], "turn", ["tokens"]).select("conv_id", "turn", "role", "first_in_turn", "tokens"),
        _TURN_SQL + "SELECT conv_id, turn, role, f AS first_in_turn, CASE WHEN f THEN tokens ELSE 0 END AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS f FROM u)",
    ),
    "cumulative_tokens": (lambda s, d: running(_turns(s, d), "conv_id", ["turn", "role"], "tokens").select("conv_id", "turn", "role", "tokens", "cumulative_tokens"), _TURN_SQL + "SELECT conv_id, turn, role, tokens, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_tokens FROM u"),
    "cache_hit_ratio": (
        lambda s, d: _turns(s, d).groupBy("role").agg(F.sum("cache_read").alias("r"), F.sum("tokens_in").alias("i")).select("role", cache_hit_ratio(F.col("r"), F.col("i")).alias("ratio")),
        _TURN_SQL + "SELECT role, round(CASE WHEN sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) = 0 THEN 0 ELSE sum(CASE WHEN cached THEN tokens ELSE 0 END) / sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END)::DOUBLE END, 3) AS ratio FROM u GROUP BY role",
    ),
    "ab_scorecard": (
        _ab,
        """WITH m AS (SELECT event_type AS metric, round(avg(value) FILTER (user_id % 2 = 0), 4) AS a, round(avg(value) FILTER (user_id % 2 = 1), 4) AS b FROM events GROUP BY 1)
SELECT metric, a, b, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN NULL WHEN (a < b) = (metric <> 'purchase') THEN 'a' ELSE 'b' END AS winner,
greatest(2.0::DOUBLE, round(coalesce(a * 100.0::DOUBLE / nullif(greatest(a, b), 0), 0), 0)) AS bar_a, greatest(2.0::DOUBLE, round(coalesce(b * 100.0::DOUBLE / nullif(greatest(a, b), 0), 0), 0)) AS bar_b FROM m""",
    ),
    "eval_rollup": (
        _eval,
        """WITH g AS (SELECT lang AS route, source AS category, quality * 0.9::DOUBLE + toxic * 0.05::DOUBLE AS score, toxic = 0 AS kp FROM labels JOIN documents USING (doc_id)),
r AS (SELECT route, category, grouping(route, category) AS l, count(*) AS n, CAST(sum(CAST(score >= 0.85 AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(kp AS INT)) AS BIGINT) AS keyword_passes, round(avg(score), 3) AS avg_score FROM g GROUP BY GROUPING SETS ((route), (category), ()))
SELECT CASE l WHEN 1 THEN 'route' WHEN 2 THEN 'category' ELSE 'all' END AS level, coalesce(route, category, 'all') AS value, n, correct, keyword_passes, avg_score FROM r""",
    ),
    "keyword_grade": (
        _grade,
        f"""WITH g AS (SELECT conv_id, turn, lower(text) AS t, {_DIGITS} AS x FROM conversations), m AS (SELECT conv_id, turn, list_filter([{', '.join(repr(k) for k in KEYWORDS)}], lambda k: NOT (contains(x, k) OR contains(t, k))) AS m FROM g)
SELECT conv_id, turn, len(m) = 0 AS keyword_pass, array_to_string(m, ',') AS missing FROM m""",
    ),
    "chunk_type_breakdown": (
        lambda s, d: breakdown(_t(s, d, "documents"), "source", F.col("doc_id")),
        "WITH r AS (SELECT coalesce(source, 'prose') AS kind, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT kind, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (r <= 3) AS samples FROM r GROUP BY kind",
    ),
    "storage_survey": (
        lambda s, d: storage_survey({n: _t(s, d, n) for n in ("documents", "embeddings", "pages", "benchmark", "conversations", "events")}),
        " UNION ALL ".join(f"SELECT '{n}' AS store, count(*) AS rows FROM {n}" for n in ("documents", "embeddings", "pages", "benchmark", "conversations", "events")),
    ),
}
