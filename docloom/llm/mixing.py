"""Operator 7: mix sources to target weights within a word budget.

Every document gets a hash-random key (the MD5 of its doc_id and its text's MD5, so that rows that share
an id, or have none, lie apart too). Documents of a source are taken in the
order of their keys until the source's budget is spent; what a budget has beyond the source's size
repeats it as further epochs. The order is a range sort dealt out by the leading digits of the key:
a prefix sum over the ranges of a source, then one within each range, so that a source with a third of
all rows is spread over all tasks and no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import n_words, stash, table

#: Hexadecimal digits of the key that make up a range: 4096 ranges for each source.
RANGE_DIGITS = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size) -> also weight and target.

    The sources share `share` times all sizes by weight, none above `most` times its own size; what is
    beyond that is shared again among the rest by weight. Sources are first filled that reach their
    bound at the lowest level of budget per weight; the others then share what is left. One row per
    source, so the windows here are over that short list. Sources of size 0 get 0.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("weight", weight)
    df = df.withColumn("filled", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)))
    df = df.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    df = df.withColumn("rest", F.sum("source_size").over(everything) * F.lit(share) - F.col("filled"))
    df = df.withColumn("bound", F.col("rest") / F.col("rest_weight") * F.col("weight") >= F.lit(most) * F.col("source_size"))
    open_ = F.row_number().over(level)
    df = df.withColumn("place", open_)
    first = F.min(F.when(~F.col("bound"), F.struct("place", "rest", "rest_weight"))).over(everything)
    df = df.withColumn("first", first)
    return df.select(
        "source", "source_size", "weight",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), (F.lit(most) * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.rest") / F.col("first.rest_weight") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, size: Column, key: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with columns source and those in `key` -> size, source_size, target, taken for every row.

    taken = whole epochs of the source's budget times size, and of the last epoch what the document's
    place in the source's order leaves it: all, nothing, or for the one at the cut a part of it.
    Rows with one key and one size are interchangeable. A null source is a source of its own. Extra
    columns stay; the names size, source_size, target and taken are overwritten.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    rows = docs.drop("size", "source_size", "target", "taken").withColumns({"size": size, "__key": digest, "__range": F.substring(digest, 1, RANGE_DIGITS)})
    ranges = stash(rows.groupBy("source", "__range").agg(F.sum("size").alias("range_size")), "ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    starts = ranges.withColumn("start", F.sum("range_size").over(Window.partitionBy("source").orderBy("__range")) - F.col("range_size"))
    starts = starts.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        F.col("s.source").alias("__source"), F.col("__range").alias("__r"), "start", "source_size", "target"
    )
    within = Window.partitionBy("source", "__range").orderBy("__key", "size")
    joined = rows.withColumn("__before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = joined.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target")) - epochs * F.col("source_size") - F.col("start") - F.col("__before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.withColumn("taken", taken.cast("long")).drop("__key", "__range", "__before", "__source", "__r", "start")


def identity(doc_id: Column, text: Column) -> Column:
    """What a row's key is made of."""
    return F.concat_ws("/", doc_id.cast("string"), F.md5(text))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each whole repeat, and one with the first words for the part at the cut. Documents of which nothing is taken go, as do columns that documents does not have.

    Rows are numbered when they are written once more, so that rows alike in all columns each take their own words.
    """
    numbered = stash(docs.select("doc_id", "text", "lang", "source").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    # sizes and decisions travel without the texts
    small = stash(numbered.select("__row", "source", n_words(F.col("text")).alias("__n"), identity(F.col("doc_id"), F.col("text")).alias("__id")), "sizes")
    taken = mix(small, F.col("__n"), F.col("__id")).where("taken > 0").select("__row", "size", "taken")
    rows = numbered.join(taken, "__row")
    part = (F.col("taken") % F.col("size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    whole = F.array_repeat(F.col("text"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rows = rows.withColumn("text", F.explode(F.when(part > 0, F.concat(whole, F.array(F.array_join(F.slice(words, 1, part), "")))).otherwise(whole)))
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, mixed; sizes are word counts, a null text has size 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"), identity(F.col("doc_id"), F.col("text")).alias("id"))
    return mix(stash(docs, "sizes"), F.col("words"), F.col("id")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('/', CAST(doc_id AS VARCHAR), md5(text))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (
  SELECT *, row_number() OVER lv AS place,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w WINDOW lv AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT place AS p, rest AS r, rest_weight AS rw FROM l WHERE rest / rest_weight * weight < 2 * source_size ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN p IS NULL OR place < p THEN CAST(2 * source_size AS DOUBLE) ELSE r / rw * weight END AS target
  FROM l LEFT JOIN f ON true),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before FROM d)
SELECT o.doc_id, o.size, t.source_size, t.target,
       CAST(e * o.size + greatest(0, least(o.size, floor(t.target) - e * t.source_size - o.before)) AS BIGINT) AS taken
FROM o JOIN (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS e FROM t) t
  ON o.source IS NOT DISTINCT FROM t.source
"""
