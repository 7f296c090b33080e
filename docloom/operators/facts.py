"""Facts with quotes: extraction by rule, validation against the cited chunk, and matching to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import SPACES_SQL, holds_quote, normalised
from docloom.operators.retrieval import dense_top

#: A line of the form "label: value" is a fact.
FACT_LINE = r"(?m)^([A-Za-z][A-Za-z0-9 ]{2,40}): +([^\n]{1,200})$"


def extract(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, label, value, type, quote, confidence) of every "label: value" line; its quote is the line."""
    found = chunks.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(FACT_LINE), F.lit(0))).alias("pos", "quote"))
    label, value = F.regexp_extract("quote", FACT_LINE, 1), F.trim(F.regexp_extract("quote", FACT_LINE, 2))
    kind = F.when(value.rlike(r"^[₱$€£¥]"), "currency").when(value.rlike(r"^[+-]?[\d,]+(\.\d+)?%?$"), "number").when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(value.contains(", "), "list").otherwise("text")
    return found.select(key, F.col("pos").cast("long"), label.alias("label"), value.alias("value"), kind.alias("type"), "quote", F.lit(1.0).alias("confidence"))


def validate(facts: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Facts with `accepted` and a reason: the cited chunk is there, and has the quote whatever the case and white space. One fact, one row."""
    cited = facts.join(chunks.select(key, F.col(text).alias("__text")).withColumn("__found", F.lit(True)), key, "left")
    reason = F.when((F.coalesce("label", F.lit("")) == "") | (F.coalesce("quote", F.lit("")) == ""), "missing_field").when(F.col("__found").isNull(), "unknown_chunk").when(holds_quote(F.col("__text"), F.col("quote")), "ok").otherwise("quote_not_found")
    return cited.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok").drop("__text", "__found")


#: The filter of asked keys has 64 bits in each of so many rows, 2 MB at most whatever is asked.
SLOTS = 1 << 16
#: Characters of a short quote's longest word by which it is looked up.
GRAM = 4


def _shared(asked: DataFrame, keys: DataFrame, quote_id: str, key: str) -> DataFrame:
    """(quote_id, key) of equal `run`. Most of the texts' runs are asked by nobody: a filter of bits, sent to all tasks, keeps these out of the shuffle."""
    slot, bit = F.pmod("run", F.lit(SLOTS)).cast("int"), F.shiftrightunsigned("run", 58).cast("int")
    bits = asked.select(slot.alias("slot"), F.expr("shiftleft(1L, CAST(shiftrightunsigned(run, 58) AS INT))").alias("b")).groupBy("slot").agg(F.bit_or("b").alias("mask"))
    near = keys.withColumns({"slot": slot, "bit": bit}).join(F.broadcast(bits), "slot").where(F.getbit("mask", "bit") == 1).select(key, "run")
    return asked.select(quote_id, "run").join(near, "run").select(quote_id, key)


def quote_places(chunks: DataFrame, quotes: DataFrame, quote_id: str = "item_id", key: str = "doc_id", quote: str = "text", width: int = 5) -> DataFrame:
    """(quote_id, key) of every chunk that has a quote. A quote's first words choose the chunks that are looked at, so no pair is formed without them in common.

    A quote's first word may be the end of a longer word of the chunk, and its last the beginning of one, as
    in a substring search: the words between must be equal, so the key is of the inner words where there are enough.
    Shorter quotes are looked up by the first characters of their longest word, which stand within one of the chunk's words.
    """
    asked = quotes.select(quote_id, normalised(F.col(quote)).alias("q")).where("q <> ''").withColumn("w", F.split("q", " "))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    # hashes: equal texts are compared in full below
    asked = asked.withColumn("enough", F.size("w") > width + 1).withColumn("run", F.when(F.col("enough"), F.xxhash64(F.slice("w", 2, width))).otherwise(F.xxhash64(F.substring(longest, 1, GRAM))))
    texts = chunks.select(key, normalised(F.col("text")).alias("t"))
    words = texts.withColumn("w", F.split("t", " "))
    runs = words.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, width))))).alias("run"))
    # a look ahead takes a word's runs of characters in one pass, however long the word is
    grams = F.flatten(F.array(*[F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]))
    parts = words.select(key, F.explode(F.array_distinct("w")).alias("word")).select(key, F.explode(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))).alias("run"))
    hits = _shared(asked.where("enough"), runs, quote_id, key).union(_shared(asked.where("NOT enough"), parts, quote_id, key)).distinct()
    return hits.join(asked.select(quote_id, "q"), quote_id).join(texts, key).where(F.contains("t", F.col("q"))).select(quote_id, key)


def match_questions(questions: DataFrame, facts: DataFrame, least: float = DEFAULT.fact_least) -> DataFrame:
    """(question_id, fact_id, score): for each question (question_id, vector) the fact (fact_id, vector) with the highest dot product, if that reaches the least; the first of equal ones."""
    best = dense_top(facts, questions.where("vector IS NOT NULL"), 1, "question_id", "fact_id", "vector", digits=9)
    return best.where(F.col("score") >= least).select("question_id", "fact_id", "score")


def by_type(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.coalesce("type", F.lit("text")).alias("type")).agg(F.count("*").alias("facts"))


def block(label: Column, value: Column, quote: Column) -> Column:
    """A fact as context for an answer."""
    return F.concat(label, F.lit(": "), value, F.lit(' (source: "'), quote, F.lit('")'))


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _claims(spark, sf_dir):
    """Each benchmark passage as a claim about the document with its number."""
    b = _t(spark, sf_dir, "benchmark")
    claims = b.select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("label"), F.col("text").alias("quote"))
    return validate(claims.withColumn("label", F.col("label").cast("string")), _t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "accepted", "reason")



def _order_forms(spark, sf_dir):
    """Each order as a form of lines with labels, and one line without."""
    o = _t(spark, sf_dir, "orders")
    lines = ["Order form", F.concat(F.lit("Order key: "), F.col("o_orderkey").cast("string")), F.concat(F.lit("Total price:  $ "), F.round("o_totalprice").cast("long").cast("string")), F.concat(F.lit("Order date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Status: "), "o_orderstatus"), F.concat(F.lit("Marks: "), "o_orderstatus", F.lit(", "), "o_orderpriority"), "no: label, too short"]
    return o.select("o_orderkey", F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("text"))


_FORMS_SQL = """SELECT o_orderkey, concat_ws(chr(10), 'Order form', 'Order key: ' || o_orderkey, 'Total price:  $ ' || CAST(round(o_totalprice) AS BIGINT), 'Order date: ' || strftime(o_orderdate, '%Y-%m-%d'), 'Status: ' || o_orderstatus, 'Marks: ' || o_orderstatus || ', ' || o_orderpriority, 'no: label, too short') AS text FROM orders"""


def _norm(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '{SPACES_SQL}', ' ', 'g'))"


QUERIES = {
    "quote_validation": (
        lambda s, d: quote_places(_t(s, d, "documents").select("doc_id", "text"), _t(s, d, "benchmark")),
        f"SELECT item_id, doc_id FROM (SELECT item_id, {_norm("text")} AS q FROM benchmark) b JOIN (SELECT doc_id, {_norm("text")} AS t FROM documents) d ON contains(t, q) WHERE q <> ''",
    ),
    "fact_validation": (
        _claims,
        f"""SELECT item_id AS doc_id, reason = 'ok' AS accepted, reason FROM (SELECT item_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_chunk' WHEN contains({_norm("d.text")}, {_norm("b.text")}) THEN 'ok' ELSE 'quote_not_found' END AS reason
FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id)""",
    ),
    "fact_types": (
        lambda s, d: by_type(extract(_order_forms(s, d), "o_orderkey")),
        rf"""WITH f AS (SELECT trim(regexp_extract(q, '{FACT_LINE}', 2)) AS v FROM (SELECT unnest(regexp_extract_all(text, '{FACT_LINE}')) AS q FROM ({_FORMS_SQL})))
SELECT CASE WHEN regexp_matches(v, '^[₱$€£¥]') THEN 'currency' WHEN regexp_matches(v, '^[+-]?[\d,]+(\.\d+)?%?$') THEN 'number' WHEN regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'date' WHEN contains(v, ', ') THEN 'list' ELSE 'text' END AS type, count(*) AS facts FROM f GROUP BY 1""",
    ),
    "fact_lines": (
        lambda s, d: extract(_order_forms(s, d), "o_orderkey").where("type <> 'text'").select("o_orderkey", "pos", "label", "value", "type"),
        """SELECT o_orderkey, 0::BIGINT AS pos, 'Order key' AS label, CAST(o_orderkey AS VARCHAR) AS value, 'number' AS type FROM orders
UNION ALL SELECT o_orderkey, 1, 'Total price', '$ ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR), 'currency' FROM orders
UNION ALL SELECT o_orderkey, 2, 'Order date', strftime(o_orderdate, '%Y-%m-%d'), 'date' FROM orders
UNION ALL SELECT o_orderkey, 4, 'Marks', o_orderstatus || ', ' || o_orderpriority, 'list' FROM orders""",
    ),
}
