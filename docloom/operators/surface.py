"""Queries of the expressions and small operators that other modules define, over whole tables, with SQL worded from their rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import mime, numeric, text
from docloom.operators import graph, observe, relational, tables
from docloom.operators.chunking import _WINDOWS_SQL, OVERLAP, WIDTH, W, table_chunks, windows, with_ids
from docloom.operators.graph import MENTION_SQL, mentions
from docloom.operators.quality import _PAGES
from docloom.sources import html, sheets
from docloom.streaming.events import progress


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, *choices):
    """One of some columns, by a key."""
    return F.element_at(F.array(*choices), (F.col(key) % len(choices) + 1).cast("int"))


# Files: documents as contents of seven kinds.
def _formats(spark, sf_dir):
    said = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    head = lambda b: F.concat(F.lit(bytearray(b)), said)
    content = _pick("doc_id", head(b"%PDF-1.4 /Font "), head(b"%PDF-1.4 "), head(b"PK\x03\x04"), head(b" <!DOCTYPE html>"), said, said, head(b"\xd0\xcf\x11\xe0"))
    name = _pick("doc_id", *[F.lit(x) for x in ("a.pdf", "b.bin", "c.docx", "d.txt", "e.csv", "f", "g.xls")])
    df = _t(spark, sf_dir, "documents").select("doc_id", content.alias("content"), name.alias("path")).withColumn("mime", mime.mime(F.col("content"), F.col("path")))
    return df.select("doc_id", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "mime", mime.sub_structure(F.col("mime"), F.col("content")).alias("sub_structure"), mime.encoding(F.col("mime"), F.col("content")).alias("encoding"), mime.mime_by_name(F.col("path")).alias("by_name"))


_FORMATS_SQL = r"""WITH c AS (SELECT doc_id, doc_id % 7 AS k, encode(coalesce(text, '')) AS t FROM documents),
b AS (SELECT doc_id, k, CASE k WHEN 0 THEN '%PDF-1.4 /Font '::BLOB || t WHEN 1 THEN '%PDF-1.4 '::BLOB || t WHEN 2 THEN 'PK\x03\x04'::BLOB || t WHEN 3 THEN ' <!DOCTYPE html>'::BLOB || t WHEN 6 THEN '\xD0\xCF\x11\xE0'::BLOB || t ELSE t END AS content FROM c)
SELECT doc_id, octet_length(content) AS size_bytes, sha256(content) AS sha256,
['application/pdf', 'application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/html', 'text/csv', 'text/plain', 'application/vnd.ms-excel'][k + 1] AS mime,
['text-native-pdf', 'scanned-pdf', 'docx-document', 'html-document', 'plain-text', 'plain-text', 'spreadsheet-xlsx'][k + 1] AS sub_structure,
['pdf-internal', 'pdf-internal', 'utf-8', 'utf-8', 'utf-8', 'utf-8', 'unknown'][k + 1] AS encoding,
['application/pdf', 'application/octet-stream', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/plain', 'application/octet-stream', 'application/octet-stream', 'application/octet-stream'][k + 1] AS by_name FROM b"""


def _languages(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


def _languages_sql() -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS {name}" for name, words in text.STOPWORDS.items())
    names = list(text.STOPWORDS)
    most = f"greatest({', '.join(names)})"
    return f"""WITH h AS (SELECT doc_id, trim(substring(text, 1, 8192)) AS h FROM documents), s AS (SELECT doc_id, h, string_split(lower(regexp_replace(h, '[^\\p{{L}}]+', ' ', 'g')), ' ') AS w FROM h), c AS (SELECT doc_id, h, {counts} FROM s)
SELECT doc_id, CASE WHEN coalesce(length(h), 0) <= 50 OR {most} = 0 THEN 'unknown' {" ".join(f"WHEN {n} = {most} THEN '{n}'" for n in names)} END AS language FROM c"""


# Tables as text: the nations of a region, every third row short and every fifth long.
def _nation_tables(spark, sf_dir):
    row = F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name")).when(F.col("n_nationkey") % 5 == 0, F.array("n_name", F.col("n_nationkey").cast("string"), F.lit("more"))).otherwise(F.array("n_name", F.col("n_nationkey").cast("string")))
    held = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    return held.select("n_regionkey", F.array(F.lit("name"), F.lit("key")).alias("headers"), F.transform("x", lambda x: x["r"]).alias("rows"))


def _table_texts(spark, sf_dir):
    h, r = F.col("headers"), F.col("rows")
    told = _nation_tables(spark, sf_dir).join(_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left")
    return told.select("n_regionkey", sheets.markdown(h, r).alias("markdown"), F.array_join(sheets.json_rows(h, r), "\n").alias("json"), sheets.summary_text(F.lit("t"), F.col("r_name"), h, r).alias("summary"))


_TABLE_TEXTS_SQL = """WITH n AS (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END AS k, n_nationkey % 3 <> 0 AND n_nationkey % 5 = 0 AS long, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || coalesce(string_agg(chr(10) || '| ' || n_name || ' | ' || k || ' |', '' ORDER BY n_nationkey) FILTER (r <= 25), '') AS markdown,
string_agg('{"name":"' || n_name || '","key":"' || k || '"}', chr(10) ORDER BY n_nationkey) FILTER (r <= 25) AS json,
'Table summary: ' || any_value(r_name) || chr(10) || 'Columns: name, key' || chr(10) || string_agg(n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' | ' || k END || CASE WHEN long THEN ' | more' ELSE '' END, chr(10) ORDER BY n_nationkey) FILTER (r <= 3) AS summary
FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey"""


# Line items of a supplier as the rows of a sheet, some of them blank.
def _sheets(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    hole = (F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0
    cells = F.when(hole, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.col("l_returnflag"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey").cast("string")).otherwise("")))
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.lit("s").alias("sheet"), F.row_number().over(order).cast("long").alias("row_no"), cells.alias("cells"))
    out = sheets.sheet_tables(rows)
    return out.select("doc", "island", F.array_join("headers", "|").alias("header"), F.size("rows").cast("long").alias("rows"), F.coalesce("note", F.lit("")).alias("note"))


_SHEETS_SQL = """WITH r AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n, (l_orderkey + l_linenumber) % 9 = 0 AS hole, l_returnflag AS a, CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS b FROM lineitem),
i AS (SELECT *, sum(CAST(hole AS INT)) OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM r WHERE n <= 1000)
SELECT doc, CAST(island AS BIGINT) AS island, arg_min(a || '|' || b, n) AS header, count(*) - 1 AS rows, CASE WHEN count(*) * 2 > 10 AND sum(CAST(a = '' AS INT) + CAST(b = '' AS INT)) / (count(*) * 2.0) > 0.4 THEN 'many blank cells' ELSE '' END AS note FROM i WHERE NOT hole GROUP BY doc, island HAVING count(*) > 1"""


def _row_chunks(spark, sf_dir):
    """A customer's orders as the rows of a table; each row has 12 words and a date."""
    row = F.array(F.col("o_orderkey").cast("string"), F.lit("one two three four five six seven eight nine"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    held = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("x"))
    made = table_chunks(held.select("o_custkey", F.array(*map(F.lit, ("key", "text", "priority", "date"))).alias("headers"), F.transform("x", lambda x: x["r"]).alias("rows")), "o_custkey")
    return made.select("o_custkey", "chunk_pos", "token_count", F.md5("text").alias("text_md5"))


_ROW_CHUNKS_SQL = f"""WITH RECURSIVE r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey || ' | one two three four five six seven eight nine | ' || o_orderpriority || ' | ' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders),
st AS (SELECT o_custkey, n, 0 AS batch, 'key | text | priority | date' || chr(10) || line AS text FROM r WHERE n = 1
  UNION ALL SELECT r.o_custkey, r.n, CASE WHEN fits THEN batch ELSE batch + 1 END, CASE WHEN fits THEN joined ELSE 'key | text | priority | date' || chr(10) || line END
  FROM (SELECT st.o_custkey, r.n, st.batch, r.line, st.text || chr(10) || r.line AS joined, floor(len(list_filter(string_split(replace(st.text || ' ' || r.line, chr(10), ' '), ' '), lambda x: x <> '')) * 1.35::DOUBLE) <= 300 AS fits FROM st JOIN r ON r.o_custkey = st.o_custkey AND r.n = st.n + 1) r)
SELECT o_custkey, CAST(batch AS BIGINT) AS chunk_pos, token_count, md5(text) AS text_md5 FROM (
  SELECT o_custkey, batch, arg_max(text, n) AS text, max(batch) OVER (PARTITION BY o_custkey) = batch AS last, CAST(floor(len({W.replace("text", "arg_max(text, n)")}) * 1.35::DOUBLE) AS BIGINT) AS token_count FROM st GROUP BY o_custkey, batch) WHERE NOT last OR token_count >= 20"""


def _ids(spark, sf_dir):
    made = windows(_t(spark, sf_dir, "documents").select("doc_id", "text"), WIDTH, OVERLAP)
    return with_ids(made, "job00001x", "custom", ["window"]).select("doc_id", "window", "chunk_id")


# SQL route guards over statements of eight forms, and numbers near or far from what is retrieved.
STATEMENTS = ["SELECT sum(o_totalprice) FROM orders", "select o_orderkey from orders;", "select 1; drop table x", "with a as (select 1) select * from a", "select replace(a, 'b', 'c') from t", "select * from t where x = 'a' and delete = 1", "update t set a = 1", "SELECT max(a) FROM t"]
QUESTIONS = ["What is the total price?", "Which orders are there?"]


def _guards(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", _pick("o_orderkey", *map(F.lit, STATEMENTS)).alias("sql"), F.when(F.col("o_orderkey") % 3 == 0, QUESTIONS[0]).otherwise(QUESTIONS[1]).alias("q"))
    return o.select("o_orderkey", tables.safe_sql(F.col("sql")).alias("safe"), tables.asks_aggregate(F.col("q")).alias("asks"), tables.passes_gate(F.col("sql"), F.col("q")).alias("passes"))


def _sanity(spark, sf_dir):
    factor = _pick("o_orderkey", *[F.lit(x) for x in (1.0, 1.004, 0.005, 50.0, 1000.0)])
    near = F.concat(F.lit("worth "), F.format_number(F.round(F.col("o_totalprice") * factor), 0), F.lit(" in all"))
    texts = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("no number"))).otherwise(F.array(F.lit("some words"), near))
    value, fact = F.round("o_totalprice"), F.round(F.col("o_totalprice") * factor)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.coalesce(tables.near_ratio(value, texts), F.lit(-1.0)), 6).alias("ratio"), tables.plausible(value, texts).alias("plausible"), tables.overlaps_fact(fact, value).alias("covered"))


_SANITY_SQL = """WITH f AS (SELECT o_orderkey, round(o_totalprice) AS v, round(o_totalprice * [1.0::DOUBLE, 1.004::DOUBLE, 0.005::DOUBLE, 50.0::DOUBLE, 1000.0::DOUBLE][o_orderkey % 5 + 1]) AS m FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR m = 0 THEN -1.0 ELSE round(v / m, 6) END AS ratio, o_orderkey % 7 = 0 OR m = 0 OR v / m BETWEEN 0.01 AND 100 AS plausible, coalesce(abs(m / v - 1) < 0.01 OR (m / v > 0.1 AND m / v < 10), false) AS covered FROM f"""


def _values(spark, sf_dir):
    kind, unit = _pick("o_orderkey", *map(F.lit, ("number", "currency", "date", "text"))), _pick("o_orderkey", *[F.lit(x).cast("string") for x in ("kg", "", None)])
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.round("o_totalprice").cast("long").cast("string")).otherwise(F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", numeric.format_value(raw, kind, unit).alias("shown"))


_VALUES_SQL = """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(o_totalprice, 2) AS DECIMAL(20,2)) AS VARCHAR) END AS raw, o_orderkey % 4 IN (0, 1) AS num, ['kg', '', NULL][o_orderkey % 3 + 1] AS unit FROM orders)
SELECT o_orderkey, CASE WHEN NOT num THEN raw WHEN CAST(raw AS DOUBLE) = floor(CAST(raw AS DOUBLE)) THEN format('{:,}', CAST(CAST(raw AS DOUBLE) AS BIGINT)) ELSE format('{:,.2f}', CAST(raw AS DOUBLE)) END || CASE WHEN unit = 'kg' THEN ' kg' ELSE '' END AS shown FROM v"""


def _fences(spark, sf_dir):
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.without_fence(fenced)).alias("bare_md5"), F.md5(text.cut(F.col("text"), 100)).alias("cut_md5"))


def _extraction(spark, sf_dir):
    parser = _pick("doc_id", *map(F.lit, ("native", "office", "unified", "vision", "other")))
    score, tier = observe.extraction_confidence(parser, F.size(text.tokens(F.col("text"))), F.col("doc_id") % 3, F.col("doc_id") % 2)
    return _t(spark, sf_dir, "documents").select("doc_id", score.alias("score"), tier.alias("tier"))


_EXTRACTION_SQL = f"""WITH w AS (SELECT doc_id, len({W}) AS n FROM documents),
s AS (SELECT doc_id, round(0.45::DOUBLE * [0.95::DOUBLE, 0.95::DOUBLE, 0.9::DOUBLE, 0.75::DOUBLE, 0.6::DOUBLE][doc_id % 5 + 1] + 0.35::DOUBLE * CASE WHEN n >= 1000 THEN 1 WHEN n >= 300 THEN 0.85::DOUBLE WHEN n >= 50 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END
 + 0.20::DOUBLE * CASE WHEN doc_id % 3 > 0 AND doc_id % 2 > 0 THEN 1 WHEN doc_id % 3 > 0 OR doc_id % 2 > 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END, 3) AS score FROM w)
SELECT *, CASE WHEN score >= 0.85 THEN 'High' WHEN score >= 0.65 THEN 'Medium' ELSE 'Low' END AS tier FROM s"""


# Orders as answers.
def _answers(spark, sf_dir):
    route = _pick("o_orderkey", *[F.lit(x).cast("string") for x in ("sql", "vector", "sql+vector", "facts+vector", "", None)])
    return _t(spark, sf_dir, "orders").select(route.alias("route"), (F.col("o_custkey") % 500).alias("tokens_in"), (F.col("o_orderkey") % 90).alias("tokens_out"), (F.col("o_orderkey") % 1000 / 1000).alias("cost"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 101 / 100).alias("score"))


def _usage(spark, sf_dir):
    calls = _t(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("turn_tokens"), (F.col("o_orderkey") % 100).alias("tokens"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(2.0)).alias("turn_cost"), F.lit(1.0).alias("cost"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.5)).alias("tool_cost"))
    return observe.usage_summary(calls, ["o_orderpriority"])


def _stage_costs(spark, sf_dir):
    """Line items as calls of the stages of their supplier's job."""
    i = _t(spark, sf_dir, "lineitem")
    usage = i.select(F.col("l_suppkey").alias("job_id"), F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("stage"), F.when(F.col("l_returnflag") == "R", "embedding").otherwise("llm").alias("provider"), F.col("l_quantity").cast("long").alias("tokens_in"), (F.col("l_partkey") % 50).alias("tokens_out"), F.lit(None).cast("long").alias("cache_write"), (F.col("l_orderkey") % 7).alias("cache_read"), F.lit(5).cast("long").alias("duration_ms"), F.col("l_shipdate").cast("timestamp").alias("started"), F.when(F.col("l_linestatus") == "O", F.expr("CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 HOUR")).alias("ended"))
    out = observe.stage_costs(usage, ["job_id"])
    return out.select("job_id", "stage", "place", "input_tokens", "output_tokens", "cache_read_tokens", "embedding_tokens", F.round("cost", 8).alias("cost"), F.col("wall_ms").cast("long").alias("wall_ms"))


_STAGE_COSTS_SQL = """WITH u AS (SELECT l_suppkey AS job_id, 'stage_' || l_linenumber AS stage, CAST(l_linenumber AS INT) AS place, l_returnflag <> 'R' AS llm, CAST(l_quantity AS BIGINT) AS ti, l_partkey % 50 AS o, l_orderkey % 7 AS cr, CAST(l_shipdate AS TIMESTAMP) AS s, CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 HOUR END AS e FROM lineitem),
g AS (SELECT job_id, stage, place, CAST(sum(CASE WHEN llm THEN ti ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN llm THEN o ELSE 0 END) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN llm THEN cr ELSE 0 END) AS BIGINT) AS cache_read_tokens, CAST(sum(CASE WHEN llm THEN 0 ELSE ti END) AS BIGINT) AS embedding_tokens, coalesce(epoch_ms(max(e)) - epoch_ms(min(s)), count(*) * 5) AS wall_ms FROM u GROUP BY ALL)
SELECT *, round((input_tokens * 80 + output_tokens * 400 + cache_read_tokens * 8 + embedding_tokens * 13) / 1e8::DOUBLE, 8) AS cost FROM g"""


def _storage(spark, sf_dir):
    return observe.storage_survey({n: _t(spark, sf_dir, n) for n in ("documents", "benchmark", "nation", "embeddings")}, chars=True)


# The entity graph: a listing, and the entity that a question is made about.
def _best_entity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    found = mentions(docs)
    return graph.best_entity(graph.mention_counts(found), graph.degrees(graph.chunk_edges(found))).select("entity", "label", "mentions", "degree")


def _sample(spark, sf_dir):
    """A page's first 25 blocks as a sample of it."""
    held = html.blocks(_t(spark, sf_dir, "pages")).where("pos < 25").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return held.select("page_id", F.md5(F.substring(F.array_join(F.transform("x", lambda x: x["text"]), "\n"), 1, 4000)).alias("sample_md5"))


def _described(spark, sf_dir):
    made = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("table_id"))
    return relational.with_descriptions(made, _t(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("table_id"), F.col("r_name").alias("description")), ["table_id"])


def _progress(spark, sf_dir):
    page, share = progress(F.col("o_custkey").cast("double"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", page.alias("page"), F.round(share, 6).alias("share"))


def _missing(spark, sf_dir):
    own = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    return relational.missing_keys(_t(spark, sf_dir, "documents").select(own.alias("metadata")), ["section", "lang", "doc_type", "source"])


QUERIES = {
    "file_formats": (_formats, _FORMATS_SQL),
    "file_languages": (_languages, _languages_sql()),
    "table_texts": (_table_texts, _TABLE_TEXTS_SQL),
    "sheet_islands": (_sheets, _SHEETS_SQL),
    "table_row_chunks": (_row_chunks, _ROW_CHUNKS_SQL),
    "chunk_ids": (_ids, _WINDOWS_SQL + """SELECT doc_id, win AS "window", 'job00001_custom_d' || doc_id || '_c' || lpad(CAST(win AS VARCHAR), CAST(greatest(4, length(CAST(win AS VARCHAR))) AS INT), '0') AS chunk_id FROM ch"""),
    "sql_guards": (_guards, "SELECT o_orderkey, [true, true, false, false, true, false, false, true][o_orderkey % 8 + 1] AS safe, o_orderkey % 3 = 0 AS asks, o_orderkey % 8 NOT IN (0, 7) OR o_orderkey % 3 = 0 AS passes FROM orders"),
    "sql_sanity": (_sanity, _SANITY_SQL),
    "value_formats": (_values, _VALUES_SQL),
    "text_fences": (_fences, r"""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace(trim('```json' || chr(10) || text || chr(10) || '```'), '^```[A-Za-z]*\s*', ''), '\s*```$', '') ELSE regexp_replace(regexp_replace(trim(text), '^```[A-Za-z]*\s*', ''), '\s*```$', '') END) AS bare_md5, md5(CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || chr(10) || '… (truncated)' ELSE text END) AS cut_md5 FROM documents WHERE text IS NOT NULL"""),
    "extraction_confidence": (_extraction, _EXTRACTION_SQL),
    "routing_summary": (lambda s, d: observe.routing_summary(_answers(s, d)), "SELECT ['sql', 'vector', 'hybrid', 'hybrid', 'vector', 'vector'][o_orderkey % 6 + 1] AS kind, count(*) AS answers FROM orders GROUP BY 1"),
    "answer_totals": (
        lambda s, d: observe.answer_totals(_answers(s, d)),
        """WITH a AS (SELECT o_custkey % 500 AS i, o_orderkey % 90 AS o, o_orderkey % 1000 / 1000.0::DOUBLE AS c, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 101 / 100.0::DOUBLE END AS s FROM orders)
SELECT count(*) AS answers, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum(c), 6) AS cost, round(avg(s), 3) AS avg_score, count(*) FILTER (s >= 0.85) AS correct, count(*) FILTER (s >= 0.5 AND s < 0.85) AS partial, count(*) FILTER (s >= 0.2 AND s < 0.5) AS unsupported, count(*) FILTER (s < 0.2) AS incorrect FROM a""",
    ),
    "usage_summary": (_usage, "SELECT o_orderpriority, count(*) AS calls, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey % 100 END) AS BIGINT) AS tokens, sum(CASE WHEN o_orderkey % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN o_orderkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END) AS cost FROM orders GROUP BY 1"),
    "stage_costs": (_stage_costs, _STAGE_COSTS_SQL),
    "storage_sizes": (
        _storage,
        "SELECT 'documents' AS store, count(*) AS rows, CAST(sum(coalesce(length(text), 0) + coalesce(length(lang), 0) + coalesce(length(source), 0)) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark UNION ALL SELECT 'nation', count(*), CAST(sum(length(n_name)) AS BIGINT) FROM nation UNION ALL SELECT 'embeddings', count(*), 0 FROM embeddings",
    ),
    "graph_listing": (
        lambda s, d: graph.listing(graph.nodes(_t(s, d, "documents").select("doc_id"), mentions(_t(s, d, "documents").select("doc_id", "text"))), "entity", "AN", 50, 3),
        f"SELECT DISTINCT entity AS key, 'entity' AS type FROM ({MENTION_SQL}) WHERE contains(lower(entity), 'an') ORDER BY key LIMIT 50 OFFSET 3",
    ),
    "best_entity": (
        _best_entity,
        f"""WITH me AS ({MENTION_SQL}), c AS (SELECT entity, label, count(*) AS mentions, count(DISTINCT doc_id) AS degree FROM me GROUP BY ALL)
SELECT entity, label, mentions, degree FROM c WHERE length(regexp_replace(entity, '^[A-Z]+:', '')) >= 4 ORDER BY CASE label WHEN 'PERSON' THEN 0 WHEN 'ORG' THEN 1 WHEN 'LAW' THEN 3 ELSE 10 END, degree DESC, entity LIMIT 1""",
    ),
    "page_samples": (_sample, _PAGES + "SELECT page_id, md5(substring(string_agg(text, chr(10) ORDER BY pos), 1, 4000)) AS sample_md5 FROM bl WHERE pos < 25 GROUP BY page_id"),
    "table_descriptions": (_described, "SELECT n_nationkey, n_regionkey AS table_id, CASE WHEN n_regionkey < 3 THEN r_name ELSE '' END AS description FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "supplier_page": (lambda s, d: relational.page(_t(s, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], 9999, -5), "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 500"),
    "parse_progress": (_progress, "SELECT o_orderkey, CAST(floor(o_custkey / 7.0::DOUBLE) AS BIGINT) AS page, round(least(0.95::DOUBLE, o_custkey / 7.0::DOUBLE / 100), 6) AS share FROM orders"),
    "missing_keys": (_missing, "SELECT 'doc_type,section' AS missing"),
}
