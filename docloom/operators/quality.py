"""Checks of extracted text: garbage predicates, pages, blocks and stage checks over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.checks import pass_rate, stage_checks
from docloom.functions.garbage import gibberish_signals, is_cid_garbage, is_gibberish, without_cid
from docloom.functions.text import SPACES_SQL, tokens
from docloom.functions.vector import INCREMENT, MULTIPLIER, mock_embedding
from docloom.operators.chunking import EST, OVERLAP, W, WIDTH, heading_chunks, merge_small, stats, windows
from docloom.operators.chunking import _WINDOWS_SQL as WINDOWS_SQL
from docloom.functions.text import estimate
from docloom.operators.tables import CATEGORY_HINTS, NUMERIC_HINTS, table_questions
from docloom.sources import html, plain
from docloom.sources.plain import needs_ocr


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gibberish(spark, sf_dir):
    signals = gibberish_signals(F.col("text"))
    df = _t(spark, sf_dir, "documents")
    return df.select("doc_id", signals["letters"].cast("long").alias("letters"), F.round(signals["runs"], 6).alias("runs"), F.round(signals["vowels"], 6).alias("vowels"), F.round(signals["other"], 6).alias("other"), is_gibberish(F.col("text")).alias("gibberish"))


def _cid(spark, sf_dir):
    """Documents, every third with its blanks as glyph codes, as a broken text layer has them."""
    broken = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit(" "), F.lit("(cid:3)"))).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", is_cid_garbage(broken).alias("garbage"), F.length(without_cid(broken)).cast("long").alias("kept_chars"))


def _checks(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    made = stats(windows(docs, WIDTH, OVERLAP).withColumn("token_count", estimate(F.col("n_words"))), ["doc_id"])
    metrics = docs.select("doc_id", F.size(tokens(F.col("text"))).alias("words")).join(made, "doc_id", "left").withColumn("coverage", F.coalesce(F.col("total_tokens") * 100.0 / estimate(F.col("words")), F.lit(0.0)))
    checked = metrics.withColumn("checks", stage_checks("chunk"))
    failed = F.array_join(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"]), ",")
    return checked.select("doc_id", F.round(pass_rate(F.col("checks")), 4).alias("pass_rate"), failed.alias("failed"))


def _ocr(spark, sf_dir):
    """Conversations as documents: a turn is a page."""
    return plain.ocr_fraction(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


_P = r"regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>', ' ', 'g')"


def _inner(c: str) -> str:
    out = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in html.ENTITIES:
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_H = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"
_B = r"(?is)<(p|li|pre|code)\b[^>]*>(.*?)</(?:p|li|pre|code)\s*>"
_PAGES = f"""WITH p AS (SELECT page_id, {_P} AS page FROM pages),
h AS (SELECT page_id, unnest(regexp_extract_all(page, '{_H}', 1)) AS level, unnest(regexp_extract_all(page, '{_H}', 2)) AS t, unnest(range(100000)[:len(regexp_extract_all(page, '{_H}', 1))]) AS i FROM p),
b AS (SELECT page_id, unnest(regexp_extract_all(page, '{_B}', 2)) AS t, unnest(range(100000)[:len(regexp_extract_all(page, '{_B}', 2))]) AS i FROM p),
u AS (SELECT page_id, 0 AS part, i, CAST(level AS INT) AS level, {_inner("t")} AS text FROM h UNION ALL SELECT page_id, 1, i, 0, {_inner("t")} FROM b),
k AS (SELECT page_id, part, i, level, CASE WHEN part = 1 THEN substring(text, 1, 1000) ELSE text END AS text FROM u WHERE (part = 0 AND text <> '') OR (part = 1 AND length(text) > 15)),
bl AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part, i) - 1 AS pos, level, text FROM k)
"""
def _heading_chunks(spark, sf_dir):
    """Web pages, chunked under their headings."""
    chunks = heading_chunks(html.blocks(_t(spark, sf_dir, "pages")), "page_id")
    return chunks.select("page_id", "chunk_pos", "token_count", F.coalesce("heading_path", F.lit("")).alias("heading_path"), F.md5("text").alias("text_md5"))


#: Block by block with the text held so far, as the rules are worded; nothing of the operator's counts.
_CHUNKS_SQL = (
    "WITH RECURSIVE "
    + _PAGES.removeprefix("WITH ")
    + f""", bw AS (SELECT page_id, pos, level, regexp_replace(text, '^{SPACES_SQL}|{SPACES_SQL}$', '', 'g') AS text, {EST.format(f"len({W})")} AS e FROM bl),
st AS (
  SELECT DISTINCT page_id, CAST(-1 AS BIGINT) AS pos, '' AS buf, CAST(0 AS BIGINT) AS held, CAST([] AS VARCHAR[]) AS path, CAST(NULL AS VARCHAR) AS made, CAST([] AS VARCHAR[]) AS made_path FROM bw
  UNION ALL
  SELECT b.page_id, b.pos,
         CASE WHEN b.level > 0 THEN CASE WHEN s.held BETWEEN 1 AND 19 THEN s.buf || ' ' || b.text ELSE b.text END
              WHEN s.held > 0 AND s.held + b.e > 300 THEN array_to_string(list_filter(regexp_split_to_array(s.buf, '{SPACES_SQL}'), lambda t: t <> '')[-47:], ' ') || ' ' || b.text
              WHEN s.held > 0 THEN s.buf || ' ' || b.text ELSE b.text END,
         b.e + CASE WHEN b.level > 0 THEN CASE WHEN s.held < 20 THEN s.held ELSE 0 END
                    WHEN s.held > 0 AND s.held + b.e > 300 THEN CAST(floor(least(47, len(list_filter(regexp_split_to_array(s.buf, '{SPACES_SQL}'), lambda t: t <> ''))) * 1.35::DOUBLE) AS BIGINT)
                    ELSE s.held END,
         CASE WHEN b.level > 0 THEN list_concat(s.path[1:b.level - 1], [b.text]) ELSE s.path END,
         CASE WHEN s.held >= 20 AND (b.level > 0 OR s.held + b.e > 300) THEN s.buf END, s.path
  FROM st s JOIN bw b ON b.page_id = s.page_id AND b.pos = s.pos + 1),
en AS (SELECT page_id, pos, made AS text, made_path AS path FROM st WHERE made IS NOT NULL
       UNION ALL SELECT page_id, pos + 1, buf, path FROM st WHERE held >= 20 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1 AND pos = (SELECT max(b.pos) FROM bw b WHERE b.page_id = st.page_id)),
fa AS (SELECT page_id, 0 AS pos, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, CAST([] AS VARCHAR[]) AS path FROM bw WHERE page_id NOT IN (SELECT page_id FROM en) GROUP BY page_id),
ch AS (SELECT * FROM en UNION ALL SELECT * FROM fa)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS chunk_pos, {EST.format(f"len({W})")} AS token_count, array_to_string(path, ' > ') AS heading_path, md5(text) AS text_md5 FROM ch"""
)


def _merge_small(spark, sf_dir):
    """Conversations as documents whose turns are chunks, most of them under the least."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role").withColumn("chunk_pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1)
    chunks = turns.select("conv_id", "chunk_pos", F.coalesce("text", F.lit("")).alias("text"), estimate(F.size(tokens(F.col("text")))).alias("token_count"), F.col("turn").cast("int").alias("page"), F.col("role").alias("heading_path"))
    return merge_small(chunks, "conv_id").select("conv_id", "chunk_pos", "token_count", "page", "heading_path", F.md5("text").alias("text_md5"))


_MERGE_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, coalesce(text, '') AS text, CAST(turn AS INT) AS page, role, {EST.format(f"len({W})")} AS e, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
st AS (
  SELECT conv_id, pos, n, text, e, page, role FROM c WHERE pos = 0
  UNION ALL
  SELECT c.conv_id, c.pos, c.n, CASE WHEN s.e < 20 THEN trim(s.text || ' ' || c.text) ELSE c.text END,
         CASE WHEN s.e < 20 THEN {EST.format(f"len({W.replace('text', chr(39) + chr(39) + ' || s.text || ' + chr(39) + ' ' + chr(39) + ' || c.text')})")} ELSE c.e END,
         CASE WHEN s.e < 20 THEN coalesce(s.page, c.page) ELSE c.page END, CASE WHEN s.e < 20 THEN coalesce(nullif(s.role, ''), c.role) ELSE c.role END
  FROM st s JOIN c ON c.conv_id = s.conv_id AND c.pos = s.pos + 1),
ok AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS chunk_pos, count(*) OVER (PARTITION BY conv_id) AS made FROM st WHERE e >= 20),
le AS (SELECT * FROM st WHERE pos = n - 1 AND e < 20),
jo AS (SELECT ok.conv_id, chunk_pos, CASE WHEN le.text IS NOT NULL AND chunk_pos = made - 1 THEN trim(ok.text || ' ' || le.text) ELSE ok.text END AS text, le.text IS NOT NULL AND chunk_pos = made - 1 AS grew, ok.e, ok.page, ok.role FROM ok LEFT JOIN le USING (conv_id)
       UNION ALL SELECT conv_id, 0, text, false, e, page, role FROM le WHERE conv_id NOT IN (SELECT conv_id FROM ok))
SELECT conv_id, CAST(chunk_pos AS BIGINT) AS chunk_pos, CASE WHEN grew THEN {EST.format(f"len({W})")} ELSE e END AS token_count, page, role AS heading_path, md5(text) AS text_md5 FROM jo"""


def _mock_vectors(spark, sf_dir):
    """Stand-in vectors of the benchmark passages, a row for each component."""
    made = _t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(mock_embedding(F.col("text"))).alias("pos", "value"))
    return made.select("item_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value"))


_MOCK_SQL = f"""
WITH RECURSIVE s AS (
  SELECT item_id, 0 AS i, CAST(CAST('0x' || right(sha256(coalesce(text, '')), 16) AS UBIGINT) AS UHUGEINT) AS st FROM benchmark
  UNION ALL
  SELECT item_id, i + 1, (st * CAST({MULTIPLIER} AS UHUGEINT) + CAST({INCREMENT} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) FROM s WHERE i < 64),
v AS (SELECT item_id, i - 1 AS pos, CAST((st // 131072) % 65536 AS DOUBLE) / 32768 - 1 AS x FROM s WHERE i > 0)
SELECT item_id, pos, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM v"""


def _questions(spark, sf_dir):
    """Templates of questions for the star tables as typed tables."""
    kinds = None
    for name in ("customer", "supplier", "part", "orders", "lineitem"):
        columns = spark.createDataFrame([(name, c, "REAL" if t in ("double", "int", "bigint") else "TEXT") for c, t in _t(spark, sf_dir, name).dtypes], "table_name string, column string, type string")
        kinds = columns if kinds is None else kinds.union(columns)
    filled = _row_counts(spark, sf_dir)
    return table_questions(kinds).join(filled, "table_name").select("table_name", "route", "q", "sql", "rows")


def _row_counts(spark, sf_dir):
    from docloom.operators.observe import storage_survey

    return storage_survey({n: _t(spark, sf_dir, n) for n in ("customer", "supplier", "part", "orders", "lineitem")}).withColumnRenamed("store", "table_name")


_STAR = ("customer", "supplier", "part", "orders", "lineitem")


def _hint_sql(hints: list[str]) -> str:
    return " OR ".join(f"contains(lower(column_name), '{h}')" for h in hints)


_QUESTIONS_SQL = f"""
WITH c AS (SELECT table_name, column_name, data_type IN ('DOUBLE', 'INTEGER', 'BIGINT') AS num, {_hint_sql(NUMERIC_HINTS)} AS nh, {_hint_sql(CATEGORY_HINTS)} AS ch FROM information_schema.columns WHERE table_name IN {_STAR}),
p AS (SELECT table_name, arg_min(column_name, (NOT nh, column_name)) FILTER (num) AS n, arg_min(column_name, (NOT ch, column_name)) FILTER (NOT num) AS k FROM c GROUP BY table_name),
r AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _STAR)})
SELECT table_name, 'sql' AS route, 'What are the highest, lowest and average ' || n || '?' AS q, 'SELECT max(' || n || ') AS max_value, min(' || n || ') AS min_value, round(avg(' || n || '), 2) AS avg_value FROM ' || table_name AS sql, rows FROM p JOIN r USING (table_name) WHERE n IS NOT NULL
UNION ALL SELECT table_name, 'sql', 'What is the average ' || n || ' by ' || k || '?', 'SELECT ' || k || ', count(*) AS n, round(avg(' || n || '), 2) AS avg_value FROM ' || table_name || ' GROUP BY ' || k || ' ORDER BY avg_value DESC', rows FROM p JOIN r USING (table_name) WHERE n IS NOT NULL AND k IS NOT NULL"""

QUERIES = {
    "heading_chunks": (_heading_chunks, _CHUNKS_SQL),
    "merge_small": (_merge_small, _MERGE_SQL),
    "mock_embedding": (_mock_vectors, _MOCK_SQL),
    "table_questions": (_questions, _QUESTIONS_SQL),
    "quality_cid": (
        _cid,
        r"WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '(cid:3)') ELSE text END AS t FROM documents), c AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '\(cid:\d+\)', '', 'g')) AS kept FROM b) SELECT doc_id, n >= 30 AND (n - kept) / greatest(n, 1)::DOUBLE > 0.20 AS garbage, kept AS kept_chars FROM c",
    ),
    "quality_gibberish": (
        _gibberish,
        r"""WITH c AS (SELECT doc_id, text, string_split(text, '') AS ch FROM documents), e AS (SELECT doc_id, unnest(ch) AS x, generate_subscripts(ch, 1) AS i FROM c),
l AS (SELECT doc_id, x, i, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l),
n AS (SELECT doc_id, run, count(*) AS n, any_value(x) AS x FROM g GROUP BY ALL), r AS (SELECT doc_id, count(*) FILTER (n >= 5 AND x <> chr(10)) AS runs FROM n GROUP BY doc_id),
s AS (SELECT doc_id, length(text) AS n, length(regexp_replace(lower(text), '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) AS v, length(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]', '', 'g')) AS filled, length(regexp_replace(text, '[\p{L}\s\x0B\x1C-\x1F\x85\p{Z}]', '', 'g')) AS o, coalesce(runs, 0) AS runs FROM c LEFT JOIN r USING (doc_id)),
t AS (SELECT doc_id, n, letters, runs * 100.0::DOUBLE / greatest(n, 1) AS runs, CASE WHEN letters > 0 THEN v / letters::DOUBLE ELSE 0 END AS vowels, o / greatest(filled, 1)::DOUBLE AS other FROM s)
SELECT doc_id, letters, round(runs, 6) AS runs, round(vowels, 6) AS vowels, round(other, 6) AS other, n >= 80 AND (letters = 0 OR CAST(runs > 1.5 AS INT) + CAST(vowels < 0.15 AS INT) + CAST(other > 0.45 AS INT) >= 2) AS gibberish FROM t""",
    ),
    "stage_checks": (
        _checks,
        WINDOWS_SQL
        + f""", s AS (SELECT doc_id, count(*) AS chunks, round(avg(token_count), 1) AS avg_tokens, min(token_count) AS min_tokens, sum(token_count) AS total FROM ch GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(chunks > 0, false) AS a, coalesce(avg_tokens BETWEEN 30 AND 600, false) AS b, coalesce(min_tokens >= 20, false) AS c, coalesce(total * 100.0::DOUBLE / {EST.format("len(w)")}, 0) >= 90 AS e FROM d LEFT JOIN s USING (doc_id))
SELECT doc_id, round((CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(e AS INT)) / 4.0::DOUBLE, 4) AS pass_rate, array_to_string(list_filter([CASE WHEN NOT a THEN 'chunks_created' END, CASE WHEN NOT b THEN 'avg_tokens_in_range' END, CASE WHEN NOT c THEN 'no_empty_chunks' END, CASE WHEN NOT e THEN 'coverage' END], lambda x: x IS NOT NULL), ',') AS failed FROM m""",
    ),
    "ocr_fraction": (
        _ocr,
        """WITH c AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT * FROM c WHERE n <= 200 OR turn < 20 OR turn >= n - 10 OR (turn - 20) % greatest(1, CAST(ceil((n - 30) / 170.0) AS BIGINT)) = 0)
SELECT conv_id, count(*) AS pages_sampled, CAST(sum(CAST(length(trim(coalesce(text, ''))) < 30 AS INT)) AS BIGINT) AS pages_needing_ocr, round(sum(CAST(length(trim(coalesce(text, ''))) < 30 AS INT)) / count(*)::DOUBLE, 3) AS ocr_fraction FROM s GROUP BY conv_id""",
    ),
    "ocr_pages": (lambda s, d: _t(s, d, "conversations").where(needs_ocr(F.col("text"))).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE length(trim(coalesce(text, ''))) < 30"),
    "html_blocks": (lambda s, d: html.blocks(_t(s, d, "pages")), _PAGES + "SELECT * FROM bl"),
    "html_headings": (lambda s, d: html.blocks(_t(s, d, "pages")).where("level > 0").groupBy("page_id", "level").agg(F.count("*").alias("headings")), _PAGES + "SELECT page_id, level, count(*) AS headings FROM bl WHERE level > 0 GROUP BY ALL"),
    "html_text_stats": (
        lambda s, d: html.page_stats(_t(s, d, "pages")),
        f"""WITH p AS (SELECT page_id, {_P} AS page FROM pages) SELECT page_id, len(regexp_extract_all(page, '{_H}')) AS headings, len(regexp_extract_all(page, '{_B}')) AS body_tags, len(regexp_extract_all(page, '(?i)<img\\b')) AS images, len(regexp_extract_all(page, '(?i)<table\\b')) AS tables,
len(list_filter(string_split({_inner("page")}, ' '), lambda w: w <> '')) AS words FROM p""",
    ),
    "markdown_blocks": (
        lambda s, d: plain.markdown_blocks(_t(s, d, "documents").select("doc_id", "text")).select("doc_id", "pos", "level", F.md5("text").alias("text_md5")),
        r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS text FROM documents), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM d),
y AS (SELECT *, length(regexp_extract(line, '^(#{1,6}) ', 1)) AS level, trim(regexp_replace(line, '[\t\r\f]', ' ', 'g')) = '' AS blank FROM x),
z AS (SELECT *, sum(CASE WHEN blank OR level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM y),
g AS (SELECT doc_id, island, level, min(n) AS first, string_agg(CASE WHEN level > 0 THEN trim(substring(line, level + 2)) ELSE trim(line) END, ' ' ORDER BY n) AS text FROM z WHERE NOT blank GROUP BY ALL HAVING string_agg(CASE WHEN level > 0 THEN trim(substring(line, level + 2)) ELSE trim(line) END, ' ') <> ''),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos, CAST(level AS INT) AS level, md5(text) AS text_md5 FROM g)
SELECT * FROM o UNION ALL SELECT doc_id, 0, 0, md5(text) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM o)""",
    ),
    "plain_blocks": (lambda s, d: plain.plain_block(_t(s, d, "documents")).select("doc_id", "word_count", F.md5("text").alias("text_md5")), f"SELECT doc_id, CAST(len({W}) AS BIGINT) AS word_count, md5(substring(text, 1, 2000)) AS text_md5 FROM documents"),
}
