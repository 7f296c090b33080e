"""Operators against hand-made cases and brute force."""

import io
import math
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Config
from docloom.operators import bm25, chunking, facts, graph, observe, records, relational, retrieval, tables
from docloom.plans import planner, provider
from docloom.plans.engine import Engine
from docloom.sources import files, html, plain, sheets
from docloom.streaming import events

WORDS = lambda n, w="word": " ".join(f"{w}{i}" for i in range(n))


def _chunked(spark, *documents):
    """The chunks of each document, given as blocks (level, text, page)."""
    rows = [(d, i, level, text, page) for d, blocks in enumerate(documents) for i, (level, text, page) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, level int, text string, page int")
    out = [[] for _ in documents]
    for r in chunking.heading_chunks(df, page="page").orderBy("doc_id", "chunk_pos").collect():
        out[r.doc_id].append(r)
    return out


def test_heading_chunks(spark):
    normal, carried, dropped, skipped, tiny, blank, huge, again, long = _chunked(
        spark,
        [(1, "Title", 1), (0, WORDS(150), 1), (0, WORDS(150, "b"), 2), (2, "Part", 2), (0, WORDS(120, "c"), 3)],
        [(0, "few words here", None), (1, "Head", None), (0, WORDS(40), None)],
        [(0, WORDS(100), 1), (1, "H", 2), (0, "short rest", 2)],
        [(1, "A", 1), (3, "B", 1), (0, WORDS(50), 1), (3, "C", None), (0, WORDS(50), None), (2, "D", 7), (0, WORDS(50), None), (1, "E", 8), (0, WORDS(50), 9)],
        [(0, "Hi.", 4), (None, " Hello. ", None)],
        [(0, "  ", None), (0, None, None)],
        [(0, WORDS(5000), None)],
        [(0, "a b c", 1), (0, WORDS(220), 2), (0, WORDS(30, "z"), 3)],
        [(0, f"w{i} x", 3) for i in range(3)] + [(1, f"h{i}", None) for i in range(4)],
    )
    assert [c.heading_path for c in normal] == ["Title", "Title", "Title > Part"]
    assert normal[0].text.startswith("Title word0") and normal[1].text.split()[:47] == WORDS(150).split()[-47:]
    assert [c.page for c in normal] == [1, 2, 3] and all(c.token_count >= 20 for c in normal)
    assert len(carried) == 1 and carried[0].text.startswith("few words here Head") and carried[0].heading_path == "Head"
    assert len(dropped) == 1 and "rest" not in dropped[0].text and dropped[0].page == 1
    assert [(c.heading_path, c.page) for c in skipped] == [("A > B", 1), ("A > B > C", None), ("A > D", 7), ("E", 9)]
    assert [(c.text, c.page, c.heading_path) for c in tiny] == [("Hi.\n\nHello.", 4, None)] and not blank
    assert len(huge) == 1  # one block is never cut here
    assert [c.text.split()[:4] for c in again] == [["a", "b", "c", "word0"], [f"word{i}" for i in range(173, 177)]] and [c.page for c in again] == [2, 3]
    assert [(c.text.split()[-1], c.page) for c in long] == [("h3", 3)]
    empty = spark.createDataFrame([], "doc_id long, pos long, level int, text string")
    assert chunking.heading_chunks(empty).count() == 0


def test_heading_chunks_fallback_windows(spark):
    blocks = spark.createDataFrame([(1, i, 0, f"w{i} x") for i in range(100)], "doc_id long, pos long, level int, text string")
    config = Config(chunk_least=10**6, fallback_tokens=60, window_overlap=14)
    got = [r.text.split() for r in chunking.heading_chunks(blocks, config=config).orderBy("chunk_pos").collect()]
    words = " ".join(f"w{i} x" for i in range(100)).split()
    assert got == [words[k : k + 44] for k in range(0, 200, 34) if k == 0 or k - 34 + 44 < 200]


def test_merge_small(spark):
    def merged(*chunks):
        rows = [(1, i, t, max(1, int(len(t.split()) * 1.35)), page, path) for i, (t, page, path) in enumerate(chunks)]
        out = chunking.merge_small(spark.createDataFrame(rows, "doc_id long, chunk_pos long, text string, token_count long, page int, heading_path string"))
        return [(r.text, r.page, r.heading_path, r.token_count) for r in out.orderBy("chunk_pos").collect()]

    big = WORDS(30)
    assert merged(("a b", 3, "H"), (big, 4, "I"), (big, 5, "J")) == [(f"a b {big}", 3, "H", 43), (big, 5, "J", 40)]
    assert merged(("a", None, ""), ("b", 2, None), (big, 4, "I")) == [(f"a b {big}", 2, "I", 43)]
    assert merged((big, None, None), ("a", 2, "X"), ("b", 3, "Y")) == [(f"{big} a b", None, None, 43)]
    assert merged(("a", 1, "H")) == [("a", 1, "H", 1)] and merged(("a", 1, "H"), ("b", 2, "I")) == [("a b", 1, "H", 2)]


@pytest.mark.parametrize("n", [0, 1, 10, 11, 18, 19, 100])
def test_windows(spark, n):
    words = WORDS(n).split()
    want, start = [], 0
    while words:
        want.append(words[start : start + 10])
        if start + 10 >= n:
            break
        start += 8
    got = chunking.windows(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), 10, 2).orderBy("window").collect()
    assert [r.text.split() for r in got] == want


def test_oversize(spark):
    rows = [("a", WORDS(20), 27, 3, "H"), ("b", WORDS(10000), 13500, 42, "X")]
    got = chunking.split_oversize(spark.createDataFrame(rows, "chunk_id string, text string, token_count long, page int, heading_path string")).collect()
    parts = [r for r in got if r.split_from == "b"]
    assert len({r.chunk_id for r in got}) == len(got) == 1 + len(parts) and {r.page for r in parts} == {42} and max(r.token_count for r in got) <= 7500
    assert sorted(r.chunk_id for r in parts) == ["b_part_00", "b_part_01"]


def test_table_rows(spark):
    rows = [(1, ["h1", "h2"], [[WORDS(20), "x"]] * 40), (2, ["a"], [["b"]]), (3, ["a"], []), (4, ["h"], [[WORDS(400)], ["tail"], [WORDS(300)]])]
    got = chunking.table_chunks(spark.createDataFrame(rows, "table_id long, headers array<string>, rows array<array<string>>")).orderBy("table_id", "chunk_pos").collect()
    first = [r for r in got if r.table_id == 1]
    assert len(first) == 5 and all(r.text.startswith("h1 | h2\n") and r.token_count <= 300 for r in first) and sum(r.text.count("\n") for r in first) == 40
    assert [(r.table_id, len(r.text.split("\n"))) for r in got if r.table_id != 1] == [(4, 2), (4, 2), (4, 2)]
    assert chunking.row_batches([400, 1, 300, 2], 1) == [0, 1, 2, -1]  # only the last one is dropped


def test_ask_reaches_chunks_outside_the_lists(spark, tmp_path):
    made = spark.createDataFrame([("c1", "alpha beta"), ("c2", "alpha gamma"), ("c3", "alpha delta"), ("c4", "omega")], "chunk_id string, text string")
    engine = Engine(spark, f"file://{tmp_path}/stores")
    held = {"chunks": made.withColumn("embedding", engine.provider.embed(F.col("text"))), "entities": spark.createDataFrame([(c, "ORG:acme") for c in ("c1", "c4")], "chunk_id string, entity string")}
    engine._of = lambda key, job_id: held[key]
    engine._table = lambda key: held.get(key)
    answer = engine.ask(spark.createDataFrame([(1, "alpha beta")], "question_id long, q string"), candidates=1).first()
    assert set(answer.chunk_ids) == {"c1", "c2", "c3", "c4"}


def test_confidence(spark):
    rows = [(1, 0.8, 0.1, 0.0, True), (1, 0.6, 0.0, 0.1, True), (2, None, None, None, True), (3, None, None, None, False)]
    got = {r.item_id: (r.confidence, r.tier) for r in retrieval.confidence(spark.createDataFrame(rows, "item_id long, dense double, sparse double, graph double, has_sql boolean")).collect()}
    assert got == {1: (round(0.35 + 0.28 + 0.14 + 0.08, 3), "high"), 2: (0.55, "medium"), 3: (0.0, "low")}


def test_context(spark):
    df = spark.createDataFrame([(1, i, "x" * 30) for i in range(5)], "q long, pos long, text string")
    assert retrieval.within_budget(df, "q", "pos", budget=60).count() == 3  # the one that crosses stays
    one = spark.range(1).select(retrieval.reranked(F.array(*map(F.lit, [3, 3, 9, 0])), 5, F.lit(4)).alias("a"), retrieval.reranked(F.array(F.lit(9)), 2, F.lit(4)).alias("b")).first()
    assert one.a == [3, 0] and one.b == [0, 1]


def test_pairs_are_dealt_out(spark, monkeypatch):
    """Tasks that count pairs are as many as the pairs ask for; a chunk that stands in two rows is one."""
    monkeypatch.setattr(graph, "PAIRS", 10)
    rows = [(i, f"E{j}") for i in range(8) for j in range(i)] + [(3, "E0"), (9, "E1"), (10, None)]
    expected = Counter((f"E{a}", f"E{b}") for i in range(8) for b in range(i) for a in range(b))
    lists = [(i, [e for k, e in rows[a::2] if k == i and e]) for i in range(11) for a in (0, 1)]
    for made in (graph.cooccurrence(spark.createDataFrame(rows, "doc_id int, entity string")), graph.list_cooccurrence(spark.createDataFrame(lists, "doc_id int, entities array<string>"))):
        assert {(r.src, r.dst): r.weight for r in made.collect()} == expected
        assert f"{sum(expected.values()) // 10 + 1}), REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
    assert graph.cooccurrence(spark.createDataFrame([], "doc_id int, entity string")).count() == 0


def test_degrees_read_texts_once(spark, sf_dir):
    """Chunks' entities are written once, so that the plan of degrees has no texts left, and its pairs are counted in one place."""
    plan = graph.QUERIES["node_degree"][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "regexp_extract_all" not in plan and plan.count("posexplode") == 1


def test_graph(spark):
    docs = spark.createDataFrame([(1, "Acme Corp met Jane Smith. Acme Corp won."), (2, "Jane Smith left."), (3, None)], "doc_id long, text string")
    found = graph.mentions(docs)
    counts = {r.entity: (r.mentions, r.chunks) for r in graph.mention_counts(found).collect()}
    assert counts == {"PERSON:acme corp": (2, 1), "PERSON:jane smith": (2, 2)}
    made = graph.edges(docs, found)
    assert {(r.src, r.dst): r.weight for r in made.where("rel = 'co_occurs'").collect()} == {("PERSON:acme corp", "PERSON:jane smith"): 1}
    assert {r.node: r.degree for r in graph.degrees(made).collect()}["PERSON:jane smith"] == 3
    assert {r.neighbour for r in graph.neighbours(made, spark.createDataFrame([("Chunk:2",)], "node string")).collect()} == {"Document:2", "PERSON:jane smith"}
    hops = {r.node: r.hops for r in graph.reach(made, spark.createDataFrame([("Document:2",)], "node string"), 3).collect()}
    assert hops == {"Document:2": 0, "Chunk:2": 1, "PERSON:jane smith": 2, "Chunk:1": 3, "PERSON:acme corp": 3}
    assert [r.key for r in graph.listing(graph.nodes(docs, found), text="JANE", limit=0).collect()] == ["PERSON:jane smith"]


def test_tables(spark):
    cells = [("a", str(i)) for i in range(7)] + [("a", "x")] * 3 + [("b", str(i)) for i in range(69)] + [("b", "x")] * 31 + [("c", " ")]
    got = {r.column: r.type for r in tables.infer_types(spark.createDataFrame(cells, "column string, cell string"), ["column"]).collect()}
    assert got == {"a": "REAL", "b": "TEXT", "c": "TEXT"}
    heads = spark.createDataFrame([(i, h) for i, h in enumerate(["a", "a", "a_1", "", None, "A"])], "pos int, header string")
    names = [r["name"] for r in tables.unique_names(heads, []).orderBy("pos").collect()]
    assert len(set(names)) == len(names) and names[0] == "a" and "col" in names
    cases = {"select 1": True, "SELECT a FROM t;": True, "select 1; drop table t": False, "with x as (select 1) select 1": False, "select replace(a, 1) from t": True, "select 1 from t where drop = 1": False}
    assert {r.s: r.ok for r in spark.createDataFrame([(s,) for s in cases], "s string").select("s", tables.safe_sql(F.col("s")).alias("ok")).collect()} == cases
    spark.range(40).createOrReplaceTempView("guarded")
    assert tables.run_guarded(spark, "select max(id) from guarded", "what is the id")[1] == "aggregate_not_asked"
    df, why = tables.run_guarded(spark, "select id from guarded", "list them")
    assert why == "ok" and df.count() == 25
    assert tables.run_guarded(spark, "select nope from guarded", "list")[1].startswith("execution_failed") and tables.run_guarded(spark, "select id from guarded where id < 0", "x")[1] == "no_rows" and tables.run_guarded(spark, "", "x")[1] == "not_routed"
    one = spark.range(1).select(tables.plausible(F.lit(5000.0), F.array(F.lit("about 1,200 units"))).alias("a"), tables.plausible(F.lit(5e9), F.array(F.lit("about 1,200"))).alias("b"), tables.plausible(F.lit(5.0), F.array(F.lit("none"))).alias("c"), tables.overlaps_fact(F.lit(100.0), F.lit(50.0)).alias("d"), tables.overlaps_fact(F.lit(1e6), F.lit(5.0)).alias("e")).first()
    assert tuple(one) == (True, False, True, True, False)
    kinds = spark.createDataFrame([("doc_table_1", "region", "TEXT"), ("doc_table_1", "price", "REAL"), ("doc_table_2", "note", "TEXT")], "table_name string, column string, type string")
    assert sorted(r.sql for r in tables.table_questions(kinds).collect())[0].startswith("SELECT max(price)") and tables.table_questions(kinds).count() == 2


def test_facts(spark):
    chunks = spark.createDataFrame([(1, "Revenue: $ 1,200\nOwner: Jane\nDate: 2020-01-02\nno fact"), (2, "other")], "doc_id long, text string")
    got = {r.label: (r.value, r.type) for r in facts.extract(chunks).collect()}
    assert got == {"Revenue": ("$ 1,200", "currency"), "Owner": ("Jane", "text"), "Date": ("2020-01-02", "date")}
    claims = spark.createDataFrame([(1, "a", "REVENUE:   $ 1,200"), (2, "b", "Revenue"), (3, "c", "x"), (1, "", "Owner")], "doc_id long, label string, quote string")
    assert sorted(r.reason for r in facts.validate(claims, chunks).collect()) == ["missing_field", "ok", "quote_not_found", "unknown_chunk"]
    quotes = spark.createDataFrame([(1, "owner: jane date: 2020-01-02 no"), (2, "her"), (3, ""), (4, None), (5, "venue: $ 1,200 owner: jane date: 2020-01-02 no fac")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in facts.quote_places(chunks, quotes).collect()) == [(1, 1), (2, 2), (5, 1)]
    vectors = lambda rows, name: spark.createDataFrame(rows, f"{name} long, vector array<double>")
    matched = facts.match_questions(vectors([(1, [1.0, 0.0]), (2, [0.1, 0.1])], "question_id"), vectors([(7, [0.9, 0.0]), (6, [0.9, 0.0])], "fact_id")).collect()
    assert [(r.question_id, r.fact_id) for r in matched] == [(1, 6)]


def test_observe(spark):
    usage = spark.createDataFrame([("j", "llm", 1000, 100, 0, 500, 10), ("j", "embedding", 2000, 0, 0, 0, 5), ("j", "llm", None, None, None, None, None)], "job_id string, provider string, tokens_in long, tokens_out long, cache_write long, cache_read long, duration_ms long")
    r = observe.job_cost(usage, ["job_id"]).first()
    assert math.isclose(r.cost, (1000 * 0.8 + 100 * 4 + 500 * 0.08 + 2000 * 0.13) / 1e6, abs_tol=1e-12) and r.wall_ms == 15
    board = spark.createDataFrame([("latency", "a", 10.0, True), ("latency", "b", 20.0, True), ("score", "a", 1.0, False), ("score", "b", 1.0, False), ("only", "a", 1.0, False)], "metric string, pipeline string, value double, lower_is_better boolean")
    assert {r.metric: r.winner for r in observe.scorecard(board).collect()} == {"latency": "a", "score": None, "only": None}


def test_events(spark):
    rows = [("j", 1, "started", 1, None, None), ("j", 1, "completed", 3, 5.0, "p"), ("j", 1, "running", 2, None, None), ("k", 1, "error", 1, None, None), ("m", 9999, "completed", 1, None, None), ("n", 1, "started", 1, None, None)]
    log = spark.createDataFrame(rows, "job_id string, stage_id int, status string, ts long, duration_ms double, payload string")
    state = events.reduce_events(log, ["job_id", "stage_id"], ["ts"])
    got = {r.job_id: (r.status, r.duration_ms, r.payload) for r in state.collect()}
    assert got["j"] == ("completed", 5.0, "p")
    assert {r.job_id: r.run_status for r in events.run_status(state).collect()} == {"j": "completed", "k": "failed", "m": "cancelled", "n": "running"}
    assert events.last_n(log, ["job_id"], ["ts"], 2).where("job_id = 'j'").count() == 2


def test_streams(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    table.limit(50).write.mode("append").parquet(f"{tmp_path}/in")  # some events arrive twice
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    once = events.drain(events.deduplicated_stream(events.stream(spark, f"{tmp_path}/in", schema, 10), late="400 days"), "once")
    assert once.count() == table.count()
    windows = events.drain(events.counts_stream(events.stream(spark, f"{tmp_path}/in", schema, 10), window="1 day", late="400 days"), "windows", "complete")
    assert windows.selectExpr("sum(events)").first()[0] == table.count() + 50
    folded = events.stream(spark, f"{tmp_path}/in", schema, 10).selectExpr("cast(user_id as string) as key", "event_type as status", "value as duration_ms", "cast(unix_micros(cast(ts as timestamp)) / 1000 as double) as at_ms")
    state = events.drain(events.reduce_stream(folded), "state", "update")
    want = {str(r.user_id): r.s for r in table.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("s")).collect()}
    got = {}
    for r in state.collect():
        got[r.key] = r.status
    assert got == want
    assert events.drain(events.sessions_stream(events.stream(spark, f"{tmp_path}/in", schema, 10)), "sessions").count() >= 0


def test_html(spark):
    page = "<h2>Late</h2><script>var a = '</p><p>hidden text that is long';</script><p>A paragraph of some length &amp; more</p><h1>First <b>x</b></h1><pre><code>code block of some length</code></pre><p>short</p><table><tr><td>a</td><td>b</td></tr><tr></tr><tr><th>1</th></tr></table><img src=x><IMG>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = [(r.level, r.text) for r in html.blocks(df).orderBy("pos").collect()]
    assert got[:2] == [(2, "Late"), (1, "First x")] and (0, "A paragraph of some length & more") in got and not any("hidden" in t or t == "short" for _, t in got)
    t = html.tables(df).collect()
    assert len(t) == 1 and t[0].headers == ["a", "b"] and t[0].rows == [["1"]]
    assert html.page_stats(df).where("page_id = 1").first().images == 2


def test_plain(spark):
    text = "# Title\n\nFirst line\nsecond line\n## Sub\n\ntext\n####### no heading\n"
    got = [(r.level, r.text) for r in plain.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()]
    assert got == [(1, "Title"), (0, "First line second line"), (2, "Sub"), (0, "text ####### no heading")]
    rest = plain.markdown_blocks(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()
    assert [(r.pos, r.text) for r in rest] == [(0, ""), (0, "")]
    cases = {"text": ["x" * 50] * 10, "scan": [""] * 5, "mixed": ["x" * 50] * 9 + [""] * 3, "fail": [None, "x" * 50, "x" * 50], "tail": ["x" * 50] * 490 + [""] * 10}
    rows = [(k, i, t) for k, ts in cases.items() for i, t in enumerate(ts)]
    got = {r.doc_id: r for r in plain.ocr_fraction(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect()}
    assert (got["text"].ocr_fraction, got["scan"].ocr_fraction, got["mixed"].ocr_fraction, got["fail"].pages_needing_ocr) == (0.0, 1.0, 0.25, 1)
    assert got["tail"].pages_sampled <= 200 and got["tail"].pages_needing_ocr >= 5


def test_sheets(spark):
    rows = [("d", "s", i, c) for i, c in enumerate([["Title"], [], ["h1", "h2", "h3"], ["1", "2"], ["", "", "", "x"], [" "], ["a"], ["b"]])]
    got = sheets.sheet_tables(spark.createDataFrame(rows, "doc string, sheet string, row_no int, cells array<string>")).orderBy("island").collect()
    assert [(r.headers, r.rows) for r in got] == [(["h1", "h2", "h3", ""], [["1", "2", "", ""], ["", "", "", "x"]]), (["a"], [["b"]])] and got[0].note == "many blank cells"
    one = spark.createDataFrame([(["a", "b", "a"], [["1", "2", "3"], ["4"]])], "headers array<string>, rows array<array<string>>")
    r = one.select(sheets.markdown(F.col("headers"), F.col("rows")).alias("m"), sheets.json_rows(F.col("headers"), F.col("rows")).alias("j"), sheets.summary_text(F.lit("t"), F.lit("What it is"), F.col("headers"), F.col("rows")).alias("s")).first()
    assert r.m == "| a | b | a |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 |  |  |" and r.j == ['{"a":"3","b":"2"}', '{"a":"","b":""}']
    assert r.s == "Table summary: What it is\nColumns: a, b, a\n1 | 2 | 3\n4"


def test_relational(spark):
    known, more = spark.createDataFrame([(1, "a")], "id long, t string"), spark.createDataFrame([(1, "b"), (2, "c")], "id long, t string")
    assert sorted((r.id, r.t) for r in relational.append_new(known, more, ["id"]).collect()) == [(1, "a"), (2, "c")]
    meta = spark.createDataFrame([({"a": "1", "chunk_type": "x"},)], "metadata map<string,string>")
    out = relational.enriched(meta, {"chunk_type": F.lit("y"), "b": F.lit(2), "n": F.lit(None)}).first().metadata
    assert out == {"a": "1", "chunk_type": "x", "b": "2"}
    assert relational.missing_keys(meta, ["a", "z", "b"]).first().missing == "b,z"
    assert [r.id for r in relational.page(spark.range(10), ["id"], 0, -5).collect()] == [0]


def test_records(spark):
    rows = [(1, 5, "render", 10, 10), (1, 5, "embedded", 900, 900), (1, 6, "embedded", 10, 10), (1, 7, "embedded", 100, 60)] + [(2, i, "render", 1, 1) for i in range(60)] + [(2, 100 + i, "embedded", 100, 100) for i in range(20)]
    got = records.select_images(spark.createDataFrame(rows, "doc_id long, page int, kind string, width int, height int")).collect()
    assert [(r.page, r.kind) for r in sorted(got, key=lambda r: r.page) if r.doc_id == 1] == [(5, "render"), (7, "embedded")]
    assert sum(r.doc_id == 2 and r.kind == "render" for r in got) == 40 and sum(r.doc_id == 2 and r.kind == "embedded" for r in got) == 10
    one = spark.createDataFrame([({"a": " x " * 200, "b": " ", "zz": "y"}, ["a", "b"])], "d map<string,string>, c array<string>").select(records.valid_descriptions(F.col("d"), F.col("c")).alias("v")).first().v
    assert list(one) == ["a"] and len(one["a"]) == 300
    asked = records.shared_questions(spark.range(30).withColumnRenamed("id", "question_id"), ["a", "b"]).collect()
    assert len(asked) == 20 and {r.question_id for r in asked} == set(range(10))
    bars = records.relative_bar(spark.createDataFrame([("p", 0.0), ("p", 50.0), ("p", None), ("p", 100.0)], "g string, v double"), ["g"], "v").collect()
    assert {r.v: r.bar for r in bars} == {0.0: 2.0, 50.0: 50.0, None: None, 100.0: 100.0}


def test_plans(spark):
    rows = [("application/pdf", 10, 0.1, False, 1, 0, 600, "report"), ("application/pdf", 40, 0.7, False, 0, 2, 10, "contract"), ("application/pdf", 5, 0.3, False, 0, 1, 10, "report"), ("text/html", 1, None, None, 0, 0, 10, "x"), ("text/plain", 1, None, True, 0, 3, 900, "x")]
    got = planner.plan(spark.createDataFrame(rows, "mime string, pages int, ocr_fraction double, cid_coded boolean, n_tables int, n_images int, words int, doc_type string")).collect()
    assert [r.parser for r in got] == ["native", "vision", "unified", "office", "plain"]
    assert "describe_tables" in got[0].steps and "caption_images" not in got[1].steps and "caption_images" in got[2].steps and got[4].steps == ["inspect", "parse", "chunk", "entities", "embed", "finalize"]
    parsed = spark.createDataFrame([("a", "unified", 40), ("a", "vision", 400), ("b", "unified", 500), ("b", "vision", 900)], "doc string, parser string, words int")
    assert {r.doc: r.parser for r in planner.rescue(parsed).collect()} == {"a": "vision", "b": "unified"}


def test_retry():
    class RateLimitError(Exception):
        pass

    class Status(Exception):
        def __init__(self, code):
            self.status_code = code

    waits, calls = [], []

    def flaky(error, times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "ok"

        calls.clear()
        return call

    assert provider.with_retry(flaky(RateLimitError(), 2), sleep=waits.append) == "ok" and waits[1] > waits[0]
    for error, tries in ((Status(400), 1), (Status(503), 3), (ValueError(), 1)):
        with pytest.raises(type(error)):
            provider.with_retry(flaky(error, 9), sleep=waits.append)
        assert len(calls) == tries


def test_all_entities_of_a_chunk_are_paired(spark, tmp_path):
    found = spark.createDataFrame([("c1", i, f"ORG:e{i:02d}") for i in range(40)], "chunk_id string, pos long, entity string")
    engine = Engine(spark, f"file://{tmp_path}/stores")
    held = {"chunks": spark.createDataFrame([(1, "c1", None)], "doc_id long, chunk_id string, table_name string"), "entities": found}
    engine._of = lambda key, job_id: held[key]
    pairs = engine.graph()["edges"].where("rel = 'co_occurs'").select("src", "dst").collect()
    assert {tuple(p) for p in pairs} == {(f"ORG:e{i:02d}", f"ORG:e{j:02d}") for j in range(40) for i in range(j)}


def _office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = _office({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Terms</w:t></w:r></w:p><w:p><w:r><w:t>{WORDS(80)}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Region</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Price</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>North</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1,000</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
S, R = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = _office({
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Month</t></si><si><t>Amount</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Jan</t></is></c><c r="C2"><v>12.5</v></c></row></sheetData></worksheet>',
})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = _office({f"ppt/slides/slide{i}.xml": f"<p {A}><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p><a:p><a:r><a:t>point</a:t></a:r></a:p></p>" for i in (10, 2)})


def test_engine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in {"c.docx": DOCX, "b.xlsx": XLSX, "d.pptx": PPTX, "broken.docx": b"PK\x03\x04 no", "p.html": f"<h1>Acme Corp</h1><p>{WORDS(90)}</p><table><tr><th>Item</th><th>Cost</th></tr><tr><td>Bolt</td><td>$ 3</td></tr></table>".encode(), "t.txt": f"# Notes\n\nOwner: Jane Smith\n\n{WORDS(70, 'note')}".encode()}.items():
        (folder / name).write_bytes(data)
    raw = files.raw_files(spark, str(folder))
    read = files.office(raw.where("path LIKE '%x'"))
    assert [r.error[:10] for r in read.where("kind = 'error'").collect()] == ["BadZipFile"]
    assert [r.text for r in read.where("path LIKE '%.pptx'").orderBy("pos").collect()] == ["Slide 2\npoint", "Slide 10\npoint"]
    assert [r.rows for r in read.where("kind = 'sheet_row'").orderBy("pos").collect()] == [[["Month", "", "Amount"]], [["Jan", "", "12.5"]]]
    engine = Engine(spark, f"file://{tmp_path}/stores")
    engine.ingest(str(folder), "job00001")
    engine.ingest(str(folder), "job00001")  # nothing is done twice
    assert engine.documents("job00001").count() == 6 and engine.documents("other").count() == 0
    assert engine.chunks("job00001", "table_summary").count() == 3 and engine.chunks("job00001", "prose").count() >= 3
    (folder.parent / "lang").mkdir()
    for name, said in {"a.txt": "Der Hund und die Katze sind nicht mit der Maus von nebenan befreundet.", "b.txt": "The dog and the cat went to the house of the mouse in the end.", "c.txt": "the end", "d.bin": "x"}.items():
        (folder.parent / "lang" / name).write_bytes(said.encode() if name != "d.bin" else b"\xff\x00" * 99)
    assert {r.filename: r.language for r in files.intake(files.raw_files(spark, str(folder.parent / "lang"))).collect()} == {"a.txt": "de", "b.txt": "en", "c.txt": "unknown", "d.bin": "unknown"}
    doc = engine.documents().where("filename = 'p.html'").first().doc_id
    assert [tuple(r)[1:] for r in engine.table(doc, "doc_table_1").collect()] == [("Bolt", 3.0)]
    with pytest.raises(LookupError):
        engine.table(doc, "doc_table_9")
    assert [r.value for r in engine.facts("job00001").collect()] == ["Jane Smith"]
    g = engine.graph("job00001")
    assert g["nodes"].where("type = 'entity'").count() > 0 and g["edges"].count() > 0
    assert {r.type for r in g["nodes"].select("type").distinct().collect()} == {"document", "chunk", "table", "entity"}
    far = graph.reach(g["edges"].drop("job_id"), g["nodes"].where("type = 'document'").select(F.col("key").alias("node")), 2)
    assert far.where("node LIKE 'Table:%' AND hops = 1").count() == 3 and far.where("node LIKE 'ORG:%' AND hops = 2").count() > 0
    assert [(r.job_id, r.run_status) for r in engine.status().collect()] == [("job00001", "completed")]
    assert {(r.status, r.duration_ms is not None, r.events) for r in engine.stages("job00001").collect()} == {("completed", True, 2)}
    questions = [(1, "note3 note4 note5", ["note3"]), (2, "Acme Corp", ["nothing of this"]), (3, "What is the average cost?", None), (4, "Owner", ["jane"]), (5, "What is the sum of amount?", None)]
    asked = spark.createDataFrame(questions, "question_id long, q string, keywords array<string>")
    answers = {r.question_id: r for r in engine.ask(asked, "job00001").collect()}
    assert len(answers) == 5 and 0 <= answers[1].confidence <= 1
    assert (answers[3].route, answers[3].reason, answers[3].sql_rows) == ("sql+vector", "ok", 1) and "3.0" in answers[3].answer and "====" in answers[3].context
    assert answers[4].route == "facts+vector" and "Jane Smith" in answers[4].answer and answers[4].context.startswith("Owner: Jane Smith") and answers[4].judge_score == 1.0
    assert answers[1].reason == "not_routed" and answers[2].judge_score == 0.0 and answers[1].trace.n_chunks == 5
    top = engine.chunks().where(F.col("chunk_id") == answers[1].chunk_ids[0]).first()
    assert "note3" in top.text
    assert engine.question_bank("job00001").count() > 0 and engine.storage_summary().count() >= 5
    small = tmp_path / "small"
    small.mkdir()
    (small / "t.txt").write_text(WORDS(70))
    engine.ingest(str(small), "0012")
    assert {r.job_id for r in engine.chunks("0012").collect()} == {"0012"} and engine.documents("12").count() == 0 and engine.documents("jobA").count() == 0
    engine.cancel("0012")
    assert {r.job_id: r.run_status for r in engine.status().collect()} == {"job00001": "completed", "0012": "cancelled"}
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader refuses
        engine.ingest(str(tmp_path / "missing"), "gone")
