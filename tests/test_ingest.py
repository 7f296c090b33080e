"""Ingestion end to end: nothing is lost, nothing is done twice, plans are followed and repaired."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import encodings
from docloom.operators import records, tables
from docloom.plans import planner
from docloom.plans.engine import Engine
from docloom.plans.provider import DOC_TYPES, Offline, Remote

WORDS = lambda n, w="word": " ".join(f"{w}{i}" for i in range(n))
S, R = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def book(rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{c}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("AB", row, strict=True)) + "</row>" for i, row in enumerate(rows))
    return office({"xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>"})


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "in"
    out.mkdir()
    return out


def test_no_text_is_lost(spark, tmp_path, folder):
    paragraph = WORDS(1600, "long")
    files = {
        "many.html": "".join(f"<h2>Part {i}</h2><p>{WORDS(12, f'p{i}x')}</p>" for i in range(500)).encode() + b"<p>here at last stands lasthtml</p>",
        "long.html": f"<p>{paragraph} lastlong</p>".encode(),
        "long.docx": office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>{paragraph} lastdocx</w:t></w:r></w:p></w:body></w:document>"}),
        "rows.xlsx": book([("Name", "Amount")] + [(f"name{i}", i) for i in range(5000)] + [("lastsheet", 1)]),
        "notes.md": f"# Title\n\n{WORDS(40, 'note')} lastmd\n".encode(),
        "data.csv": ("city;amount\n" + "".join(f"town{i};{i}.5\n" for i in range(300)) + "lastcsv;9\n").encode(),
        "data.xml": f"<root><v>{WORDS(30, 'xml')} lastxml</v></root>".encode(),
        "latin.txt": f"Les élèves français préfèrent l'été à Québec. {WORDS(30, 'é')} dernièrelatin".encode("latin-1"),
        "wide.txt": f"Größe und Straße {WORDS(40, 'wide')} lastwide".encode("utf-16-le"),
        "russian.txt": ("Вчера вечером мы долго говорили о новой книге, которую написал известный русский писатель. " * 4 + "последнее").encode("cp1251"),
        "plain": f"{WORDS(50, 'noname')} lastplain".encode(),
        "tiny.txt": b"just lasttiny",
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    engine = Engine(spark, f"file://{tmp_path}/stores")
    engine.ingest(str(folder), "job1")
    text = "\n".join(r.text for r in engine.chunks_of("job1").collect())
    for word in ("lasthtml", "lastlong", "lastdocx", "lastsheet", "lastmd", "lastcsv", "lastxml", "dernièrelatin", "lastwide", "последнее", "lastplain", "lasttiny", "p499x11", "long1599"):
        assert word in text, word
    kinds = {r.filename: r.encoding for r in engine.documents("job1").collect()}
    assert kinds["latin.txt"] == "iso8859-1" and kinds["wide.txt"] == "utf-16-le" and kinds["russian.txt"] == "cp1251" and kinds["notes.md"] == "utf-8"
    doc = engine.documents().where("filename = 'rows.xlsx'").first().doc_id
    assert engine.table(doc, "doc_table_1").count() == 5001
    doc = engine.documents().where("filename = 'data.csv'").first().doc_id
    assert engine.table(doc, "doc_table_1").agg(F.sum("amount")).first()[0] == sum(range(300)) + 150 + 9
    summary = {r.store: r for r in engine.storage_summary().collect()}
    assert summary["tables"].detail and summary["chunks"].detail["table_rows"] > 5 and all(r.bytes > 0 for r in summary.values() if r.rows)


def test_one_text_file_and_nothing_twice(spark, tmp_path, folder):
    """A corpus without tables and entities goes through; a second ingestion starts nothing; a changed file makes all anew."""
    (folder / "a.txt").write_text(WORDS(60))
    engine = Engine(spark, f"file://{tmp_path}/stores")
    engine.ingest(str(folder), "j")
    assert engine.chunks("j").count() == 1 and engine._of("tables", "j").count() == 0 and engine.columns("j").count() == 0
    assert engine.graph("j")["nodes"].count() == 2 and engine.facts("j").count() == 0
    assert engine.ask(spark.createDataFrame([(1, "word7 word8")], "question_id long, q string"), "j").first().reason == "not_routed"
    events = engine._table("events").count()
    engine.ingest(str(folder), "j")
    assert engine._table("events").count() == events
    with_crash = engine._stage

    def fails(number, key, *rest):
        if key == "facts":
            raise RuntimeError("stopped here")
        with_crash(number, key, *rest)

    (folder / "a.txt").write_text(WORDS(80, "other"))
    engine._stage = fails
    with pytest.raises(RuntimeError):
        engine.ingest(str(folder), "j")
    engine._stage = with_crash
    before = {r.stage: r.n for r in engine._table("completions").groupBy("stage").agg(F.count("*").alias("n")).collect()}
    engine.ingest(str(folder), "j")  # goes on where it stopped
    after = {r.stage: r.n for r in engine._table("completions").groupBy("stage").agg(F.count("*").alias("n")).collect()}
    assert {k for k in after if after[k] != before.get(k, 0)} == {"facts", "entities", "columns", "nodes", "edges", "lexical"}
    assert "other79" in engine.chunks("j").first().text and engine.chunks("j").count() == 1
    for f in folder.iterdir():
        f.unlink()
    (folder / "b.txt").write_text("  \n")
    engine.ingest(str(folder), "j")  # an empty result replaces the job's rows
    assert engine.chunks("j").count() == 0 and engine.documents("j").count() == 1


class Skips(Offline):
    """A planner that forgets summaries and a document."""

    def plan(self, inspected):
        made = planner.plan(inspected)
        steps = F.when(F.col("doc_type") == "contract", F.array(F.lit("inspect"))).otherwise(F.array_except("steps", F.array(F.lit("describe_tables"))))
        return made.withColumn("steps", steps)


def test_plan_is_followed_and_repaired(spark, tmp_path, folder):
    table = "<table><tr><th>Item</th><th>Cost</th></tr><tr><td>Bolt</td><td>3</td></tr></table>"
    (folder / "a.html").write_text(f"<h1>Shop</h1><p>{WORDS(60)}</p>{table}")
    (folder / "b.txt").write_text(f"This agreement binds each party under the clause on liability. {WORDS(50, 'deal')}")
    (folder / "c.txt").write_text("Jane Smith met Acme Corporation. " + WORDS(600, "prose"))
    (folder / "d.txt").write_text("John Miller met Other Company. " + WORDS(30, "few"))
    engine = Engine(spark, f"file://{tmp_path}/a", Skips())
    engine.ingest(str(folder), "agent1", pipeline="agent")
    plans = {r.doc_id: r for r in engine._of("plans", "agent1").collect()}
    names = {r.filename: r.doc_id for r in engine.documents().collect()}
    assert plans[names["b.txt"]].doc_type == "contract" and plans[names["b.txt"]].domain == "legal" and "contains_tables" in plans[names["a.html"]].content_flags
    # the steps that the plan leaves out were not done, and what the checks ask for was made afterwards
    assert engine._of("chunks", "agent1").where("chunk_type = 'table_summary'").count() == 0
    fixed = engine._of("repaired", "agent1").collect()
    assert {(r.doc_id, r.chunk_type) for r in fixed} == {(names["a.html"], "table_summary"), (names["b.txt"], "prose")}
    assert engine.chunks("agent1", "table_summary").count() == 1
    assert [r.payload for r in engine._table("events").where("stage = 'auto.repair'").collect()] == ["1 table summaries and 1 documents without a chunk"]
    found = {r.chunk_id.split("_d")[1].split("_")[0] for r in engine._of("entities", "agent1").collect()}
    assert found == {str(names["c.txt"])}  # entities only of long prose
    nodes = {r.key for r in engine.graph("agent1")["nodes"].collect()}
    assert f"Document:{names['b.txt']}" in nodes and any(k.startswith("Table:") for k in nodes)
    whole = Engine(spark, f"file://{tmp_path}/b")
    whole.ingest(str(folder), "custom1")
    assert whole._of("repaired", "custom1").count() == 0 and whole._of("entities", "custom1").count() > len(found)


def test_samples(spark):
    blocks = spark.createDataFrame([(1, i, f" block{i} ") for i in range(40)] + [(3, 0, "  ")], "doc_id long, pos long, text string")
    made = spark.createDataFrame([(1, 0, ["h"], [["x"]]), (2, 1, ["b", "c"], [["1", "2"]] * 30), (2, 0, [], [["only"]]), (2, 7, ["far"], [["away"]])], "doc_id long, table_pos long, headers array<string>, rows array<array<string>>")
    got = {r.doc_id: r.sample for r in records.samples(blocks, made).collect()}
    assert got[1].split("\n") == [f"block{i}" for i in range(25)]
    assert got[2].split("\n") == ["only", "b | c", *["1 | 2"] * 10]
    assert 3 not in got


def flaky(reply):
    """A model that is overloaded twice for each prompt, then answers; made here, so that it is sent to the tasks by value."""

    class OverloadedError(Exception):
        pass

    seen = {}

    def send(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if seen[prompt] < 3:
            raise OverloadedError
        return reply

    return send


def test_remote_provider_retries_and_falls_back(spark):
    df = spark.createDataFrame([(1, "An agreement of each party with a clause. Signed 2024-05-06 it was."), (2, ""), (3, None)], "i int, sample string").coalesce(1)
    good = '```json\n{"doc_type": "memo", "domain": "nonsense", "doc_type_confidence": 0.9, "content_flags": ["contains_code", "other"], "summary": "One. Two.", "key_dates": ["2024-01-01"]}\n```'
    ask = lambda reply, attempts=3: {r.i: r.c for r in df.select("i", Remote(flaky(reply), attempts, 0.001).classify(F.col("sample"), F.lit(False), F.lit(True)).alias("c")).collect()}
    got = ask(good)
    assert (got[1].doc_type, got[1].doc_type_confidence, got[1].domain, got[1].content_flags, got[1].summary) == ("memo", 0.9, "legal", ["contains_code"], "One. Two.")
    assert (got[2].doc_type, got[2].domain, got[2].doc_type_confidence) == ("other", "general", 0.0) and got[3].summary == "No text content available for analysis."
    for reply, attempts in (("no json at all", 3), (good, 2)):  # given up after two attempts
        ruled = ask(reply, attempts)[1]
        assert (ruled.doc_type, ruled.domain, ruled.key_dates) == ("contract", "legal", ["2024-05-06"]) and ruled.doc_type in DOC_TYPES
        assert ruled.content_flags == ["contains_figures"] and ruled.summary.startswith("An agreement")


def test_statements_run_once(spark, monkeypatch):
    spark.createDataFrame([(1.0,), (3.0,)], "cost double").createOrReplaceTempView("t_once")
    seen, real = [], spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: (seen.append(q), real(q, *a, **k))[1])
    got = tables.run_statements(spark, ["SELECT avg(cost) AS a FROM t_once;", "SELECT avg(cost) AS a FROM t_once;", "SELECT cost FROM t_once WHERE cost > 9", "SELECT nothing FROM nowhere"])
    assert len(seen) == 3 and [got[k][2].split(":")[0] for k in got] == ["ok", "no_rows", "execution_failed"] and got["SELECT avg(cost) AS a FROM t_once;"][1][0][0] == 2.0


def test_decoded_column_keeps_utf8_in_spark(spark):
    rows = spark.createDataFrame([(bytearray("plain ünï".encode()),), (None,)], "c binary").select(encodings.decoded(F.col("c")).alias("x")).collect()
    assert rows[0].x.text == "plain ünï" and rows[1].x.text is None
