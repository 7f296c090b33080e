"""The evaluation report's files, and pipelines that run at once."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.numeric import iso_seconds
from docloom.operators import report
from docloom.plans.engine import STORES, Engine


def test_report_files(spark, tmp_path):
    rows = [(2, "why\nso?", "sql", "b", "x" * 600, 0.9, True, 0.00125, 10, 5, 100), (10, "how?", "sql", None, None, 0.5, False, None, None, None, None), (3, None, None, "a", "said", None, None, 0.5, 1, 1, 1), (11, "q", "graph", "a", "z", 0.1234, True, 0.0, 0, 0, 7)]
    graded = spark.createDataFrame(rows, "question_id long, q string, route string, category string, answer string, score double, keyword_pass boolean, cost double, tokens_in long, tokens_out long, wall_ms long")
    path = f"file://{tmp_path}/out"
    report.write_report(graded, path)
    lines = [r.value for r in spark.read.text(f"{path}/report").select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert lines[0] == "# Evaluation" and "- questions: 4" in lines and "- cost in dollars: 0.5013" in lines and "- milliseconds: 108" in lines
    assert "| correct | 1 | 25 |" in lines and "| error | 1 | 25 |" in lines and "| keywords found | 2 | 50 |" in lines
    assert "| sql | 2 | 1 | 1 | 0.700 |" in lines and "| ? | 1 | 0 | 0 | — |" in lines and "| 11 | graph | incorrect | 0.123 | yes | 7 |" in lines
    gaps = lines[lines.index("## Not correct") + 1 : lines.index("## All answers")]
    assert [g.split(" ")[1] for g in gaps] == ["3", "10", "11"] and not any("x" * 100 in line for line in gaps)
    assert lines.index("## By route") < lines.index("## By category") < lines.index("## All answers")
    assert spark.read.json(f"{path}/results").count() == 4
    empty = [r.line for r in report.report_lines(graded.limit(0)).collect()]
    assert "- questions: 0" in empty and "| correct | 0 | 0 |" in empty
    assert report.report_lines(graded.select("question_id", "score")).where("section = 6 AND place >= '1'").count() == 4


def test_times_and_shown(spark):
    rows = [("2024-01-01T00:00:00Z", "2024-01-02T00:00:01Z"), ("2024-01-01T00:00:00Z", "soon"), (None, "2024-01-01T00:00:00Z"), ("2024-01-01T00:00:00Z", "2024-13-01T00:00:00Z")]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(iso_seconds(F.col("a"), F.col("b"))).collect()] == [86401.0, None, None, None]
    asked = spark.createDataFrame([(0, "s0"), (1, "s1"), (2, None), (3, "s3")], "idx long, sql string")
    shown = spark.createDataFrame([(0, ["c"], [["1"]]), (1, [], []), (2, None, None)], "idx long, sql_cols array<string>, sql_rows array<array<string>>")
    assert {r.idx: (r.rerun, r.sql_rows) for r in report.reuse_shown(asked, shown).collect()} == {0: (False, [["1"]]), 1: (True, None), 2: (False, None), 3: (True, None)}


def test_pipelines_at_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.html").write_text(f"<h1>Part {n}</h1><p>John Miller of Acme Corporation wrote {' '.join(f'word{n}x{i}' for i in range(60))}</p><table><tr><th>Item</th><th>Cost</th></tr><tr><td>Bolt</td><td>{n}</td></tr></table>")
    engine = Engine(spark, f"file://{tmp_path}/both")
    assert engine.ingest_all(str(folder), {"custom": "jobc", "agent": "joba"}) == {"jobc": None, "joba": None}
    alone = Engine(spark, f"file://{tmp_path}/alone")
    alone.ingest(str(folder), "joba", "agent")
    for store in STORES:
        if store not in ("repaired", "events"):
            assert engine._of(store, "joba").count() == alone._of(store, "joba").count(), store
    # neither log has lost a row to the other's
    held = {r.job_id: r["count"] for r in engine._of("completions", None).groupBy("job_id").count().collect()}
    assert held["jobc"] == held["joba"] == alone._of("completions", "joba").count()
    assert {r.run_status for r in engine.status().collect()} == {r.run_status for r in alone.status().collect()}
    with pytest.raises(ValueError):
        engine.ingest_all(str(folder), {"custom": "same", "agent": "same"})
    failed = engine.ingest_all(f"{folder}/missing", {"custom": "lost"})
    assert failed["lost"]
    asked = spark.createDataFrame([(1, "Who wrote word1x5?", ["Miller"])], "question_id long, q string, keywords array<string>")
    engine.report(engine.ask(asked, "jobc"), f"file://{tmp_path}/report")
    assert any(r.value.startswith("- questions: 1") for r in spark.read.text(f"file://{tmp_path}/report/report").collect())
