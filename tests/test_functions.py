"""Expressions on hand-made cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import checks, garbage, mime, numeric, text, vector


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell,want", [
    ("3,000.00", 3000.0), ("P 100,000,000.00", 1e8), ("₱ 35,018", 35018.0), ("(123)", -123.0), ("DECLINED TO BID", None), ("74%", None), ("", None), (None, None), ("nan", None), ("1_000", None), ("1d", None), ("$5", 5.0), ("-2.5e3", -2500.0), ("(1,2", None), (".5", 0.5), ("€ (7)", -7.0), ("p 12", 12.0), ("P(3)", None), ("(P 3)", None), ("p (1,000.5)", -1000.5),
])
def test_parse_number(spark, cell, want):
    assert _one(spark, numeric.parse_number(F.lit(cell).cast("string"))) == want


def test_identifiers(spark):
    got = [_one(spark, numeric.safe_identifier(F.lit(x).cast("string"))) for x in ("Net New MRR ($)", "__a--b__", "", None, "Größe", "日本", "A")]
    assert got == ["net_new_mrr", "a_b", "col", "col", "gr_e", "col", "a"]


def test_value_format(spark):
    got = [_one(spark, numeric.format_value(F.lit(v), F.lit(k), F.lit(u))) for v, k, u in (("1234567", "number", "kg"), ("1234.5", "currency", ""), ("2020-01-01", "date", ""), ("n/a", "number", "x"))]
    assert got == ["1,234,567 kg", "1,234.50", "2020-01-01", "n/a x"]


def test_tokens(spark):
    assert _one(spark, F.size(text.tokens(F.lit("  a b\t c\n")))) == 3
    assert [_one(spark, text.estimated_tokens(F.lit(t).cast("string"))) for t in (None, "", "a", "a b c", " ".join("w" * 20))] == [1, 1, 1, 4, 27]


def test_quotes_and_fences(spark):
    assert _one(spark, text.holds_quote(F.lit("The  Quick\nbrown fox"), F.lit("quick BROWN")))
    assert not _one(spark, text.holds_quote(F.lit("abc"), F.lit(" ")))
    assert not _one(spark, text.holds_quote(F.lit(None).cast("string"), F.lit("x")))
    assert _one(spark, text.without_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert _one(spark, text.cut(F.lit("x" * 20), 5, "!")) == "xxxxx!"


def test_keywords(spark):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(text.keyword_grade(F.lit("We are done in two days"), F.array(F.lit("2"), F.lit("done"), F.lit("1"), F.lit("three"))), ("ok", "missing"), strict=True)]).first()
    assert not row.ok and row.missing == ["three"]  # "done" holds "one"


@pytest.mark.parametrize("t,cid,gib", [
    ("(cid:12)(cid:7)(cid:99) some more text", True, False), ("(cid:1)", False, False), ("plain words " * 10, False, False), ("#" * 100, False, True), ("zzzzzz bcdfg xxxxxx kkkkkk " * 5, False, True), ("12345 !!! " * 10, False, True), ("Съешь же ещё этих мягких французских булок да выпей чаю. " * 2, False, False), ("これは日本語の文章です。段落が続きます。" * 6, False, False), ("Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και aei " * 2, False, False), ("a1 " * 40, False, False), ("b 1 2 " * 20, False, True), ("\u2028a" * 60, False, False), (None, False, False), ("", False, False),
])
def test_garbage(spark, t, cid, gib):
    c = F.lit(t).cast("string")
    assert _one(spark, garbage.is_cid_garbage(c)) is cid and _one(spark, garbage.is_gibberish(c)) is gib


def test_mock_vectors(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "t string").select("t", vector.mock_embedding(F.col("t"), 16).alias("v"))
    rows = df.collect()
    for r in rows:
        want, state = [], int(hashlib.sha256(r.t.encode()).hexdigest(), 16) % 2**64
        for _ in range(16):
            state = (state * vector.MULTIPLIER + vector.INCREMENT) % 2**64
            want.append(((state >> 17) & 0xFFFF) / 32768 - 1)
        assert np.allclose(r.v, np.array(want) / np.linalg.norm(want), atol=1e-6)
    assert rows[0].v == rows[2].v and rows[0].v != rows[1].v
    assert abs(_one(spark, vector.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0)))) - 1) < 1e-12


def test_files(spark):
    rows = [("a/x.pdf", b"%PDF-1.4 /Font", "application/pdf", "text-native-pdf", "pdf-internal"), ("x.pdf", b"%PDF-1.4", "application/pdf", "scanned-pdf", "pdf-internal"), ("y.docx", b"PK\x03\x04..", mime.BY_EXTENSION["docx"], "docx-document", "utf-8"), ("z.bin", b"<!DOCTYPE html><p>", "text/html", "html-document", "utf-8"), ("n", "Größe".encode(), "text/plain", "plain-text", "utf-8"), ("t.csv", b"a,b", "text/csv", "plain-text", "utf-8"), ("w.doc", b"\xd0\xcf\x11\xe0..", "application/msword", "docx-document", "unknown"), ("s.xls", b"\xd0\xcf\x11\xe0..", "application/vnd.ms-excel", "spreadsheet-xlsx", "unknown"), ("n.dat", b"\xff\xfea\x00", mime.UNKNOWN, "unknown", "utf-16-le")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c, *_ in rows], "path string, content binary")
    df = df.withColumn("mime", mime.mime(F.col("content"), F.col("path")))
    got = df.select("path", "mime", mime.sub_structure(F.col("mime"), F.col("content")).alias("s"), mime.encoding(F.col("mime"), F.col("content")).alias("e")).collect()
    assert [(r.mime, r.s, r.e) for r in got] == [r[2:] for r in rows]


def test_checks(spark):
    df = spark.createDataFrame([(5, 100.0, 30, 95.0), (0, None, None, 0.0)], "chunks int, avg_tokens double, min_tokens int, coverage double")
    got = df.select(checks.stage_checks("chunk").alias("c")).select("c", checks.pass_rate(F.col("c")).alias("r")).collect()
    assert got[0].r == 1.0 and got[1].r == 0.0 and {c.severity for c in got[1].c} == {"error", "warn"} and {c.severity for c in got[0].c} == {"info"}
    assert all(len(v) >= 3 for v in checks.CATALOGUE.values())


def test_language_words_once(spark):
    """The words of a text are made once, not once a language and use."""
    df = spark.createDataFrame([("der Hund und die Katze " * 4,), ("le chat et les chiens sont dans la maison " * 3,), ("the",), (None,), ("xx " * 40,)], "t string").coalesce(1)
    told = df.select(text.language(F.col("t")).alias("l"))
    assert [r.l for r in told.collect()] == ["de", "fr", "unknown", "unknown", "unknown"]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
