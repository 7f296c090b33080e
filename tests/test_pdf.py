"""PDF files of several makes, damaged ones, and pages that only a model can read."""

import json
import zlib

from pyspark.sql import functions as F

from docloom.plans.engine import Engine
from docloom.plans.provider import Remote
from docloom.sources import pdf

WORDS = " ".join(f"word{i}" for i in range(60))


def made(objects, trailer=b"trailer\n<</Root 1 0 R>>\n"):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + trailer + b"%%EOF"


def stream(body, head=b""):
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(body), head, body)


def book(*contents, font=b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", more=None, resources=b"<</Font<</F1 3 0 R>>>>"):
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d/Resources %s>>" % (kids, len(contents), resources), 3: font} | (more or {})
    for i, c in enumerate(contents):
        objects |= {10 + 2 * i: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i), 11 + 2 * i: c if c.startswith(b"<<") else stream(c)}
    return objects


def texts(data):
    doc = pdf.Document(data)
    return [pdf.Page(doc, head, own).text() for head, own in doc.pages()]


def test_text_forms():
    body = rb"BT /F1 10 Tf 50 700 Td (Price \(net\): caf\351 \2444) Tj 0 -14 TD [(Sec) -20 (ond) -400 (line)] TJ T* <54 68 69 72 64> Tj (fourth) ' ET"
    assert texts(made(book(body))) == ["Price (net): café ¤4\nSecond line\nThird\nfourth"]
    packed = zlib.compress(body)
    assert texts(made(book(stream(packed, b"/Filter/FlateDecode")))) == texts(made(book(body)))
    # columns are read from left to right, whatever order they are drawn in; q and Q keep the place
    assert texts(made(book(b"q 1 0 0 1 100 0 cm BT /F1 10 Tf 200 700 Td (right) Tj ET Q BT /F1 10 Tf 50 701 Td (left) Tj ET"))) == ["left right"]
    # an inline image's bytes are no operators
    assert texts(made(book(b"BI /W 2 /H 2 ID \xff(\x00<[ EI BT /F1 10 Tf (seen) Tj ET"))) == ["seen"]


def test_fonts():
    names = b"<</Type/Font/Subtype/Type1/BaseFont/A/Encoding<</Differences[65/eacute/fi/uni20AC/three]>>>>"
    assert texts(made(book(b"BT /F1 9 Tf (ABCDz) Tj ET", font=names))) == ["éfi€3z"]
    two = b"<</Type/Font/Subtype/Type0/BaseFont/A/Encoding/Identity-H/ToUnicode 4 0 R/DescendantFonts[5 0 R]>>"
    told = stream(b"2 beginbfchar <0001> <0048> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <00590059>] endbfrange")
    own = b"<</Type/Font/Subtype/CIDFontType2/W[1[600 700]16 18 500]/DW 1000>>"
    assert texts(made(book(b"BT /F1 9 Tf <00010002001000120020002100FF> Tj ET", font=two, more={4: told, 5: own}))) == ["H😀acXYY(cid:255)"]


def test_object_streams_updates_and_forms():
    plain = book(b"BT /F1 9 Tf (old) Tj ET")
    inner = [(n, plain.pop(n)) for n in (2, 3, 10)]
    heads, bodies = b"", b""
    for n, b in inner:
        heads, bodies = heads + b"%d %d " % (n, len(bodies)), bodies + b + b" "
    rows = zlib.compress(b"".join(b"\x02" + row for row in (b"\x01\x02", b"\x01\x01")))
    plain[20] = stream(zlib.compress(heads + bodies), b"/Type/ObjStm/N 3/First %d/Filter/FlateDecode" % len(heads))
    plain[21] = stream(rows, b"/Type/XRef/Root 1 0 R/Filter/FlateDecode")
    data = made(plain, b"startxref\n7\n")
    assert texts(data) == ["old"]
    form = stream(b"BT /F1 9 Tf (new) Tj ET", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 5 5]")
    later = made({11: stream(b"/X1 Do"), 2: b"<</Type/Pages/Kids[10 0 R]/Resources<</Font<</F1 3 0 R>>/XObject<</X1 30 0 R>>>>>>", 30: form}, b"")
    assert texts(data + later) == ["new"]
    doc = pdf.Document(data)
    assert doc.decoded(pdf.Stream({"Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 2}}, rows)) == b"\x01\x02\x02\x03"
    assert doc.decoded(pdf.Stream({"Filter": [pdf.Name("ASCII85Decode")]}, b"87cURD]i,\"Ebo80~>")) == b"Hello World!"


def test_damaged_files_are_rows(spark):
    good = made(book(f"BT /F1 9 Tf ({WORDS}) Tj ET".encode()))
    rows = [(1, good), (2, b"no pdf at all"), (3, None), (4, b""), (5, good.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R")), (6, made(book(b"BT ET", stream(b"xx", b"/Filter/FlateDecode"), stream(b"", b"/Filter/NoSuch")))), (7, good[:-40]), (8, made({1: b"<</Type/Catalog>>"}))]
    found = {(r.doc_id, r.page): r for r in pdf.judged(pdf.pages(spark.createDataFrame(rows, "doc_id long, content binary"))).collect()}
    assert found[1, 1].clean == WORDS and found[1, 1].layer == "native" and found[7, 1].clean == WORDS
    assert all(found[n, None].error and found[n, None].layer == "broken" for n in (2, 3, 4)) and "encrypted" in found[5, None].error
    assert found[6, 1].layer == "scanned" and found[6, 2].error and found[6, 3].error and found[6, 3].pages == 3
    assert not any(n == 8 for n, _ in found)
    assert pdf.pages(spark.createDataFrame([], "doc_id long, content binary")).count() == 0


def test_replies(spark):
    good = {"prose_text": " some prose ", "tables": [{"description": "d", "headers": ["a"], "rows": [["1"]]}, {"headers": [], "rows": [["1"]]}, {"headers": ["a"], "rows": []}]}
    replies = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", "no json", '{"prose_text": "cut', None, "{}", "[1]"]
    df = spark.createDataFrame(list(enumerate(replies)), "i long, reply string").select("i", pdf.structured(F.col("reply")).alias("r")).orderBy("i")
    got = [(r.r.prose, [(t.headers, t.rows) for t in r.r.tables]) for r in df.collect()]
    table = [(["a"], [["1"]])]
    assert got == [("some prose", table), ("some prose", table), ("no json", []), ('{"prose_text": "cut', []), ("", []), ("", []), ("[1]", [])]


def test_ingest(spark, tmp_path):
    def see(data, kind):
        """A model that reads one page; an image that is not JPEG breaks it."""
        if not data.startswith(b"\xff\xd8") or kind != "jpeg":
            raise ValueError("no image")
        return json.dumps({"prose_text": "scannedprose stands here", "tables": [{"description": "", "headers": ["City", "Amount"], "rows": [["Rome", "3"], ["Bern", "4"]]}]})

    folder = tmp_path / "in"
    folder.mkdir()
    image = stream(b"\xff\xd8\xff\xe0scan", b"/Type/XObject/Subtype/Image/Width 900/Height 1200/Filter/DCTDecode")
    both = b"<</Font<</F1 3 0 R>>/XObject<</I 30 0 R>>>>"
    long = b"BT /F1 9 Tf 12 TL 40 800 Td " + b" ".join(f"(line{i} {WORDS[:60]}) Tj T*".encode() for i in range(200)) + b" (lastpdf) Tj ET"
    (folder / "a.pdf").write_bytes(made(book(long, b"/I Do", more={30: image}, resources=both)))
    (folder / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    coded = b"<</Type/Font/Subtype/Type0/BaseFont/A/Encoding/Identity-H>>"
    (folder / "c.pdf").write_bytes(made(book(b"BT /F1 9 Tf <" + b"0041" * 40 + b"> Tj ET", font=coded)))
    engine = Engine(spark, f"file://{tmp_path}/stores", Remote(lambda prompt: "", base=0.0, see=see))
    engine.ingest(str(folder), "j", "agent")
    names = {r.doc_id: r.filename for r in engine.documents("j").collect()}
    text = {n: " ".join(r.text for r in engine.chunks_of("j").collect() if names[r.doc_id] == n) for n in names.values()}
    assert "lastpdf" in text["a.pdf"] and "line199" in text["a.pdf"] and "scannedprose" in text["a.pdf"] and not text["b.pdf"] and "cid" not in text["c.pdf"]
    doc = next(k for k, n in names.items() if n == "a.pdf")
    name = engine._of("tables", "j").first().table_name
    assert engine.table(doc, name).agg(F.sum("amount")).first()[0] == 7
    plans = {names[r.doc_id]: r for r in engine._of("plans", "j").collect()}
    assert plans["a.pdf"].pages == 2 and plans["a.pdf"].ocr_fraction == 0.5 and plans["a.pdf"].parser == "unified" and plans["a.pdf"].n_images == 1
    assert plans["c.pdf"].cid_coded and plans["c.pdf"].parser == "vision" and "caption_images" in plans["a.pdf"].steps
    assert [r.error for r in engine._of("parsed", "j").where("kind = 'error'").collect()][0].startswith("ValueError")


def test_work_by_page(spark, monkeypatch):
    """Words are split once a document, not once a page; fonts are read once a file; pages come in bounded frames."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1500))), (2, None)], "doc_id long, text string")
    made = pdf.written(docs)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    doc = pdf.Document(made.where("doc_id = 1").first().content)
    pages = [pdf.Page(doc, *p) for p in doc.pages()]
    assert len(pages) == 5 and len(doc.fonts) == 1
    monkeypatch.setattr(pdf, "GIVEN", 1)
    got = {(r.doc_id, r.page): r.text for r in pdf.pages(made).collect()}
    assert len(got) == 6 and got[2, 1] == "" and got[1, 5].split() == [f"w{i}" for i in range(1200, 1500)]
