"""Encodings and web pages against the standard library."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import encodings, languages
from docloom.sources import markup

TEXTS = {
    "fr": "Le conseil a décidé, après une longue séance, d’accepter le projet présenté l’été dernier. Où êtes-vous allés ? Ça coûte très cher à l’élève français.",
    "de": "Die Größe der Straße überraschte alle Bürger. Für schöne Häuser müssen wir früh aufstehen und über Äpfel und Öl sprechen.",
    "es": "El niño comió mañana en el jardín. ¿Dónde está la señora? ¡Qué día tan bonito para la canción española!",
    "pl": "Zażółć gęślą jaźń. Wczoraj wieczorem łódź płynęła powoli, a dzieci śpiewały piękną pieśń o miłości i wolności.",
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy. Včera jsme šli přes řeku a viděli krásné město s věžemi.",
    "ru": "Вчера вечером мы долго говорили о новой книге, которую написал известный русский писатель. Она стоит недорого.",
    "el": "Το παιδί πήγε στο σχολείο και διάβασε ένα ωραίο βιβλίο για την ιστορία της Ελλάδας και των άλλων χωρών.",
    "ja": "昨日は友達と一緒に東京へ行きました。天気がとてもよかったので、公園で写真をたくさん撮りました。",
}
CODECS = {"fr": ["cp1252", "utf-16-le", "utf-16-be", "utf-8"], "de": ["iso8859-1", "utf-16-le"], "es": ["iso8859-1", "cp1252", "utf-16-be"], "pl": ["cp1250", "iso8859-2", "utf-16-le"], "cs": ["cp1250", "iso8859-2"], "ru": ["cp1251", "koi8-r", "iso8859-5", "utf-16-le", "utf-16-be"], "el": ["cp1253"], "ja": ["cp932", "euc_jp", "utf-16-le", "utf-16-be"]}


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_samples(lang):
    for codec in CODECS[lang]:
        text = TEXTS[lang] if codec.startswith("utf") else TEXTS[lang].encode(codec, "ignore").decode(codec)
        assert encodings.decode(text.encode(codec))[1] == text, codec


def test_documents_encoded_each_way(spark, sf_dir):
    """Texts of documents as files of each encoding come back whole, at least 95 of 100."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(60).collect()
    for codec in ("cp1252", "iso8859-1", "utf-16-le", "utf-16-be", "cp1250", "utf-8"):
        files = []
        for r in rows:
            text = r.text.encode(codec, "ignore").decode(codec)
            files.append((r.doc_id, bytearray(text.encode(codec)), text))
        got = spark.createDataFrame(files, "i long, content binary, text string").select((encodings.decoded(F.col("content"))["text"] == F.col("text")).alias("same")).collect()
        assert sum(bool(r.same) for r in got) >= 0.95 * len(files), codec


def test_marks_and_binaries(spark):
    cases = [b"\xef\xbb\xbfabc", b"\xff\xfea\0b\0", b"\xfe\xff\0a\0b", b"plain", b"", None, bytes(range(256)) * 4, b"\x89PNG\r\n\x1a\n" + bytes(random.Random(1).randbytes(400)), "é".encode("latin-1") * 0 + "un café très près".encode("latin-1")]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, content binary").select("i", encodings.decoded(F.col("content")).alias("x")).orderBy("i").collect()
    assert [r.x.text for r in rows[:6]] == ["abc", "ab", "ab", "plain", "", None]
    assert [r.x.encoding for r in rows[:5]] == ["utf-8-sig", "utf-16-le", "utf-16-be", "utf-8", "utf-8"]
    assert rows[6].x.text is None and rows[7].x.text is None and rows[8].x.text == "un café très près"


def blocks(html):
    page = markup.Page(html)
    return page.blocks, [[r for r in t.rows if r] for t in page.tables]


def test_nesting():
    assert blocks("<ul><li><p>first paragraph of it</p><p>second paragraph of it</p></li><li>next item of the list</ul>")[0] == [(0, "first paragraph of it"), (0, "second paragraph of it"), (0, "next item of the list")]
    assert blocks("<p>unclosed paragraph one<p>unclosed paragraph two<h2>Head <b>ing</b></h2>loose text of the body")[0] == [(0, "unclosed paragraph one"), (0, "unclosed paragraph two"), (2, "Head ing"), (0, "loose text of the body")]
    assert blocks("<pre><code>int main(void) { return 1 &lt; 2; }</code></pre>")[0] == [(0, "int main(void) { return 1 < 2; }")]
    assert blocks("<p>running <code>code()</code> within a text</p>")[0] == [(0, "running code() within a text")]
    found, tables = blocks("<table><tr><th>a<th>b<tr><td>1<td>2 <table><tr><td>inner</td></tr></table> tail</table><p>after the table it goes on</p>")
    assert tables == [[["a", "b"], ["1", "2 tail"]], [["inner"]]] and found == [(0, "after the table it goes on")]
    assert blocks("<ul><li>outer item with a list<ul><li>inner item of the list</li></ul>and more of the outer</li></ul>")[0] == [(0, "outer item with a list"), (0, "inner item of the list"), (0, "and more of the outer")]
    assert blocks("<script>if (a < b) { '</p>' }</script><style>p{}</style><!-- <p>hidden hidden hidden</p> --><p>seen and not hidden</p>")[0] == [(0, "seen and not hidden")]
    assert blocks("<p>short</p>")[0] == [] and blocks("")[0] == [] and blocks("<<<>>> no tags & none &amp; more")[0]
    assert blocks('<p title="a > b">attribute with a bracket</p>')[0] == [(0, "attribute with a bracket")]
    long = "word " * 4000
    assert blocks(f"<div><p>{long}last</p></div>")[0] == [(0, f"{long}last")]


class Texts(HTMLParser):
    """All text of a page outside scripts and the like, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.held, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "noscript", "title")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "noscript", "title") and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.held += data.split()


def test_every_word_once(spark, sf_dir):
    """On all web pages: blocks, cells and what is too short to be a block hold each word of the page, once."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    kept = every = 0
    for r in rows:
        other = Texts()
        other.feed(r.html)
        page = markup.Page(r.html)
        assert page.words == len(other.held), r.page_id
        held = [w for _, t in page.blocks for w in t.split()] + [w for t in page.tables for row in t.rows for c in row for w in c.split()]
        assert set(held) <= set(other.held)
        kept, every = kept + len(held), every + len(other.held)
    assert kept >= 0.9 * every
    found = markup.pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert found.where("kind = 'page'").count() == len(rows)
    some = found.where("kind = 'block' AND page_id = 1").orderBy("pos").collect()
    assert [b.level > 0 for b in some] == sorted((b.level > 0 for b in some), reverse=True)


def test_language_profiles(spark, sf_dir):
    """Learned on three of four documents, the others' languages are told, 97 of 100; what has no profile is unknown."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    known = languages.profiles(docs.where("doc_id % 4 <> 1"))
    assert known.groupBy("lang").count().where(f"count > {languages.MOST}").count() == 0
    tell = languages.detector(known)
    rows = docs.where("doc_id % 4 = 1 AND lang IS NOT NULL AND length(text) > 100").select("lang", tell(F.col("text")).alias("told")).collect()
    assert sum(r.lang == r.told for r in rows) >= 0.97 * len(rows) and len(rows) > 100
    other = spark.createDataFrame([(TEXTS["ru"],), (TEXTS["ja"],), ("short",), (None,), ("12345 67890 " * 20,)], "t string").select(tell(F.col("t")).alias("told")).collect()
    assert {r.told for r in other} == {"unknown"}
    none = languages.detector(languages.profiles(docs.limit(0)))
    assert spark.range(1).select(none(F.lit("any text of some length that has letters")).alias("x")).first().x == "unknown"


def test_grams():
    """Counted by arrays, in the order that counting text by text gives."""
    from collections import Counter

    for t in (None, "", "12 _ !", "a", "Ab ab ÀB x_y İstanbul 𐐀𐐁 a a", "the cat " * 2000):
        plain = Counter()
        for word in languages._WORD.findall((t or "")[: languages.HEAD].lower()):
            marked = f"_{word}_"
            plain.update(g for n in (1, 2, 3) for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) != "_")
        codes, counts = languages.grams(t)
        assert isinstance(codes, np.ndarray)
        assert dict(zip(map(languages.gram_text, codes.tolist()), counts.tolist(), strict=True)) == plain
        assert [languages.gram_text(c) for c in languages.ranked(codes, counts).tolist()] == sorted(plain, key=lambda g: (-plain[g], g))[: languages.MOST]
        assert all(languages.gram_code(languages.gram_text(c)) == c for c in codes.tolist())
