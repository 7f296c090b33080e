"""License scans against a plain reading; held-out accuracy of languages and quality."""

import re
import time
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language, licenses, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


CASES = [
    ("Released under the MIT License.", "mit"), ("under the mit license under THE\nMIT-LICENSE", "mit"), ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("Copyright 2020 X. All rights reserved.", "all-rights-reserved"), ("shared under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    ("nothing of the kind, und die submitted licence", ""), ("éunder the mit license", "mit"), ("under the mit licensed", ""), ("", ""), (None, ""), ("apache license version 2" + " word" * 50_000 + " cc by nc", "apache-2,cc-by-nc"),
    ("cc by nc by nc cc by nc", "cc-by-nc"),
]


def test_licenses(spark, sf_dir):
    assert len(licenses.rules()) > 200
    docs = spark.createDataFrame([(i, t, "labels", 0.5) for i, (t, _) in enumerate(CASES)] + [(None, "cc by nc", "", 0.0)], "doc_id long, text string, labels string, score double")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, (text, labels) in enumerate(CASES):
        n, places = _plain(text)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(places)), text
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert r.labels == labels and 0 <= r.score <= 1 and (r.score > 0) == bool(labels), text
    assert got[None].n_base == 1
    assert licenses.scan(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in licenses.op5_licenses(spark, sf_dir).collect():
        n, places = _plain(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert {x for _, x in places} <= set(r.labels.split(","))


def test_gate_and_keywords_lose_nothing():
    """A rule's match always holds its keyword and passes the gate."""
    samples = [t for t, _ in CASES if t] + [f"licensed under the {n} license; {n} license: {n}" for n in ("bsd", "isc", "boost", "ruby", "x11", "zlib", "cc0", "0bsd", "agpl-3", "creative commons attribution-sharealike 4.0", "mozilla public license 2.0", "sil open font license", "cc by-nd")]
    for t in samples:
        low = t.lower()
        plain = {r.label for r in licenses.rules() if r.pattern.search(low)}
        gated = {r.label for k, some in licenses._by_keyword().items() if k in low for _, r in some if r.pattern.search(low)}
        assert gated == plain, t
        assert bool(plain) == bool(licenses.detect(low))


def _spellings(pattern, blank, rng):
    """A text that the pattern matches: blanks as given, optional parts and alternatives by chance."""
    from re import _constants as C
    from re import _parser

    def one(nodes):
        out = ""
        for op, arg in nodes:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.ANY:
                out += "x"
            elif op is C.IN:
                kind, value = arg[0]
                out += {C.LITERAL: lambda v: chr(v), C.RANGE: lambda v: chr(v[0]), C.CATEGORY: lambda v: "1"}[kind](value)
            elif op is C.BRANCH:
                out += one(arg[1][rng.integers(len(arg[1]))])
            elif op is C.SUBPATTERN:
                out += one(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, inner = arg
                if len(inner) == 1 and inner[0][0] is C.IN and (C.CATEGORY, C.CATEGORY_SPACE) in inner[0][1]:
                    out += blank
                else:
                    out += "".join(one(inner) for _ in range(rng.integers(least, min(most, least + 1) + 1)))
        return out

    return one(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE))


def test_no_spelling_is_lost():
    """Wrapped, commented and compact spellings of every rule reach it through gate and keyword."""
    rng = np.random.default_rng(0)
    for blank in (" ", "\n", "\n# ", "\n * ", "  ", '" '):
        for rule in licenses.rules():
            for _ in range(3):
                low = _spellings(rule.pattern, blank, rng)
                assert rule.pattern.search(low), (rule, low)
                assert any((r.label, r.priority) == (rule.label, rule.priority) and r.pattern.search(low) for _, r in licenses._due(low)), (rule, low)
    cases = [("released under the GNU General\n# Public License version 3", "gpl-3"), ("Copyright X. All rights\n * reserved.", "all-rights-reserved"), ("is in the public\n# domain", "public-domain"), ("License:MIT", "mit"), ("released under GPLv3", "gpl-3"), ("SPDX-License-Identifier:ISC", "isc"), ("Mozilla Public License, v2.0", "mpl-2"), ("Apache License, Version2.0", "apache-2"), ("the PSF license", "python-2"), ("under Creative Commons\n// Attribution-Non-Commercial-ShareAlike 4.0", "cc-by-nc-sa")]
    for text, label in cases:
        assert {r.label for _, _, r in licenses.detect(text.lower())} == {label}, text


def _all_pairs(low):
    """Detections by comparing each with all that were taken before."""
    taken = []
    for rule in licenses.rules():
        for m in rule.pattern.finditer(low):
            if not any(s <= m.start() and m.end() <= e for s, e, _ in taken):
                taken.append((m.start(), m.end(), rule))
    return sorted(taken, key=lambda x: x[:2])


def test_suppression():
    """The sorted intervals against all pairs, on texts of many overlapping references."""
    rng = np.random.default_rng(2)
    parts = ["released under the", "mit license", "gnu lesser general public license version 2.1", "gpl v3", "license: bsd-3-clause", "under the apache license, version 2.0", "all rights reserved", "x", "the", "copyright (c) y", "cc by-nc-sa 4.0"]
    for _ in range(60):
        low = " ".join(rng.choice(parts, 30))
        assert licenses.detect(low) == _all_pairs(low)
    covered, kept = licenses.Covered(), []
    for a, b in rng.integers(0, 60, (3000, 2)).tolist():
        a, b = min(a, b), max(a, b)
        inside = any(s <= a and b <= e for s, e in kept)
        assert covered.holds(a, b) == inside
        if not inside:
            covered.add(a, b)
            kept.append((a, b))


def test_many_detections(spark):
    """Time in proportion to the text; rows alike have equal results."""
    low = "under the mit license " * 45_000
    began = time.process_time()
    assert len(licenses.detect(low)) == 45_000
    assert time.process_time() - began < 12
    rows = [r.asDict() for r in licenses.scan(spark.createDataFrame([(1, "GPL v3, MIT license"), (1, "GPL v3, MIT license")], "doc_id long, text string")).drop("spans").collect()]
    assert rows[0] == rows[1] and rows[0]["labels"] == "gpl-3,mit"


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.op4_language(spark, sf_dir).collect()
    assert len(got) == len(known) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([known[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_language_cases(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in ((f"der die und das nicht {i}", "de"), (f"the and of with {i}", "en"))]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    rows += [(1000, None, "de"), (1001, "", None), (1002, "123 !!", "en"), (1003, "der " * 50_000, None), (None, "die und das", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de" and got[None].lang_pred == "de"
    empty = language.train(docs.limit(0))
    assert [r.lang_pred for r in language.identify(docs.limit(3), empty).collect()] == ["und"] * 3


def test_many_languages(spark):
    """More than eight languages need the wide masks."""
    rows = [(10 * k + i, " ".join(chr(0x4E00 + 100 * k + (i * 7 + j) % 40) * 3 for j in range(30)), f"l{k:02d}") for k in range(12) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_more_languages_than_bits(spark):
    """Over 64 languages need several words; the ones with fewest documents are learned as well."""
    n = 140
    rows = [(100 * k + i, " ".join(chr(0x4E00 + 100 * k + (i * 7 + j) % 40) * 3 for j in range(30)), f"l{k:03d}") for k in range(n) for i in range(8 + (k < 64))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model["langs"]) == n
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [r for r in got if r.lang == r.lang_pred and r.score > language.REJECT]
    assert len(right) > 0.9 * len(rows) and len({r.lang for r in right}) > 0.95 * n


def _plain_language(rows, model_rows, size):
    """The operator in plain Python: sets of n-grams, a bit for each slot and language, counts. -> by text (name, score)."""
    low64 = (1 << 64) - 1

    def scramble(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & low64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & low64
        return x ^ (x >> 31)

    def grams(text):
        out = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in out)
        out = " " + re.sub(" +", " ", out) + " "
        found = []
        for i in range(max(1, len(out) - language.GRAM + 1)):
            h = 0
            for c in out[i : i + language.GRAM]:
                h = (h * 0x100000001B3 + ord(c)) & low64
            found.append(scramble(h))
        return found

    def slots(h):
        step = (h >> 32) | 1
        return [(h + k * step & low64) % size for k in range(language.HASHES)]

    langs = sorted({lang for _, lang in model_rows})
    shares = {lang: Counter() for lang in langs}
    sizes = Counter(lang for _, lang in model_rows)
    for text, lang in model_rows:
        shares[lang].update(set(grams(text)) if any(map(str.isalpha, text)) else [])
    shares = {lang: {g: n / sizes[lang] for g, n in c.items()} for lang, c in shares.items()}
    bits = {lang: set() for lang in langs}
    for lang in langs:
        for g, s in shares[lang].items():
            if s >= language.LEAST_SHARE and s * language.MOST_TIMES >= max(shares[o].get(g, 0) for o in langs):
                bits[lang].update(slots(g))
    out = []
    for text in rows:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        own, best = grams(text), []
        for lang in langs:
            n = sum(all(s in bits[lang] for s in slots(g)) for g in own)
            false = (len(bits[lang]) / size) ** language.HASHES
            best.append((min(1.0, max(0.0, (n / len(own) - false) / (1 - false))), lang))
        top = max(s for s, _ in best)
        out.append((next(lang for s, lang in best if s == top), top))
    return out


def test_language_against_plain_python(spark, sf_dir):
    """Membership, popcounts and correction, with so few slots that false positives occur."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL").limit(60).select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    docs = spark.createDataFrame([*docs.collect(), (10**6, "", "en"), (10**6 + 1, "ÉtÉ ß 12", "en"), (10**6 + 2, "a", "de")], docs.schema)
    rows = docs.withColumn("held", language.held_out(F.col("doc_id"))).collect()
    model = language.train(docs, slots=1 << 14)
    want = _plain_language([r.text for r in rows], [(r.text, r.lang) for r in rows if not r.held], 1 << 14)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for r, (name, score) in zip(rows, want, strict=True):
        assert got[r.doc_id].lang_pred == name and abs(got[r.doc_id].score - score) < 1e-9, r


def test_language_sample(spark):
    """At most the sample of each language, one text of rows that share an id; a hot language is thinned before it is ranked."""
    rows = [(i, f"wort{i} und", "de") for i in range(4000)] + [(5000 + i, f"word{i} and", "en") for i in range(50)] + [(3, "noch ein text", "de")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkey = language.stash
    try:
        language.stash = lambda df, name: seen.append((name, monkey(df, name))) or seen[-1][1]
        discard, language.discard = language.discard, lambda *a: None
        language.train(docs, 100)
    finally:
        language.stash, language.discard = monkey, discard
    sample = dict(seen)["language-sample"].groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample} == {"de": 100, "en": dict(seen)["language-sample"].where("lang = 'en'").count()}
    assert 30 < dict(seen)["language-sample"].where("lang = 'en'").count() <= 50


def test_quality(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.op10_quality(spark, sf_dir).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.8
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "words of a text", 1), (3, "x" * 200_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_non_negative_risk():
    """Positives at +1, negatives at -1, seven of ten unlabelled positive: the fit tells them apart, with no negative label."""
    rng = np.random.default_rng(0)
    make = lambda n, c: np.concatenate([rng.normal(c, 0.6, (n, 2)), rng.normal(0, 1, (n, quality.FEATURES - 2))], axis=1)
    model = quality.fit(make(3000, 1.2), np.concatenate([make(2800, 1.2), make(1200, -1.2)]), 0.7)
    high, low = quality.predict(model, make(500, 1.2)), quality.predict(model, make(500, -1.2))
    assert (high[:, None] > low[None, :]).mean() > 0.97 and high.mean() > 0.8 and low.mean() < 0.5


def _plain_features(text):
    """The features one by one, from the text's bytes."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * quality.FEATURES
    kinds = [0] * quality.KINDS
    for b in raw:
        c = chr(b)
        kind = 6 if b >= 128 else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isdigit() else 4 if b in (32, 9, 11, 12) else 5 if b in (10, 13) else 7 + quality._MARKS.index(b) if b in quality._MARKS else 0
        kinds[kind] += 1
    out = [(n / len(raw)) ** 0.5 for n in kinds]
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
    if not w:
        return out + [0.0] * 10
    pairs = list(zip(w, w[1:], strict=False))
    windows = [w[i : i + 64] for i in range(0, len(w), 64)]
    return out + [
        np.log1p(len(w)) / 8, np.log1p(len(raw)) / 10, len(raw) / len(w) / 20, len(set(w)) / len(w), max(Counter(w).values()) / len(w),
        sum(a == b for a, b in pairs) / len(pairs) if pairs else 0, len(set(pairs)) / max(1, len(pairs)), sum(len(set(x)) for x in windows) / len(w), kinds[2] / max(1, kinds[1] + kinds[2]), 1,
    ]


def test_features_against_plain_python(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()] + ["", None, "  \n", "one", "Same same SAME", "x " * 5000, "É日本 1,2;3"]
    got = quality.text_features([(t or "").encode() for t in texts])
    assert np.allclose(got, np.array([_plain_features(t) for t in texts]), atol=1e-5)


def test_risk_gradient():
    """The step follows the non-negative risk: numerical gradients of the parts, on both sides of 0."""
    rng = np.random.default_rng(0)
    seen = set()
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        w = {"w": np.abs(rng.standard_normal((5, 4))), "b": rng.standard_normal(4), "v": rng.standard_normal(4) + shift, "c": np.array(0.2 + shift)}
        xp, xu = rng.standard_normal((30, 5)) + shift, rng.standard_normal((40, 5)) - shift
        below, grads = quality.step_direction(w, xp, xu, prior)
        positive, negative = quality.risk(w, xp, xu, prior)
        seen.add(below)
        assert below == (negative < 0)
        for k in w:
            for at in np.ndindex(w[k].shape):
                def value(step, k=k, at=at):
                    moved = {n: x.astype(float).copy() for n, x in w.items()}
                    moved[k][at] += step
                    a, b = quality.risk(moved, xp, xu, prior)
                    return -b if below else a + b

                slope = (value(1e-5) - value(-1e-5)) / 2e-5 + (1e-4 * w[k][at] if k in "wv" else 0)
                assert abs(slope - np.asarray(grads[k])[at]) < 1e-6
    assert seen == {True, False}


def test_scores_against_plain_python(spark, sf_dir):
    """The network's output written out, and that a label's copies, clashing columns and repeated ids change nothing that is not theirs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumns({"text": F.lit("other"), "kind": F.lit(7), "order": F.lit(1), "score": F.lit("x")})
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs.withColumn("quality", F.lit(9)), model).collect()}
    for r in docs.limit(20).collect():
        x = np.clip((np.array(_plain_features(r.text)) - model["mean"]) / model["scale"], -8, 8)
        f = sum(float(np.tanh(x @ model["w"][:, j] + model["b"][j])) * model["v"][j] for j in range(len(model["v"]))) + float(model["c"])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-f))) < 1e-4
    again = quality.train(docs, labels.union(labels))
    assert np.allclose(again["w"], model["w"]) and np.allclose(again["v"], model["v"])
