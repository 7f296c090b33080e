"""Operator 5: license scans by ordered signature rules.

A rule is a regular expression with a label, a priority and a weight, and is tried only on texts that
hold its keyword, however its blanks are written. Detections are taken in the order of their rules' priority; one whose interval lies
within an interval already taken is suppressed (so "GNU Lesser General Public License" is not also the
GPL, and a license's full text is one detection, not one for each of its sentences). Besides, fixed
phrases are counted wherever their words stand consecutively; their labels are never suppressed.

Most rules are made from the table of licenses: each license's names in each of the forms in which
texts refer to one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, text_chunks, utf8

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    label: str
    priority: int  # lower is tried first
    weight: float
    keyword: str
    pattern: re.Pattern


#: label; keyword; names, most special first. Texts are lower-cased; a blank in a pattern is any run of blanks, line ends, quotes and comment marks.
LICENSES = [
    ("agpl-3", "affero", [r"gnu affero general public licen[cs]e,? (?:v(?:ersion)? ?)?3(?:\.0)?", r"gnu affero general public licen[cs]e", r"agpl[ -]?(?:v ?)?3(?:\.0)?"]),
    ("agpl-3", "agpl", [r"agpl[ -]?(?:v ?)?3(?:\.0)?"]),
    ("lgpl-2.1", "lesser", [r"gnu lesser general public licen[cs]e,? (?:v(?:ersion)? ?)?2\.1"]),
    ("lgpl-3", "lesser", [r"gnu lesser general public licen[cs]e,? (?:v(?:ersion)? ?)?3(?:\.0)?"]),
    ("lgpl-2", "library general", [r"gnu library general public licen[cs]e(?:,? (?:v(?:ersion)? ?)?2(?:\.0)?)?"]),
    ("lgpl", "lesser", [r"gnu lesser general public licen[cs]e", r"lesser gpl"]),
    ("lgpl", "lgpl", [r"(?:gnu )?lgpl(?:[ -]?v?[23](?:\.[01])?)?"]),
    ("gpl-3", "general public", [r"(?:gnu )?general public licen[cs]e,? (?:v(?:ersion)? ?)3(?:\.0)?"]),
    ("gpl-2", "general public", [r"(?:gnu )?general public licen[cs]e,? (?:v(?:ersion)? ?)2(?:\.0)?"]),
    ("gpl-3", "gpl", [r"(?:gnu )?gpl[ -]?(?:v(?:ersion)? ?)?3(?:\.0)?"]),
    ("gpl-2", "gpl", [r"(?:gnu )?gpl[ -]?(?:v(?:ersion)? ?)?2(?:\.0)?"]),
    ("gpl", "general public", [r"gnu general public licen[cs]e"]),
    ("gpl", "gpl", [r"gnu gpl"]),
    ("gfdl", "documentation", [r"gnu free documentation licen[cs]e(?:,? version 1\.[123])?"]),
    ("mpl-2", "mozilla", [r"mozilla public licen[cs]e,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?"]),
    ("mpl-1.1", "mozilla", [r"mozilla public licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.1"]),
    ("mpl", "mozilla", [r"mozilla public licen[cs]e"]),
    ("apache-2", "apache", [r"apache (?:software )?licen[cs]e,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?", r"apache[ -]2(?:\.0)?"]),
    ("apache-1.1", "apache", [r"apache (?:software )?licen[cs]e,? (?:v(?:ersion)?\.? ?)?1\.1"]),
    ("apache", "apache", [r"apache (?:software )?licen[cs]e"]),
    ("bsd-4-clause", "bsd", [r"(?:4|four)[- ]clause bsd", r"bsd[- ]4[- ]clause", r"original bsd"]),
    ("bsd-3-clause", "bsd", [r"(?:3|three)[- ]clause bsd", r"bsd[- ]3[- ]clause", r"(?:new|modified|revised) bsd"]),
    ("bsd-2-clause", "bsd", [r"(?:2|two)[- ]clause bsd", r"bsd[- ]2[- ]clause", r"simplified bsd"]),
    ("0bsd", "bsd", [r"(?:zero|0)[- ]clause bsd", r"0bsd"]),
    ("bsd", "bsd", [r"bsd(?:[- ]style)?"]),
    ("mit-0", "mit", [r"mit no attribution", r"mit-0"]),
    ("mit", "mit", [r"mit(?:/x11)?(?:[- ]style)?", r"x11/mit"]),
    ("x11", "x11", [r"x11"]),
    ("expat", "expat", [r"expat"]),
    ("isc", "isc", [r"isc"]),
    ("zlib", "zlib", [r"zlib(?:/libpng)?"]),
    ("libpng", "libpng", [r"libpng"]),
    ("boost-1", "boost", [r"boost software licen[cs]e(?:,? (?:v(?:ersion)? ?)?1(?:\.0)?)?", r"boost"]),
    ("epl-2", "eclipse", [r"eclipse public licen[cs]e,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?"]),
    ("epl-1", "eclipse", [r"eclipse public licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?1(?:\.0)?)?"]),
    ("cddl-1.1", "common development", [r"common development and distribution licen[cs]e,? (?:version )?1\.1"]),
    ("cddl-1", "common development", [r"common development and distribution licen[cs]e(?:,? (?:version )?1(?:\.0)?)?"]),
    ("eupl-1.2", "european union public", [r"european union public licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?1\.[12])?"]),
    ("artistic-2", "artistic", [r"artistic licen[cs]e,? (?:v(?:ersion)? ?)?2(?:\.0)?"]),
    ("artistic-1", "artistic", [r"artistic licen[cs]e(?:,? (?:v(?:ersion)? ?)?1(?:\.0)?)?", r"perl artistic"]),
    ("ofl-1.1", "open font", [r"sil open font licen[cs]e(?:,? version 1\.[01])?", r"open font licen[cs]e"]),
    ("osl-3", "open software licen", [r"open software licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?3(?:\.0)?)?"]),
    ("afl-3", "academic free", [r"academic free licen[cs]e(?:,? (?:v(?:ersion)?\.? ?)?3(?:\.0)?)?"]),
    ("ms-pl", "microsoft", [r"microsoft public licen[cs]e"]),
    ("ms-rl", "microsoft", [r"microsoft reciprocal licen[cs]e"]),
    ("python-2", "python", [r"python software foundation licen[cs]e(?:,? version 2)?"]),
    ("python-2", "psf", [r"psf"]),
    ("ruby", "ruby", [r"ruby"]),
    ("php-3", "php", [r"php licen[cs]e,? (?:version )?3(?:\.01?)?", r"php"]),
    ("openssl", "openssl", [r"openssl"]),
    ("postgresql", "postgresql", [r"postgresql"]),
    ("unlicense", "unlicen", [r"the unlicen[cs]e", r"unlicen[cs]e"]),
    ("wtfpl", "wtfpl", [r"wtfpl"]),
    ("beerware", "beer", [r"beer-?ware"]),
    ("odbl-1", "open database", [r"open database licen[cs]e", r"open data commons open database licen[cs]e"]),
    ("odc-by", "open data commons", [r"open data commons attribution licen[cs]e"]),
    ("pddl", "public domain dedication", [r"public domain dedication and licen[cs]e"]),
    ("ecl-2", "educational community", [r"educational community licen[cs]e(?:,? version 2(?:\.0)?)?"]),
    ("ncsa", "ncsa", [r"university of illinois/ncsa", r"ncsa"]),
    ("w3c", "w3c", [r"w3c software(?: notice and)?", r"w3c"]),
    ("sspl-1", "server side", [r"server side public licen[cs]e(?:,? (?:v(?:ersion)? ?)?1)?"]),
    ("bsl-1.1", "business source", [r"business source licen[cs]e(?:,? (?:v(?:ersion)? ?)?1\.1)?"]),
    ("elastic-2", "elastic", [r"elastic licen[cs]e(?:,? (?:v(?:ersion)? ?)?2(?:\.0)?)?"]),
    ("openrail", "rail", [r"(?:bigscience |creativeml )?(?:open)?rail(?:-m)?"]),
    ("cc0", "cc0", [r"cc0(?:[- ]1\.0)?"]),
    ("cc0", "creative commons zero", [r"creative commons zero(?: v?1\.0)?(?: universal)?"]),
    ("cc-by-nc-nd", "nc", [r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|noncommercial|non-commercial)[ -](?:nd|noderiv(?:s|atives)?|no-derivatives)(?: [1-4]\.\d)?"]),
    ("cc-by-nc-nd", "commercial", [r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:noncommercial|non-commercial)[ -](?:nd|noderiv(?:s|atives)?|no-derivatives)(?: [1-4]\.\d)?"]),
    ("cc-by-nc-sa", "nc", [r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|noncommercial|non-commercial)[ -](?:sa|sharealike|share-alike)(?: [1-4]\.\d)?"]),
    ("cc-by-nc-sa", "commercial", [r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:noncommercial|non-commercial)[ -](?:sa|sharealike|share-alike)(?: [1-4]\.\d)?"]),
    ("cc-by-nc", "nc", [r"cc[ -]by[ -]nc(?: [1-4]\.\d)?"]),
    ("cc-by-nc", "commercial", [r"creative commons attribution[ -](?:noncommercial|non-commercial)(?: [1-4]\.\d)?"]),
    ("cc-by-nd", "nd", [r"cc[ -]by[ -]nd(?: [1-4]\.\d)?"]),
    ("cc-by-nd", "creative commons", [r"creative commons attribution[ -](?:noderiv(?:s|atives)?|no-derivatives)(?: [1-4]\.\d)?"]),
    ("cc-by-sa", "sa", [r"cc[ -]by[ -]sa(?: [1-4]\.\d)?"]),
    ("cc-by-sa", "creative commons", [r"creative commons attribution[ -](?:sharealike|share-alike)(?: [1-4]\.\d)?"]),
    ("cc-by", "cc", [r"cc[ -]by(?: [1-4]\.\d)?"]),
    ("cc-by", "creative commons", [r"creative commons attribution(?: [1-4]\.\d)?"]),
]
#: Forms in which a text refers to a license's name, with priority and weight. {} is the name.
FORMS = [
    (20, 1.0, r"(?:licen[cs]ed|released|distributed|available|published|provided|made available|shared|redistributed|covered) under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the |an? )?{}(?: licen[cs]e| international| unported)*"),
    (30, 0.9, r"under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the |an? )?{}(?: licen[cs]e| international| unported)*"),
    (40, 0.8, r"(?:the )?{} licen[cs]e"),
    (50, 0.7, r"licen[cs]e ?: ?{}"),
]
#: Names that say enough by themselves.
PLAIN = (60, 0.6)
#: Keywords of names that are common words or names of other things: these need the word license after them.
COMMON_NAMES = {"mit", "bsd", "x11", "expat", "isc", "zlib", "libpng", "boost", "ruby", "php", "openssl", "postgresql", "python", "psf", "ncsa", "w3c", "rail"}
#: Sentences and lines by which a license's own text or a notice is known.
TEXTS = [
    ("mit", "free of charge, to any person", 1.0, r"permission is hereby granted, free of charge, to any person obtaining a copy.{0,400}?without restriction"),
    ("isc", "with or without fee", 1.0, r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", 1.0, r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("apache-2", "apache.org/licenses", 1.0, r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("gpl", "free software foundation", 0.9, r"it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl", "you can redistribute it", 0.6, r"this program is free software[:;] you can redistribute it and/or modify"),
    ("zlib", "as-is", 0.9, r"this software is provided 'as-is', without any express or implied warranty"),
    ("unlicense", "public domain", 1.0, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 0.7, r"(?:released into|dedicated to|placed in|is in) the public domain"),
    ("mpl-2", "mozilla.org/mpl", 1.0, r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    ("gpl-3", "gnu.org/licenses", 0.8, r"https?://www\.gnu\.org/licenses/gpl-3\.0"),
    ("cc-by", "creativecommons.org", 1.0, r"creativecommons\.org/licenses/by/[1-4]\.\d"),
    ("cc-by-sa", "creativecommons.org", 1.0, r"creativecommons\.org/licenses/by-sa/[1-4]\.\d"),
    ("cc-by-nc", "creativecommons.org", 1.0, r"creativecommons\.org/licenses/by-nc/[1-4]\.\d"),
    ("cc-by-nd", "creativecommons.org", 1.0, r"creativecommons\.org/licenses/by-nd/[1-4]\.\d"),
    ("cc-by-nc-sa", "creativecommons.org", 1.0, r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.\d"),
    ("cc-by-nc-nd", "creativecommons.org", 1.0, r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.\d"),
    ("cc0", "creativecommons.org", 1.0, r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("all-rights-reserved", "all rights reserved", 0.5, r"(?:copyright (?:\(c\) |© )?.{0,60}?)?all rights reserved"),
    ("proprietary", "confidential", 0.6, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthori", 0.5, r"unauthori[sz]ed (?:copying|reproduction|distribution|use) .{0,40}?(?:is )?(?:strictly )?prohibited"),
    ("no-ai-training", "train", 0.6, r"(?:may not|must not|shall not|not) be used (?:to|for) train(?:ing)?"),
]


_BLANK = r"[\s\"'*#/]+"


def _pattern(p: str) -> re.Pattern:
    either = f"(?:{_BLANK}|-)"
    parts = [x.replace(" ?", f"(?:{_BLANK})?").replace(" ", _BLANK) for x in re.split(r"\[ -\]|\[- \]", p)]
    return re.compile(r"(?<![a-z0-9])" + either.join(parts) + r"(?![a-z0-9])", re.DOTALL)


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules in the order of their priority; of equal ones the earlier in the tables first."""
    out = []
    for label, keyword, names in LICENSES:
        spdx = rf"spdx-license-identifier: ?{re.escape(label).replace('/', '')}(?:\.0)?(?:-(?:only|or-later))?"
        out.append(Rule(label, 10, 1.0, "spdx", _pattern(spdx)))
        for name in names:
            needed = keyword in COMMON_NAMES and "licen" not in name
            out += [Rule(label, priority, weight, keyword, _pattern(form.replace(")*", ")+" if needed else ")*").format(f"(?:{name})"))) for priority, weight, form in FORMS]
            if "licen" in name or any(c.isdigit() for c in name) and "[ -]" in name:
                out.append(Rule(label, PLAIN[0], PLAIN[1], keyword, _pattern(name)))
    out += [Rule(label, 15, weight, keyword, _pattern(p)) for label, keyword, weight, p in TEXTS]
    return [r for _, r in sorted(enumerate(out), key=lambda x: (x[1].priority, x[0]))]


@lru_cache(1)
def _by_keyword() -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list] = {}
    for i, r in enumerate(rules()):
        out.setdefault(r.keyword, []).append((i, r))
    return out


@lru_cache(1)
def _squeezed() -> list[tuple[str, list[tuple[int, Rule]]]]:
    """The rules by keyword, each run of what a blank stands for written as one blank."""
    return [(re.sub(_BLANK, " ", keyword), some) for keyword, some in _by_keyword().items()]


#: A text without any of these holds nothing that a rule matches: every rule's match has one.
_GATE = re.compile(r"licen[cs]|under|spdx|reserved|permission|redistribut|commons|apache|mozilla|gnu|gpl|domain|confidential|unauthori|train|as-is|bsd|cc0|mit-0|openrail|(?:cc|x11|boost)\W")


def _due(low: str) -> list[tuple[int, Rule]]:
    """The rules that a lower-cased text is tried for, with their places in the order."""
    if not _GATE.search(low):
        return []
    plain = re.sub(_BLANK, " ", low)
    return sorted((i, r) for keyword, some in _squeezed() if keyword in plain for i, r in some)


class Covered:
    """Intervals, of which only those are kept that lie in no other: by start, their ends then rise too, so one bisection tells whether a new one lies within any."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end

    def add(self, start: int, end: int) -> None:
        """An interval that none of those here holds; those that lie in it go."""
        first = bisect_left(self.starts, start)
        last = bisect_right(self.ends, end, first)
        self.starts[first:last], self.ends[first:last] = [start], [end]


def detect(low: str) -> list[tuple[int, int, Rule]]:
    """The detections in a lower-cased text that are left after suppression: (start, end, rule), by start."""
    taken: list[tuple[int, int, Rule]] = []
    covered = Covered()
    for _, rule in _due(low):
        for m in rule.pattern.finditer(low):
            if not covered.holds(m.start(), m.end()):
                covered.add(m.start(), m.end())
                taken.append((m.start(), m.end(), rule))
    return sorted(taken, key=lambda x: x[:2])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_IN, _OUT = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
_PLACES = [(p.split(" ")[1].encode() if p.startswith("under") else p.split(" ")[-1 if p.startswith("cc") else 0].encode(), label, re.compile(rb"(?<!" + _IN + rb")" + _OUT.join(w.encode() for w in p.split(" ")) + rb"(?!" + _IN + rb")")) for p, label in PHRASES.items()]


def word_counts(texts: list[bytes]) -> np.ndarray:
    """Words of each lower-cased text: runs of digits, small letters and bytes that are not ASCII."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = _WORD[joined]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return np.add.reduceat(begins, starts, dtype=np.int64)


def base_places(low: bytes) -> list[tuple[int, str]]:
    """(byte, label) of every place of the fixed phrases."""
    return [(m.start(), label) for keyword, label, pattern in _PLACES if keyword in low for m in pattern.finditer(low)]


def _scan(batches):
    for df in batches:
        texts = [t.translate(_LOWER) for t in utf8(df["text"])]
        for a, b in text_chunks(texts, 1 << 21):
            rows = []
            for low, n in zip(texts[a:b], word_counts(texts[a:b]).tolist(), strict=True):
                places = sorted(base_places(low))
                first, last = ((int(word_counts([low[:at]])[0]) if at else 0) for at in (places[0][0], places[-1][0])) if places else (None, None)
                base = {label for _, label in places}
                found = detect(low.decode("utf-8", "replace"))
                labels = base | {r.label for _, _, r in found}
                score = max([1.0 if places else 0.0, *(r.weight for _, _, r in found)])
                spans = [(s, e, r.label, float(r.weight)) for s, e, r in found]
                rows.append((n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            out = pd.DataFrame(dict(zip(names, zip(*rows, strict=True), strict=True)))
            out["spans"] = pd.Series([[dict(zip(("start", "end", "label", "weight"), s, strict=True)) for s in x] for x in out["spans"]], dtype=object)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", df["doc_id"].iloc[a:b].to_numpy())
            yield out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> counts of words and fixed phrases, labels, score and the detections' spans (in characters of the lower-cased text).

    A null or empty text has 0 words, no labels and score 0. score is the highest weight of a detection,
    1 where a fixed phrase stands. A null doc_id stays null; extra columns are ignored.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, weight: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
