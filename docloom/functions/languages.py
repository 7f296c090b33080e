"""Languages by ranked profiles of character n-grams, learned from texts whose language is known and kept as a table."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams of a profile, their lengths, characters of a text that are looked at, and letters that a text must have.
MOST, LENGTHS, HEAD, LEAST = 400, (1, 2, 3), 8192, 30
#: A text is of no known language where its distance to the nearest profile is over this share of the greatest possible.
FAR = 0.8
_WORD = re.compile(r"[^\W\d_]+")


#: Bits of a character in an n-gram's code, and different n-grams that a task holds before it gives their counts back.
BITS, HELD = 21, 1 << 20


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes in ascending order, counts) of the n-grams of the words of a text's beginning, lower-cased, with _ where a word begins and ends. Codes are in the order of the n-grams as texts."""
    words = _WORD.findall((text or "")[:HEAD].lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blank = c == ord("_")
    first, second = c << 2 * BITS, c << BITS
    inner = ~blank[1:-1]  # an n-gram of three has no end of a word in the middle
    codes = np.concatenate([first[~blank], first[:-1] | second[1:], (first[:-2] | second[1:-1] | c[2:])[inner]])
    return np.unique(codes, return_counts=True)


def gram_text(code: int) -> str:
    mask = (1 << BITS) - 1
    return "".join(chr(x) for x in (code >> 2 * BITS, code >> BITS & mask, code & mask) if x)


def gram_code(gram: str) -> int:
    return sum(ord(x) << (2 - i) * BITS for i, x in enumerate(gram))


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order, equal ones by themselves."""
    return codes[np.argsort(-counts, kind="stable")[:MOST]]


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several texts as one."""
    codes, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in held]))
    return codes, total


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, rank): each language's most frequent n-grams, over all texts whose language is not null. Counted in the tasks, so a language comes together as counts of its n-grams."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def given():
            for name, own in held.items():
                codes, counts = _added(own)
                yield pd.DataFrame({"lang": name, "gram": pd.Series([gram_text(c) for c in codes.tolist()], dtype=object), "n": counts})

        for df in batches:
            for name, t in zip(df["lang"], df["text"], strict=True):
                held.setdefault(name, []).append(grams(t))
                size += len(held[name][-1][0])
                if size > HELD:
                    held = {k: [_added(own)] for k, own in held.items()}
                    size = sum(len(own[0][0]) for own in held.values())
                    if size > HELD // 2:
                        yield from given()
                        held, size = {}, 0
        yield from given()

    own = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = own.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    return counts.withColumn("rank", place).where(F.col("rank") <= MOST).select("lang", "gram", "rank")


class Known:
    """Profiles as the tasks use them; at most MOST n-grams a language."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.names = sorted({name for name, _, _ in rows})
        number = {name: i for i, name in enumerate(self.names)}
        self.codes = np.unique(np.array([gram_code(gram) for _, gram, _ in rows], np.int64))
        self.rank = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for name, gram, rank in rows:
            self.rank[number[name], np.searchsorted(self.codes, gram_code(gram))] = rank

    def detect(self, text: str | None) -> str:
        """The language whose profile is nearest, by how far each of the text's n-grams is out of its place; unknown for short texts and for none near enough."""
        codes, counts = grams(text)
        if counts[codes & ((1 << 2 * BITS) - 1) == 0].sum() < LEAST or not self.names:
            return "unknown"
        own = ranked(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank, place = np.where(self.codes[at] == own, self.rank[:, at], -1), np.arange(1, len(own) + 1)
        far = np.where(rank < 0, MOST, np.abs(rank - place)).sum(axis=1)
        best = int(far.argmin())  # the first by name of equal ones
        return self.names[best] if far[best] <= FAR * MOST * len(own) else "unknown"


def detector(known: DataFrame):
    """A function of a text column to its language, by a table of profiles (its rows go to the tasks: MOST a language)."""
    held = known.sparkSession.sparkContext.broadcast(Known([(r["lang"], r["gram"], r["rank"]) for r in known.select("lang", "gram", "rank").collect()]))

    def language(text: Column) -> Column:
        @F.pandas_udf("string")
        def read(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: held.value.detect(t if isinstance(t, str) else None)).astype(object)

        return read(text)

    return language


def _documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", detector(profiles(docs))(F.col("text")).alias("language"))


QUERIES = {"document_languages": (_documents, None)}
