"""Operator 4: language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of the character n-grams that it contains. The filters are bit-sliced:
they share one table of slots, and a slot's bitmask has a bit for each language whose filter sets it, in
as many 64-bit words as the languages need. So
the AND of an n-gram's slots gives all languages that contain it at once. A text's language is the one
with the highest count of its n-grams, each language's count corrected for the false positives that its
filter's fill leads to.

The filters are fitted on at most SAMPLE documents of each language, chosen by the hash of their ids;
their n-grams are counted in Spark. Of rows that share id and language one text is learned from. The
table has SLOTS slots, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, mix, stash, table

#: Characters of an n-gram; most documents of a language that are learned from; slots; hashes of an n-gram.
GRAM, SAMPLE, SLOTS, HASHES = 4, 3000, 1 << 20, 3
#: A language contains an n-gram that this share of its documents have, if no other has it this many times as often.
LEAST_SHARE, MOST_TIMES = 0.005, 8.0
#: Bits of a word of a mask.
BITS = 64
FOLDS, HELD_OUT = 4, 2
#: Documents of the pipeline below this score have no language.
REJECT = 0.1


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 32 for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str | None]):
    """For each text the hashes of its n-grams (uint64), white space and marks as one blank; None if it has no letter."""
    letters = _letters()
    for t in texts:
        points = letters[np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32)]
        blank = points == 32
        if blank.all() or not any(map(str.isalpha, t)):  # marks alone are no letters
            yield None
            continue
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # the first of several blanks
        points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
        h = np.zeros(max(1, len(points) - GRAM + 1), np.uint64)
        for k in range(min(GRAM, len(points))):
            h = h * np.uint64(0x100000001B3) + points[k : k + len(h)]
        yield mix(h)


def _places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """The places of each hash among the slots, a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    """Language i's bit of each mask."""
    return (masks[:, i // BITS] >> np.uint64(i % BITS)) & np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """Whether the row is in the fold that nothing is learned from; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def _sample_grams(batches):
    for df in batches:
        for a in range(0, len(df), 64):
            some = df.iloc[a : a + 64]
            keys, values = [], []
            for lang, h in zip(some["lang"], grams(some["text"].tolist()), strict=True):
                if h is not None:
                    u = np.unique(h).view(np.int64)
                    keys.append(np.full(len(u), lang, dtype=object))
                    values.append(u)
            if keys:
                yield pd.DataFrame({"lang": np.concatenate(keys), "gram": np.concatenate(values)})


def train(docs: DataFrame, sample: int = SAMPLE, slots: int = SLOTS) -> dict:
    """Filters from documents (doc_id, text, lang). Null languages, null texts and the held-out fold are not learned from."""
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sizes = stash(usable.groupBy("lang").agg(F.count("*").alias("rows")), "language-sizes")
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    words = -(-len(langs) // BITS) or 1
    # a language's size tells below which hash about twice the sample lie: only these ids are ranked, however large it is
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    low = usable.select("doc_id", "lang", place.alias("place")).join(sizes, "lang").where(F.col("place") * F.col("rows").cast("double") < F.lit(2.0 * sample * (1 << 30)))
    low = low.select("doc_id", "lang", "place").distinct()
    chosen = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("rank") <= sample).select("doc_id", "lang")
    chosen = stash(chosen, "language-ids")  # then its size is known: few ids are broadcast, and the texts stay where they are
    rows = docs.select("doc_id", "text", "lang").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = stash(rows, "language-sample")
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    found = rows.select("lang", "text").mapInPandas(_sample_grams, "lang string, gram long").groupBy("gram", "lang").count().join(F.broadcast(n), "lang").withColumn("share", F.col("count") / F.col("n"))
    most = found.groupBy("gram").agg(F.max("share").alias("most")).where(F.col("most") >= LEAST_SHARE)
    contained = found.join(most, "gram").where((F.col("share") >= LEAST_SHARE) & (F.col("share") * MOST_TIMES >= F.col("most"))).select("lang", "gram")

    def set_bits(batches):
        at = {lang: i for i, lang in enumerate(langs)}
        for df in batches:
            h = df["gram"].to_numpy(np.int64).view(np.uint64)
            i = np.array([at[x] for x in df["lang"]], np.int64)
            mask = np.uint64(1) << (i % BITS).astype(np.uint64)
            for place in _places(h, slots):
                yield pd.DataFrame({"slot": place * words + i // BITS, "mask": mask.view(np.int64)})

    got = contained.mapInPandas(set_bits, "slot long, mask long").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()  # a row for each slot and word of a mask at most
    masks = np.zeros(slots * words, np.uint64)
    masks[got["slot"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    masks = masks.reshape(slots, words)
    discard(sizes, chosen, rows)
    fill = np.array([_bit(masks, i).mean() for i in range(len(langs))])
    narrow = masks[:, 0].astype(np.uint8) if len(langs) <= 8 else masks
    return {"langs": langs, "masks": narrow, "false": fill**HASHES}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and the share of its n-grams that the language contains beyond false positives; `und` with 0 for null and for texts without letters."""
    langs, masks, false = model["langs"], model["masks"], model["false"]
    names, scores = [], []
    bits = np.array([[m >> i & 1 for i in range(len(langs))] for m in range(256)]) if masks.dtype == np.uint8 else None
    for t, h in zip(texts, grams(texts), strict=True):
        if t is None or h is None or not langs:
            names.append("und")
            scores.append(0.0)
            continue
        places = _places(h, len(masks))
        mask = masks[places[0]]
        for p in places[1:]:
            mask = mask & masks[p]
        if bits is not None:
            counts = np.bincount(mask, minlength=256) @ bits
        else:
            counts = np.array([int(_bit(mask, i).sum()) for i in range(len(langs))])
        shares = np.clip((counts / len(h) - false) / np.maximum(1e-9, 1 - false), 0, 1)
        best = int(shares.argmax())
        names.append(langs[best])
        scores.append(float(shares[best]))
    return names, scores


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score. A tie goes to the first language by name; a null doc_id stays null, extra columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for df in batches:
            names, scores = predict(held.value, df["text"].where(df["text"].notna(), None).tolist())
            yield pd.DataFrame({"doc_id": df["doc_id"], "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; their lang becomes the predicted one. Columns that documents does not have go."""
    model = spark.sparkContext.broadcast(train(docs))

    def run(batches):
        for df in batches:
            names, scores = predict(model.value, df["text"].where(df["text"].notna(), None).tolist())
            kept = np.array([n != "und" and s >= REJECT for n, s in zip(names, scores, strict=True)], bool)
            yield df.assign(lang=names)[kept]

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    return docs.select(*[c.split()[0] for c in columns.split(", ")]).mapInPandas(run, columns)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, train(docs))
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
