"""Operator 13: exact ranked search by MaxScore with bounds of term pairs.

A document's score for an item is the sum of its terms' impacts. Documents are indexed in shards of some
thousands; a shard has the postings of all terms that the items ask, its terms' highest impacts, and for
chosen pairs of terms of an item what their intersection list says: how long it is, the highest joint
impact, and the ten highest of them.

Two terms together add no more to a score than their joint maximum or the higher of their own maxima,
mostly far less than the sum of both. A set of terms is bounded by pairing them off, the pairs that save
most first. With these bounds a shard is left out for an item when all its terms cannot reach the
score of the tenth best document so far; else the terms are split into those that cannot reach it together
(not looked up to find candidates) and the essential rest; candidates that the bound of what is left
rules out go before each further term is added. The first thresholds come from the lists: ten documents
have at least the tenth highest joint impact of a pair of the item's terms.

Nothing that could be among the ten is left out: a document goes only when its bound is below ten others' scores.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import stash, table, text_chunks, utf8

TOP = 10
#: Documents and bytes of text of a shard, at most (a text is never split).
SHARD, SHARD_BYTES = 4096, 32 << 20
#: Terms of an item whose pairs are all listed, those of the highest weight; the others are paired with their neighbour by weight.
PAIRED = 6
#: Bytes of items that are sent to the tasks at once; more items take several passes.
ITEM_BYTES = 8 << 20
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SHARDS = "shard long, filled long, words long, ids binary, nulls binary, sizes binary, terms binary, dfs binary, places binary, tfs binary"
_LISTS = "pairs binary, lengths binary, joint binary"


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in order: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_MAP).split()


class Items:
    """A block of items: their terms as numbers of a vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        held: dict[int | None, set[bytes]] = {}
        for item, text in rows:
            held.setdefault(item, set()).update(terms_of(utf8([text])[0]))
        self.ids = sorted((i for i, t in held.items() if t), key=lambda i: (i is None, i or 0))
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*held.values())))}
        self.terms = [sorted(self.vocabulary[t] for t in held[i]) for i in self.ids]


class Weights:
    """What the whole corpus says: documents with terms, terms with repeats, and each term's weight; and the pairs that get lists."""

    def __init__(self, items: Items, filled: int, words: int, df: np.ndarray):
        self.filled, self.words = filled, words
        self.weight = np.array([math.floor(1000 * math.log((2 * filled + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        #: For each item its terms that some document holds, those of the highest weight first.
        self.terms = [sorted((t for t in terms if df[t]), key=lambda t: (-self.weight[t], t)) for terms in items.terms]
        pairs: dict[tuple[int, int], int] = {}
        self.pairs: list[list[tuple[int, int, int]]] = []
        for terms in self.terms:
            own = [*combinations(terms[:PAIRED], 2), *zip(terms[PAIRED::2], terms[PAIRED + 1 :: 2], strict=False)]
            own += zip(terms[PAIRED + 1 :: 2], terms[PAIRED + 2 :: 2], strict=False)
            self.pairs.append([(pairs.setdefault((min(x, y), max(x, y)), len(pairs)), x, y) for x, y in own])
        self.all_pairs = np.array(list(pairs), np.int64).reshape(-1, 2)

    def impacts(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of documents with so many terms, for so many occurrences of a term."""
        m = 10 + 90 * size * self.filled // max(self.words, 1)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Shard:
    """A shard's postings with their impacts."""

    def __init__(self, row, weights: Weights):
        self.sizes = unpacked(row.sizes, "<i8")
        self.terms, dfs = unpacked(row.terms, "<i4"), unpacked(row.dfs, "<i4")
        self.ends = np.concatenate(([0], np.cumsum(dfs, dtype=np.int64)))
        self.places = unpacked(row.places, "<u2").astype(np.int64)
        self.impacts = weights.impacts(np.repeat(self.terms, dfs), unpacked(row.tfs, "<u4").astype(np.int64), self.sizes[self.places])
        self.at = {t: k for k, t in enumerate(self.terms.tolist())}
        self.most = np.maximum.reduceat(self.impacts, self.ends[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.at[term]
        return self.places[self.ends[k] : self.ends[k + 1]], self.impacts[self.ends[k] : self.ends[k + 1]]

    def lists(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs whose terms meet: their numbers, the lengths of the intersection lists, and the TOP highest joint impacts (0: fewer)."""
        found, lengths, joint = [], [], []
        dense, of = np.full(len(self.sizes), -1, np.int64), -1
        present = np.isin(pairs, self.terms).all(axis=1)
        own = np.flatnonzero(present)
        for p in own[np.argsort(pairs[own, 0], kind="stable")].tolist():
            x, y = pairs[p].tolist()
            if x != of:
                if of >= 0:
                    dense[self.postings(of)[0]] = -1
                places, impacts = self.postings(x)
                dense[places], of = impacts, x
            places, impacts = self.postings(y)
            both = dense[places]
            hit = both >= 0
            n = int(hit.sum())
            if n:
                best = both[hit] + impacts[hit]
                best = np.sort(np.partition(best, n - TOP)[n - TOP :] if n > TOP else best)[::-1]
                found.append(p)
                lengths.append(n)
                joint.append(np.concatenate([best, np.zeros(TOP - len(best), np.int64)]))
        return np.array(found, np.int64), np.array(lengths, np.int64), np.array(joint, np.int64).reshape(-1, TOP)


def bounds(most: list[int], pairs: list[tuple[int, int, int]]) -> list[int]:
    """For each k the most that the first k terms can add to a score: `pairs` (joint, i, j) are paired off by what they save.

    joint is the most that both add together. Pairs that save nothing may be there.
    """
    saving = sorted(((most[i] + most[j] - joint, max(i, j), min(i, j)) for joint, i, j in pairs), reverse=True)
    out, total = [0], 0
    for k, m in enumerate(most):
        total += m
        used, saved = set(), 0
        for s, j, i in saving:
            if s <= 0:
                break
            if j <= k and i not in used and j not in used:
                used |= {i, j}
                saved += s
        out.append(min(total - saved, out[-1] + m))
    return out


class Best:
    """The best documents of each item so far, as (score, null, doc_id) in order, and the score that one must reach."""

    def __init__(self, least: np.ndarray):
        self.least = least.astype(np.int64).copy()
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in least]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        order = np.lexsort((ids, nulls, -scores))[:TOP]
        new = zip((-scores[order]).tolist(), nulls[order].tolist(), ids[order].tolist(), strict=True)
        rows = sorted([*self.rows[item], *new])[:TOP]
        self.rows[item] = rows
        if len(rows) == TOP:
            self.least[item] = max(self.least[item], -rows[-1][0])


def evaluate(shard: Shard, item: int, weights: Weights, joint: dict[int, int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a shard that reach `least` (above 0) for an item; others may be among them, with true scores.

    joint has the highest joint impacts of the pairs that meet in the shard.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = [(int(shard.most[shard.at[t]]), t) for t in weights.terms[item] if t in shard.at]
    terms = sorted(x for x in terms if x[0] > 0)
    if not terms:
        return none
    most = [m for m, _ in terms]
    at = {t: k for k, (_, t) in enumerate(terms)}
    pairs = [(max(joint.get(p, 0), most[at[x]], most[at[y]]), at[x], at[y]) for p, x, y in weights.pairs[item] if x in at and y in at]
    bound = bounds(most, pairs)
    if bound[-1] < least:
        return none
    rest = 0  # the terms before this one cannot reach the threshold together
    while rest < len(terms) and bound[rest + 1] < least:
        rest += 1
    scores = np.zeros(len(shard.sizes), np.int64)
    for _, t in terms[rest:]:
        places, impacts = shard.postings(t)
        scores[places] += impacts
    found = np.flatnonzero(scores > 0)
    for k in range(rest - 1, -1, -1):
        found = found[scores[found] + bound[k + 1] >= least]
        if not len(found):
            return none
        places, impacts = shard.postings(terms[k][1])
        if len(found) * 8 < len(places):
            near = np.minimum(np.searchsorted(places, found), len(places) - 1)
            scores[found] += np.where(places[near] == found, impacts[near], 0)
        else:
            scores[places] += impacts  # of other documents too, which are looked at no more
    found = found[scores[found] >= max(least, 1)]
    return found, scores[found]


def _shards(items):
    """Documents -> shards of postings of the items' terms."""
    columns = [c.split()[0] for c in _SHARDS.split(", ")]

    def run(batches):
        get = items.value.vocabulary.get
        number = TaskContext.get().partitionId() << 32
        ids, sizes, keys, held = [], [], [], 0

        def shard():
            key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            term, first, dfs = np.unique(key >> 16, return_index=True, return_counts=True)
            n = np.array(sizes, "<i8")
            row = (number, int((n > 0).sum()), int(n.sum()), packed(np.array([int(i or 0) for i in ids], "<i8")), packed(np.array([i is None for i in ids])), packed(n), packed(term.astype("<i4")), packed(dfs.astype("<i4")), packed((key & 0xFFFF).astype("<u2")), packed(tf.astype("<u4")))
            return pd.DataFrame([row], columns=columns)

        for df in batches:
            texts = utf8(df["text"])
            for a, z in text_chunks(texts, 1 << 20):
                for i in range(a, z):
                    words = terms_of(texts[i])
                    if len(ids) == SHARD or held and held + len(texts[i]) > SHARD_BYTES:
                        yield shard()
                        number += 1
                        ids, sizes, keys, held = [], [], [], 0
                    known = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    keys.append(known[known >= 0] << 16 | len(ids))
                    ids.append(df["doc_id"].iat[i])
                    sizes.append(len(words))
                    held += len(texts[i])
        if ids:
            yield shard()

    return run


def _document_counts(size: int):
    """Shards -> a row for each term of the vocabulary that a task has, and for the counts of all (-1 documents, -2 terms)."""

    def run(batches):
        total, filled, words = np.zeros(size, np.int64), 0, 0
        for df in batches:
            for r in df.itertuples():
                total[unpacked(r.terms, "<i4")] += unpacked(r.dfs, "<i4")
                filled, words = filled + r.filled, words + r.words
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(some, [-1, -2]), "n": np.append(total[some], [filled, words])})

    return run


def _indexed(weights):
    """Shards -> the same with their lists."""

    def run(batches):
        for df in batches:
            made = [Shard(r, weights.value).lists(weights.value.all_pairs) for r in df.itertuples()]
            yield df.assign(**{c: [packed(x[k]) for x in made] for k, c in enumerate(("pairs", "lengths", "joint"))})

    return run


def _heads(n_pairs: int):
    """Shards -> the TOP highest joint impacts that a task has of each pair."""

    def run(batches):
        heads = np.zeros((n_pairs, TOP), np.int64)
        for df in batches:
            for pairs, joint in zip(df["pairs"], df["joint"], strict=True):
                at = unpacked(pairs, "<i8")
                heads[at] = np.sort(np.concatenate([heads[at], unpacked(joint, "<i8").reshape(-1, TOP)], axis=1), axis=1)[:, : TOP - 1 : -1]
        some, place = np.nonzero(heads)
        yield pd.DataFrame({"pair": some, "impact": heads[some, place]})

    return run


def _searched(items, weights, least):
    def run(batches):
        held, w = items.value, weights.value
        best = Best(least.value)
        for df in batches:
            for r in df.itertuples():
                shard = Shard(r, w)
                joint = dict(zip(unpacked(r.pairs, "<i8").tolist(), unpacked(r.joint, "<i8").reshape(-1, TOP)[:, 0].tolist(), strict=True))
                ids, nulls = unpacked(r.ids, "<i8"), unpacked(r.nulls, "?")
                for k in range(len(held.ids)):
                    found, scores = evaluate(shard, k, w, joint, int(best.least[k]))
                    if len(found):
                        best.add(k, scores, ids[found], nulls[found])
        rows = [(k, None if null else str(doc), -score) for k, found in enumerate(best.rows) for score, null, doc in found]
        yield pd.DataFrame(rows, columns=["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: Items, top: int) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    n = len(items.vocabulary)
    shards = stash(docs.mapInPandas(_shards(sent), _SHARDS), "postings")
    counted = shards.select("filled", "words", "terms", "dfs").mapInPandas(_document_counts(n), "term int, n long")
    counts = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # of the block's vocabulary at most
    weights = Weights(items, counts.get(-1, 0), counts.get(-2, 0), np.array([counts.get(t, 0) for t in range(n)], np.int64))
    known = spark.sparkContext.broadcast(weights)
    index = stash(shards.mapInPandas(_indexed(known), f"{_SHARDS}, {_LISTS}"), "search-index")
    # the tenth highest joint impact of a pair is a score that ten documents reach
    heads = index.select("pairs", "joint").mapInPandas(_heads(len(weights.all_pairs)), "pair int, impact long")
    by = Window.partitionBy("pair").orderBy(F.desc("impact"))
    tenth = heads.withColumn("k", F.row_number().over(by)).where(f"k <= {TOP}").where(f"k = {TOP}").select("pair", "impact").collect()  # a row for each pair of the block
    tenth = {r.pair: r.impact for r in tenth}
    least = np.array([max([1, *(tenth.get(p, 0) for p, _, _ in pairs)]) for pairs in weights.pairs], np.int64)
    least = spark.sparkContext.broadcast(least)
    found = index.mapInPandas(_searched(sent, known, least), "item int, doc_id string, score long").withColumn("doc_id", F.col("doc_id").cast("long"))
    # few of many tasks' bests are left before an item's come together
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = Window.partitionBy("item", "part").orderBy(*order)
    found = found.withColumn("part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(parts)).where(f"rank <= {TOP}").drop("rank", "part")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(f"rank <= {top}")
    names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> item_id, rank, doc_id, score: each item's `top` (TOP at most) best documents with a score above 0.

    Equal scores go by ascending doc_id, a null doc_id last; equal rows are documents of their own. Rows that share
    an item_id (null is one too) are one item with the terms of all. Null and empty texts have no terms: such documents
    count nowhere, such items have no rows. Extra columns are ignored. Items go to the tasks in blocks of ITEM_BYTES
    of text or so, dealt by their id; each block is a pass over docs.
    """
    if not 1 <= top <= TOP:
        raise ValueError(f"top must be 1 to {TOP}")
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")  # pandas makes numbers with nulls inexact
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = size // ITEM_BYTES + 1, []
    for k in range(blocks):
        block = Items([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()])
        if block.ids:
            out.append(_block(docs, block, top))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents for each item of benchmark."""
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
l AS (SELECT doc_id, len(t) AS size FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS all_docs, CAST(sum(size) AS BIGINT) AS all_terms FROM l),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
x AS (SELECT doc_id, unnest(t) AS term FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
i AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * all_docs) // all_terms))) AS impact
  FROM p JOIN l USING (doc_id) JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= 10
"""
