"""A stored BM25 index in shards of documents, searched with bounds of blocks of postings.

A shard has the postings of some thousands of documents, term by term; a term's postings there are a block,
with its highest term frequency and its shortest document, so that no impact in it is higher than theirs,
whatever the corpus's average length and the term's weight are. These two come from all shards when a
question is asked, so documents are added by adding shards, and nothing that is stored changes.

A search looks at a shard only where its blocks together can reach the score of the k-th best document so far,
and finds candidates only by terms without which that score cannot be reached. Ranks of single documents come
from counting, in each shard, the scores above theirs: no list of all hits is made.

Scores are whole millionths. Documents may carry tags (entities), whose postings are stored beside those of terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import count
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docloom.config import DEFAULT

#: Documents of a shard, and characters of their texts, at most (a text is never split).
SHARD, SHARD_CHARS = 4096, 16 << 20
#: Documents that Spark takes for fewer bytes are dealt out to all cores first: such a table is often one block of one file, which one task would read. Larger ones stay where they are.
DEALT = 1 << 30
#: Characters of questions that are sent to the tasks at once; more take several passes.
QUESTION_CHARS = 4 << 20
#: One unit of a score.
UNIT = 1e-6
SHARDS = (
    "shard long, n int, words long, keys binary, sizes binary, terms string, dfs array<int>, places binary, tfs binary, most binary, least binary, "
    "tags array<string>, tag_dfs array<int>, tag_places binary"
)
KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 2, pa.string(), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
_BLANKS = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def words(text: str | None) -> list[str]:
    """Lower-cased words between runs of Unicode white space, as functions.text.tokens and F.lower make them."""
    text = (text or "").lower()
    return [w for w in _BLANKS.split(text) if w] if _CONTROLS.search(text) else text.split()


class _Numbers(dict):
    """A number for each word, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Postings:
    """Postings of lists of words as they come: of a list only its words' numbers and how often each is there are kept."""

    def __init__(self):
        self.number = _Numbers()
        self.own, self.times = [], []

    def add(self, ws: list[str]) -> None:
        own, times = np.unique(np.fromiter(map(self.number.__getitem__, ws), np.int32, len(ws)), return_counts=True)
        self.own.append(own)
        self.times.append(times.astype(np.int32))

    def made(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(words in order, in how many lists each is, the lists' numbers word by word, how often each is in each)."""
        order = sorted(self.number)
        place = np.zeros(len(order), np.int32)
        place[[self.number[w] for w in order]] = np.arange(len(order), dtype=np.int32)
        owner = np.repeat(np.arange(len(self.own), dtype=np.uint16), [len(x) for x in self.own])
        word = place[np.concatenate([*self.own, np.zeros(0, np.int32)])]
        sort = np.argsort(word, kind="stable")  # lists are in order already
        return order, np.bincount(word, minlength=len(order)), owner[sort], np.concatenate([*self.times, np.zeros(0, np.int32)])[sort]


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", tags: str | None = None, only: frozenset[str] | None = None) -> DataFrame:
    """Documents as shards of an index, to be written (kept, or added to a store). Rows without a key are left out; a null text has no words.

    With `only` (`words_of` questions) other words have no postings, but count in a document's size: such an index answers these questions as a whole one does.
    """
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        only = None if sent is None else sent.value
        number = count(TaskContext.get().partitionId() << 32)
        keys, sizes, own, tagged, chars = [], [], _Postings(), _Postings(), 0

        def shard() -> pa.RecordBatch:
            terms, dfs, places, tfs = own.made()
            names, tag_dfs, tag_places, _ = tagged.made()
            size, first = np.array(sizes, np.int32), np.cumsum(dfs) - dfs
            most = np.maximum.reduceat(tfs, first) if len(terms) else tfs
            least = np.minimum.reduceat(size[places], first) if len(terms) else tfs
            raw = lambda a, kind: a.astype(kind).tobytes()
            row = (next(number), len(keys), int(size.sum()), raw(np.array(keys), "<i8"), raw(size, "<i4"), "\n".join(terms), dfs.astype(np.int32), raw(places, "<u2"), raw(tfs, "<i4"), raw(most, "<i4"), raw(least, "<i4"), names, tag_dfs.astype(np.int32), raw(tag_places, "<u2"))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:  # by Arrow, so that only one text at a time is a Python string
            for k, t, x in zip(*batch.columns, strict=True):
                t = t.as_py() or ""
                if len(keys) == SHARD or keys and chars + len(t) > SHARD_CHARS:
                    yield shard()
                    keys, sizes, own, tagged, chars = [], [], _Postings(), _Postings(), 0
                ws = words(t)
                keys.append(k.as_py())
                sizes.append(len(ws))
                own.add(ws if only is None else [w for w in ws if w in only])
                tagged.add(sorted({y for y in x.as_py() or [] if y is not None}))
                chars += len(t)
        if keys:
            yield shard()

    own = docs.where(F.col(key).isNotNull())
    if int(str(own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < DEALT:
        own = own.repartition(own.sparkSession.sparkContext.defaultParallelism)
    own = own.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), (F.col(tags) if tags else F.array().cast("array<string>")).alias("tags"))
    return own.mapInArrow(run, SHARDS)


def _rows(batches) -> Iterator[SimpleNamespace]:
    """Shards one by one, their binary columns as buffers of the batch, not copied."""
    for batch in batches:
        names, kinds = batch.schema.names, batch.schema.types
        for i in range(batch.num_rows):
            row = [c[i] for c in batch.columns]
            yield SimpleNamespace(**{n: x.as_buffer() if pa.types.is_binary(t) or pa.types.is_large_binary(t) else (x.values.to_numpy() if pa.types.is_integer(t.value_type) else x.values) if pa.types.is_list(t) else x.as_py() for n, t, x in zip(names, kinds, row, strict=True)})


def stats(index: DataFrame) -> DataFrame:
    """(n, avgdl) of the documents of all shards."""
    return index.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), (F.coalesce(F.sum("words"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("avgdl"))


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df) of all terms."""
    each = index.where("terms <> ''").select(F.explode(F.arrays_zip(F.split("terms", "\n").alias("terms"), "dfs")).alias("x"))
    return each.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))


def weights(index: DataFrame) -> DataFrame:
    """(term, df, idf) of all terms."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return document_counts(index).join(F.broadcast(stats(index))).select("term", "df", idf.alias("idf"))


class Questions:
    """A block of questions with what the corpus says about their words. Words that a question has twice count twice."""

    def __init__(self, rows: list[tuple[int, str | None]], index: DataFrame):
        bags = {q: words(t) for q, t in rows}
        self.ids = sorted(bags)
        self.terms = np.array(sorted(set().union(*bags.values())), dtype=object)
        number = {t: i for i, t in enumerate(self.terms)}
        self.bags = [np.unique(np.array([number[w] for w in bags[q]], np.int64), return_counts=True) for q in self.ids]
        self.n, self.average = map(float, stats(index).first())
        sent = index.sparkSession.sparkContext.broadcast(self.terms)

        def found(batches):
            total = np.zeros(len(sent.value), np.int64)
            for row in _rows(batches):
                at, hit = _places(listed(row.terms), sent.value)
                total[hit] += row.dfs[at[hit]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "df"])

        df = np.zeros(len(self.terms))
        for r in index.select("terms", "dfs").mapInArrow(found, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # of the block's words at most
            df[r.term] = r.df
        self.idf = np.log((self.n - df + 0.5) / (df + 0.5) + 1)


def listed(terms: str) -> list[str]:
    """A shard's terms; one text is read faster than a list of a hundred thousand, and no word has a line end."""
    return terms.split("\n") if terms else []


def _places(have, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the asked words are in a sorted array, and which of them are."""
    have = np.asarray(have, dtype=object)
    if not len(have) or not len(asked):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return at, have[at] == asked


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of some ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Shard:
    """A shard as a block of questions sees it. What a pass does not use is not read, so the row may lack it."""

    def __init__(self, row, asked: Questions):
        self.row, self.asked = row, asked
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def keys(self) -> np.ndarray:
        return np.frombuffer(self.row.keys, "<i8")

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.frombuffer(self.row.sizes, "<i4")

    @cached_property
    def places(self) -> np.ndarray:
        return np.frombuffer(self.row.places, "<u2")

    @cached_property
    def tfs(self) -> np.ndarray:
        return np.frombuffer(self.row.tfs, "<i4")

    @cached_property
    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the asked words are among the shard's terms, and which of them are."""
        return _places(listed(self.row.terms), self.asked.terms)

    @cached_property
    def ends(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.row.dfs, dtype=np.int64)))

    @cached_property
    def present(self) -> np.ndarray:
        return self.found[1]

    @cached_property
    def first(self) -> np.ndarray:
        return self.ends[self.found[0]]

    @cached_property
    def last(self) -> np.ndarray:
        return self.ends[np.minimum(self.found[0] + 1, len(self.ends) - 1)]

    @cached_property
    def bound(self) -> np.ndarray:
        if not self.present.any():
            return np.zeros(len(self.asked.terms))
        at, hit = self.found
        most, least = np.frombuffer(self.row.most, "<i4")[at], np.frombuffer(self.row.least, "<i4")[at]
        return np.where(hit, self.asked.idf * self.share(most, least), 0.0)

    def share(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        k1, b = DEFAULT.bm25_k1, DEFAULT.bm25_b
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / (self.asked.average or 1.0)))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of a term and its impacts there."""
        if term not in self.made:
            some = slice(self.first[term], self.last[term])
            places = self.places[some].astype(np.int64)
            self.made[term] = places, self.asked.idf[term] * self.share(self.tfs[some], self.sizes[places])
        return self.made[term]

    @cached_property
    def all_postings(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The places and impacts of all asked words, word by word, and where each word's begin."""
        n = np.where(self.present, self.last - self.first, 0)
        at = _ranges(self.first, n)
        places = self.places[at].astype(np.int64)
        return places, np.repeat(self.asked.idf, n) * self.share(self.tfs[at], self.sizes[places]), [0, *np.cumsum(n).tolist()]

    def scores(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Every document's score for a question, and which documents share a word with it (a word's impact is above 0)."""
        places, impacts, begin = self.all_postings
        terms, times = (x.tolist() for x in self.asked.bags[q])
        none = np.zeros(0, np.int64), np.zeros(0)
        some = [(places[begin[t] : begin[t + 1]], impacts[begin[t] : begin[t + 1]]) for t in terms]
        added = [x if n == 1 else n * x for (_, x), n in zip(some, times, strict=True)]
        total = np.bincount(np.concatenate([none[0], *[p for p, _ in some]]), np.concatenate([none[1], *added]), len(self.keys))  # each document's words in order, as if added one by one
        return np.rint(total / UNIT).astype(np.int64), total > 0

    def holding(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a key, place) of all documents here that have one of some keys."""
        order, own = self.by_key
        first = np.searchsorted(own, keys, "left")
        n = np.searchsorted(own, keys, "right") - first
        return np.repeat(np.arange(len(keys)), n), order[_ranges(first, n)]

    @cached_property
    def by_key(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.keys, kind="stable")
        return order, self.keys[order]

    def reaching(self, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that share a word with a question and reach a score; of the blocks only those needed are looked at."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms, times = self.asked.bags[q]
        own = self.present[terms]
        terms, times = terms[own], times[own]
        bound = times * self.bound[terms]
        order = np.argsort(bound, kind="stable")
        terms, times, reach = terms[order], times[order], np.cumsum(bound[order]) / UNIT + 1  # a unit more, for rounding
        if not len(terms) or reach[-1] < least:
            return none
        rest = int(np.searchsorted(reach, least))  # all terms before cannot reach it together
        total, hit = np.zeros(len(self.keys)), np.zeros(len(self.keys), bool)
        for t, n in zip(terms[rest:], times[rest:], strict=True):
            places, impacts = self.postings(t)
            total[places] += n * impacts
            hit[places] = True
        found = np.flatnonzero(hit)
        for k in range(rest - 1, -1, -1):
            found = found[total[found] / UNIT + reach[k] >= least]
            if not len(found):
                return none
            places, impacts = self.postings(terms[k])
            total[places] += times[k] * impacts
        scores = np.rint(total[found] / UNIT).astype(np.int64)
        return found[scores >= least], scores[scores >= least]

    @cached_property
    def tag_ends(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.row.tag_dfs, dtype=np.int64)))

    def tag_ranges(self, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents of some tags begin and how many they are."""
        at, hit = _places(self.row.tags, tags)
        return self.tag_ends[at], np.where(hit, self.tag_ends[np.minimum(at + 1, len(self.tag_ends) - 1)] - self.tag_ends[at], 0)

    def tagged(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many of some tags, given by their ranges, each document has."""
        return np.bincount(np.frombuffer(self.row.tag_places, "<u2")[_ranges(first, n)], minlength=len(self.keys))

    def tags_of(self, place: int) -> list[str]:
        held = np.flatnonzero(np.frombuffer(self.row.tag_places, "<u2") == place)
        return [str(self.row.tags[k]) for k in np.searchsorted(self.tag_ends, held, "right") - 1]


def over_shards(index: DataFrame, asked, each: Callable[[], tuple[Callable, Callable]], schema: str, *columns: str) -> DataFrame:
    """A pass over all shards: `each` makes, for a task, what takes a shard and yields frames, and what gives frames at the end. `asked` is the broadcast of the questions; with `columns` only these are read."""

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches) -> Iterator[pa.RecordBatch]:
        take, end = each()
        for row in _rows(batches):
            for df in take(Shard(row, asked.value)):
                yield pa.RecordBatch.from_pandas(df, kinds, preserve_index=False)
        for df in end():
            yield pa.RecordBatch.from_pandas(df, kinds, preserve_index=False)

    return (index.select(*columns) if columns else index).mapInArrow(run, schema)


def best_rows(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in an order, with their place as rank; what many tasks have is cut down in parts before a group comes together."""
    part = Window.partitionBy(*by, "__part").orderBy(*order)
    some = df.withColumn("__part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("__part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


class Best:
    """A task's k best (score, key) of each of n questions so far, and the score that one must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n)], np.zeros(n, np.int64)

    def add(self, q: int, scores: np.ndarray, keys: np.ndarray) -> None:
        least = self.least[q]
        if len(scores) > 4 * self.k:  # those after the k-th place need no order
            least = max(least, np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
        some = scores >= least
        scores, keys = scores[some], keys[some]
        if not len(keys):
            return
        order = np.lexsort((keys, -scores))[: self.k]
        self.rows[q] = sorted([*self.rows[q], *zip((-scores[order]).tolist(), keys[order].tolist(), strict=True)])[: self.k]
        if len(self.rows[q]) == self.k:
            self.least[q] = -self.rows[q][-1][0]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame([(q, key, -score) for q, rows in enumerate(self.rows) for score, key in rows], columns=["q", "key", "score"])


def blocks_of(questions: DataFrame, index: DataFrame, query: str, text: str) -> Iterator[Questions]:
    """Questions in blocks of about QUESTION_CHARS characters, dealt by their id."""
    own = questions.where(F.col(query).isNotNull()).select(F.col(query).cast("long").alias("q"), F.col(text).alias("t"))
    blocks = (own.agg(F.sum(F.length("t"))).first()[0] or 0) // QUESTION_CHARS + 1
    for k in range(blocks):
        rows = [(r.q, r.t) for r in own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()]
        if rows:
            yield Questions(rows, index)


def words_of(questions: DataFrame, text: str = "text") -> frozenset[str] | None:
    """All words of questions that fit in one block, else None: then an index of all words is for them."""
    if (questions.agg(F.sum(F.length(text))).first()[0] or 0) >= QUESTION_CHARS:
        return None
    return frozenset(w for r in questions.select(F.col(text).alias("t")).collect() for w in words(r.t))


def search(index: DataFrame, questions: DataFrame, k: int, query: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, key, score, rank): each question's k best documents that share a word with it, equal scores by key."""
    spark, out = index.sparkSession, []
    for asked in blocks_of(questions, index, query, text):
        sent = spark.sparkContext.broadcast(asked)

        def each(sent=sent):
            best = Best(len(sent.value.ids), k)

            def take(shard: Shard):
                for q in range(len(best.rows)):
                    found, scores = shard.reaching(q, int(best.least[q]))
                    if len(found):
                        best.add(q, scores, shard.keys[found])
                return ()

            return take, lambda: [best.frame()]

        found = best_rows(over_shards(index, sent, each, "q int, key long, score long"), ["q"], [F.desc("score"), F.asc("key")], k)
        names = spark.createDataFrame(list(enumerate(asked.ids)), f"q int, {query} long")
        out.append(found.join(F.broadcast(names), "q").select(query, F.col("key").alias(key), F.round(F.col("score") * UNIT, 6).alias("score"), "rank"))
    if not out:
        return spark.createDataFrame([], f"{query} long, {key} long, score double, rank long")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found
