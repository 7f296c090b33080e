"""Dense search: exact by matrix products, and approximate by an inverted file of residual product codes.

The file has a list for each of its centres, more lists the more vectors there are. Of a vector it stores the list,
a code of a byte for each few components of what is left after the list's centre, and the vector itself, in
blocks of one list. A question scores the codes by tables of products, and only the vectors of its shortlist are
read and compared. Which lists a question looks into is estimated from a sample: those where a vector is to be
expected that beats the k-th best of the sample, which the k-th best of all can only exceed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.lexical import best_rows
from docloom.sources.scratch import kept

#: Bytes of question vectors that are sent to the tasks at once; more take several passes.
QUESTION_BYTES = 32 << 20
#: Vectors that are compared at a time, and in a block of a list.
BLOCK = 1024
#: Questions that a block is compared with at a time: what a task holds beside its questions does not grow with their number.
TILE = 256
#: Vectors on which the file is fitted, components of a code, and vectors of the sample for each list at least.
SAMPLE, COMPONENTS, EACH = 20_000, 4, 8
#: A list is looked into where more than so many of its vectors are expected to beat the k-th best of the sample.
EXPECTED = 0.01
#: The shortlist: so many vectors, but no more than a tenth of all unless k asks for it.
SHORTLIST = 400


def _question_blocks(queries: DataFrame, query: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of questions, dealt into blocks by their id."""
    own = queries.where(F.col(vector).isNotNull() & F.col(query).isNotNull()).select(F.col(query).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    size = own.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = 8 * size // QUESTION_BYTES + 1
    for k in range(blocks if size else 0):
        rows = own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()
        if rows:
            yield np.array([r.q for r in rows], np.int64), np.array([r.v for r in rows])


class _Best:
    """The k best (score, key) of each question so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.keys = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, keys: np.ndarray, first: int = 0) -> None:
        """Scores of questions, all or those from `first` on, with some keys, in ascending order of these."""
        near = np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= self.scores[first : first + len(scores), -1])
        some, scores = near + first, scores[near]
        both = np.concatenate([self.scores[some], scores], axis=1)
        of = np.concatenate([self.keys[some], np.broadcast_to(keys, (len(some), len(keys)))], axis=1)
        order = np.lexsort((of, -both), axis=1)[:, : self.k]
        self.scores[some], self.keys[some] = np.take_along_axis(both, order, 1), np.take_along_axis(of, order, 1)

    def frame(self) -> pd.DataFrame:
        q, place = np.nonzero(self.scores > -np.inf)
        return pd.DataFrame({"q": q, "key": self.keys[q, place], "score": self.scores[q, place]})


def _named(found: list[tuple[np.ndarray, DataFrame]], spark, query: str, key: str) -> DataFrame:
    if not found:
        return spark.createDataFrame([], f"{query} long, {key} long, score double, rank long")
    out = None
    for ids, df in found:
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], f"q int, {query} long")
        some = df.join(F.broadcast(names), "q").select(query, F.col("key").alias(key), "score", "rank")
        out = some if out is None else out.unionByName(some)
    return out


def _vectors(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    return chunks.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


def dense_top(chunks: DataFrame, queries: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query, key, score, rank): the k highest dot products of each query with all chunks, ties by key; null vectors take no part.

    The questions go to the tasks in blocks of QUESTION_BYTES; each task compares its chunks by matrix products and keeps k
    of each question, and what the tasks kept is cut down twice before a question comes together. Nothing is paired by a join.
    """
    spark, out = chunks.sparkSession, []
    for ids, matrix in _question_blocks(queries, query, vector):
        sent = spark.sparkContext.broadcast(matrix)

        def run(batches, sent=sent):
            asked = sent.value
            best = _Best(len(asked), k)
            for df in batches:
                df = df.sort_values("key", kind="stable")
                for a in range(0, len(df), BLOCK):
                    some = df.iloc[a : a + BLOCK]
                    own, keys = np.stack(some["v"].to_numpy()).T, some["key"].to_numpy(np.int64)
                    for q in range(0, len(asked), TILE):
                        best.add(np.round(asked[q : q + TILE] @ own, digits) + 0.0, keys, q)
            yield best.frame()

        found = _vectors(chunks, key, vector).mapInPandas(run, "q int, key long, score double")
        out.append((ids, best_rows(found, ["q"], [F.desc("score"), F.asc("key")], k)))
    return _named(out, spark, query, key)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _fitted(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of n groups of vectors; a group that loses all its vectors keeps its centre."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


class Codes:
    """Centres, code books and the sample that they were fitted on."""

    def __init__(self, sample: np.ndarray, n: int):
        self.sample, dim = sample, sample.shape[1]
        self.centres = _fitted(sample, max(1, min(len(sample) // EACH, int(n**0.5))), 8, 5)
        self.list_of = _nearest(sample, self.centres)
        rest = sample - self.centres[self.list_of]
        self.cuts = list(range(0, dim, COMPONENTS))
        self.books = [_fitted(rest[:, a : a + COMPONENTS], min(256, len(rest)), 6, 7) for a in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(x, self.centres)
        rest = x - self.centres[lists]
        codes = np.stack([_nearest(rest[:, a : a + COMPONENTS], book) for a, book in zip(self.cuts, self.books, strict=True)], axis=1)
        return lists, codes.astype(np.uint8)

    def products(self, asked: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each question its products with all centres, and its tables of products with all code words."""
        return asked @ self.centres.T, [asked[:, a : a + COMPONENTS] @ book.T for a, book in zip(self.cuts, self.books, strict=True)]

    def lists(self, asked: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
        """Which lists each question looks into (questions by lists): by the mean and spread of its products with the sample's vectors of a list, at least those k lists whose centres are nearest."""
        s = asked @ self.sample.T
        least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        sizes = np.bincount(self.list_of, minlength=len(self.centres))
        means, squares = np.zeros((len(asked), len(self.centres))), np.zeros((len(asked), len(self.centres)))
        for j in np.flatnonzero(sizes).tolist():
            own = s[:, self.list_of == j]
            means[:, j], squares[:, j] = own.mean(axis=1), own.var(axis=1)
        pooled = (squares * sizes).sum(axis=1, keepdims=True) / max(1, sizes.sum())
        means = np.where(sizes > 0, means, asked @ self.centres.T)
        spread = np.sqrt(np.where(sizes >= EACH, squares * (1 + 2 / np.maximum(sizes, 1)), np.maximum(squares, pooled))) + 1e-9
        far = np.maximum(0.0, (least[:, None] - means) / spread)
        wanted = counts * np.exp(-far * far / 2) > EXPECTED
        near = np.argsort(-(asked @ self.centres.T), axis=1)[:, :k]
        np.put_along_axis(wanted, near, True, axis=1)
        return wanted & (counts > 0)


class VectorFile:
    """A stored file: blocks of (list, part, keys, codes, vectors), the codes' model, and how many vectors each list has."""

    def __init__(self, blocks: DataFrame, codes: Codes, counts: np.ndarray):
        self.blocks, self.codes, self.counts = blocks, codes, counts


def build(chunks: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> VectorFile | None:
    """The file of all vectors, or None where there is none. It is fitted on the `sample` vectors whose keys hash lowest; every vector is stored."""
    spark, own = chunks.sparkSession, _vectors(chunks, key, vector)
    n = own.count()
    if not n:
        return None
    chosen = own.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    codes = Codes(np.array([r.v for r in chosen]), n)
    sent = spark.sparkContext.broadcast(codes)

    def run(batches):
        for df in batches:
            for a in range(0, len(df), 4096):
                some = df.iloc[a : a + 4096]
                x = np.stack(some["v"].to_numpy())
                lists, made = sent.value.encode(x)
                yield pd.DataFrame({"list": lists, "key": some["key"].to_numpy(), "code": [c.tobytes() for c in made], "v": [v.astype("<f8").tobytes() for v in x]})

    rows = kept(own.mapInPandas(run, "list int, key long, code binary, v binary"), "coded-vectors")
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    counts = np.zeros(len(codes.centres), np.int64)
    for r in sizes.collect():  # a row for each list
        counts[r.list] = r.n
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    blocks = dealt.groupBy("list", "part").agg(F.array_sort(F.collect_list(F.struct("key", "code", "v"))).alias("x"))
    blocks = blocks.select("list", "part", F.col("x.key").alias("keys"), F.col("x.code").alias("codes"), F.col("x.v").alias("vectors"))
    return VectorFile(kept(blocks.repartitionByRange("list", "part").sortWithinPartitions("list", "part"), "vector-file"), codes, counts)


def shortlists(file: VectorFile, asked: np.ndarray, k: int, size: int) -> DataFrame:
    """(q, key, list, part, place): the `size` vectors of each question with the highest scores by their codes, of the lists that it looks into."""
    spark = file.blocks.sparkSession
    wanted = file.codes.lists(asked, file.counts, k)
    sent = spark.sparkContext.broadcast((file.codes, asked, wanted))

    def run(batches):
        codes, asked, wanted = sent.value
        centre, books = codes.products(asked)
        best = _Best(len(asked), size)
        where: list[tuple[int, int, int]] = []
        for df in batches:
            for number, part, held in zip(df["list"], df["part"], df["codes"], strict=True):
                some = np.flatnonzero(wanted[:, number])
                if not len(some):
                    continue
                code = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
                scores = np.full((len(asked), len(code)), -np.inf)
                scores[some] = centre[some, number][:, None] + sum(book[some][:, code[:, m]] for m, book in enumerate(books))
                best.add(scores, np.arange(len(where), len(where) + len(code)))
                where += [(number, part, i) for i in range(len(code))]
        found = best.frame()
        at = np.array(where, np.int64).reshape(-1, 3)[found["key"].to_numpy()]
        yield pd.DataFrame({"q": found["q"], "about": found["score"], "list": at[:, 0], "part": at[:, 1], "place": at[:, 2]})

    found = file.blocks.select("list", "part", "codes").mapInPandas(run, "q int, about double, list int, part int, place int")
    return best_rows(found, ["q"], [F.desc("about"), F.asc("list"), F.asc("part"), F.asc("place")], size).drop("rank")


def ann_top(chunks: DataFrame, queries: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", digits: int = 6, file: VectorFile | None = None) -> DataFrame:
    """As dense_top, approximately: each question's shortlist by codes is compared exactly, at most a tenth of all vectors (2 k where that is more). tests measure recall."""
    spark, out = chunks.sparkSession, []
    file = file or build(chunks, key, vector)
    if file is None:
        return _named([], spark, query, key)
    size = max(2 * k, min(SHORTLIST, int(file.counts.sum()) // 10))
    for ids, asked in _question_blocks(queries, query, vector):
        short = kept(shortlists(file, asked, k, size), "shortlists")
        sent = spark.sparkContext.broadcast(asked)

        def run(batches, sent=sent):
            for df in batches:
                for keys, vectors, held in zip(df["keys"], df["vectors"], df["held"], strict=True):
                    q, place = np.array([h["q"] for h in held]), np.array([h["place"] for h in held])
                    v = np.frombuffer(b"".join(vectors), "<f8").reshape(len(keys), -1)[place]
                    yield pd.DataFrame({"q": q, "key": np.asarray(keys)[place], "score": np.round((sent.value[q] * v).sum(axis=1), digits) + 0.0})

        held = short.groupBy("list", "part").agg(F.collect_list(F.struct("q", "place")).alias("held"))  # questions of the block by places of the block
        found = file.blocks.select("list", "part", "keys", "vectors").join(held, ["list", "part"]).mapInPandas(run, "q int, key long, score double")
        out.append((ids, best_rows(found, ["q"], [F.desc("score"), F.asc("key")], k)))
    return _named(out, spark, query, key)
