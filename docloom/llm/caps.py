"""Operator 1: near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction of the sphere; a vector is in the filter's cap if its dot product with the
direction exceeds a threshold. The directions form a product code: after a random rotation the
dimensions are cut into blocks, each block has a few random codewords, and every combination of one
codeword from each block is a direction. So a few hundred codewords stand for millions of directions,
and all that a vector exceeds are list-decoded from the blocks' sorted scores. Vectors that share a
label and a filter are compared exactly, in double precision.

A product code's directions lie unevenly: with one threshold for all, some vectors are in no cap and
others in hundreds (measured: a fifth of pairs at cosine 0.93 would share none). So a vector's threshold
is the score of its own FILTERS-th best direction in each code, which also bounds the rows that are
joined. tests/llm measures recall against brute force at the lowest cosine that counts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from docloom.llm.common import connected_components, discard, stash, table

#: Rotations with codes of their own; blocks of each code; codewords of each block; filters that a vector exceeds in each code.
TABLES, BLOCKS, WORDS, FILTERS = 4, 3, 128, 12
#: Members of one label and filter that are compared in one task; larger groups are dealt out as pairs of parts.
PART = 1024
MIN_COSINE = 0.93


@lru_cache(16)
def code(dim: int, seed: int, words: int = WORDS, blocks: int = BLOCKS):
    """A rotation, and for each block its dimensions and codewords."""
    rng = np.random.default_rng([20240311, seed, dim])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for cut in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.standard_normal((words, len(cut)))
        books.append((cut, c / np.linalg.norm(c, axis=1, keepdims=True)))
    return rotation, books


@lru_cache(4)
def _places(most: int, blocks: int) -> np.ndarray:
    """Ranks (one for each block, from 0) that can be among the `most` best sums: a combination has no more rivals above it than it has of better or equal ranks in every block."""
    found = [()]
    for _ in range(blocks):
        found = [(*f, r) for f in found for r in range(most) if np.prod([x + 1 for x in f]) * (r + 1) <= most]
    return np.array(found)


def decode(unit: np.ndarray, seed: int, filters: int = FILTERS) -> np.ndarray:
    """The filters whose caps hold each unit vector in one code, `filters` of them: the directions with the highest dot products."""
    rotation, books = code(unit.shape[1], seed)
    turned = unit @ rotation
    filters = min(filters, WORDS ** len(books))
    places = _places(filters, len(books))
    places = places[(places < WORDS).all(axis=1)]
    sums, ids = np.zeros((len(unit), len(places))), np.zeros((len(unit), len(places)), np.int64)
    for k, (cut, book) in enumerate(books):
        scores = turned[:, cut] @ book.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(filters, WORDS)][:, places[:, k]]
        sums += np.take_along_axis(scores, best, axis=1)
        ids = ids * WORDS + best
    top = np.argsort(-sums, axis=1, kind="stable")[:, :filters]
    return np.take_along_axis(ids, top, axis=1)


def _matrix(vectors) -> np.ndarray:
    """The vectors, all of one length, as unit rows in double precision; scaled first, so that no square leaves the range of doubles."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepared(batches):
    """Valid vectors with a digest of their components and their length; cosines need a finite, non-zero vector."""
    for df in batches:
        keep, keys = [], []
        for i, v in enumerate(df["embedding"]):
            if v is None or not len(v):
                continue
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all() and x.any():
                keep.append(i)
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
        out = df.iloc[keep]
        yield out.assign(same=keys, dim=out["embedding"].map(len))[["vec_id", "label", "same", "dim", "embedding"]]


def _filters(batches):
    for df in batches:
        for dim, part in df.groupby("dim", sort=False):
            for at in range(0, len(part), 512):
                some = part.iloc[at : at + 512]
                x = _matrix(some["embedding"])
                found = np.concatenate([decode(x, t) + t * WORDS ** min(BLOCKS, dim) for t in range(TABLES)], axis=1)
                found.sort(axis=1)
                yield pd.DataFrame({"rep": some["rep"], "filters": list(found.astype(np.int32))})


def _met_before(filters: list[np.ndarray], this: int) -> np.ndarray:
    """Which two of the rows share a filter that comes before this one; a bounded number of filters at a time."""
    early = [f[: np.searchsorted(f, this)] for f in filters]
    names, counts = np.unique(np.concatenate(early), return_counts=True)
    names = names[counts > 1]
    met = np.zeros((len(filters), len(filters)), bool)
    for at in range(0, len(names), 4096):
        some = names[at : at + 4096]
        member = np.zeros((len(filters), len(some)), np.float32)
        for k, f in enumerate(early):
            f = f[np.searchsorted(f, some[0]) : np.searchsorted(f, some[-1], side="right")]
            place = np.searchsorted(some, f)
            member[k, place[some[place] == f]] = 1
        met |= member @ member.T > 0.5
    return met


def _links(batches):
    """Compare the members of each (label, dim, filter, tile) run; a pair counts in the first filter it shares only.

    Yields for each member the weight of its partners (as `links`) and one partner that it is joined
    with (the smallest in what the run connects), so the output is as large as the input at most.
    """
    held: pd.DataFrame | None = None
    names = ["label", "dim", "filter", "tile"]

    def run(df: pd.DataFrame):
        n = len(df)
        if n < 2:
            return None
        x = _matrix(df["embedding"])
        part, reps, copies = df["part"].to_numpy(), df["rep"].to_numpy(), df["copies"].to_numpy()
        close = x @ x.T >= MIN_COSINE
        np.fill_diagonal(close, False)
        if df["tile"].iat[0] % 2:
            close &= part[:, None] != part[None, :]  # pairs inside one part belong to that part's own tile
        if not close.any():
            return None
        near = np.flatnonzero(close.any(axis=1))
        close = close[np.ix_(near, near)]
        close &= ~_met_before([df["filters"].iat[i] for i in near], int(df["filter"].iat[0]))
        if not close.any():
            return None
        reps, copies = reps[near], copies[near]
        label = np.arange(len(near))
        while True:  # smallest reachable member; the runs are small
            least = np.where(close, label[None, :], len(near)).min(axis=1)
            new = np.minimum(label, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        order = np.full(len(near), np.iinfo(np.int64).max)
        np.minimum.at(order, label, reps)
        some = close.any(axis=1)
        return pd.DataFrame({"rep": reps, "links": close @ copies, "joined": order[label]})[some]

    for df in batches:
        if held is not None:
            df = pd.concat([held, df], ignore_index=True)
        if not len(df):
            continue
        new = np.zeros(len(df) - 1, bool)
        for c in names:
            new |= df[c].to_numpy()[1:] != df[c].to_numpy()[:-1]
        cut = np.flatnonzero(new) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(df)]))
        held = df.iloc[starts[-1] :]
        for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if b - a > 1 and (out := run(df.iloc[a:b])) is not None:
                yield out
    if held is not None and (out := run(held)) is not None:
        yield out


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id long, embedding array<float|double>, label) -> vec_id, n_links, component_id, kept, one row for each row.

    Only vectors with one and the same label (not null) are compared. A vector that is null, empty,
    zero or not finite links with nothing, nor do vectors of different lengths. Rows with equal
    components and one label are a class, compared once and counted in full. Rows that share a vec_id
    are vectors of their own: each has its own links, and ids only name components. A row with a null
    vec_id takes part like any other, but names no component: it is kept only if no row of its component has
    an id, which then is null. Extra columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType
    array = "array<float>" if isinstance(element, FloatType) else "array<double>"
    # ids are text until the end: pandas makes numbers with nulls inexact
    rows = vectors.select(F.col("vec_id").cast("long").cast("string").alias("vec_id"), F.col("embedding").cast(array).alias("embedding"), "label")
    kind = rows.schema["label"].dataType.simpleString()
    valid = rows.where("label IS NOT NULL").mapInPandas(_prepared, f"vec_id string, label {kind}, same binary, dim int, embedding {array}")
    valid = stash(valid, "vectors")
    classes = valid.groupBy("label", "same").agg(F.min(F.col("vec_id").cast("long")).alias("lowest"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"))
    # numbered when written, so a class keeps its number in all that is read from the table
    reps = stash(classes.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    filters = stash(reps.select("rep", "dim", "embedding").mapInPandas(_filters, "rep long, filters array<int>"), "filters")
    held = filters.join(reps.select("rep", "label", "dim"), "rep").select("rep", "label", "dim", F.explode("filters").alias("filter"))
    own = ["label", "dim", "filter"]
    shared = held.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    held = held.join(shared, own).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # a tile holds one part, or two (then its number is odd, and only pairs across count)
    tiles = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.least(F.col("part"), j) * F.col("parts") + F.greatest(F.col("part"), j)) * 2 + (F.col("part") != j).cast("int")))
    held = held.select(*own, "rep", "part", F.explode(tiles).alias("tile"))
    full = held.join(reps.select("rep", "embedding", "copies"), "rep").join(filters, "rep")
    found = full.select(*own, "tile", "part", "rep", "copies", "embedding", "filters")
    found = found.repartition(*own, "tile").sortWithinPartitions(*own, "tile", "rep")
    found = stash(found.mapInPandas(_links, "rep long, links long, joined long"), "vector-links")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("joined").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("label", "same", "rep", "lowest", "copies").join(sums, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "same", "lowest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    names = known.groupBy("component").agg(F.min("lowest").alias("component_id"))
    known = stash(known.join(names, "component").select("label", "same", "n_links", "component_id"), "known-vectors")
    discard(reps, filters, found)
    linked = valid.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "same").join(known, ["label", "same"]).select("vec_id", "n_links", "component_id")
    usable = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rest = rows.where(F.col("label").isNull() | ~F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(rest.withColumn("component_id", F.col("vec_id"))).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
