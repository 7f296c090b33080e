"""Helpers that the operators share: table reading, scratch tables, connected components, byte-level words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Everything but the ASCII space and \t \n \v \f \r makes up words.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch of rows that goes to Python: four tasks' texts, frames and results then take little of an executor, however long the texts are.
BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns. Bounds the session's batches to Python (spark.sql.execution.arrow.maxBytesPerBatch), as all operators here run on texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set by setCheckpointDir.

    Only a local master, where all tasks run in one process, gets one of its own if none is named.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-docloom-"))
        base = sc.getCheckpointDir()
    return base


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    for df in stashed:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stash_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As stash, and the number of rows, counted while they are written."""
    seen = Observation()
    stored = stash(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return stored, seen.get.get("rows") or 0


#: Edges that a task contracts at a time.
EDGES = 1 << 20


def _forest(batches):
    """The edges of each EDGES or so as a star forest: (node, smallest node that these edges lead to)."""

    def stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
        ends = np.concatenate([p[c].to_numpy(np.int64) for c in ("a", "b") for p in parts])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], least)
            np.minimum.at(new, label[b], least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})

    held, n = [], 0
    for df in batches:
        held.append(df)
        n += len(df)
        if n >= EDGES:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable, for every node but the components' smallest ones.

    Each task first makes a star forest of the edges it has. Then large-star and small-star steps
    alternate; a step takes the smallest neighbour of each node by a map-side combined aggregate and
    joins it back, so that no neighbourhood is gathered in one place. Every round is written to the
    shared folder. Nulls and loops in edges are ignored.
    """

    def settled(edges: DataFrame) -> bool:
        """Whether the edges are stars: no node has two edges down, or one down and one up."""
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down > 0 AND up > 0").isEmpty()

    edges = stash(edges.where("a <> b").select("a", "b").mapInPandas(_forest, "a long, b long").distinct(), "edges")
    for _ in range(max_rounds):
        if settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        # a node's other neighbours get its smallest one; that edge itself stays
        small = large.join(least, F.col("a") == F.col("k")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        was, edges = edges, stash(small, "edges")
        discard(was)
    raise RuntimeError("connected components did not settle")


def text_chunks(texts: list[bytes], most: int = 1 << 19):
    """Slices of the list whose texts hold about `most` bytes together; a longer text is alone in its slice."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(values) -> list[bytes]:
    """UTF-8 of strings; null is the empty text, and a lone surrogate (not valid in UTF-8) becomes '?'."""
    return [x.encode("utf-8", "replace") if isinstance(x, str) else b"" for x in values]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts, and for each text the index after its last word."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power = np.full(len(joined) + 1, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[joined]] * power[:-1], out=sums[1:])
    back = np.full(len(joined) + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, ends_at)
