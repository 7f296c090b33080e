"""Operator 2: exact n-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A document's set holds 64-bit hashes of its distinct runs of five lower-cased words. Two sets of
Jaccard similarity t share a member among the first |x| - ceil(t |x|) + 1 of each, in any order that
is the same for all. The order here is by hash, with the members that very many documents hold put
last, so that a passage common to thousands of documents brings none of them together.

1. common: a pass over the texts counts each set's first members by hash. The most frequent are common.
2. sketch: a second pass gives each set's size, digest, first members in the order with the common ones
   last, and a parity bitmap. Sets with one digest are one class from here on. Only members that two
   classes hold go on.
3. tiles: the classes that share a member meet in that member's tile, in bands of set size (only
   adjacent bands are compared); a tile of many classes is dealt out as pairs of parts. Every bit
   in which two parity bitmaps differ is a member that only one of the sets holds, so the bit count
   bounds the overlap from above; pairs that it leaves are checked by intersecting the sorted sets,
   made again from the texts of the documents that a semi-join by doc_id leaves.
4. two rounds: in the first each class proposes only its most similar partner in a tile, and only in
   those of its LEAD members, which near copies mostly share. Links that hold join components, and
   tiles within one component are done with, so a group of near copies costs links in proportion to its
   size. The second round proposes every remaining pair of different components, so that no link
   between components is lost. A pair that shares many members is proposed for the first SEEN of them
   only: each row has prints of its class's EARLY members that come before, and where two rows have SEEN
   in common there, their pair has been proposed in those members' tiles.

Sets are compared by 64-bit hashes: with n distinct runs in the corpus the chance that any two collide
is n^2 / 2^65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import connected_components, discard, mix, stash, stash_counted, table, text_chunks, utf8, word_hashes

WORDS, PERCENT = 5, 80
#: A first member that more rows hold is common, and goes last in the order; where there are more such members than MOST_COMMON, this is doubled until there are not.
COMMON, MOST_COMMON = 8, 1 << 20
#: Classes of one tile that are compared in one task; more are dealt out as pairs of parts.
PART = 1024
#: Members of a class that bring it together with near copies in the first round, those whose hashes are lowest.
LEAD = 16
#: Members of a class of which the second round has a 32-bit print, and how many prints in common before a member tell that a pair has been proposed (that all of so many are false has a chance of about 1e-20 a pair).
EARLY, SEEN = 24, 3
#: Bits of the filter of shared members that is sent to the tasks: 8 for each entry within these bounds, so at most 16 MB whatever the input. It only thins what is joined.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


def shingle_sets(texts: list[bytes]):
    """For each text its sorted distinct shingle hashes (uint64)."""
    for a, b in text_chunks(texts):
        words, ends = word_hashes(texts[a:b])
        rows = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS if len(rows) else 0):
            rows += words[k : k + len(rows)] * _STEP[k]
        rows = mix(rows)
        start = 0
        for end in ends.tolist():
            if end - start >= WORDS:
                yield np.unique(rows[start : end - WORDS + 1])
            elif end > start:
                yield mix(np.array([(words[start:end] * np.array(_STEP[: end - start])).sum() + np.uint64(end - start)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            start = end


def first_members(n: int) -> int:
    """How many members, in the common order, a set of size n shares one of with every set that it links with."""
    return n - (PERCENT * n + 99) // 100 + 1


def bitmap(members: np.ndarray) -> bytes:
    """Parity bitmap: for each bit whether an odd number of members fall on it; a power of two of bits, one to two for each member.

    With fewer, bits in which two sets differ cancel out and the bound no longer tells 0.7 from 0.8.
    """
    bits = min(1 << 15, max(64, 1 << len(members).bit_length()))
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


class Bitmaps:
    """The bitmaps of some rows, kept as one matrix for each length."""

    def __init__(self, many: list[bytes]):
        self.sizes = np.array([len(b) for b in many], np.int64)
        self.at = np.zeros(len(many), np.int64)
        self.rows = {}
        for size in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == size)
            self.at[own] = np.arange(len(own))
            self.rows[size] = np.frombuffer(b"".join([many[i] for i in own]), np.uint64).reshape(len(own), size // 8)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of rows the bits in which they differ; the longer of two bitmaps is folded to the shorter one's length, which keeps parities."""
        out = np.zeros(len(a), np.int64)
        kind = self.sizes[a] << 32 | self.sizes[b]
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            least = min(k >> 32, k & 0xFFFFFFFF) // 8
            for c in range(0, len(own), max(1, 1 << 17 >> least.bit_length())):
                some = own[c : c + max(1, 1 << 17 >> least.bit_length())]
                x, y = (np.bitwise_xor.reduce(self.rows[size][self.at[rows[some]]].reshape(len(some), -1, least), axis=1) for size, rows in ((k >> 32, a), (k & 0xFFFFFFFF, b)))
                out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


class Early:
    """For each row the prints of those of its class's members that come before the row's own."""

    def __init__(self, prints: list[np.ndarray], place: np.ndarray):
        sizes = np.array([len(p) for p in prints], np.int64)
        at = np.arange(EARLY)
        held = at < np.minimum(sizes, EARLY)[:, None]
        self.prints = np.full((len(prints), EARLY), -1, np.int64)
        self.prints[held] = np.concatenate([np.asarray(p[:EARLY], np.int64) for p in prints]) & 0xFFFFFFFF if len(prints) else 0
        self.prints[at >= place[:, None]] = -1

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many prints each pair of rows has in common."""
        out = np.zeros(len(a), np.int64)
        for c in range(0, len(a), 1 << 12):
            x, y = self.prints[a[c : c + (1 << 12)]], self.prints[b[c : c + (1 << 12)]]
            out[c : c + (1 << 12)] = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).sum(axis=(1, 2))
        return out


def digest(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _by_text(df: pd.DataFrame):
    """(slice of df, its sets) for about half a megabyte of texts at a time."""
    texts = utf8(df["text"])
    for a, b in text_chunks(texts):
        yield df.iloc[a:b], list(shingle_sets(texts[a:b]))


def _first(batches):
    """The first members by hash of each text's set."""
    for df in batches:
        for _, sets in _by_text(df):
            if any(map(len, sets)):
                yield pd.DataFrame({"first": [m[: first_members(len(m))].view(np.int64) for m in sets if len(m)]})


class Common:
    """Which values are among the common members; a table of 2^22 flags spares most values the search."""

    def __init__(self, members: np.ndarray):
        self.members = np.sort(members.astype(np.int64))
        self.flags = None

    def __getstate__(self):
        return self.members

    def __setstate__(self, members):
        self.members, self.flags = members, None

    def holds(self, values: np.ndarray) -> np.ndarray:
        if self.flags is None:
            self.flags = np.zeros(1 << 22, bool)
            self.flags[self.members & (1 << 22) - 1] = True
        hit = self.flags[values & (1 << 22) - 1]
        some = np.flatnonzero(hit)
        if len(some):
            at = np.searchsorted(self.members, values[some])
            hit[some] = self.members[np.minimum(at, len(self.members) - 1)] == values[some]
        return hit


def _sketches(common):
    def run(batches):
        for df in batches:
            for some, sets in _by_text(df):
                often = common.value.holds(np.concatenate(sets).view(np.int64)) if sets else np.zeros(0, bool)
                rows, at = [], 0
                for m in sets:
                    k, last = first_members(len(m)), often[at : at + len(m)]
                    at += len(m)
                    first = m[:k] if not last[:k].any() else np.concatenate([m[~last], m[last]])[:k]
                    rows.append((len(m), digest(m), first.view(np.int64).copy(), bitmap(m)) if len(m) else (0, None, None, None))
                n, key, first, bits = zip(*rows, strict=True)
                yield pd.DataFrame({"doc_id": some["doc_id"], "n": n, "key": pd.array(key, dtype="Int64"), "first": first, "bits": bits})

    return run


# A filter: a set of 64-bit values as two bits for each in a fixed field of bits. A hit can be false, a miss cannot.
def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(values.astype(np.int64).view(np.uint64) + _BASE)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


_BASE = np.uint64(0x2545F4914F6CDD1D)


def bit_filter(values: DataFrame, count: int) -> np.ndarray:
    """The filter of a one-column table, built by OR-ing parts of it where they are; its size is bounded, not that of the table."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * count).bit_length()))

    def parts(batches):
        field = np.zeros(bits // 64, np.uint64)
        for df in batches:
            for place in _places(df.iloc[:, 0].to_numpy(), bits):
                np.bitwise_or.at(field, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        at = np.flatnonzero(field)
        for k in range(0, len(at), 65536):
            yield pd.DataFrame({"at": at[k : k + 65536], "word": field[at[k : k + 65536]].view(np.int64)})

    got = values.mapInPandas(parts, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toPandas()
    field = np.zeros(bits // 64, np.uint64)
    field[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)
    return field


def in_filter(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits, hit = len(field) * 64, np.ones(len(values), bool)
    for place in _places(values, bits):
        hit &= (field[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def _only(field):
    """Rows with the first members that are in a filter, if any."""

    def run(batches):
        for df in batches:
            df = df.drop_duplicates("key")  # copies: once a batch
            if not len(df):
                continue
            sizes = np.concatenate(([0], np.cumsum(df["first"].map(len).to_numpy())))
            flat = np.concatenate(df["first"].tolist())
            hit = in_filter(field.value, flat)
            kept = np.diff(np.concatenate(([0], np.cumsum(hit)))[sizes])
            some = kept > 0
            if some.any():
                first = pd.Series(np.split(flat[hit], np.cumsum(kept[some])[:-1]), index=df.index[some], dtype=object)
                yield df[some].assign(first=first)

    return run


def _proposals(every: bool):
    """Pairs of each (member, tile) run that bands, sizes and bitmaps leave, from different components.

    With `every` all of them; else for each class the one partner whose bound is the highest.
    """

    def candidates(df: pd.DataFrame):
        n, comp, part, tile, run = (df[c].to_numpy() for c in ("n", "comp", "part", "tile", "run"))
        band = np.floor(np.log(n) / np.log(100 / PERCENT + 0.01)).astype(np.int64)  # a little wider, so that rounding parts no two that can link
        across = tile % 2 == 1  # such a tile holds two parts, and only pairs across them count

        def near(i, j):
            keep = (band[j] - band[i] <= 1) & (100 * n[i] >= PERCENT * n[j]) & (comp[i] != comp[j]) & ~(across[i] & (part[i] == part[j]))
            return i[keep], j[keep]

        first = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        sizes = np.diff(np.append(first, len(run)))
        small = np.repeat(sizes <= 32, sizes)
        for step in range(1, min(32, int(sizes.max()))):
            i = np.flatnonzero((run[step:] == run[:-step]) & small[:-step])
            yield near(i, i + step)
        for at, size in zip(first[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            last = np.searchsorted(band[at : at + size], band[at : at + size] + 1, side="right")  # rows of a run are sorted by size
            held, count = [], 0
            for i in range(size - 1):
                if last[i] > i + 1:
                    held.append(near(np.full(last[i] - i - 1, at + i), np.arange(at + i + 1, at + last[i])))
                    count += len(held[-1][0])
                if held and (count > 1 << 18 or i == size - 2):
                    yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    held, count = [], 0

    def good(df: pd.DataFrame):
        """The candidates that the bitmaps leave, with how alike they are at most; a bounded number at a time."""
        n, bits = df["n"].to_numpy(), Bitmaps(df["bits"].tolist())
        for i, j in candidates(df):
            if len(i):
                overlap = (n[i] + n[j] - bits.differing(i, j)) // 2
                union = n[i] + n[j] - overlap
                keep = 100 * overlap >= PERCENT * union
                if keep.any():
                    yield i[keep], j[keep], overlap[keep] * 1_000_000 // union[keep]

    def pairs(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j])}).drop_duplicates()

    def propose(df: pd.DataFrame):
        key = df["key"].to_numpy()
        if every:
            early = Early(df["prints"].tolist(), df["place"].to_numpy())
            for i, j, _ in good(df):
                new = early.shared(i, j) < SEEN
                if new.any():
                    yield pairs(key, i[new], j[new])
            return
        best, mate = np.full(len(df), -1, np.int64), np.zeros(len(df), np.int64)
        for i, j, score in good(df):
            row, partner, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([score, score])
            order = np.lexsort((key[partner], -score, row))
            row, at = np.unique(row[order], return_index=True)
            partner, score = partner[order][at], score[order][at]
            better = (score > best[row]) | (score == best[row]) & (key[partner] < key[mate[row]])
            best[row[better]], mate[row[better]] = score[better], partner[better]
        if (some := np.flatnonzero(best >= 0)).size:
            yield pairs(key, some, mate[some])

    def runs(batches):
        held = None
        for df in batches:
            if not len(df):
                continue
            if held is not None:
                df = pd.concat([held, df], ignore_index=True)
            member, tile = df["member"].to_numpy(), df["tile"].to_numpy()
            new = (member[1:] != member[:-1]) | (tile[1:] != tile[:-1])
            df["run"] = np.concatenate(([0], np.cumsum(new)))
            last = int(df["run"].searchsorted(df["run"].iat[-1]))
            held = df.iloc[last:].drop(columns="run")
            if last:
                yield from propose(df.iloc[:last])
        if held is not None:
            yield from propose(held.assign(run=0))

    return runs


def _verified(batches):
    for df in batches:
        links = []
        for x, y in zip(df["sa"], df["sb"], strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            links.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield df.loc[np.array(links, bool), ["a", "b"]]


def _sets(batches):
    for df in batches:
        for _, sets in _by_text(df):
            if sets := [m for m in sets if len(m)]:
                yield pd.DataFrame({"key": [digest(m) for m in sets], "members": [m.view(np.int64) for m in sets]})


def _near_in_size(members: DataFrame) -> DataFrame:
    """Of members with at most PART rows those rows that have a neighbour in size near enough to link with; all rows of larger ones, which are not sorted together."""
    apart = F.when(F.col("large"), F.pmod(F.xxhash64("key"), F.lit(1024))).otherwise(0)
    order = Window.partitionBy("member", apart).orderBy("n", "key")
    near = (F.lag("n").over(order) * 100 >= F.col("n") * PERCENT) | (F.col("n") * 100 >= F.lead("n").over(order) * PERCENT)
    return members.withColumn("near", F.col("large") | F.coalesce(near, F.lit(False))).where("near").drop("near")


def _small_tiles(members: DataFrame) -> DataFrame:
    """Members with at most PART rows: one tile each, if in two components."""
    by = Window.partitionBy("member")
    kept = members.withColumn("mixed", F.min("comp").over(by) != F.max("comp").over(by)).where("mixed")
    return kept.select("member", F.lit(0).alias("tile"), F.lit(0).alias("part"), "key", "n", "comp", "place")


def _large_tiles(members: DataFrame, every: bool) -> DataFrame:
    """Members with more rows: those in two components are dealt out as parts, and each two parts, and each part, are a tile.

    Without `every` only each part is, and each member deals its rows in its own way, so that classes of
    one group meet others in every member's parts, at a cost in proportion to their number.

    Counts and components are combined before the shuffle, so a member that one component holds costs no more than a row for each task.
    """
    mixed = members.groupBy("member").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    parts = F.ceil(F.col("rows") / PART).cast("int")
    by = F.xxhash64("key") if every else F.xxhash64("key", "member")
    dealt = members.join(mixed.select("member", parts.alias("parts")), "member").withColumn("part", F.pmod(by, F.col("parts")).cast("int"))
    if not every:
        return dealt.select("member", (F.col("part") * 2).alias("tile"), "part", "key", "n", "comp", "place")
    one = lambda j: (F.least(F.col("part"), j) * F.col("parts") + F.greatest(F.col("part"), j)) * 2 + (F.col("part") != j).cast("int")
    return dealt.select("member", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), one)).alias("tile"), "part", "key", "n", "comp", "place")


def common_members(docs: DataFrame) -> Common:
    """The first members that more than COMMON rows hold, or the most frequent of these: MOST_COMMON at most, so 8 MB whatever the input."""
    counts = docs.mapInPandas(_first, "first array<long>").select(F.explode("first").alias("member")).groupBy("member").agg(F.count("*").alias("rows"))
    counts = stash(counts.where(F.col("rows") > COMMON), "frequent-members")
    by_size = sorted(counts.groupBy(F.floor(F.log2("rows")).cast("int").alias("power")).count().collect(), reverse=True)  # at most 63 rows
    total, least = 0, COMMON
    for r in by_size:
        total += r["count"]
        if total > MOST_COMMON:
            least = max(least, 2 ** (r["power"] + 1) - 1)
            break
    found = Common(counts.where(F.col("rows") > least).select("member").toPandas()["member"].to_numpy(np.int64)) if by_size else Common(np.zeros(0, np.int64))
    discard(counts)
    return found


def near_texts(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id long, text) -> doc_id, n_shingles, component_id, one row for each row.

    Null texts and texts without words have an empty set (0 shingles) and link with nothing. Rows with
    equal sets are one class; a null doc_id takes part, and counts as a component's id only if no row
    of it has one. Rows that share a doc_id each have their own text's set. Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("text") if text is None else text).alias("text"))
    common = spark.sparkContext.broadcast(common_members(docs))
    sketch = stash(docs.mapInPandas(_sketches(common), "doc_id long, n long, key long, first array<long>, bits binary"), "sketches")
    common.destroy()
    full = sketch.where("n > 0")
    classes = stash(full.groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc"), F.first("bits").alias("bits")), "classes")

    # members that two classes hold
    held = full.select("key", F.explode("first").alias("member"))
    shared = held.groupBy("member").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("member")
    shared, n_shared = stash_counted(shared, "members")
    field = spark.sparkContext.broadcast(bit_filter(shared, n_shared))
    rows = full.select("key", "n", "first").mapInPandas(_only(field), "key long, n long, first array<long>")
    rows = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("first").alias("first"))
    by_hash = F.array_sort(F.transform("first", lambda m: F.struct(F.xxhash64(m).alias("h"), m.alias("m"))))
    grouped = stash(rows.select("key", "n", F.transform(by_hash, lambda x: x["m"]).alias("first")), "class-members")
    prints = grouped.select("key", F.transform(F.slice("first", 1, EARLY), lambda m: F.shiftright(m, 32).cast("int")).alias("prints"))
    rows = grouped.select("key", "n", F.posexplode("first").alias("place", "member"))
    two = rows.groupBy("member").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    rows = rows.join(two.select("member", (F.col("rows") > PART).alias("large")), "member")
    rows = stash(_near_in_size(rows), "tile-rows")
    field.destroy()  # what was made with it is stored
    sketch, was = stash(sketch.select("doc_id", "n", "key"), "documents"), sketch
    discard(shared, was)  # all that comes later is made from stored tables

    components, tested, sets = None, None, None
    for every in (False, True):
        members = (rows if every else rows.where(F.col("place") < LEAD)).withColumn("comp", F.col("key"))
        if components is not None:
            members = members.join(components, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "key")).drop("node", "component")
        tiled = _small_tiles(members.where("NOT large")).unionByName(_large_tiles(members.where("large"), every))
        tiled = tiled.join(classes.select("key", "bits"), "key")
        if every:
            tiled = tiled.join(prints, "key")
        tiled = tiled.repartition("member", "tile").sortWithinPartitions("member", "tile", "n", "key")
        pairs = tiled.mapInPandas(_proposals(every), "a long, b long").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, n_pairs = stash_counted(pairs, "pairs")
        if not n_pairs:
            continue
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        if sets is not None:
            ends = ends.join(sets.select("key"), "key", "left_anti")
        # written out, the number of classes asked for is known: few ids are broadcast, and the texts then stay where they are
        ends, n_ends = stash_counted(ends.join(classes.select("key", "doc"), "key"), "ends")
        if n_ends:
            holders = ends.select(F.col("doc").alias("__doc")).distinct()
            got = docs.join(holders, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi").mapInPandas(_sets, "key long, members array<long>")
            got = stash(got.join(ends.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")
            sets = got if sets is None else sets.unionByName(got)  # of keys that were not there
        checked = pairs.join(sets.select(F.col("key").alias("b"), F.col("members").alias("sb")), "b").join(sets.select(F.col("key").alias("a"), F.col("members").alias("sa")), "a")
        # written out: components run Python too, and two such steps in one task take twice the workers
        links = stash(checked.select("a", "b", "sa", "sb").mapInPandas(_verified, "a long, b long"), "links")
        holds = links if components is None else links.union(components.select("node", "component"))
        components, was = connected_components(holds), components
        if was is not None:
            discard(was)
        discard(ends, links)
        tested = pairs if tested is None else tested.union(pairs)
    if components is None:
        components = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    lowest = classes.join(components, F.col("key") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "key").alias("comp"))
    names = lowest.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = lowest.join(names, "comp").select("key", "component_id")
    out = sketch.join(named, "key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    for done in (grouped, rows, tested, sets):
        if done is not None:
            discard(done)
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of each component with the smallest doc_id; documents without words, or without a doc_id, stay. Columns that documents does not have go."""
    found = near_texts(docs)
    # written out, its size is known before the join: few ids are broadcast, and the texts then stay where they are
    lost = stash(found.where("component_id IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct(), "lost")
    return docs.select("doc_id", "text", "lang", "source", "n_chars").join(lost, "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    return near_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS (SELECT x.doc_id, x.g FROM x JOIN o USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM y a JOIN y b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, CAST(least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS BIGINT) AS component_id
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
