"""Operator 11: alignment of two tokenizers' vocabularies over a corpus, counted outside memory.

A text's tokens of both tokenizers are cut into groups where tokens of both end at one byte. Neither
tokenizer has a token across the border of a word and the white space after it, so a text is cut there
into chunks, and what a chunk gives is computed once and kept while it is seen again.

1. Runs. Each task gathers the (pair of ids, document) records of its documents, each with how often the
   document links the pair. When about a million are held they are radix-partitioned by the A id,
   sorted in A-major order, and written to the shared folder as zstd runs: a row for each run and bucket.
2. Counts. A bucket's runs are merged with a heap over their heads, block by block, which adds up each
   pair's documents. All pairs of an A id follow one another, so its highest count is known when the
   merge leaves it. A bucket of many runs is dealt out, and the parts' results are merged once more.
3. Contributions. Bucket by bucket the table of counts goes ahead, then the bucket's runs stream past it,
   and for each run and document go back the sum of counts and the number of best links; a bucket with
   many records is dealt out with copies of its table. They are added up by run.

Counts hold each pair once, so a bucket's table is bounded by the two vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import mix, stash, table, text_chunks

#: Buckets of A ids; pairs of ids are numbered A << ID_BITS | B.
BUCKETS, ID_BITS, PLACE_BITS = 64, 17, 16
#: Links that a run gathers before it is written (a document is never split over runs).
RUN = 1 << 20
#: Runs that are merged at once, pairs of a block, and how many runs or records of one bucket go to one task.
FAN, BLOCK, RUNS, RECORDS = 64, 1 << 13, 1024, 1 << 23
#: Bytes of the chunks that a task keeps (about; they are begun anew when that is full).
KEPT = 160 << 20
#: White space of the byte-level tokenizer's pattern, and characters that only some definitions have.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DOUBTFUL = "\x1c\x1d\x1e\x1f\x85"


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def bucket_of(a: np.ndarray) -> np.ndarray:
    return (mix(a.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


class Aligner:
    """Both tokenizers, and what each chunk of text gives."""

    def __init__(self, tokenizer_json: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("A must be byte-level BPE without a normalizer or an added space")
        self.a = Tokenizer.from_str(tokenizer_json.decode())
        self.a.encode_special_tokens = True
        size = self.a.get_vocab_size()
        self.a_lengths = np.zeros(size, np.int64)
        for token, i in self.a.get_vocab().items():
            self.a_lengths[i] = len(token)  # one character for each byte

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rule = proto.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces or proto.trainer_spec.model_type != 2 or any(p.type == 4 for p in proto.pieces):
            raise ValueError("B must be BPE whose rule changes nothing but spaces and adds one in front")
        rule.add_dummy_prefix = False  # the space is in the text here
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.b_bytes = [bytes((int(p.piece[1:-1], 16),)) if p.type == 6 else p.piece.encode().replace("▁".encode(), b" ") for p in proto.pieces]
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        if max(size, len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"more than {1 << ID_BITS} ids")
        # after a character that is no white space a chunk ends before white space that no piece of B has inside
        inside = {m for p in proto.pieces if p.type == 1 for m in re.findall(r"(?<=[^\s▁])[\s▁]", p.piece)}
        if "▁" in inside:
            raise ValueError("B has pieces that go on after a space")
        blank, go_on = BLANKS + DOUBTFUL, DOUBTFUL + "".join(sorted(inside & set(BLANKS)))
        self.chunks = re.compile(f"[{blank}]*[^{blank}]+(?:[{go_on}][{blank}]*[^{blank}]*)*|[{blank}]+").findall
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.held, self.n, self.n_pairs = 0, 0, 0
        self.sums = np.zeros((5, 1 << 12), np.int64)  # by chunk: A tokens, B tokens, groups, links, and whether its bytes differ
        self.ends = np.zeros((1 << 12) + 1, np.int64)  # by chunk: where its pairs end
        self.pairs = np.zeros((2, 1 << 12), np.int64)  # ids of the pair, and times

    def learn(self, chunks: list[str]) -> None:
        """What each of some new chunks gives."""
        coded = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        a_ids, b_ids = [x.ids for x in coded], self.b.encode(chunks, num_threads=1)
        raw = [c.encode() for c in chunks]
        ends = np.cumsum([len(r) for r in raw])
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in (a_ids, b_ids))
        bad = np.array([b"".join(map(self.b_bytes.__getitem__, ids)) != r for ids, r in zip(b_ids, raw, strict=True)])
        for i in np.flatnonzero(bad):
            b_ids[i], n_b[i] = [], 0
        if bad.any():
            b = np.fromiter(chain.from_iterable(b_ids), np.int64)
            keep = np.repeat(~bad, n_a)
            a, n_a = a[keep], np.where(bad, 0, n_a)
        # the bytes of chunks that differ stay out of the count of bytes
        at_a, at_b = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        good_ends = np.cumsum(np.where(bad, 0, np.diff(ends, prepend=0)))
        if (len(at_a) and at_a[-1] != good_ends[-1]) or not np.isin(good_ends, np.concatenate(([0], at_a))).all():
            raise ValueError("the tokens of A do not tile the chunks")
        cuts = np.intersect1d(at_a, at_b, assume_unique=True)
        in_a, in_b = np.searchsorted(cuts, at_a), np.searchsorted(cuts, at_b)
        size_a, size_b = np.bincount(in_a, minlength=len(cuts)), np.bincount(in_b, minlength=len(cuts))
        of_chunk = np.searchsorted(good_ends, cuts)  # of chunks that end there the first, the one with bytes
        n_groups = np.bincount(of_chunk, minlength=len(chunks))
        n_links = np.bincount(of_chunk, weights=size_a * size_b, minlength=len(chunks)).astype(np.int64)
        # all pairs of each group, added up for each chunk
        per_a = size_b[in_a]  # partners of each A token
        first_b = np.concatenate(([0], np.cumsum(size_b)))[in_a]
        step = np.arange(per_a.sum()) - np.repeat(np.cumsum(per_a) - per_a, per_a)
        pair = np.repeat(a, per_a) << ID_BITS | b[np.repeat(first_b, per_a) + step]
        owner = np.repeat(of_chunk[in_a], per_a)
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(owner) != 0)))) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pair)))
        # the serialised groups
        names_a, names_b = map(str, a.tolist()), map(str, b.tolist())
        strings: list[list[str]] = [[] for _ in chunks]
        for c, x, y in zip(of_chunk.tolist(), size_a.tolist(), size_b.tolist(), strict=True):
            left = next(names_a) if x == 1 else ",".join([next(names_a) for _ in range(x)])
            right = next(names_b) if y == 1 else ",".join([next(names_b) for _ in range(y)])
            strings[c].append(f"{left}|{right}")
        self.groups += [";".join(s) for s in strings]

        n, k = self.n + len(chunks), self.n_pairs + len(new)
        while n > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], axis=1)
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) - 1, np.int64)])
        while k > self.pairs.shape[1]:
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)], axis=1)
        self.sums[:, self.n : n] = n_a, n_b, n_groups, n_links, bad
        self.pairs[:, self.n_pairs : k] = pair[new], times
        self.ends[self.n + 1 : n + 1] = self.n_pairs + np.cumsum(np.bincount(owner[new], minlength=len(chunks)))
        self.number.update(zip(chunks, range(self.n, n), strict=True))
        self.held += 5 * int(ends[-1]) + 16 * len(new) + 260 * len(chunks) + sum(map(len, self.groups[self.n :]))
        self.n, self.n_pairs = n, k

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each text the five sums; its links as (number of the text, pair, times) rows, a pair perhaps more than once; its groups as a string."""
        if self.held > KEPT:
            self.clear()
        parts = [self.chunks(" " + t) if t else [] for t in texts]
        known = self.number
        if new := list({c: None for p in parts for c in p if c not in known}):
            for at in range(0, len(new), 4096):
                self.learn(new[at : at + 4096])
        found = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(owner, weights=self.sums[k][found], minlength=len(texts)) for k in range(5)]).astype(np.int64)
        bad = sums[4] > 0
        sums[:4, bad] = 0
        strings, at, groups = [], 0, self.groups
        for size, off in zip(sizes.tolist(), bad.tolist(), strict=True):
            strings.append("" if off or not size else ";".join([groups[i] for i in found[at : at + size].tolist()]))
            at += size
        keys, times = np.unique((owner << 32 | found)[~bad[owner]], return_counts=True)
        at, whose = keys & 0xFFFFFFFF, keys >> 32
        counts = self.ends[at + 1] - self.ends[at]
        rows = np.repeat(self.ends[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return sums, np.stack([np.repeat(whose, counts), self.pairs[0][rows], self.pairs[1][rows] * np.repeat(times, counts)]), strings


@lru_cache(1)
def _aligner(tokenizer_json: bytes, model: bytes) -> Aligner:
    return Aligner(tokenizer_json, model)


_RUNS = "run long, bucket int, records long, pairs binary, counts binary, places binary, times binary"
_DOCS = "place int, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _written(run: int, links: list[np.ndarray]) -> pd.DataFrame:
    """A run: its records sorted by bucket, A id, B id and document, as a row for each bucket."""
    place, pair, times = np.concatenate(links, axis=1)
    key = (bucket_of(pair >> ID_BITS) << 2 * ID_BITS | pair) << PLACE_BITS | place
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.add.reduceat(times, new)
    key = key[new]
    held, pairs = key >> PLACE_BITS, key >> PLACE_BITS & (1 << 2 * ID_BITS) - 1
    first = np.flatnonzero(np.diff(held, prepend=-1))
    counts = np.diff(np.append(first, len(held)))
    buckets = held >> 2 * ID_BITS
    rows = []
    for k in np.unique(buckets).tolist():
        a, z = np.searchsorted(buckets, [k, k + 1])
        x, y = np.searchsorted(first, [a, z])
        rows.append((run, k, z - a, packed(np.diff(pairs[first[x:y]], prepend=0)), packed(counts[x:y].astype("<u4")), packed((key[a:z] & (1 << PLACE_BITS) - 1).astype("<u2")), packed(times[a:z].astype("<u4"))))
    return pd.DataFrame(rows, columns=["run", "bucket", "records", "pairs", "counts", "places", "times"])


def _runs(spec):
    def run(batches):
        aligner = _aligner(*spec.value)
        number, place, held, links = TaskContext.get().partitionId() << 32, 0, 0, []
        for df in batches:
            texts = [x if isinstance(x, str) else "" for x in df["text"]]
            for a, z in text_chunks(texts, 1 << 20):
                for b in range(a, z, 4096):
                    some = texts[b : min(z, b + 4096)]
                    sums, found, strings = aligner.read(some)
                    if place + len(some) > 1 << PLACE_BITS or held + found.shape[1] > RUN and held:
                        if held:
                            yield _written(number, links)
                        number, place, held, links = number + 1, 0, 0, []
                    hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings]
                    yield pd.DataFrame({"run": number, "place": np.arange(place, place + len(some)), "doc_id": df["doc_id"].iloc[b : b + len(some)].to_numpy()} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=False)) | {"groups_sha256": hashes})
                    found[0] += place
                    links.append(found)
                    place, held = place + len(some), held + found.shape[1]
        if held:
            yield _written(number, links)

    columns = [c.split()[0] for c in f"{_RUNS}, {_DOCS}".split(", ")]

    def whole(batches):
        for df in run(batches):
            yield df.assign(**{c: None for c in columns if c not in df})[columns]

    return whole


class Run:
    """A sorted run of pairs and counts, read block by block."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts, self.at = pairs, counts, 0

    def last(self) -> int:
        """The last pair of the block at the head."""
        return int(self.pairs[min(self.at + BLOCK, len(self.pairs)) - 1])

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs up to the bound."""
        a, self.at = self.at, int(np.searchsorted(self.pairs, bound, side="right"))
        return self.pairs[a : self.at], self.counts[a : self.at]


def merged(runs: list[Run]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k-way merge: at each step the run whose block ends first tells how far all can be taken; equal pairs are added up."""
    heap = [(r.last(), i) for i, r in enumerate(runs) if len(r.pairs)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts, again = [], []
        # runs whose head block ends later may still begin below the bound
        for _, i in heap:
            parts.append(runs[i].take(bound))
            if runs[i].at < len(runs[i].pairs):
                again.append((runs[i].last(), i))
        heap = again
        heapq.heapify(heap)
        pairs, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        new = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[new], np.add.reduceat(counts, new)


def _merge(runs: list[Run]) -> Run:
    parts = list(merged(runs))
    return Run(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Run(np.zeros(0, np.int64), np.zeros(0, np.int64))


class Merger:
    """Runs of one bucket as they come: FAN of one level become one of the next, so few are held."""

    def __init__(self):
        self.levels: list[list[Run]] = []

    def add(self, run: Run, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN:
            full, self.levels[level] = self.levels[level], []
            self.add(_merge(full), level + 1)

    def result(self) -> Run:
        return _merge([r for level in self.levels for r in level])


def _counted(final: bool):
    """Rows of (bucket, part) runs -> one row for each: its pairs and counts; at last also whether a pair is best for its A id."""

    def row(key: tuple[int, int], m: Merger) -> pd.DataFrame:
        r = m.result()
        out = {"bucket": [key[0]], "pairs": [packed(np.diff(r.pairs, prepend=0))], "counts": [packed(r.counts.astype("<i8"))]}
        if final:
            a = r.pairs >> ID_BITS
            first = np.flatnonzero(np.diff(a, prepend=-1))
            highest = np.maximum.reduceat(r.counts, first) if len(first) else first
            out["best"] = [packed(r.counts == np.repeat(highest, np.diff(np.append(first, len(a)))))]
        return pd.DataFrame(out)

    def run(batches):
        key, merger = None, Merger()
        for df in batches:
            for k, part, pairs, counts in zip(df["bucket"], df["part"], df["pairs"], df["counts"], strict=True):
                if (k, part) != key:
                    if key is not None:
                        yield row(key, merger)
                    key, merger = (k, part), Merger()
                n = unpacked(counts, "<i8" if final else "<u4").astype(np.int64)
                merger.add(Run(np.cumsum(unpacked(pairs, np.int64)), n))
        if key is not None:
            yield row(key, merger)

    return run


def _contributed(batches):
    """A bucket's table, then its runs: for each run its documents' sums."""
    pairs = counts = best = None
    for df in batches:
        out = []
        for r in df.itertuples():
            if r.kind == 0:
                pairs, counts, best = np.cumsum(unpacked(r.pairs, np.int64)), unpacked(r.counts, "<i8"), unpacked(r.best, bool)
                continue
            at = np.repeat(np.searchsorted(pairs, np.cumsum(unpacked(r.pairs, np.int64))), unpacked(r.counts, "<u4"))
            places, times = unpacked(r.places, "<u2"), unpacked(r.times, "<u4").astype(np.int64)
            n = int(places.max()) + 1
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], places, times * best[at])
            np.add.at(sums[1], places, times * counts[at])
            out.append((r.run, packed(sums)))
        if out:
            yield pd.DataFrame(out, columns=["run", "sums"])


def _summed(batches):
    """The sums of each run's documents over all buckets."""

    def rows(run, total):
        return pd.DataFrame({"run": run, "place": np.arange(total.shape[1]), "n_best": total[0], "count_sum": total[1]})

    run, total = None, None
    for df in batches:
        for key, blob in zip(df["run"], df["sums"], strict=True):
            if key != run:
                if run is not None:
                    yield rows(run, total)
                run, total = key, np.zeros((2, 0), np.int64)
            sums = unpacked(blob, np.int64).reshape(2, -1)
            if sums.shape[1] > total.shape[1]:
                total = np.concatenate([total, np.zeros((2, sums.shape[1] - total.shape[1]), np.int64)], axis=1)
            total[:, : sums.shape[1]] += sums
    if run is not None:
        yield rows(run, total)


def align(docs: DataFrame, tokenizer: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> the documents' alignment, and the corpus's pairs by bucket (see pair_counts).

    The first has a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    `tokenizer` and `model` are the paths of a byte-level BPE .json and of a BPE SentencePiece model; their
    bytes are sent to the tasks. Null and empty texts, and those that B does not give back (they hold
    U+2581), have zeros and ''. A null doc_id stays null, equal rows count as documents of their own, extra
    columns are ignored, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    files = []
    for path in (tokenizer, model):
        with open(path, "rb") as f:
            files.append(f.read())
    spec = spark.sparkContext.broadcast(tuple(files))
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")  # pandas makes numbers with nulls inexact
    found = stash(docs.mapInPandas(_runs(spec), f"{_RUNS}, {_DOCS}"), "alignment")
    spec.destroy()
    runs, docs = found.where("bucket IS NOT NULL"), found.where("bucket IS NULL")
    sizes = runs.groupBy("bucket").agg(F.count("*").alias("runs"), F.sum("records").alias("records"))  # a row for each of the fixed buckets
    parts = F.broadcast(sizes.select("bucket", F.ceil(F.col("runs") / RUNS).alias("run_parts"), F.ceil(F.col("records") / RECORDS).alias("parts")))
    dealt = lambda n: F.pmod(F.xxhash64("run"), F.col(n)).cast("int").alias("part")
    some = runs.select("run", "bucket", "pairs", "counts").join(parts, "bucket").select("bucket", dealt("run_parts"), "pairs", "counts")
    some = some.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInPandas(_counted(False), "bucket int, pairs binary, counts binary")
    some = some.withColumn("part", F.lit(0)).repartition("bucket").sortWithinPartitions("bucket")
    counts = stash(some.mapInPandas(_counted(True), "bucket int, pairs binary, counts binary, best binary"), "pair-counts")
    # each part of a bucket: the table first, then its share of the runs
    none = F.lit(None).cast("binary")
    tables = counts.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("run"), "pairs", "counts", none.alias("places"), none.alias("times"), "best")
    rows = runs.join(parts, "bucket").select("bucket", dealt("parts"), F.lit(1).alias("kind"), "run", "pairs", "counts", "places", "times", none.alias("best"))
    rows = tables.unionByName(rows).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    sums = rows.mapInPandas(_contributed, "run long, sums binary").repartition("run").sortWithinPartitions("run")
    sums = sums.mapInPandas(_summed, "run long, place int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = docs.select("run", *[c.split()[0] for c in _DOCS.split(", ")]).join(sums, ["run", "place"], "left")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), counts


def pair_counts(counts: DataFrame) -> DataFrame:
    """The corpus's table of `align` as rows: a_id, b_id, docs (documents that hold the pair linked), best (whether no B id has more with that A id)."""

    def run(batches):
        for df in batches:
            for p, n, b in zip(df["pairs"], df["counts"], df["best"], strict=True):
                pairs = np.cumsum(unpacked(p, np.int64))
                yield pd.DataFrame({"a_id": (pairs >> ID_BITS).astype(np.int32), "b_id": (pairs & (1 << ID_BITS) - 1).astype(np.int32), "docs": unpacked(n, "<i8"), "best": unpacked(b, bool)})

    return counts.mapInPandas(run, "a_id int, b_id int, docs long, best boolean")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    import public_tokenizers

    found, _ = align(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found
