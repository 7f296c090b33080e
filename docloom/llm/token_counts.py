"""Operator 3: exact token counts at every prefix by dynamic programming, for byte-level BPE vocabularies.

The tokens of a prefix are those of the prefix that ends before its last token, plus that token. Of all
vocabulary entries that end at a place, exactly one continues the tokens before it the way the merges
would: the one whose pair with its predecessor the merges leave as it is. So count[i] = count[i - len] + 1,
place by place. Text is first split as the tokenizer splits it, and a piece has a table of its own, kept
per task for pieces seen before; a text's table is theirs one after the other. A prefix that ends within
white space, within a contraction or within a special string splits otherwise than the whole text does;
the table has the prefix's own count there too.

A table is stored as differences: one number for each character, by how much its prefix has more tokens
than the one before. The total, the longest prefix within a budget and the count of any prefix are read
off it (prefix_tokens, longest_within); no text is encoded again.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import accumulate, pairwise
from operator import sub

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

LIMIT = 1024
#: Bytes of the pieces' tables that a task keeps (about; they are begun anew when that is full), and characters of the longest piece that is kept.
KEPT, LONGEST = 192 << 20, 64
#: How the byte-level pre-tokenizer splits text.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPLIT = "|".join(CONTRACTIONS) + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Prefixes:
    """A vocabulary's prefix tables. Strings here hold one character for each byte."""

    def __init__(self, tokenizer_json: bytes):
        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or an added space")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        plain = {b: chr(b) for b in printable} | {256 + k: chr(b) for k, b in enumerate(rest)}
        tokens = [t.translate(plain) for t in model["vocab"]]
        number = {t: i for i, t in enumerate(tokens)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: By pair of tokens the place of their merge; by token the place of the first merge that makes it (-1: none does) and its halves.
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * len(tokens), list(range(len(tokens))), list(range(len(tokens)))
        for place, (x, y) in enumerate(pairs):
            x, y = x.translate(plain), y.translate(plain)
            whole = number[x + y]
            self.rank.setdefault(number[x] << 20 | number[y], place)
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = place, number[x], number[y]
        #: Tokens that the merges make of their own bytes, in a tree read from their last byte; None holds the token that ends there.
        self.tree: dict = {}
        for i, t in enumerate(tokens):
            if len(t) == 1 or self.made[i] >= 0 and self.stands(self.left[i], self.right[i], self.made[i]):
                node = self.tree
                for c in reversed(t):
                    node = node.setdefault(c, {})
                node[None] = i
        if max(map(len, tokens)) > 1 << 14:
            raise ValueError("tokens are too long for differences of 16 bits")
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT).findall
        blanks = "".join(chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c)))
        self.blanks = re.compile(f"[{re.escape(blanks)}]{{2,}}")
        self.pairs: dict[int, bool] = {}
        #: By piece its differences; by character the counts and last tokens of its run, which grow as longer runs come.
        self.tables: dict[str, bytes] = {}
        self.runs: dict[str, tuple[list[int], list[int]]] = {}
        self.joins: dict[str, int] = {}
        self.specials: dict[tuple[str, str], np.ndarray] = {}
        self.held = 0

    def stands(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether the merges made before a place leave the border between two tokens that stand side by side.

        Seen backwards, the later made of the two tokens at the border is undone, until both are single
        bytes; at each step no merge across the border may come before the one undone. Of equal places the
        left one is made first.
        """
        rank, made = self.rank, self.made
        while True:
            across = rank.get(a << 20 | b)
            if across is not None and across < before:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            else:
                before, b = made[b] + 1, self.left[b]

    def table(self, piece: str) -> list[int]:
        """count[i] of every prefix of i bytes of a piece."""
        run = len(piece) > LONGEST and piece == piece[0] * len(piece)
        count, last = self.runs.setdefault(piece[0], ([0], [-1])) if run else ([0], [-1])
        pairs, tree = self.pairs, self.tree
        for i in range(len(count), len(piece) + 1):
            node, j = tree, i
            while j:
                node = node.get(piece[j - 1])
                if node is None:
                    raise ValueError(f"no token of the vocabulary ends at byte {i}")
                j -= 1
                token = node.get(None)
                if token is not None:
                    if not j:
                        break
                    pair = last[j] << 20 | token
                    known = pairs.get(pair)
                    if known is None:
                        known = pairs[pair] = self.stands(last[j], token)
                    if known:
                        break
            count.append(count[j] + 1)
            last.append(token)
        return count[: len(piece) + 1] if run else count

    def counts(self, piece: str) -> list[int]:
        """The count of every prefix of a piece by characters, from the empty one."""
        raw = piece.encode("utf-8", "replace")
        table = self.table(raw.decode("latin-1"))
        if piece in CONTRACTIONS:  # a beginning of one splits otherwise
            return [sum(self.table(x)[-1] for x in self.split(piece[:n])) for n in range(len(piece))] + [table[-1]]
        return table if len(raw) == len(piece) else [table[n] for n in accumulate((len(c.encode("utf-8", "replace")) for c in piece), initial=0)]

    def piece(self, piece: str) -> bytes:
        """The differences of a piece's counts, as 16-bit numbers."""
        counts = self.table(piece) if piece.isascii() and piece[0] != "'" else self.counts(piece)
        found = array("h", map(sub, counts[1:], counts)).tobytes()
        if len(piece) <= LONGEST:
            self.held += 3 * len(found) + 200
            if self.held > KEPT:
                self.tables.clear()
                self.joins.clear()
                self.runs.clear()
                self.held = 0
            self.tables[piece] = found
        return found

    def join(self, run: str) -> int:
        """By how much a run of white space at the end of a text has more tokens than split as before a word, where its last character is apart."""
        found = self.joins.get(run)
        if found is None:
            counts = self.counts(run)
            found = counts[-1] - counts[-2] - self.counts(run[-1])[-1]
            if len(run) <= LONGEST:
                self.joins[run] = found
                self.held += 300
        return found

    def _plain(self, text: str) -> np.ndarray:
        pieces = self.split(text)
        try:
            joined = b"".join(map(self.tables.__getitem__, pieces))
        except KeyError:
            known = self.tables.get
            joined = b"".join([known(p) or self.piece(p) for p in pieces])
        out = np.frombuffer(joined, np.int16)
        for m in self.blanks.finditer(text):
            if m.end() < len(text) and (more := self.join(m[0])):
                out = out if out.flags.writeable else out.copy()
                out[m.end() - 1] += more
                out[m.end()] -= more
        return out

    def differences(self, text: str) -> np.ndarray:
        """For each character by how much the prefix that it ends has more tokens than the one before."""
        if self.at_special is None or not (found := list(self.at_special.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            before = text[at : m.start()]
            out.append(self._plain(before))
            # a beginning of a special string belongs to the text before it, whose last piece may go on or split otherwise
            out.append(self.within(self.split(before)[-1] if before else "", m[0]))
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def within(self, last: str, special: str) -> np.ndarray:
        """The differences of a special string after a piece."""
        found = self.specials.get((last, special))
        if found is None:
            base = self.total(last)
            counts = [base, *(self.total(last + special[:n]) for n in range(1, len(special))), base + 1]
            found = np.array([b - a for a, b in pairwise(counts)], np.int16)
            if len(last) <= LONGEST and len(self.specials) < 10_000:
                self.specials[last, special] = found
        return found

    def total(self, text: str) -> int:
        return int(self.differences(text).sum())


def prefix_tokens(differences: Column, chars: Column) -> Column:
    """The tokens of a text's first `chars` characters, from its table."""
    return F.aggregate(F.slice(differences, F.lit(1), chars), F.lit(0), lambda n, d: n + d)


def longest_within(differences: Column, budget: Column) -> Column:
    """The characters of a text's longest prefix with at most `budget` tokens, from its table."""
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("chars"), F.lit(0).alias("best"))

    def step(s: Column, d: Column) -> Column:
        tokens, chars = s["tokens"] + d, s["chars"] + 1
        return F.struct(tokens.alias("tokens"), chars.alias("chars"), F.when(tokens <= budget, chars).otherwise(s["best"]).alias("best"))

    return F.aggregate(differences, start, step, lambda s: s["best"])


@lru_cache(2)
def _prefixes(tokenizer_json: bytes) -> Prefixes:
    return Prefixes(tokenizer_json)


def count_tokens(docs: DataFrame, tokenizer: str, budgets: tuple[int, ...] = (LIMIT,), with_tables: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, and for each budget cut_<budget>: the bytes of the longest prefix within it.

    `tokenizer` is the path of a byte-level BPE tokenizer .json; its bytes are sent to the tasks. With
    `with_tables` also differences: the table of every prefix, to be stored and asked later.
    Null and empty texts have 0 bytes, 0 tokens and an empty table; a null doc_id stays null. Extra columns are ignored.
    """
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        prefixes = _prefixes(spec.value)
        for df in batches:
            for a in range(0, len(df), 256):  # few texts at a time, for long ones
                some = df.iloc[a : a + 256]
                out = {"doc_id": some["doc_id"], "n_bytes": [], "n_tokens": []} | {f"cut_{b}": [] for b in budgets} | ({"differences": []} if with_tables else {})
                for text in some["text"].fillna("").tolist():
                    found = prefixes.differences(text)
                    counts = found.cumsum(dtype=np.int64)
                    n, size = int(counts[-1]) if len(counts) else 0, len(text.encode("utf-8", "replace"))
                    out["n_bytes"].append(size)
                    out["n_tokens"].append(n)
                    for b in budgets:
                        within = np.flatnonzero(counts <= b) if n > b else [len(text) - 1]
                        out[f"cut_{b}"].append(len(text[: within[-1] + 1].encode("utf-8", "replace")) if len(within) else 0)
                    if with_tables:
                        out["differences"].append(found)
                yield pd.DataFrame(out)

    cuts = "".join(f", cut_{b} long" for b in budgets)
    tables = ", differences array<short>" if with_tables else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, n_bytes long, n_tokens long{cuts}{tables}")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
