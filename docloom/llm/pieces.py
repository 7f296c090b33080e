"""Operator 8: SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks the text once: at each place the longest entry of the model's compiled character
map is replaced, or else one character is copied, and every byte of the result records the byte of the
text that it comes from. Pieces tile the normalised text, so their lengths give places in it, and the
record projects these to byte spans of the original text. The library segments into pieces; that the
pieces' bytes make up our normalised text, and the spans the original one, is checked for every text.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

SPACE = "▁".encode()


class CharacterMap:
    """A compiled map: a double-array trie over byte strings, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that the text has at a place, and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        node ^= self._offset(self.units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Pieces:
    """A model's encoder and decoder with spans."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.strip, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not spec.precompiled_charsmap and not self.strip
        kinds = [p.type for p in proto.pieces]
        self.own = [p.piece.encode() for p in proto.pieces if p.type == 4]  # user-defined: never normalised
        self.plain &= not self.own
        self.bytes = [bytes((int(p.piece[1:-1], 16),)) if k == 6 else p.piece.encode() for p, k in zip(proto.pieces, kinds, strict=True)]
        self.lengths = np.array([len(b) for b in self.bytes])
        self.unknown = proto.trainer_spec.unk_id
        self.names = [str(i) for i in range(len(kinds))]

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The normalised text and, for each of its bytes and its end, the byte of the text that it comes from (None: computed from the text by `origin`)."""
        if self.plain:
            if not text:
                return b"", None
            return ((b" " if self.dummy else b"") + text).replace(b" ", SPACE if self.escape else b" "), None
        space = SPACE if self.escape else b" "
        out, origin, at, spaced = bytearray(), [], 0, self.strip
        steps = []
        while at < len(text):
            length, piece = self._step(text, at)
            steps.append((at, piece))
            at += length
        first = 0
        if self.strip:
            while first < len(steps) and steps[first][1] == b" ":
                first += 1
        start = steps[first][0] if first < len(steps) else len(text)
        if first < len(steps) and self.dummy:
            out += space
            origin += [start] * len(space)
        spaced = self.strip
        for at, piece in steps[first:]:
            if self.strip and spaced:
                piece = piece.lstrip(b" ")
            if piece:
                for b in piece:
                    part = space if b == 32 else bytes((b,))
                    out += part
                    origin += [at] * len(part)
                spaced = piece.endswith(b" ")
        end = len(text)
        if self.strip:
            while out.endswith(space):
                end = origin[-len(space)]
                del out[-len(space) :], origin[-len(space) :]
        return bytes(out), np.array([*origin, end], np.int64)

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        for own in self.own:
            if text.startswith(own, at):
                return len(own), own
        if (found := self.map.longest(text, at)) is not None:
            return found
        b = text[at]
        length = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return length, text[at : at + length]

    def origin(self, text: bytes, normal: bytes) -> np.ndarray:
        """For a model that changes nothing but spaces: where each byte of the normalised text, and its end, comes from."""
        if not text:
            return np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        wide = np.where(raw == 32, len(SPACE) if self.escape else 1, 1)
        origin = np.repeat(np.arange(len(raw)), wide)
        return np.concatenate((np.zeros((len(SPACE) if self.escape else 1) * self.dummy, np.int64), origin, [len(raw)]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the bytes [start, end) of the original text; byte pieces have one byte each. An unknown piece spans the run of characters that the library gives it."""
        raw, at = text.encode(), np.array(ids, np.int64)
        normal, origin = self.normalise(raw)
        if self.unknown in ids:  # as strings, unknown pieces are the characters that they stand for
            parts = [p.encode() if i == self.unknown else self.bytes[i] for i, p in zip(ids, self.library.encode(text, out_type=str), strict=True)]
            lengths = np.array([len(p) for p in parts])
        else:
            parts, lengths = map(self.bytes.__getitem__, ids), self.lengths[at]
        if b"".join(parts) != normal:
            raise ValueError("the pieces do not tile the normalised text")
        origin = self.origin(raw, normal) if origin is None else origin
        places = origin[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))]
        if (places[1:] < places[:-1]).any() or not self.strip and (places[0], places[-1]) != (0, len(raw)):
            raise ValueError("the spans do not tile the text")
        return places[:-1], places[1:]


@lru_cache(2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str, ids: bool = False, spans: bool = False, digests: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, and by choice ids_sha256, decoded_sha256 and spans_sha256, ids, and starts and ends (byte spans).

    spans_sha256 is of all starts, then all ends, as little-endian 64-bit integers. Spans are computed and checked for every text.
    `model` is the path of a SentencePiece model; its bytes are sent to the tasks. Null and empty texts
    have no ids. A null doc_id stays null; extra columns are ignored.
    """
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        pieces = _pieces(held.value)
        names = pieces.names
        for df in batches:
            for a in range(0, len(df), 256):  # few texts at a time, for long ones
                some = df.iloc[a : a + 256]
                texts = some["text"].fillna("").tolist()
                coded = pieces.encode(texts)
                both = [pieces.spans(t, c) for t, c in zip(texts, coded, strict=True)]
                out = {"doc_id": some["doc_id"], "n_tokens": [len(c) for c in coded]}
                if digests:
                    out["ids_sha256"] = [hashlib.sha256(",".join([names[i] for i in c]).encode()).hexdigest() for c in coded]
                    out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in pieces.library.decode(coded, num_threads=1)] if coded else []
                    out["spans_sha256"] = [hashlib.sha256(np.concatenate(x).astype("<i8").tobytes()).hexdigest() for x in both]
                if ids:
                    out["ids"] = [np.array(c, np.int32) for c in coded]
                if spans:
                    out["starts"], out["ends"] = [s for s, _ in both], [e for _, e in both]
                yield pd.DataFrame(out)

    schema = "doc_id long, n_tokens long" + ", ids_sha256 string, decoded_sha256 string, spans_sha256 string" * digests + ", ids array<int>" * ids + ", starts array<long>, ends array<long>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: doc_id, n_tokens, digests, ids and byte spans of each of its rows."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True, spans=True)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
