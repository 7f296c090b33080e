"""Token counts and SentencePiece against the libraries."""

import hashlib
import time
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import pieces, token_counts

TEXTS = [
    "", None, "a", "Hello world", "  two  spaces \n\n\tand tabs  ", "it's we'll I'D they're '", "don't1234 ½²x 3,000.5", "Größe über naïve façade é", "é combining ‍ zero   nbsp wide",
    "日本語のテキスト 中文 한국어", "🙂👩‍👩‍👧 emoji", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x" * 3000, "ab " * 2000, "\x1c\x1f ctrl \x00 nul", "thhaenthhaen erthwhnt onanou " * 50, "\r\n\r\n  end ", "<s> </s> <unk> ▁", "!!!???###", " ", "   ", "▁ meta",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, ids string")


def test_counts(spark, sf_dir, docs):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    made = token_counts.count_tokens(docs, path, (5,), with_tables=True)
    asked = made.withColumns({"three": token_counts.prefix_tokens(F.col("differences"), F.lit(3)), "within": token_counts.longest_within(F.col("differences"), F.lit(7))})
    got = {r.doc_id: r for r in asked.collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        assert got[i].n_tokens == count(t), t
        assert got[i].n_bytes == len(t.encode())
        assert len(got[i].differences) == len(t) and got[i].three == count(t[:3])
        if len(t) < 200:
            counts = [count(t[:n]) for n in range(len(t) + 1)]
            assert counts == [0, *accumulate(got[i].differences)], t
            assert got[i].cut_5 == len(t[: max(n for n, c in enumerate(counts) if c <= 5)].encode()), t
            assert got[i].within == max(n for n, c in enumerate(counts) if c <= 7)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


@pytest.fixture(scope="module")
def prefixes():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        return token_counts.Prefixes(f.read())


def test_every_prefix(prefixes, monkeypatch):
    """Of texts made of what splits in more than one way, with a table that is emptied again and again too."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    parts = [*" \n\t'sret!<|endoftext>aé日1", "<|endoftext|>", "  ", "\n\n", "'re", "\u3000", " internationalisation", "x" * 70, " " * 70, "'" * 70, "\x1c"]
    texts = ["".join(rng.choice(parts, 25)) for _ in range(120)] + [" internationalisation", "thhaenthhaenerthwhnt", " 1234567", "!!!!??...", "Größe", "a!!<|endoftext|>b  <|endoftext|>\n\n<|endoftext|> '<|endoft"]
    for kept in (token_counts.KEPT, 3000):
        monkeypatch.setattr(token_counts, "KEPT", kept)
        for t in texts:
            assert [0, *accumulate(prefixes.differences(t).tolist())] == [len(library.encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)], t


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "'" * 1_000_000, "x" * 1_000_000, " \n" * 500_000 + "x", "!<|endoftext|>" * 70_000])
def test_long_runs(prefixes, text):
    """Time in proportion to the text, and no more kept than for short ones."""
    began = time.process_time()
    total = int(prefixes.differences(text).sum())
    assert time.process_time() - began < 6
    assert total == len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)
    assert prefixes.held < token_counts.KEPT and all(len(p) <= token_counts.LONGEST for p in prefixes.tables)


def test_documents(spark, sf_dir):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in token_counts.op3_token_counts(spark, sf_dir).collect()}
    assert {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()} == {i: r.n_tokens for i, r in got.items()}
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())


def test_pieces(spark, docs):
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode(docs, path, ids=True, spans=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        raw, at = (t or "").encode(), 0
        for (start, end), p in zip(zip(got[i].starts, got[i].ends, strict=True), ids, strict=True):
            assert start == at
            at = end
            piece = library.id_to_piece(p)
            if not library.is_byte(p):
                assert raw[start:end].decode().replace("▁", " ") in (piece.replace("▁", " "), piece[1:].replace("▁", " "))
        assert at == len(raw)
    assert pieces.encode(docs.limit(0), path).count() == 0


def test_character_map():
    """The compiled maps that the library brings, against its own normaliser."""
    from sentencepiece import sentencepiece_model_pb2

    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(own.serialized_model_proto())
        p = pieces.Pieces.__new__(pieces.Pieces)
        spec = proto.normalizer_spec
        p.map, p.dummy, p.strip, p.escape, p.own, p.plain = pieces.CharacterMap(spec.precompiled_charsmap), True, True, True, [], False
        for t in TEXTS:
            t = (t or "") + " ﬁ Å ｶﾞ ①"
            normal, origin = p.normalise(t.encode())
            assert normal.decode() == own.normalize(t), (rule, t)
            assert len(origin) == len(normal) + 1 and (origin[1:] >= origin[:-1]).all()


def test_pieces_documents(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pieces.op8_pieces(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_spans_of_documents(spark, sf_dir):
    """The registered query and the pipeline's stage carry spans, against the library's own offsets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    digests = {r.doc_id: r.spans_sha256 for r in pieces.op8_pieces(spark, sf_dir).collect()}
    for r in pieces.stage(spark, docs, sf_dir).collect():
        text = texts[r.doc_id]
        assert digests[r.doc_id] == r.spans_sha256 == hashlib.sha256(b"".join(x.to_bytes(8, "little") for x in [*r.starts, *r.ends])).hexdigest()
        assert [0, *r.ends] == [*r.starts, len(text.encode())]
        if len(text) < 2000:
            theirs = library.encode(text, return_type="proto").pieces
            for start, end, p in zip(r.starts, r.ends, theirs, strict=True):
                assert library.is_byte(p.id) or (start, end) == (p.begin, p.end)


def test_unknown_pieces():
    """A model whose byte pieces are taken away: an unknown piece spans its characters."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.byte_fallback = False
    for piece in proto.pieces:
        if piece.type == 6:
            piece.type = 5
    p = pieces.Pieces(proto.SerializeToString())
    for text in ("ab \U0001f9ff\U0001f9ff cab", "\ue000", "ab\ue000", " 🧿\ue000 a \ue001"):
        ids = p.encode([text])[0]
        starts, ends = p.spans(text, ids)
        assert p.unknown in ids and [0, *ends] == [*starts, len(text.encode())]
        for i, a, b in zip(ids, starts, ends, strict=True):
            if i == p.unknown:
                assert not set(text.encode()[a:b].decode()) & set("abc")
