"""Operator 11 against the libraries on whole texts and plain counting."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGES = [None, "", " ", "  ", "a", "\n", " \n ", "a b", "a  b   c", "a\nb\n\n c\t d", "don't they're 'tis", "x\x1c y\x1d\x1e z\x85 q", "naïve café ÆØÅ ß", "日本語 テキスト 中文", "👩‍👩‍👧 ok", "a b c　 d e", "under ▁ bar", "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "\r\n);\r\n }\r x\r", "\0 a \0", "1234567 3.14 -5e10", "    indented\n        more    ", "é ​ ﻿", "mixed\u0085text here", "w" * 3000, "ab " * 2000, "a" * 10 + " " * 500 + "b", "tail  ", "tail\n", "ﬁ ﬂ Ⅷ ½"]


def reference(texts):
    """All of it from whole-text encodings."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    decode = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    rest = [b for b in range(256) if b not in set(decode.values())]
    decode |= {chr(256 + k): b for k, b in enumerate(rest)}
    docs, counts = [], Counter()
    for t in texts:
        links, groups, n_a, n_b = Counter(), [], 0, 0
        if t:
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            raw_a = [bytes(decode[c] for c in tok.id_to_token(i)) for i in a]
            raw_b = [bytes((int(sp.id_to_piece(i)[1:-1], 16),)) if sp.is_byte(i) else sp.id_to_piece(i).encode().replace("▁".encode(), b" ") for i in b]
            whole = (" " + t).encode()
            if b"".join(raw_a) == whole == b"".join(raw_b):
                n_a, n_b, i, j, at_a, at_b, ga, gb = len(a), len(b), 0, 0, 0, 0, [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        at_a, i = at_a + len(raw_a[i]), i + 1
                        ga.append(a[i - 1])
                    else:
                        at_b, j = at_b + len(raw_b[j]), j + 1
                        gb.append(b[j - 1])
                    if at_a == at_b:
                        groups.append((ga, gb))
                        links.update((x, y) for x in ga for y in gb)
                        ga, gb = [], []
        counts.update(links.keys())
        docs.append((n_a, n_b, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for n_a, n_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((n_a, n_b, len(groups), sum(links.values()), sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows, counts, best


def result(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    expected, counts, best = reference(texts)
    found, pairs = alignment.align(docs.repartition(5), A, B)
    assert result(found) == expected
    rows = alignment.pair_counts(pairs).collect()
    assert {(r.a_id, r.b_id): r.docs for r in rows} == dict(counts)
    assert all(r.best == (r.docs == best[r.a_id]) for r in rows)


def test_edges(spark, monkeypatch):
    texts = EDGES + ["same words here"] * 40 + [e for e in EDGES if e]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, run string").repartition(3)
    assert result(alignment.align(docs, A, B)[0]) == reference(texts)[0]


def test_many_small_runs(spark):
    """Runs, blocks, fans and parts far below their sizes give the same. Limits are set in the tasks too, as they are part of what is sent."""
    texts = [f"{w} the common words {i % 7} and {w}s" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split() * 20)]
    expected, counts, _ = reference(texts)
    aligner = alignment._aligner(open(A, "rb").read(), open(B, "rb").read())
    runs, rows = [], []
    for a in range(0, len(texts), 3):
        sums, links, _ = aligner.read(texts[a : a + 3])
        rows += sums[:4].T.tolist()
        runs.append(alignment._written(a, [links]))
    assert [tuple(r) for r in rows] == [r[:4] for r in expected]
    total = Counter()
    for bucket in range(alignment.BUCKETS):
        merger = alignment.Merger()
        for r in runs:
            for x in r[r.bucket == bucket].itertuples():
                merger.add(alignment.Run(alignment.np.cumsum(alignment.unpacked(x.pairs, alignment.np.int64)), alignment.unpacked(x.counts, "<u4").astype(alignment.np.int64)))
        out = merger.result()
        assert (alignment.np.diff(out.pairs) > 0).all()
        total.update({(p >> alignment.ID_BITS, p & (1 << alignment.ID_BITS) - 1): n for p, n in zip(out.pairs.tolist(), out.counts.tolist(), strict=True)})
    assert total == counts


@pytest.mark.parametrize("block", [1, 2, 7])
def test_merge_blocks(monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = alignment.np.random.default_rng(block)
    total, runs = Counter(), []
    for _ in range(9):
        pairs = alignment.np.unique(rng.integers(0, 60, rng.integers(0, 40)))
        counts = rng.integers(1, 5, len(pairs))
        total.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
        runs.append(alignment.Run(pairs, counts))
    parts = list(alignment.merged(runs))
    assert [x for p, _ in parts for x in p.tolist()] == sorted(total)
    assert {p: n for a, b in parts for p, n in zip(a.tolist(), b.tolist(), strict=True)} == dict(total)


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B)[0].count() == 0
    docs = spark.createDataFrame([(None, "one two"), (None, None), (2**60 + 1, "one two"), (7, "one two")], "doc_id long, text string").coalesce(1)
    rows = alignment.align(docs, A, B)[0].collect()
    assert sorted((str(r.doc_id), r.n_a) for r in rows) == [("1152921504606846977", 2), ("7", 2), ("None", 0), ("None", 2)]
    assert {r.count_sum for r in rows if r.n_a} == {6}
