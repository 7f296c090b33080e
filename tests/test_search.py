"""The stored lexical index and exact fusion against plain scoring, ranking and fusing of everything."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import tokens
from docloom.operators import fusion, lexical
from docloom.sources.scratch import kept


def plain_scores(docs, questions):
    """{question: {doc: score in millionths}} of all pairs that share a word."""
    bags = {d: Counter(lexical.words(t)) for d, t, *_ in docs}
    n, total = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(w for b in bags.values() for w in b)
    average = total / n if n else 1.0
    out = {}
    for q, text in questions:
        own = Counter(lexical.words(text))
        found = {}
        for d, b in bags.items():
            if any(w in b for w in own):
                size = sum(b.values())
                found[d] = round(1e6 * sum(k * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * size / average)) for w, k in own.items() if b[w]))
        out[q] = found
    return out


def plain_fused(docs, questions, dense, candidates, graph=None):
    """All ranks, fused; with graph ({doc: set of tags}) the bonus too. {question: [(rounded score, doc, dense rank, sparse rank)]} in order."""
    out = {}
    for q, found in plain_scores(docs, questions).items():
        order = sorted(found, key=lambda d: (-found[d], d))
        sparse = {d: r + 1 for r, d in enumerate(order)}
        own = {d: r + 1 for r, (d, _) in enumerate(dense.get(q, []))}
        rrf = lambda d: round(1 / (60 + own.get(d, candidates + 1)) + 1 / (60 + sparse.get(d, len(order) + 1)), 9)  # noqa: E731, B023
        rows = sorted(((-rrf(d), d) for d in set(sparse) | set(own)))
        if graph is not None:
            anchors = set().union(*(graph.get(d, set()) for _, d in rows[:3])) if rows else set()
            everyone = {d for _, d in rows} | {d for d, tags in graph.items() if tags & anchors}
            bonus = lambda d: math.floor(0.25 * min(1.0, len(graph.get(d, set()) & anchors) / len(anchors)) * 1e9 + 0.5) if anchors else 0  # noqa: E731, B023
            final = lambda d: (round(rrf(d) * 1e9) + bonus(d) + 500) // 1000 / 1e6  # noqa: E731, B023
            rows = sorted((-final(d), d) for d in everyone)
        out[q] = [(-s, d, own.get(d, candidates + 1), sparse.get(d, len(order) + 1)) for s, d in rows]
    return out


def corpus(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    p = 1 / np.arange(1, 61)
    docs = [(i * 3 + 1, " ".join(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))) for i in range(n)]
    docs += [(10_000 + i, docs[5][1]) for i in range(copies)]
    docs = [(i, t, sorted({f"T{k}" for k in rng.integers(0, 5 + n // 40, rng.integers(0, 4))})) for i, t in docs]
    questions = [(k, " ".join(rng.choice(words, rng.integers(1, 9)))) for k in range(8)] + [(50, "unknown words"), (51, ""), (52, None), (53, "w0 w0 w1")]
    return docs, questions, rng


@pytest.fixture
def made(spark):
    def make(docs, parts=3):
        return kept(lexical.shards(spark.createDataFrame(docs, "doc_id long, text string, tags array<string>").repartition(parts), tags="tags"), "test-index")

    return make


@pytest.mark.parametrize("seed", [1, 2])
def test_search(spark, made, seed):
    docs, questions, _ = corpus(seed, 300, 30)
    index = made(docs, 7)
    asked = spark.createDataFrame(questions, "item_id long, text string")
    expected = plain_scores(docs, questions)
    got = {}
    for r in lexical.search(index, asked, 5).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, round(r.score * 1e6)))
    for q, found in expected.items():
        first = sorted(found, key=lambda d: (-found[d], d))[:5]
        assert sorted(got.get(q, [])) == [(r + 1, d, found[d]) for r, d in enumerate(first)]


def test_words(spark):
    texts = ["A b　C", "x\x1cy z\x85q", "   lone\xa0x", "ÀÉ ΣΑΣ İ ǅ", "", None, "\x1f \x1e", "a\x0bb\x0cc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.transform(tokens(F.col("t")), F.lower).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [lexical.words(t) for t in texts]


def test_stored_index_grows(spark, made):
    """Added shards change weights and averages without a rebuild, and blocks' bounds still hold."""
    docs, questions, _ = corpus(3, 120)
    asked = spark.createDataFrame(questions, "item_id long, text string")
    both = made(docs[:50]).unionByName(made(docs[50:]))
    n, average = lexical.stats(both).first()
    assert n == 120 and average == pytest.approx(sum(len(lexical.words(t)) for _, t, _ in docs) / 120)
    df = Counter(w for _, t, _ in docs for w in set(lexical.words(t)))
    assert {r.term: (r.df, round(r.idf, 9)) for r in lexical.weights(both).collect()} == {w: (k, round(math.log((120 - k + 0.5) / (k + 0.5) + 1), 9)) for w, k in df.items()}
    expected = plain_scores(docs, questions)
    for r in lexical.search(both, asked, 3).collect():
        assert round(r.score * 1e6) == expected[r.item_id][r.doc_id]
    empty = made([])
    assert lexical.search(empty, asked, 3).count() == 0 and lexical.stats(empty).first()[0] == 0


def test_blocks_are_left_out(spark, made):
    """What `reaching` gives is what all scores give above a threshold, and no posting is read of a shard whose blocks cannot reach it."""
    docs, questions, _ = corpus(4, 400)
    index = made(docs, 2)
    asked = lexical.Questions(questions, index)
    for row in index.toPandas().itertuples():
        for q in range(len(asked.ids)):
            shard = lexical.Shard(row, asked)
            score, hit = shard.scores(q)
            for least in (0, *np.quantile(score, [0.5, 0.95, 1.0]).astype(int).tolist(), int(score.max()) + 1):
                pruned = lexical.Shard(row, asked)
                at, found = pruned.reaching(q, least)
                expected = np.flatnonzero(hit & (score >= least))
                assert sorted(at.tolist()) == expected.tolist() and dict(zip(at.tolist(), found.tolist())) == {i: int(score[i]) for i in expected.tolist()}
            terms, times = asked.bags[q]
            beyond = lexical.Shard(row, asked)
            at, _ = beyond.reaching(q, int((times * shard.bound[terms]).sum() / lexical.UNIT) + 3)
            assert not len(at) and not beyond.made
            assert (shard.bound[terms] <= asked.idf[terms] * 2.5).all()


@pytest.mark.parametrize(("seed", "n", "copies", "k"), [(5, 200, 0, 5), (6, 150, 200, 5), (7, 3000, 40, 5), (8, 30, 0, 15)])
def test_fusion(spark, made, seed, n, copies, k):
    docs, questions, rng = corpus(seed, n, copies)
    candidates = 10
    ids = [d for d, *_ in docs]
    dense = {q: [(int(d), float(np.round(1 - r / 20, 3))) for r, d in enumerate(rng.choice(ids, candidates, replace=False))] for q, _ in questions[:9]}
    index = made(docs, 5)
    asked = spark.createDataFrame(questions, "item_id long, text string")
    lists = spark.createDataFrame([(q, d, s, r + 1) for q, rows in dense.items() for r, (d, s) in enumerate(rows)], "item_id long, doc_id long, score double, rank long")
    expected = plain_fused(docs, questions, dense, candidates)
    got = {}
    for r in fusion.fused_top(index, asked, lists, k, candidates).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.rrf, r.doc_id, r.dense_rank, r.sparse_rank))
    assert got == {q: rows[:k] for q, rows in expected.items() if rows}
    expected = plain_fused(docs, questions, dense, candidates, {d: set(t) for d, _, t in docs})
    got = {}
    for r in fusion.graph_top(index, asked, lists, k, candidates).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.final, r.doc_id, r.dense_rank, r.sparse_rank))
    assert got == {q: rows[:k] for q, rows in expected.items() if rows}


def test_ties_beyond_the_lists(spark, made):
    """A hot entity: thousands of documents share it, and their rounded scores tie, so the keys decide."""
    n = 4000
    rng = np.random.default_rng(9)
    docs = [(int(k), f"common w{i % 997} " + "pad " * int(i % 53), ["HOT"]) for i, k in enumerate(rng.permutation(n) + 1)]
    questions = [(1, "common"), (2, "common w5"), (3, "w7"), (4, "nothing known")]
    dense = {q: [(int(d), 0.5) for d in rng.choice(n, 10, replace=False) + 1] for q, _ in questions}
    lists = spark.createDataFrame([(q, d, s, r + 1) for q, rows in dense.items() for r, (d, s) in enumerate(rows)], "item_id long, doc_id long, score double, rank long")
    expected = plain_fused(docs, questions, dense, 10, {d: set(t) for d, _, t in docs})
    got = {}
    for r in fusion.graph_top(made(docs, 4), spark.createDataFrame(questions, "item_id long, text string"), lists, 5, 10).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.final, r.doc_id, r.dense_rank, r.sparse_rank))
    assert got == {q: rows[:5] for q, rows in expected.items()}
    assert DEFAULT.graph_anchors == 3


def test_few_passes(spark, made, monkeypatch):
    """Narrowing down a score in ties takes three passes over the shards at most, and a pass reads only the columns that it uses."""
    passes = []
    over = fusion.over_shards
    monkeypatch.setattr(fusion, "over_shards", lambda *args: passes.append(args[4:]) or over(*args))
    docs = [(i, f"common w{i % 97} " + "pad " * (i % 53), ["HOT"]) for i in range(1500)]
    questions = [(1, "common"), (2, "common w5")]
    lists = spark.createDataFrame([(q, i, 0.5, i + 1) for q, _ in questions for i in range(10)], "item_id long, doc_id long, score double, rank long")
    got = [(r.item_id, r.doc_id) for r in fusion.graph_top(made(docs, 2), spark.createDataFrame(questions, "item_id long, text string"), lists, 5, 10).orderBy("item_id", "rank").collect()]
    expected = plain_fused(docs, questions, {q: [(i, 0.5) for i in range(10)] for q, _ in questions}, 10, {d: {"HOT"} for d, *_ in docs})
    assert got == [(q, d) for q, rows in expected.items() for _, d, *_ in rows[:5]]
    assert 6 <= len(passes) <= 11
    assert sum("terms" not in p for p in passes) == 1 and sum("tags" in p for p in passes) <= 3


def test_index_of_asked_words(spark, made):
    """An index of the asked words alone has no other postings and gives the same results."""
    docs, questions, rng = corpus(11, 300, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string, tags array<string>").repartition(3)
    asked = spark.createDataFrame(questions, "item_id long, text string")
    only = lexical.words_of(asked)
    assert only == {w for _, t in questions for w in lexical.words(t)}
    whole, some = made(docs), kept(lexical.shards(df, tags="tags", only=only), "test-index")
    assert {r.term for r in lexical.document_counts(some).collect()} <= only and lexical.document_counts(whole).count() > len(only)
    assert lexical.stats(some).first() == lexical.stats(whole).first()
    assert sorted(lexical.search(some, asked, 5).collect()) == sorted(lexical.search(whole, asked, 5).collect())
    lists = spark.createDataFrame([(0, docs[3][0], 0.5, 1)], "item_id long, doc_id long, score double, rank long")
    assert sorted(fusion.graph_top(some, asked, lists, 5, 10).collect()) == sorted(fusion.graph_top(whole, asked, lists, 5, 10).collect())


def test_words_of_many_questions(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUESTION_CHARS", 5)
    assert lexical.words_of(spark.createDataFrame([("ab cd",)], "text string")) is None
    assert lexical.words_of(spark.createDataFrame([("a B",), (None,)], "text string")) == {"a", "b"}


def test_postings_kept_small():
    """A shard in the making keeps two numbers a posting, not the words; the result is what counting gives."""
    rng = np.random.default_rng(7)
    lists = [[f"word{i}" for i in rng.zipf(1.5, 400) % 500] for _ in range(50)] + [[]]
    held = lexical._Postings()
    for ws in lists:
        held.add(ws)
    bags = [Counter(ws) for ws in lists]
    assert sum(a.nbytes for a in [*held.own, *held.times]) == 8 * sum(map(len, bags))
    terms, dfs, places, tfs = held.made()
    want = sorted((w, d, n) for d, bag in enumerate(bags) for w, n in bag.items())
    assert list(zip(np.repeat(np.array(terms, object), dfs), places.tolist(), tfs.tolist(), strict=True)) == want
    assert [len(x) for x in lexical._Postings().made()] == [0, 0, 0, 0]
