"""Ranked search against scoring every document, and the bounds against random cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import maxscore

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, top=10):
    """All scores by the definition."""
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_all, words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for item, terms in held.items():
        rows = []
        for (i, b), n in zip(bags, sizes, strict=True):
            m = 10 + (90 * n * n_all) // words if words else 10
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(maxscore.search(docs.repartition(3), items)) == expected


def test_edges(spark):
    words = "alpha beta gamma delta éclair Éclair 日本 x1 1 the a".split()
    docs = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 9))) for i in range(60)]
    docs += [(None, "alpha beta"), (None, None), (70, ""), (71, "!!! --"), (72, "alpha,BETA;gamma\tdelta\n" * 3000), (5, "alpha beta"), (5, "alpha beta"), (2**60 + 1, "gamma")]
    items = [(1, "Alpha beta the a"), (2, "éclair"), (3, None), (4, "..."), (5, "unheard of"), (6, " ".join(words)), (None, "gamma 日本"), (7, "alpha"), (7, "delta alpha"), (8, "the " * 500)]
    frames = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, rank int, item_id string").repartition(2), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    assert result(maxscore.search(*frames)) == plain(docs, items)
    assert result(maxscore.search(*frames, top=3)) == plain(docs, items, 3)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert maxscore.search(none, frames[1]).count() == 0
    assert maxscore.search(frames[0], spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 5} w{i % 3} common") for i in range(50)]
    items = [(i, f"w{i} common w{i + 1}") for i in range(9)]
    monkeypatch.setattr(maxscore, "ITEM_BYTES", 30)
    assert result(maxscore.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def row_of(items, docs, monkeypatch=None):
    """One shard of some documents, as the tasks make it."""
    import pandas as pd

    class Sent:
        value = items

    class Context:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": lambda self: 0})()

    monkeypatch.setattr(maxscore, "TaskContext", Context)
    return pd.concat(list(maxscore._shards(Sent)([pd.DataFrame({"doc_id": [str(i) for i, _ in docs], "text": [t for _, t in docs]})])), ignore_index=True)


@pytest.mark.parametrize("seed", range(6))
def test_pruning_is_exact_and_prunes(monkeypatch, seed):
    """Shards, thresholds and pairs of random corpora: nothing above the threshold is lost, scores are true, and pairs tighten the bounds."""
    monkeypatch.setattr(maxscore, "SHARD", 40)
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)]
    p = 1 / np.arange(1, 41)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(200)]
    items = maxscore.Items([(k, " ".join(rng.choice(words, 9))) for k in range(12)])
    rows = row_of(items, docs, monkeypatch)
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in rows.itertuples():
        df[maxscore.unpacked(r.terms, "<i4")] += maxscore.unpacked(r.dfs, "<i4")
    weights = maxscore.Weights(items, int(rows["filled"].sum()), int(rows["words"].sum()), df)
    expected = {}
    for item, rank, doc, score in plain(docs, [(i, " ".join(t.decode() for t, k in items.vocabulary.items() if k in terms)) for i, terms in zip(items.ids, items.terms, strict=True)], 200):
        expected.setdefault(item, {})[doc] = score
    loose = tight = 0
    for r in rows.itertuples():
        shard = maxscore.Shard(r, weights)
        ids = maxscore.unpacked(r.ids, "<i8")
        pairs, lengths, joint = shard.lists(weights.all_pairs)
        for q, n, best in zip(pairs.tolist(), lengths.tolist(), joint.tolist(), strict=True):
            (px, ix), (py, iy) = (shard.postings(t) for t in weights.all_pairs[q].tolist())
            sums = sorted((dict(zip(px.tolist(), ix.tolist()))[d] + v for d, v in zip(py.tolist(), iy.tolist()) if d in set(px.tolist())), reverse=True)
            assert len(sums) == n and [x for x in best if x] == [x for x in sums[:10] if x]
        joint = dict(zip(pairs.tolist(), joint[:, 0].tolist(), strict=True))
        for k, item in enumerate(items.ids):
            for least in (1, *sorted(expected[item].values())[:: 37]):
                found, scores = maxscore.evaluate(shard, k, weights, joint, least)
                got = dict(zip(ids[found].tolist(), scores.tolist(), strict=True))
                assert got == {d: s for d, s in expected[item].items() if s >= least and d in set(ids.tolist())}
            terms = sorted((int(shard.most[shard.at[t]]), t) for t in weights.terms[k] if t in shard.at)
            at = {t: i for i, (_, t) in enumerate(terms)}
            most = [m for m, _ in terms]
            own = [(max(joint.get(q, 0), most[at[x]], most[at[y]]), at[x], at[y]) for q, x, y in weights.pairs[k] if x in at and y in at]
            bound = maxscore.bounds(most, own)
            assert bound[-1] >= max([0, *(expected[item].get(d, 0) for d in ids.tolist())])
            loose, tight = loose + sum(most), tight + bound[-1]
    assert tight < loose


def test_thresholds_of_best():
    best = maxscore.Best(np.array([5, 1]))
    best.add(0, np.array([7, 7, 9]), np.array([3, 1, 8]), np.array([False, False, True]))
    assert best.rows[0] == [(-9, True, 8), (-7, False, 1), (-7, False, 3)] and best.least.tolist() == [5, 1]
    best.add(0, np.arange(20), np.arange(20), np.zeros(20, bool))
    assert best.least[0] == 10 and len(best.rows[0]) == 10
