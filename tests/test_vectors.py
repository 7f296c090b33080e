"""Dense search against numpy; recall and work of the approximate one on clustered and on even vectors."""

import numpy as np
import pytest

from docloom.operators import vectors


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def exact(x, q, k):
    s = np.round(q @ x.T, 6) + 0.0
    return [[(j, s[i, j]) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("block", [1024, 7])
def test_dense(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((9, 8))
    x[100:140] = x[3]  # ties
    chunks = frame(spark, x).unionByName(spark.createDataFrame([(999, None), (None, [1.0] * 8)], "vec_id long, embedding array<double>")).repartition(5)
    asked = frame(spark, q).withColumnRenamed("vec_id", "query_id")
    want = exact(x, q, 4)
    for size in (32 << 20, 64 * 3):
        monkeypatch.setattr(vectors, "QUESTION_BYTES", size)
        got = {}
        for r in vectors.dense_top(chunks, asked, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert [got[i] for i in range(9)] == want
    assert vectors.dense_top(chunks.limit(0), asked, 4).count() == 0 and vectors.dense_top(chunks, asked.limit(0), 4).count() == 0
    few = vectors.dense_top(frame(spark, x[:2]), asked, 4)
    assert few.count() == 18


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["even", "clustered", "crowded"])
def test_recall(spark, kind):
    """At least nine of ten of the exact nearest, with at most a tenth of the vectors compared."""
    rng = np.random.default_rng(3)
    n, dim = 6000, 32
    if kind == "even":
        x = unit(rng.standard_normal((n, dim)))
    else:
        centres = unit(rng.standard_normal((40, dim)))
        share = np.full(40, 1 / 40) if kind == "clustered" else np.array([0.5] + [0.5 / 39] * 39)
        x = unit(centres[rng.choice(40, n, p=share)] + 0.15 * rng.standard_normal((n, dim)))
    q = x[::150]
    chunks = frame(spark, x).repartition(4)
    file = vectors.build(chunks)
    assert file.counts.sum() == n and len(file.counts) > 16
    size = max(10, min(vectors.SHORTLIST, n // 10))
    assert size <= n // 10
    rows = vectors.shortlists(file, q, 5, size).groupBy("q").count().collect()
    assert len(rows) == len(q) and max(r["count"] for r in rows) <= size
    looked = (file.codes.lists(q, file.counts, 5) * file.counts).sum(axis=1).mean() / n
    assert kind != "clustered" or looked < 0.5
    got = {}
    for r in vectors.ann_top(chunks, frame(spark, q).withColumnRenamed("vec_id", "query_id"), 5, file=file).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = exact(x, q, 5)
    right = sum(s >= want[i][-1][1] for i in range(len(q)) for s in got[i].values())
    assert right / (5 * len(q)) >= 0.9
    assert all(abs(float(q[i] @ x[j]) - s) < 1e-6 for i in range(len(q)) for j, s in got[i].items())


def test_approximate_edges(spark):
    asked = frame(spark, np.eye(4)).withColumnRenamed("vec_id", "query_id")
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.ann_top(none, asked, 3).count() == 0
    few = frame(spark, np.eye(4)[:2])
    assert sorted((r.query_id, r.vec_id) for r in vectors.ann_top(few, asked, 1).where("score = 1").collect()) == [(0, 0), (1, 1)]
    same = frame(spark, np.ones((50, 4)))
    assert [r.vec_id for r in vectors.ann_top(same, asked.limit(1), 3).orderBy("rank").collect()] == [0, 1, 2]
    assert vectors.ann_top(same, asked.limit(0), 3).count() == 0


def test_best_by_tiles():
    """Questions compared tile by tile keep what all at once would, with no more than a tile's scores at a time."""
    rng = np.random.default_rng(5)
    scores = np.round(rng.standard_normal((7, 40)), 1)
    whole, tiles = vectors._Best(7, 4), vectors._Best(7, 4)
    for a in (0, 20):
        keys = np.arange(a, a + 20)
        whole.add(scores[:, a : a + 20], keys)
        for q in range(0, 7, 3):
            tiles.add(scores[q : q + 3, a : a + 20], keys, q)
    assert whole.frame().equals(tiles.frame())
    assert [sorted(zip((-s).tolist(), range(40), strict=True))[:4] for s in scores] == [[(-s, k) for s, k in zip(*x, strict=True)] for x in zip(tiles.scores.tolist(), tiles.keys.tolist(), strict=True)]
