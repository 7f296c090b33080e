"""Near-duplicate operators against brute force."""

import re

import numpy as np
import pytest

from docloom.llm import caps, ngram_join


def _components(ids, links):
    name = {i: i for i in ids}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        name[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("part", [1024, 3])
def test_vectors(spark, monkeypatch, part):
    monkeypatch.setattr(caps, "PART", part)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i, b in enumerate(base):
        for k in range(1 + i % 6):  # partners at cosines from 0.9 to 0.99
            w = rng.standard_normal(64)
            w -= (w @ b) * b
            c = 1.0 if k == 0 else (0.90, 0.932, 0.94, 0.96, 0.99)[k - 1]
            rows.append((len(rows), (c * b + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).astype(np.float32).tolist(), i % 3))
    rows += [(len(rows) + i, rows[7][1], rows[7][2]) for i in range(5)]  # equal vectors
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, rows[0][1], None), (1004, [], 1), (1005, [float("inf")] + [0.0] * 63, 1), (1006, [1.0, 2.0], 1), (1007, [1.0, None], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep int, links string")
    got = {r.vec_id: r for r in caps.near_vectors(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and i < 1000]
    links = []
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
                links.append((a[0], b[0]))
    component = _components([g[0] for g in good], links)
    for i, _, _ in good:
        assert got[i].n_links == sum(i in link for link in links)
        assert got[i].component_id == component[i] and got[i].kept == (component[i] == i)
    for i in range(1000, 1008):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[None].component_id is None and got[None].kept
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_vectors_with_repeated_ids_and_extreme_sizes(spark):
    """Rows that share a vec_id, in one label and in two, are vectors of their own; components from 1e-200 to 1e200 keep their cosines."""
    x, y = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    rows = [(1, x, "a"), (1, x, "a"), (1, y, "a"), (1, y, "b"), (2, [1e200 * v for v in y], "a"), (3, [-1e-200 * v for v in x], "a"), (4, [1e-200 * v + 1e-202 for v in x], "a"), (5, [1e-200 * v for v in y], "b"), (6, [0.0, 1.0, 0.0, 0.0], "c")]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    unit = [np.array(v) / np.abs(v).max() for _, v, _ in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    want = []
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
    component = _components(range(len(rows)), links)
    for i, (name, _, _) in enumerate(rows):
        lowest = min(rows[j][0] for j in range(len(rows)) if component[j] == component[i])
        want.append((name, sum(i in link for link in links), lowest, name == lowest))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(want)


def test_filters_met_before():
    """In blocks of filters, as by sets."""
    rng = np.random.default_rng(1)
    filters = [np.unique(rng.integers(0, 30_000, 400)).astype(np.int32) for _ in range(60)]
    for this in (0, 17_000, 30_000):
        met = caps._met_before(filters, this)
        early = [{int(f) for f in fs if f < this} for fs in filters]
        assert all(met[i, j] == bool(early[i] & early[j]) for i in range(60) for j in range(60) if i != j)


def test_recall_at_the_lowest_cosine():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.standard_normal(x.shape)
    w -= (w * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    found = np.zeros(len(x), bool)
    for t in range(caps.TABLES):
        found |= (caps.decode(x, t)[:, :, None] == caps.decode(y, t)[:, None, :]).any(axis=(1, 2))
    assert found.mean() > 0.999


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("part,common", [(1024, 64), (4, 3)])
def test_texts(spark, monkeypatch, part, common):
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "LEAD", 16 if part > 4 else 1)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Straße", "É", "été", "x y"]
    passage = rng.choice(vocabulary, 60).tolist()
    texts = []
    for i in range(30):
        words = rng.choice(vocabulary, int(rng.integers(1, 300))).tolist()
        if i % 3 == 0:
            words += passage
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(0, 8))):
            some = list(words)
            for _ in range(int(rng.integers(0, 1 + len(some) // 20))):
                some[int(rng.integers(0, len(some)))] = "edited"
            texts.append(("\n" if i % 2 else "\t ").join(some).upper() if i % 5 == 0 else " ".join(some))
    texts += [texts[0]] * 5 + ["", None, "   ", "one two", "One  two", "one two three", "a b c d e", "A b\nc d e", " ".join(["same"] * 500), " ".join(["same"] * 9), "long " * 3 + " ".join(rng.choice(vocabulary, 20000))]
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int")
    got = {r.doc_id: r for r in ngram_join.near_texts(df).collect()}
    sets = _sets(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    component = _components(range(len(texts)), links)
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert got[i].n_shingles == len(s), i
        assert got[i].component_id == component[i], i
    assert ngram_join.near_texts(df.limit(0)).count() == 0
    assert ngram_join.near_texts(df.where("text is null")).collect()[0].n_shingles == 0


def test_texts_with_repeated_ids(spark):
    """Rows that share a doc_id, or have none, each have their own text's set; ids only name components."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (3, b + " end"), (None, a + " more"), (None, c), (9, c + " x"), (9, None)]
    got = ngram_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("7", 36, "7"), ("7", 36, "3"), ("3", 37, "3"), ("None", 37, "7"), ("None", 36, "9"), ("9", 37, "9"), ("9", 0, "9")])


def test_common_members_are_bounded(spark, monkeypatch):
    """Over the bound the most frequent ones are taken, and the result stays exact."""
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    monkeypatch.setattr(ngram_join, "MOST_COMMON", 8)
    texts = [" ".join(f"p{j}" for j in range(50)) + " " + " ".join(f"{i}w{j}" for j in range(3 if i < 30 else 200)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(ngram_join.common_members(docs).members) <= 8
    sets = _sets(texts)
    component = _components(range(60), [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert {r.doc_id: r.component_id for r in ngram_join.near_texts(docs).collect()} == component


def test_vectors_with_null_ids(spark):
    """A vector without an id links like any other; it only names nothing."""
    rng = np.random.default_rng(8)
    first = rng.standard_normal(32)
    x, y = first.tolist(), (first + 0.01 * rng.standard_normal(32)).tolist()
    rows = [(None, x, "a"), (2**60 + 1, y, "a"), (None, x, "b"), (None, y, "b"), (3, x, None), (None, None, "a")]
    got = sorted(caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").coalesce(1)).collect(), key=str)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted([
        ("None", 1, str(2**60 + 1), False), (str(2**60 + 1), 1, str(2**60 + 1), True), ("None", 1, "None", True), ("None", 1, "None", True), ("3", 0, "3", True), ("None", 0, "None", True),
    ])
