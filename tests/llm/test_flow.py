"""Sharding, mixing and the pipeline."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import language, mixing, ngram_join, pieces, quality, sharding
from docloom.llm.common import connected_components, n_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (3000, 3001), (3001, 3000), (3000, 3001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + [(None, 7)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1100)) and got[3001] == 3000
    assert not {0, 1000, 3000} & set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, due = share * sum(sizes.values()), {}, set(names)
    while due:
        total = sum(weight[s] for s in due)
        over = [s for s in due if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in due}
            break
        for s in over:
            out[s] = most * sizes[s]
            due.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("rows", [
    [(i, "w " * (1 + i % 50), f"s{i % 7}" if i % 3 else "s0") for i in range(900)] + [(900 + i, "x y", None) for i in range(5)] + [(2000, None, "s1"), (2001, "", "s9"), (None, "a b c", "s2")],
    [(1, "one two", "only")], [(1, None, None)], [(i, "same text", "s") for i in range(3)] * 2,
])
def test_mix(spark, rows):
    docs = spark.createDataFrame([(*r, 1.0, 1) for r in rows], "doc_id long, text string, source string, target double, taken int")
    got = mixing.mix(docs, n_words(F.col("text")), F.col("doc_id")).collect()
    again = mixing.mix(docs.repartition(7), n_words(F.col("text")), F.col("doc_id")).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = _targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert mixing.mix(docs.limit(0), n_words(F.col("text")), F.col("doc_id")).count() == 0


def test_mix_stage(spark, sf_dir):
    """Targets are met to a word by what the stage returns, with rows alike in all columns and rows that share an id or a text."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40)), "en", f"s{i % 4}", 5) for i in range(300)] + [(1, "w0", "en", "s1", 5)] + [(None, "a b c", "en", "s2", 5)] * 101 + [(7, f"x y z{i}", "en", "s3", 5) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.stage(spark, docs, sf_dir).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    out = Counter()
    for r in got:
        out[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    for s, t in _targets(sizes).items():
        assert abs(out[s] - t) <= 1
    texts = {r[1] for r in rows}
    assert sum(r.text not in texts for r in got) <= 4  # one document is cut for each source


def _sharded(docs, root):
    sharding.append(docs, root, F.floor(F.col("doc_id") / 10), F.octet_length("text"), F.col("doc_id"))


def _files(spark, root):
    """By name of set and part: the rows of each unit of the latest version, and its tier, run and piece."""
    out = defaultdict(list)
    for r in sharding.read(spark, root).collect():
        assert r.bytes == len((r.row.text or "").encode())
        out[r.shard.set, r.shard.part].append((str(r.row.doc_id), r.row.text))
    return out


def test_sharding(spark, tmp_path):
    """Append, compact, remove what is merged, four times: no row is lost, files that are not due keep their names, and none is far from the target."""
    root, size, target = f"file://{tmp_path}/shards", 0, 20_000
    rows, before = [], {}
    for k, n in enumerate((900, 40, 10, 600)):
        new = [(1000 * k + i, "x" * (i * 37 % 300), i) for i in range(n)] + [(None, f"null id {k}", 1), (7, None, k)]
        _sharded(spark.createDataFrame(new, "doc_id long, text string, tier int"), root)
        rows += new
        assert sharding.compact(spark, root, target, 4) == k + 1
        sharding.vacuum(spark, root)
        now = _files(spark, root)
        assert sorted(map(str, sum(now.values(), []))) == sorted(str((str(i), t)) for i, t, _ in rows)
        for name, held in before.items():
            if sum(len(t or "") for _, t in held) * 2 >= target:  # done with, so never moved again
                assert sorted(map(str, now[name])) == sorted(map(str, held))
        size = max(sum(len(t or "") for _, t in held) for held in now.values())
        assert size <= 1.5 * target
        before = now
    assert sharding.versions(spark, root) == [1, 2, 3, 4]
    assert sharding.compact(spark, root, target, 4) == 5 and _files(spark, root).keys() == now.keys()  # nothing new: only what a merge made due could move, and it did not


def test_sharding_splits_hot_arrival(spark, tmp_path):
    """An arrival with nearly all rows, all of them without an id, is dealt out by its texts."""
    root = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(None, f"text {i}" * 20) for i in range(2000)] + [(1, "x")], "doc_id long, text string")
    sharding.append(docs, root, F.floor(F.col("doc_id") / 10), F.octet_length("text"), F.concat_ws("/", "doc_id", F.md5("text")))
    sharding.compact(spark, root, 40_000)
    sizes = [sum(len(t) for _, t in held) for held in _files(spark, root).values()]
    assert sum(x > 10_000 for x in sizes) >= 6 and max(sizes) < 60_000


def test_sharding_edges(spark, tmp_path):
    """No rows at all, columns named as shards' own in any case, columns that come later, and a reader of the version before."""
    root = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(1, "a", 5, 6, 7, 8, 9)], "doc_id long, text string, pieces int, Tier int, `set` int, bytes int, part int")
    _sharded(docs.limit(0), root)
    assert sharding.compact(spark, root) == 1 and sharding.read(spark, root).count() == 0
    _sharded(docs, root)
    assert sharding.compact(spark, root) == 2
    (r,) = sharding.read(spark, root).select("row.*").collect()
    assert r.asDict() == docs.first().asDict()
    _sharded(docs.withColumn("more", F.lit("new")), root)
    assert sharding.compact(spark, root) == 3 and sharding.read(spark, root, 2).count() == 1
    assert sorted(str(r.more) for r in sharding.read(spark, root).select("row.more").collect()) == ["None", "new"]
    with pytest.raises(ValueError):
        sharding.read(spark, f"file://{tmp_path}/none", 0)


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second of two writers with one base begins again on what the first made."""
    root, made = f"file://{tmp_path}/shards", sharding._compacted
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "doc_id long, text string")
    _sharded(docs, root)

    def late(*a):
        out = made(*a)
        monkeypatch.setattr(sharding, "_compacted", made)
        assert sharding.compact(spark, root, 2000) == 1
        return out

    monkeypatch.setattr(sharding, "_compacted", late)
    assert sharding.compact(spark, root, 2000) == 2
    assert sharding.read(spark, root).count() == 100


def test_dead_writers(spark, tmp_path, monkeypatch):
    """An empty and a cut manifest stop nobody; a name that is taken is not written over; what is aside does not count."""
    root = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id long, text string")
    _sharded(docs, root)
    assert sharding.compact(spark, root, 2000) == 1
    folder = tmp_path / "shards" / "manifest"
    whole = (folder / "version-1").read_text()
    (folder / "version-2").write_text("")
    (folder / "version-3").write_text(whole[: len(whole) // 2])
    (folder / "_version-4-gone").write_text("half of")
    assert sharding.versions(spark, root) == [1] and sharding.latest(spark, root) == 1 and sharding.read(spark, root).count() == 40
    _sharded(docs, root)
    assert sharding.compact(spark, root, 2000) == 4 and sharding.read(spark, root).count() == 80
    assert not sharding._publish(spark, f"{root}/manifest/version-1", "other") and (folder / "version-1").read_text() == whole
    assert not [f for f in folder.iterdir() if f.name.startswith("_version-1")]
    # the way that other file systems go, on one that does not overwrite either
    monkeypatch.setattr(sharding, "_folder", lambda s, p, real=sharding._folder: real(s, p))
    assert sharding._publish(spark, f"{root}/manifest/version-9", whole) and sharding.latest(spark, root) == 9


def test_shard_plan(spark):
    units = [("a", i, b, i) for i, b in enumerate((100, 120, 5000, 90, 0, 101, 150, 1_000_000))]
    units = spark.createDataFrame(units, "set string, part long, unit_bytes long, first_arrival long").selectExpr("*", "CAST(null AS long) AS run", "CAST(null AS long) AS piece")
    got = {r.part: r for r in sharding.plan(units, 400, 4).collect()}
    assert [got[i].kind for i in range(8)] == [0, 0, 2, 0, 0, 0, 0, 2] and [got[i].tier for i in (0, 1, 3, 5, 6)] == [3, 3, 3, 3, 4]
    assert [got[i].move for i in range(8)] == [True, True, True, True, False, True, False, True]
    assert got[0].run == got[1].run == got[3].run == got[5].run == 0 and got[0].pieces == 1 and got[7].pieces == 2500


def test_pipeline(spark, sf_dir):
    """Each stage against its operator on the stage's own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf_dir).cache()
        assert out.columns == COLUMNS, name
        ids = {r.doc_id for r in out.collect()}
        if name == "quality":
            model = quality.train(at, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r.doc_id for r in quality.score(at, model).where("predicted = 1").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
            assert len(good & ids) > 0.97 * len(good)
        if name == "language":
            want = {r.doc_id for r in language.identify(at, language.train(at)).where(f"lang_pred <> 'und' AND score >= {language.REJECT}").collect()}
            assert ids == want
        if name == "near_duplicates":
            assert ids == {r.doc_id for r in ngram_join.near_texts(at).where("doc_id = component_id").collect()}
        if name == "mix":
            assert ids <= {r.doc_id for r in at.collect()}
        at = out
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert last.count() == at.count() and set(last.columns) >= {"doc_id", "ids", "n_tokens"}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.select(F.sum("n_tokens")).first() == last.select(F.sum("n_tokens")).first()


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "mix"])
def test_stage_edges(spark, sf_dir, name):
    """Nulls in any column, empty and long texts, repeated rows, extra columns, no rows."""
    rows = [(1, None, None, None, None), (None, "a b c d e f g", "en", "s", 7), (2, "", "en", None, 0), (3, "word " * 30_000, None, "s", 9), (4, "the same words again and again here", "en", "s", 1), (4, "the same words again and again here", "en", "s", 1), (5, "the same words again and again here", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, key string")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs, sf_dir).columns == COLUMNS
    kept = stage(spark, docs, sf_dir).collect()
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "4", "None"]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert pieces.stage(spark, docs, sf_dir).count() == len(rows)
