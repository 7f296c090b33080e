"""Fused ranks of dense, lexical and graph search, exact without a ranking of everything.

A document outside the dense list has one and the same dense rank, so of these only the best by words
can be among the best by fused rank: the first candidates + k of the lexical order are enough, and for the
dense list itself lexical ranks are counted. Documents that share an entity with the best three get a bonus by
how many they share; of each such number only the lexically first k can be among the best k, save for
documents whose rounded scores tie with the last of them: these go by key, and are found by narrowing down
the lexical score at the last tying rank, by counts alone.

What comes to the driver is bounded by a block of questions: their lists, the entities of three documents of
each, and counts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.operators import lexical
from docloom.operators.lexical import Best, Questions, Shard, best_rows, over_shards
from docloom.sources.scratch import kept

#: Scores between which a narrowing step counts, for a question and for all of a block at most.
CUTS, ALL_CUTS = 1024, 1 << 18
#: A place before all keys.
NO_KEY = -(1 << 63)
#: Columns of a shard that passes over words, and over tags alone, read.
WORDS, TAGS = ("keys", "sizes", "terms", "dfs", "places", "tfs"), ("keys", "tags", "tag_dfs", "tag_places")


def _billionths(x: np.ndarray) -> np.ndarray:
    """Rounded half up."""
    return np.floor(np.asarray(x) * 1e9 + 0.5).astype(np.int64)


def _rrf(dense_rank: np.ndarray, sparse_rank: np.ndarray) -> np.ndarray:
    c = DEFAULT.rrf_k
    return _billionths(1.0 / (c + dense_rank) + 1.0 / (c + sparse_rank)) / 1e9


def _pairs(keys) -> tuple[np.ndarray, np.ndarray]:
    """(question, key) of the keys of each question, as two arrays."""
    return np.repeat(np.array(list(keys), np.int64), [len(k) for k in keys.values()]), np.array([x for k in keys.values() for x in k], np.int64)


def _held(shard: Shard, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(question, place) of the documents here that have a key of a question."""
    i, place = shard.holding(pairs[1])
    return pairs[0][i], place


def _by_question(q: np.ndarray, place: np.ndarray):
    """(question, its places), for each question that has some."""
    order = np.argsort(q, kind="stable")
    some, first = np.unique(q[order], return_index=True)
    return zip(some.tolist(), np.split(place[order], first[1:]), strict=False)


class _Tags:
    """Tags of all questions of a block, each once, so that a shard looks them up once."""

    def __init__(self, tags: dict[int, np.ndarray]):
        self.all = np.array(sorted(set().union(*map(set, tags.values()))), dtype=object)
        self.own = {q: np.searchsorted(self.all, t) for q, t in tags.items()}

    def counter(self, shard: Shard):
        """How many of a question's tags each document of a shard has."""
        first, n = shard.tag_ranges(self.all)
        return lambda q: shard.tagged(first[self.own[q]], n[self.own[q]])


def _final(rrf: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """In whole millionths, rounded half up; both have nine digits."""
    return (_billionths(rrf) + _billionths(graph) + 500) // 1000


class Hybrid:
    """One block of questions over an index and a dense list."""

    def __init__(self, index: DataFrame, asked: Questions, dense: dict[int, list[tuple[int, float]]], candidates: int):
        """dense: by number of the question its dense list, best first."""
        self.index, self.asked, self.candidates = index, asked, candidates
        self.spark = index.sparkSession
        self.sent = self.spark.sparkContext.broadcast(asked)
        self.dense = {q: {key: (score, r + 1) for r, (key, score) in enumerate(dense.get(q, []))} for q in range(len(asked.ids))}

    def _pass(self, each, schema: str, *columns: str) -> DataFrame:
        return over_shards(self.index, self.sent, each, schema, *(columns or WORDS))

    def _scores_of(self, keys: dict[int, set[int]]) -> dict[tuple[int, int], int]:
        """(question, key) -> lexical score of some documents that share a word with it."""
        sent = self.spark.sparkContext.broadcast(_pairs(keys))

        def each():
            def take(shard: Shard):
                q, place = _held(shard, sent.value)
                rows = []
                for one, at in _by_question(q, place):
                    score, hit = shard.scores(one)
                    at = at[hit[at]]
                    rows.append(np.stack([np.full(len(at), one), shard.keys[at], score[at]], axis=1))
                if rows:
                    yield pd.DataFrame(np.concatenate(rows), columns=["q", "key", "score"])

            return take, lambda: []

        return {(r.q, r.key): r.score for r in self._pass(each, "q int, key long, score long").collect()}

    def _lexical(self, k: int) -> tuple[dict[int, list[tuple[int, int]]], np.ndarray]:
        """By question the first k (key, score) of the lexical order, and how many documents share a word with it."""
        n = len(self.asked.ids)

        def each():
            best, hits = Best(n, k), np.zeros(n, np.int64)

            def take(shard: Shard):
                for q in range(n):
                    score, hit = shard.scores(q)
                    at = np.flatnonzero(hit)
                    hits[q] += len(at)
                    best.add(q, score[at], shard.keys[at])
                return ()

            return take, lambda: [best.frame(), pd.DataFrame({"q": -1 - np.arange(n), "key": 0, "score": hits})]

        rows = kept(self._pass(each, "q int, key long, score long"), "lexical-lists")
        hits = np.zeros(n, np.int64)
        for r in rows.where("q < 0").groupBy("q").agg(F.sum("score").alias("n")).collect():
            hits[-1 - r.q] = r.n
        first: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r in best_rows(rows.where("q >= 0"), ["q"], [F.desc("score"), F.asc("key")], k).orderBy("q", "rank").collect():
            first[r.q].append((r.key, r.score))
        return first, hits

    def _before(self, cuts: dict[int, list[tuple[int, int]]]) -> dict[tuple[int, int, int], int]:
        """(question, score, key) -> how many documents come before that place in the lexical order of the question."""
        places = {q: np.array(sorted(set(c), key=lambda x: (-x[0], x[1])), np.int64).reshape(-1, 2) for q, c in cuts.items() if c}
        sent = self.spark.sparkContext.broadcast(places)

        def each():
            held = {q: np.zeros(len(c), np.int64) for q, c in sent.value.items()}

            def take(shard: Shard):
                for q, cut in sent.value.items():
                    score, hit = shard.scores(q)
                    own = np.sort(score[hit])
                    after = np.searchsorted(own, cut[:, 0], side="right")
                    held[q] += len(own) - after
                    ties = np.flatnonzero((np.searchsorted(own, cut[:, 0]) < after) & (cut[:, 1] > NO_KEY))
                    if len(ties):
                        at = np.flatnonzero(hit & np.isin(score, cut[ties, 0]))
                        at = at[np.lexsort((shard.keys[at], score[at]))]
                        some, keys = score[at], shard.keys[at]
                        for i, a, b in zip(ties.tolist(), np.searchsorted(some, cut[ties, 0]).tolist(), np.searchsorted(some, cut[ties, 0], side="right").tolist(), strict=True):
                            held[q][i] += np.searchsorted(keys[a:b], cut[i, 1])
                return ()

            return take, lambda: [pd.DataFrame({"q": q, "i": np.arange(len(n)), "n": n}) for q, n in held.items()]

        out = {}
        for r in self._pass(each, "q int, i int, n long").groupBy("q", "i").agg(F.sum("n").alias("n")).collect():
            score, key = places[r.q][r.i].tolist()
            out[r.q, score, key] = r.n
        return out

    def fused(self, k: int) -> pd.DataFrame:
        """Candidates (q, key, dense, dense_rank, sparse, sparse_rank, rrf, hit), among them the first k by fused rank of every question."""
        first, self.hits = self._lexical(self.candidates + k)
        known = {q: dict(rows) for q, rows in first.items()}
        self.top = {q: rows[0][1] for q, rows in first.items()}
        more = self._scores_of({q: set(d) - set(known.get(q, {})) for q, d in self.dense.items()})
        before = self._before({q: [(more[q, key], key) for key in d if (q, key) in more] for q, d in self.dense.items()})
        rows = []
        for q in range(len(self.asked.ids)):
            rank = {key: r + 1 for r, (key, _) in enumerate(first.get(q, []))}
            for key in {**dict.fromkeys(rank), **dict.fromkeys(self.dense[q])}:
                score = known.get(q, {}).get(key, more.get((q, key)))
                place = rank.get(key) or (before[q, score, key] + 1 if score is not None else int(self.hits[q]) + 1)
                rows.append((q, key, *self.dense[q].get(key, (0.0, self.candidates + 1)), score or 0, place, score is not None))
        out = pd.DataFrame(rows, columns=["q", "key", "dense", "dense_rank", "sparse", "sparse_rank", "hit"])
        out["rrf"] = _rrf(out["dense_rank"].to_numpy(), out["sparse_rank"].to_numpy())
        return out

    # The graph bonus
    def _anchors(self, fused: pd.DataFrame) -> dict[int, np.ndarray]:
        """By question the entities of its first documents."""
        ranked = fused.sort_values(["q", "rrf", "key"], ascending=[True, False, True]).groupby("q").head(DEFAULT.graph_anchors)
        sent = self.spark.sparkContext.broadcast((ranked["q"].to_numpy(np.int64), ranked["key"].to_numpy(np.int64)))

        def each():
            def take(shard: Shard):
                rows = [(q, t) for q, at in zip(*(x.tolist() for x in _held(shard, sent.value)), strict=True) for t in shard.tags_of(at)]
                if rows:
                    yield pd.DataFrame(rows, columns=["q", "tag"])

            return take, lambda: []

        tags: dict[int, set[str]] = defaultdict(set)
        for r in self._pass(each, "q int, tag string", *TAGS).collect():
            tags[r.q].add(r.tag)
        return {q: np.array(sorted(t), dtype=object) for q, t in tags.items()}

    def _shared(self, anchors: dict[int, np.ndarray], fused: pd.DataFrame, k: int) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], list[tuple[int, int]]]]:
        """How many anchors the candidates share; and by question and number of shared anchors the lexically first k of other documents, as (score, key), score -1 without a common word."""
        sent = self.spark.sparkContext.broadcast((_Tags(anchors), (fused["q"].to_numpy(np.int64), fused["key"].to_numpy(np.int64))))

        def each():
            groups: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            least: dict[int, np.ndarray] = {}  # by number of shared anchors the score that a document must reach

            def take(shard: Shard):
                tags, known = sent.value
                count, listed, rows = tags.counter(shard), dict(_by_question(*_held(shard, known))), []
                for q, own in tags.own.items():
                    n, have = count(q), np.zeros(len(shard.keys), bool)
                    if q in listed:
                        have[listed[q]] = True
                        at = np.flatnonzero(have & (n > 0))
                        rows.append(np.stack([np.full(len(at), q), n[at], shard.keys[at], np.full(len(at), -2)], axis=1))
                    at = np.flatnonzero(~have & (n > 0))
                    if not len(at):
                        continue
                    score, hit = shard.scores(q)
                    score = np.where(hit, score, -1)[at]
                    bar = least.setdefault(q, np.full(len(own) + 1, -1, np.int64))
                    some = score >= bar[n[at]]
                    at, score = at[some], score[some]
                    order = np.lexsort((shard.keys[at], -score, n[at]))
                    number = n[at][order]
                    order = order[np.arange(len(order)) - np.searchsorted(number, number) < k]
                    for s, *row in zip(n[at[order]].tolist(), (-score[order]).tolist(), shard.keys[at[order]].tolist(), strict=True):
                        groups[q, s].append(tuple(row))
                    for s in np.unique(n[at[order]]).tolist():
                        held = groups[q, s] = sorted(groups[q, s])[:k]
                        if len(held) == k:
                            bar[s] = -held[-1][0]
                if rows:
                    yield pd.DataFrame(np.concatenate(rows), columns=["q", "shared", "key", "score"])

            def end():
                rows = [(q, s, key, -score) for (q, s), held in groups.items() for score, key in sorted(held)[:k]]
                return [pd.DataFrame(rows, columns=["q", "shared", "key", "score"])]

            return take, end

        rows = kept(self._pass(each, "q int, shared int, key long, score long", *dict.fromkeys(WORDS + TAGS)), "shared-entities")
        shared = {(r.q, r.key): r.shared for r in rows.where("score = -2").collect()}
        groups: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for r in best_rows(rows.where("score > -2"), ["q", "shared"], [F.desc("score"), F.asc("key")], k).orderBy("q", "shared", "rank").collect():
            groups[r.q, r.shared].append((r.score, r.key))
        return shared, groups

    def _cut_score(self, targets: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        """(question, rank) -> the lexical score at that rank: the lowest score that fewer than `rank` documents exceed."""
        low = dict.fromkeys(targets, 0)  # exceeded by `rank` documents or more, or nothing to exceed
        high = {(q, rank): self.top[q] for q, rank in targets}  # exceeded by fewer: by none at first
        while open_ := [t for t in targets if high[t] - low[t] > 1]:
            n = max(16, min(CUTS, ALL_CUTS // len(open_)))
            cuts = {t: sorted({low[t] + (high[t] - low[t]) * i // (n + 1) for i in range(1, n + 1)} - {low[t], high[t]}) for t in open_}
            asked: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for (q, _), values in cuts.items():
                asked[q] += [(v, NO_KEY) for v in values]  # before the first key: scores above only
            above = self._before(asked)
            for t in open_:
                for v in cuts[t]:
                    if above[t[0], v, NO_KEY] < t[1]:
                        high[t] = min(high[t], v)
                    else:
                        low[t] = max(low[t], v)
        return high

    def _ties(self, wanted: dict[tuple[int, int], int], anchors: dict[int, np.ndarray], fused: pd.DataFrame, k: int) -> list[tuple[int, int, int, int]]:
        """(question, shared, key, score) of the k lowest keys among documents that share so many anchors and stand at a lexical rank or before; some beyond it too, for the caller to rank."""
        hits = self.hits
        cut = self._cut_score({(q, rank): rank for (q, _), rank in wanted.items() if rank <= hits[q]})
        levels = {(q, s): cut.get((q, rank), -1) for (q, s), rank in wanted.items()}
        sent = self.spark.sparkContext.broadcast((_Tags({q: anchors[q] for q in {q for q, _ in wanted}}), (fused["q"].to_numpy(np.int64), fused["key"].to_numpy(np.int64)), levels))

        def each():
            held: dict[tuple[int, int, bool], np.ndarray] = {}

            def take(shard: Shard):
                tags, known, levels = sent.value
                counts: dict[int, tuple] = {}
                count, listed = tags.counter(shard), dict(_by_question(*_held(shard, known)))
                for (q, s), level in levels.items():
                    if q not in counts:
                        score, hit = shard.scores(q)
                        counts[q] = count(q), np.where(hit, score, -1), np.zeros(len(shard.keys), bool)
                        counts[q][2][listed.get(q, [])] = True
                    n, score, have = counts[q]
                    for at_cut in (False, True):  # those at the cut score itself may lie beyond the rank
                        at = np.flatnonzero((n == s) & ~have & (score == level if at_cut else score > level))
                        if len(at):
                            both = np.concatenate([held.get((q, s, at_cut), np.zeros((0, 2), np.int64)), np.stack([shard.keys[at], score[at]], axis=1)])
                            held[q, s, at_cut] = both[np.argsort(both[:, 0], kind="stable")[:k]]
                return ()

            return take, lambda: [pd.DataFrame({"q": q, "shared": s, "at_cut": c, "key": rows[:, 0], "score": rows[:, 1]}) for (q, s, c), rows in held.items()]

        found = best_rows(self._pass(each, "q int, shared int, at_cut boolean, key long, score long", *dict.fromkeys(WORDS + TAGS)), ["q", "shared", "at_cut"], [F.asc("key")], k)
        return [(r.q, r.shared, r.key, r.score) for r in found.collect()]

    def with_graph(self, k: int) -> pd.DataFrame:
        """The first k of every question by fused rank and graph bonus: q, key, dense, dense_rank, sparse, sparse_rank, rrf, graph, final (millionths), rank."""
        fused = self.fused(k)
        anchors = self._anchors(fused)
        shared, groups = self._shared(anchors, fused, k)
        bonus = lambda q, s: float(_billionths(DEFAULT.graph_weight * min(1.0, s / len(anchors[q])))) / 1e9 if s else 0.0
        absent = self.candidates + 1

        def frame(rows: list[tuple[int, int, int, int]]) -> pd.DataFrame:
            """(q, shared, key, score) of documents that are in neither list."""
            asked: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for q, _, key, score in rows:
                if score >= 0:
                    asked[q].append((score, key))
            before = self._before(asked) if asked else {}
            made = [(q, key, 0.0, absent, max(score, 0), before[q, score, key] + 1 if score >= 0 else int(self.hits[q]) + 1, score >= 0, bonus(q, s), s) for q, s, key, score in rows]
            out = pd.DataFrame(made, columns=["q", "key", "dense", "dense_rank", "sparse", "sparse_rank", "hit", "graph", "shared"])
            out["rrf"] = _rrf(out["dense_rank"].to_numpy(np.float64), out["sparse_rank"].to_numpy(np.float64))
            return out

        fused["shared"] = [shared.get((q, key), 0) for q, key in zip(fused["q"], fused["key"], strict=True)]
        fused["graph"] = [bonus(q, s) for q, s in zip(fused["q"], fused["shared"], strict=True)]
        others = frame([(q, s, key, score) for (q, s), rows in groups.items() for score, key in rows])
        everything = pd.concat([fused, others], ignore_index=True) if len(others) else fused
        everything["final"] = _final(everything["rrf"].to_numpy(np.float64), everything["graph"].to_numpy(np.float64))
        # documents that are not listed can only tie with the last of the first k
        last = everything.sort_values("final", ascending=False).groupby("q")["final"].apply(lambda x: x.iloc[k - 1] if len(x) >= k else -1).to_dict()
        wanted = {}
        for (q, s), rows in groups.items():
            if len(rows) == k:
                own = everything[(everything["q"] == q) & (everything["shared"] == s) & everything["key"].isin([key for _, key in rows])]
                if own["final"].min() >= last[q]:
                    wanted[q, s] = self._last_rank(bonus(q, s), int(last[q]), int(own["sparse_rank"].max()), int(self.hits[q]) + 1)
        if wanted:
            more = frame(self._ties(wanted, anchors, fused, k))
            more["final"] = _final(more["rrf"].to_numpy(np.float64), more["graph"].to_numpy(np.float64))
            everything = pd.concat([everything, more], ignore_index=True).drop_duplicates(["q", "key"])
        ranked = everything.sort_values(["q", "final", "key"], ascending=[True, False, True]).groupby("q").head(k).copy()
        ranked["rank"] = ranked.groupby("q").cumcount() + 1
        return ranked

    def _last_rank(self, graph: float, final: int, rank: int, most: int) -> int:
        """The last lexical rank, of documents outside the dense list, whose score is `final`; rank has it."""
        low, high = rank, most
        while low < high:
            middle = (low + high + 1) // 2
            if int(_final(_rrf(np.float64(self.candidates + 1), np.float64(middle)), np.float64(graph))) >= final:
                low = middle
            else:
                high = middle - 1
        return low


def _each_block(index: DataFrame, questions: DataFrame, dense: DataFrame, candidates: int, query: str, text: str, key: str):
    """Hybrid of each block of questions."""
    for asked in lexical.blocks_of(questions, index, query, text):
        names = index.sparkSession.createDataFrame([(i,) for i in asked.ids], f"{query} long")
        number = {i: q for q, i in enumerate(asked.ids)}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for r in dense.join(F.broadcast(names), query).select(F.col(query).alias("i"), F.col(key).alias("k"), "score", "rank").orderBy("i", "rank").collect():  # `candidates` rows a question
            lists[number[r.i]].append((r.k, r.score))
        yield asked, Hybrid(index, asked, lists, candidates)


def _frame(spark, found: list[tuple[Questions, pd.DataFrame]], query: str, key: str, graph: bool) -> DataFrame:
    schema = f"{query} long, {key} long, dense double, dense_rank long, sparse double, sparse_rank long, rrf double" + ", graph double, final double" * graph + ", rank long"
    rows = []
    for asked, df in found:
        for r in df.itertuples():
            rows.append((asked.ids[r.q], int(r.key), float(r.dense), int(r.dense_rank), round(r.sparse * lexical.UNIT, 6), int(r.sparse_rank), float(r.rrf), *((float(r.graph), r.final / 1e6) if graph else ()), int(r.rank)))
    return spark.createDataFrame(rows, schema)


def fused_top(index: DataFrame, questions: DataFrame, dense: DataFrame, k: int, candidates: int = 50, query: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, key, dense, dense_rank, sparse, sparse_rank, rrf, rank): each question's first k documents by reciprocal rank fusion.

    dense is (query, key, score, rank) with at most `candidates` rows a question; a document that it misses ranks
    behind its last place, one that shares no word with the question behind all that do. Scores of these are 0.
    """
    out = []
    for asked, hybrid in _each_block(index, questions, dense, candidates, query, text, key):
        df = hybrid.fused(k).sort_values(["q", "rrf", "key"], ascending=[True, False, True]).groupby("q").head(k).copy()
        df["rank"] = df.groupby("q").cumcount() + 1
        out.append((asked, df))
    return _frame(index.sparkSession, out, query, key, False)


def graph_top(index: DataFrame, questions: DataFrame, dense: DataFrame, k: int, candidates: int = 50, query: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """As fused_top with graph and final before rank: the entity bonus is the share of the first three documents' tags that a document has, times the weight; every document that has one takes part."""
    return _frame(index.sparkSession, [(asked, hybrid.with_graph(k)) for asked, hybrid in _each_block(index, questions, dense, candidates, query, text, key)], query, key, True)
