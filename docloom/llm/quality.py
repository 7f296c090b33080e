"""Operator 10: a quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts of the training fold fit a small network that minimises
the non-negative unbiased risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior *
loss(positives as 0)). Where the second part turns negative, as it does once the network memorises the
positives, the step goes the other way. The class prior is estimated as the share of label 1 among the
labelled rows of the training fold. With the logistic loss the sigmoid of the output estimates the
chance of label 1.

Features are computed in Spark for all texts by numpy: shares of kinds of characters, of repeated words
and of repeated pairs, of repeats within windows, lengths. The network is fitted on the driver on at most SAMPLE positives and
SAMPLE unlabelled rows, chosen by the hash of their ids; only their features go there. Scoring is one
pass over the texts with the network's few thousand weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import mix, table, text_chunks, utf8, word_hashes

#: Most positives and most unlabelled rows that the fit uses.
SAMPLE = 12_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_MARKS = b"!#$%&*+-./:;<=>?@\\^_|~,\"'()[]{}"
_CLASSES = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 not ASCII, then marks one by one
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[[32, 9, 11, 12]], _CLASSES[[10, 13]], _CLASSES[128:] = 1, 2, 3, 4, 5, 6
_CLASSES[list(_MARKS)] = np.arange(7, 7 + len(_MARKS))
KINDS = 7 + len(_MARKS)
FEATURES = KINDS + 10


def _window_variety(w: np.ndarray) -> float:
    """The share of distinct words within windows of 64 words, over all of them (the last may be shorter)."""
    cut = len(w) // 64 * 64
    whole, rest = np.sort(w[:cut].reshape(-1, 64), axis=1), np.sort(w[cut:])
    same = (whole[:, 1:] == whole[:, :-1]).sum() + (rest[1:] == rest[:-1]).sum()
    return 1 - same / len(w)


def text_features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES numbers for each text; all zero for an empty one."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for a, b in text_chunks(texts):
        sizes = np.array([len(t) for t in texts[a:b]])
        joined = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        owner = np.repeat(np.arange(b - a), sizes)
        counts = np.bincount(owner * KINDS + _CLASSES[joined], minlength=(b - a) * KINDS).reshape(-1, KINDS)
        safe = np.maximum(sizes, 1)[:, None]
        out[a:b, :KINDS] = np.sqrt(counts / safe)
        words, ends = word_hashes(texts[a:b])
        start = 0
        for i, end in enumerate(ends.tolist()):
            n = end - start
            if n:
                w = words[start:end]
                _, each = np.unique(w, return_counts=True)
                pairs = mix(w[1:] + w[:-1] * np.uint64(0x9E3779B97F4A7C15))
                distinct = len(np.unique(pairs)) / max(1, len(pairs))
                out[a + i, KINDS:] = (
                    np.log1p(n) / 8, np.log1p(sizes[i]) / 10, sizes[i] / n / 20, len(each) / n, each.max() / n,
                    (w[1:] == w[:-1]).mean() if n > 1 else 0, distinct, _window_variety(w), counts[i, 2] / max(1, counts[i, 1] + counts[i, 2]), 1,
                )
            start = end
    return out


def risk(w: dict, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the unbiased risk, with the logistic loss: its sum may turn negative, which no risk is."""
    f = lambda x: np.tanh(x @ w["w"] + w["b"]) @ w["v"] + w["c"]
    loss = lambda z: np.logaddexp(0, z).mean()
    return prior * loss(-f(xp)), loss(f(xu)) - prior * loss(f(xp))


def step_direction(w: dict, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[bool, dict]:
    """Whether the negative part is below 0, and the gradient to follow: that of both parts, or else of the negative part away from 0; with a little weight decay."""
    x = np.concatenate([xp, xu])
    h = np.tanh(x @ w["w"] + w["b"])
    f = h @ w["v"] + w["c"]
    fp, fu = f[: len(xp)], f[len(xp) :]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    below = bool(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() < 0)
    of_negative = np.concatenate([-prior * sigmoid(fp) / len(xp), sigmoid(fu) / len(xu)])
    grad = -of_negative if below else np.concatenate([-prior * sigmoid(-fp) / len(xp), np.zeros(len(xu))]) + of_negative
    inner = grad[:, None] * w["v"] * (1 - h * h)
    return below, {"w": x.T @ inner + 1e-4 * w["w"], "b": inner.sum(0), "v": h.T @ grad + 1e-4 * w["v"], "c": grad.sum()}


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1500, rate: float = 0.01, seed: int = 7) -> dict:
    """The network's weights; deterministic for given rows. Without rows of both kinds it gives the prior for all."""
    prior = float(min(max(prior, 1e-3), 1 - 1e-3))
    if not len(positive) or not len(unlabelled):
        return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w": np.zeros((FEATURES, 1)), "b": np.zeros(1), "v": np.zeros(1), "c": np.log(prior / (1 - prior))}
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 0.01
    rng = np.random.default_rng(seed)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    w = {"w": rng.standard_normal((FEATURES, hidden)) / np.sqrt(FEATURES), "b": np.zeros(hidden), "v": rng.standard_normal(hidden) / np.sqrt(hidden), "c": np.array(np.log(prior / (1 - prior)))}
    m1, m2 = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1):
        grads = step_direction(w, p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)], prior)[1]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] = w[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "scale": scale, **w}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.tanh(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] + model["b"]) @ model["v"] + model["c"]
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether the row is in the fold that no label is learned from; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def _features(batches):
    for df in batches:
        for a in range(0, len(df), 2048):
            x = text_features(utf8(df["text"].iloc[a : a + 2048]))
            yield pd.DataFrame({"kind": df["kind"].iloc[a : a + 2048], "order": df["order"].iloc[a : a + 2048], "x": list(x)})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, quality); rows of the held-out fold and null labels are not used.

    Of a doc_id with labels of both kinds the larger counts. Where hardly any row is unlabelled, all
    texts of the training fold serve as unlabelled ones.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior, n = known.agg(F.avg((F.col("quality") == 1).cast("double")), F.count("*")).first()
    order = F.xxhash64("doc_id")
    positive = known.where("quality = 1").select("doc_id", F.lit(1).alias("kind"), order.alias("order")).orderBy("order").limit(sample)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    unlabelled = ids.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("kind"), order.alias("order"))
    chosen = unlabelled.distinct().orderBy("order").limit(sample).union(positive)  # at most 2 * sample ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.mapInPandas(_features, "kind int, order long, x array<float>").groupBy("kind", "order").agg(F.min("x").alias("x"))  # of rows that share a doc_id one
    got = found.toPandas().sort_values(["order", "kind"], kind="stable")
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, FEATURES), np.float32)
    kind = got["kind"].to_numpy()
    return fit(x[kind == 1], x[kind == 0] if (kind == 0).sum() >= 50 else x, 0.5 if prior is None else prior)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) -> doc_id, score, predicted; null and empty texts get the score of no features."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for df in batches:
            for a in range(0, len(df), 2048):
                some = df.iloc[a : a + 2048]
                yield pd.DataFrame({"doc_id": some["doc_id"], "score": predict(weights.value, text_features(utf8(some["text"])))})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Columns that documents does not have go."""
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    weights = spark.sparkContext.broadcast(model)

    def run(batches):
        for df in batches:
            for a in range(0, len(df), 2048):
                some = df.iloc[a : a + 2048]
                yield some[predict(weights.value, text_features(utf8(some["text"]))) >= THRESHOLD]

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    return docs.select(*[c.split()[0] for c in columns.split(", ")]).mapInPandas(run, columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")
