"""Vector expressions and the deterministic stand-in for an embedding model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalise_score(score: Column) -> Column:
    """A cosine as a score from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score + 1) / 2))


# Multiplier and increment of a 64-bit linear congruential generator.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """Vectors of a text column; all texts of a batch step through the generator together."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        seeds = [int.from_bytes(hashlib.sha256((t or "").encode()).digest()[-8:], "big") for t in texts]
        state, out = np.array(seeds, np.uint64), np.zeros((len(seeds), dim))
        for i in range(dim):
            state = state * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
            out[:, i] = ((state >> np.uint64(17)) & np.uint64(0xFFFF)).astype(np.float64) / 32768.0 - 1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list((out / np.where(size == 0, 1, size)).astype(np.float32)), index=texts.index)

    return embed(text)
