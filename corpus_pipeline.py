"""A corpus pipeline: quality, language, near duplicates, mix, token ids. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import language, mixing, ngram_join, pieces, quality
from docloom.llm.common import stash, table

STAGES = [
    ("quality", quality.stage),
    ("language", language.stage),
    ("near_duplicates", ngram_join.stage),
    ("mix", mixing.stage),
    ("token_ids", pieces.stage),
]

#: A trained classifier decides in the first stage, which SQL cannot express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
