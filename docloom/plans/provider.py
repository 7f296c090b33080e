"""Model calls behind one interface, and a provider that needs no model: every answer is a function of its input.

A provider's methods take and return columns or DataFrames. `Offline` answers by rule; `Remote` sends prompts to
a model from the tasks, each through `with_retry`, which tries transient errors again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import keyword_grade, tokens, without_fence
from docloom.functions.vector import mock_embedding
from docloom.operators import facts, graph, tables
from docloom.operators.observe import verdict
from docloom.plans import planner

#: The closed lists of document types, domains and content flags that a classification chooses from.
DOC_TYPES = ["research_paper", "financial_report", "contract", "technical_spec", "presentation", "memo", "other"]
DOMAINS = ["medical", "financial", "legal", "technical", "general"]
FLAGS = ["contains_tables", "contains_code", "contains_figures", "has_executive_summary", "is_regulatory", "multi_column"]
#: Words by which the offline provider tells types and domains, and patterns of flags that a sample's text shows.
TYPE_WORDS = {
    "research_paper": ["abstract", "hypothesis", "methodology", "experiment", "findings", "references"],
    "financial_report": ["revenue", "ebitda", "margin", "fiscal", "earnings"],
    "contract": ["agreement", "party", "clause", "liability", "hereby"],
    "technical_spec": ["api", "endpoint", "server", "protocol", "interface"],
    "presentation": ["slide", "agenda", "deck"],
    "memo": ["memo", "memorandum", "subject", "cc"],
}
DOMAIN_WORDS = {"medical": ["patient", "clinical", "drug", "dose"], "financial": ["revenue", "invoice", "bank", "fiscal"], "legal": ["agreement", "law", "court", "clause"], "technical": ["software", "api", "data", "server"]}
FLAG_PATTERNS = {"contains_code": r"```|\b(def|class|function|SELECT|import)\b .*[({;:]", "has_executive_summary": r"(?i)\bexecutive summary\b", "is_regulatory": r"(?i)\b(regulation|directive|compliance|statute|pursuant)\b", "multi_column": r"\S {4,}\S[^\n]*\n[^\n]*\S {4,}\S"}
INTEL = "struct<doc_type:string,doc_type_confidence:double,domain:string,content_flags:array<string>,summary:string,key_dates:array<string>>"
TRANSIENT = {"RateLimitError", "APIConnectionError", "APITimeoutError", "InternalServerError", "OverloadedError", "TimeoutError", "ConnectionError"}


def is_transient(error: Exception) -> bool:
    """By the error's name, or an HTTP status of 429 or 5xx."""
    status = getattr(error, "status_code", None)
    return type(error).__name__ in TRANSIENT or (isinstance(status, int) and (status == 429 or 500 <= status < 600))


def with_retry(call: Callable, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient errors are tried again after base * 2^n seconds and a little more."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not is_transient(e):
                raise
            sleep(min(most, base * 2**n + random.uniform(0, base / 2)))


def _most_hits(text: Column, words: dict[str, list[str]], default: str) -> Column:
    own = tokens(F.lower(text))
    hits = [F.struct(F.size(F.array_intersect(own, F.array(*map(F.lit, w)))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, w) in enumerate(words.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


class Offline:
    """The provider without a model."""

    def embed(self, text: Column, dim: int = 64) -> Column:
        return mock_embedding(text, dim)

    def plan(self, inspected: DataFrame) -> DataFrame:
        """The steps of each inspected document; a model's plan may leave some out, which the repair makes good."""
        return planner.plan(inspected)

    def classify(self, sample: Column, has_tables: Column, has_images: Column) -> Column:
        """INTEL of a document by its sample: type and domain by keywords, flags by what the sample shows, its first two sentences and its dates. An empty text is other and general, without confidence."""
        text = F.coalesce(sample, F.lit(""))
        kind = _most_hits(text, TYPE_WORDS, "other")
        flags = {"contains_tables": has_tables, "contains_figures": has_images} | {name: text.rlike(pattern) for name, pattern in FLAG_PATTERNS.items()}
        found = F.array_compact(F.array(*[F.when(F.coalesce(flags[name], F.lit(False)), F.lit(name)) for name in FLAGS]))
        dates = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))), 1, 5)
        summary = F.when(F.trim(text) == "", "No text content available for analysis.").otherwise(F.trim(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"^((?:[^.!?]*[.!?]){1,2}|.{1,300})", 1)))
        return F.struct(kind.alias("doc_type"), F.when(kind == "other", 0.0).otherwise(0.8).alias("doc_type_confidence"), _most_hits(text, DOMAIN_WORDS, "general").alias("domain"), found.alias("content_flags"), summary.alias("summary"), dates.alias("key_dates")).cast(INTEL)

    def entities(self, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
        return graph.mentions(chunks, key)

    def describe_table(self, headers: Column, n_rows: Column) -> Column:
        return F.when(F.size(headers) > 0, F.format_string("Table of %d rows with %s", n_rows, F.array_join(headers, ", "))).otherwise("Table data")

    def describe_column(self, name: Column, kind: Column) -> Column:
        return F.concat(F.when(kind == "REAL", "Numbers of ").otherwise("Values of "), F.replace(name, F.lit("_"), F.lit(" ")))

    def caption(self, kind: Column, width: Column, height: Column) -> Column:
        return F.format_string("%s image of %d by %d pixels", F.upper(kind), width, height)

    def read_page(self, image: Column, kind: Column) -> Column:
        """The reply about a page's image (bytes and format): JSON of prose and tables, or prose. No rule reads images."""
        return F.lit(None).cast("string")

    def facts(self, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
        return facts.extract(chunks, key)

    def route(self, questions: DataFrame, columns: DataFrame) -> DataFrame:
        """(q) -> (q, sql): the template of the table whose column the question names; null where it asks no aggregate."""
        made = tables.table_questions(columns).select("table_name", "sql", F.lower("q").alias("t"))
        one = made.withColumn("column", F.regexp_extract("t", r"average ([a-z0-9_]+)", 1)).groupBy("column").agg(F.min("sql").alias("sql")).where("column <> ''")
        asked = questions.withColumn("wants", tables.asks_aggregate(F.col("q"))).withColumn("word", F.explode_outer(F.regexp_extract_all(F.lower("q"), F.lit(r"[a-z0-9_]+"), F.lit(0))))
        return asked.join(one, F.col("word") == F.col("column"), "left").groupBy("q").agg(F.min(F.when(F.col("wants"), F.col("sql"))).alias("sql"))

    def rerank(self, question: Column, texts: Column) -> Column:
        """Places of the texts by words in common with the question, most first."""
        own = F.array_distinct(tokens(F.lower(question)))
        scored = F.transform(texts, lambda t, i: F.struct((-F.size(F.array_intersect(own, tokens(F.lower(t))))).alias("s"), i.alias("i")))
        return F.transform(F.array_sort(scored), lambda x: x["i"])

    def answer(self, chunks: Column, sql_value: Column) -> Column:
        """The beginnings of the first two chunks, and the SQL result."""
        parts = F.transform(F.slice(chunks, 1, 2), lambda t: F.substring(t, 1, 50))
        return F.concat(F.array_join(parts, " … "), F.when(F.coalesce(sql_value, F.lit("")) != "", F.concat(F.lit(" [SQL: "), sql_value, F.lit("]"))).otherwise(""))

    def judge(self, answer: Column, keywords: Column) -> tuple[Column, Column]:
        """A score by the keywords that the answer has, and its verdict."""
        _, missing = keyword_grade(answer, keywords)
        score = F.round(1 - F.coalesce(F.try_divide(F.size(missing).cast("double"), F.size(keywords)), F.lit(1.0)), 3)
        return score, verdict(score)


class Remote(Offline):
    """A model behind `send` (a prompt to its reply), which the tasks call; what it does not answer well falls back to the rules.

    attempts and base are those of `with_retry`. A call that still fails is an empty reply, so one document's
    failure does not end a stage. `see` (an image's bytes and format to a reply) reads pages that have no text layer.
    """

    def __init__(self, send: Callable[[str], str], attempts: int = 3, base: float = 1.0, see: Callable[[bytes, str], str] | None = None):
        self.send, self.attempts, self.base, self.see = send, attempts, base, see

    def read_page(self, image: Column, kind: Column) -> Column:
        if self.see is None:
            return super().read_page(image, kind)
        see, attempts, base = self.see, self.attempts, self.base

        def one(data: bytes | None, name: str | None) -> str | None:
            if data is None:
                return None
            try:
                return with_retry(lambda: see(bytes(data), name), attempts, base)
            except Exception:  # noqa: BLE001 - whatever a service raises
                return None

        @F.pandas_udf("string")
        def look(images: pd.Series, kinds: pd.Series) -> pd.Series:
            return pd.Series([one(i, k) for i, k in zip(images, kinds, strict=True)], dtype=object)

        return look(image, kind)

    def complete(self, prompt: Column) -> Column:
        send, attempts, base = self.send, self.attempts, self.base

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return with_retry(lambda: send(text), attempts, base)
            except Exception:  # noqa: BLE001 - whatever a service raises
                return ""

        @F.pandas_udf("string")
        def ask(prompts: pd.Series) -> pd.Series:
            return pd.Series([one(p) for p in prompts], dtype=object)

        return ask(prompt)

    def classify(self, sample: Column, has_tables: Column, has_images: Column) -> Column:
        """The reply's JSON, without a fence; values outside the closed lists, and a reply that is no JSON, give way to the rules."""
        ruled = super().classify(sample, has_tables, has_images)
        asked = F.concat(F.lit(f"Return one JSON object: doc_type, one of {DOC_TYPES}; domain, one of {DOMAINS}; doc_type_confidence, 0 to 1; content_flags, any of {FLAGS}; summary, two sentences; key_dates, at most 5 ISO dates. Document:\n"), F.coalesce(sample, F.lit("")))
        said = F.from_json(without_fence(self.complete(F.when(F.trim(sample) != "", asked))), INTEL.removeprefix("struct<").removesuffix(">").replace(":", " "))
        listed = lambda name, known: F.when(said[name].isin(known), said[name]).otherwise(ruled[name]).alias(name)
        known = F.coalesce(said["doc_type"].isin(DOC_TYPES), F.lit(False))
        return F.struct(
            listed("doc_type", DOC_TYPES), F.when(known, F.coalesce(said["doc_type_confidence"], F.lit(0.5))).otherwise(ruled["doc_type_confidence"]).alias("doc_type_confidence"), listed("domain", DOMAINS),
            F.coalesce(F.filter(said["content_flags"], lambda f: f.isin(FLAGS)), ruled["content_flags"]).alias("content_flags"), F.coalesce(F.nullif(said["summary"], F.lit("")), ruled["summary"]).alias("summary"),
            F.coalesce(F.slice(said["key_dates"], 1, 10), ruled["key_dates"]).alias("key_dates"),
        ).cast(INTEL)

    def answer(self, chunks: Column, sql_value: Column) -> Column:
        said = self.complete(F.concat(F.lit("Answer from these passages only:\n"), F.array_join(chunks, "\n---\n"), F.lit("\nResult of SQL: "), F.coalesce(sql_value, F.lit(""))))
        return F.coalesce(F.nullif(said, F.lit("")), super().answer(chunks, sql_value))
