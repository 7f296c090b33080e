"""Quotes of any length against all texts, by brute force; what the plan leaves out."""

import random

from docloom.operators.facts import quote_places

WORDS = "the cat sat on a mat élan 日本語 naïve x 😀😀z end.".split()


def _norm(text):
    return " ".join((text or "").lower().split())


def test_quotes_of_any_length(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", " ", "x" * 200_000 + "needle", "Upper  CASE\ttext\nof seven words here now and on"]
    quotes = []
    for _ in range(150):
        t = rng.choice(texts[:60]) or "cat"
        a = rng.randrange(len(t))
        quotes.append(t[a : a + rng.choice([1, 2, 3, 5, 9, 20, 40, 80])])
    quotes += ["needle", "xn", "case TEXT of seven words here no", "ASE text", None, "", "   ", "absent words that nobody wrote in any text", "q", "😀z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = quote_places(docs, asked).collect()
    want = {(i, d) for i, q in enumerate(quotes) if _norm(q) for d, t in enumerate(texts) if _norm(q) in _norm(t)}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 500
    assert quote_places(docs.limit(0), asked).count() == 0 and quote_places(docs, asked.limit(0)).count() == 0


def test_no_nested_loop(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    plan = quote_places(read("documents").select("doc_id", "text"), read("benchmark"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
