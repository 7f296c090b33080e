"""Text expressions: tokens, estimates, normalisation, quotes, fences, number words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import DEFAULT

SPACES = r"(?U)\s+"
#: The same set of characters for RE2.
SPACES_SQL = r"[\s\x0B\x85\p{Z}]+"
#: Words for numbers and their digits.
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}


def tokens(text: Column) -> Column:
    """Words between runs of Unicode white space; of null the empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: t != "")


def estimate(words: Column) -> Column:
    """Estimated tokens of a number of words: at least 1, rounded down."""
    return F.greatest(F.lit(1), F.floor(words * F.lit(DEFAULT.tokens_per_word))).cast("long")


def estimated_tokens(text: Column) -> Column:
    return estimate(F.size(tokens(text)))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether a text has a quote, whatever the case and white space; an empty quote is nowhere."""
    q = normalised(quote)
    return F.coalesce((q != "") & F.contains(normalised(text), q), F.lit(False))


def without_fence(text: Column) -> Column:
    """A text without a leading and a trailing code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def cut(text: Column, most: int, mark: str = "\n… (truncated)") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def with_digits(text: Column) -> Column:
    """Lower-cased text in which each number word, also within a longer word, is followed by its digits."""
    out = F.lower(text)
    for word, digit in NUMBER_WORDS.items():
        out = F.replace(out, F.lit(word), F.lit(f"{word} {digit}"))
    return out


def keyword_grade(answer: Column, keywords: Column) -> tuple[Column, Column]:
    """(all keywords are in the answer, those that are not); numbers count as words or digits."""
    text = with_digits(answer)
    missing = F.filter(keywords, lambda k: ~(F.contains(text, F.lower(k)) | F.contains(F.lower(answer), F.lower(k))))
    return F.size(missing) == 0, missing


def confidence_tier(score: Column, high: float = 0.70, medium: float = 0.45) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


#: Frequent words by which a text's language is told.
STOPWORDS = {
    "de": ["der", "die", "und", "das", "nicht", "ist", "ein", "eine", "mit", "von"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was"],
    "es": ["el", "la", "de", "que", "los", "las", "por", "con", "una", "para"],
    "fr": ["le", "la", "les", "des", "est", "dans", "une", "pour", "que", "avec"],
}


def language(text: Column, least: int = 50, most: int = 8192) -> Column:
    """The language with the most of its frequent words in a text's beginning, the first by name of equal ones; unknown for short texts and without any."""
    head = F.trim(F.substring(text, 1, most))
    known = sorted({w for words in STOPWORDS.values() for w in words})
    # a lambda's argument is computed once; as an expression the words would be made anew for each language
    own = F.filter(F.split(F.lower(F.regexp_replace(head, r"[^\p{L}]+", " ")), " "), lambda w: w.isin(known))
    count = lambda o, words: F.size(F.filter(o, lambda w: w.isin(words)))
    hits = lambda o: F.array(*[F.struct(count(o, words).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(STOPWORDS.items())])
    told = lambda b: F.when(b["n"] > 0, b["name"]).otherwise("unknown")
    best = F.get(F.transform(F.transform(F.array(own), lambda o: F.array_max(hits(o))), told), F.lit(0))
    return F.when(F.length(head) > least, best).otherwise("unknown")
