"""Text: slugs, titles, topic labels, numbers, search terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Words that topic labels lose.
STOPWORDS = ("and", "the", "a", "an", "of", "for", "with", "your")

#: Canonical tags and the phrases that mean them.
TOPIC_PHRASES = {
    "machine-learning": ("ml", "machine learning", "artificial intelligence", "ai", "deep learning", "neural networks"),
    "self-hosting": ("self hosted", "selfhosted", "self hosting"),
    "devops": ("devops", "ci cd", "continuous integration"),
    "javascript": ("js", "javascript", "typescript", "nodejs", "node js"),
    "python": ("py", "python"),
    "frontend": ("front end", "frontend", "user interface", "ui"),
    "backend": ("back end", "backend", "server side"),
    "databases": ("database", "databases", "db"),
    "security": ("security", "infosec", "cybersecurity"),
    "cloud": ("cloud computing", "cloud"),
    "containers": ("containers", "docker", "kubernetes", "k8s"),
    "data-science": ("data science", "data analysis"),
    "photos": ("photo gallery", "photography", "photos", "images"),
}


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding, which lower() isn't: ß becomes ss. For keys whose order or equality must agree with it."""
    return text.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def normalize_title(text: pd.Series) -> pd.Series:
    """Case folded, runs of white space as one space, none at the ends; null as an empty title."""
    return text.map(lambda x: " ".join((x or "").casefold().split()))


def fast_title(text: Column) -> Column:
    """normalize_title for titles in which case folding and lower() agree: JVM only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    """Heading anchor: lower case, word characters, hyphens and spaces only, spaces as hyphens."""
    return F.replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\- ]", ""), F.lit(" "), F.lit("-"))


def topic_phrase(label: Column) -> Column:
    """A topic label as its words without stop words, joined by spaces; empty if none is left. Null gives an empty one."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[/_]+", " "), "[^a-z0-9 ]+", " ")
    return F.array_join(F.filter(F.split(text, " +"), lambda w: (w != "") & ~w.isin(*STOPWORDS)), " ")


def normalize_topic(label: Column, overrides: Column | None = None) -> Column:
    """Canonical tag of a label: a known phrase's tag, else the overrides' (a map from phrase to tag), else the words
    joined by hyphens; empty for labels without words."""
    phrase = topic_phrase(label)
    known = F.create_map(*(F.lit(x) for tag, phrases in TOPIC_PHRASES.items() for p in phrases for x in (p, tag)))
    found = [F.try_element_at(known, phrase)] + ([] if overrides is None else [F.try_element_at(overrides, phrase)])
    return F.coalesce(*found, F.replace(phrase, F.lit(" "), F.lit("-")))


def distinct_topics(labels: Column, limit: int = 6, overrides: Column | None = None) -> Column:
    """The first `limit` different tags of an array of labels, in their order."""
    tags = F.transform(labels, lambda x: normalize_topic(x, overrides))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, limit)


def terms_of(query: str, longest: int = 200) -> list[str]:
    """Search terms, bound on the driver: a query is a parameter, not data."""
    return query[:longest].casefold().split()


def all_terms_in(text: Column, terms: list[str]) -> Column:
    """Every term occurs in the text, as a substring. No terms: true."""
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(text, F.lit(t))
    return out


def number(value: Column) -> Column:
    """With thousands separators; Unknown for null."""
    return F.coalesce(F.format_number(value, 0), F.lit("Unknown"))
