"""License scan: an exact set-similarity join between text blocks and notice templates. Built-in functions only.

A block matches a template if it holds at least `threshold` of the template's distinct words. Blocks are the lines of a
text and, for notices wrapped over several lines, each window of its words that is as long as the template allows.
Words stand in one global order, rarest over the whole corpus first. A template of k words of which m are needed must
share one of its first k - m + 1 words with every block that matches (prefix filter); the block needs m template words
(length filter), and enough of them must be left at the places where the two first meet (positional filter).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common
from .lines import let

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label and text of public licence notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Label and words that must stand one after the other.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, the rest as it is. lower() is faster and differs only where a letter outside ASCII becomes one or more
    ASCII characters, which two letters do."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of a text in which A-Z are lower-cased already."""
    return F.filter(F.split(text, _GAPS), lambda w: w != "")


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, words in their order, repeated ones too) of each template that has a word."""
    import re

    out = []
    for label, text in templates:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        if words := [w for w in re.split(_GAPS, lower) if w]:
            out.append((label, words))
    return out


def template_rows(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words in their order) of each template that has a word."""
    return [(i, label, list(dict.fromkeys(words))) for i, (label, words) in enumerate(template_words(templates))]


def window_sizes(templates=TEMPLATES, threshold: str = "0.8") -> list[int]:
    """By template number, how many words a window has: the most of which the template's words can be `threshold`."""
    return [int(len(words) / Fraction(threshold)) for _, words in template_words(templates)]


def word_order(docs: DataFrame, vocabulary: list[str], text_column: str = "text") -> dict[str, tuple[int, str]]:
    """For each word of the templates (so many at most) its document frequency over all of docs, the order's key."""
    known = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(words_of(lower_ascii(F.col(text_column))), known)).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}
    return {w: (counts.get(w, 0), w) for w in vocabulary}


def needed(k: int, threshold: str) -> int:
    """The least whole number of words that is at least threshold * k."""
    x = Fraction(threshold) * k
    return max(1, -(-x.numerator // x.denominator))


def prefix_index(spark: SparkSession, rows, order: dict, threshold: str) -> DataFrame:
    """word, template, label, place, size, need and words of each word in a template's prefix; as many rows as the
    templates have words at most."""
    out = []
    for number, label, words in rows:
        own, need = sorted(words, key=order.__getitem__), needed(len(words), threshold)
        out += [(w, number, label, i, len(own), need, own) for i, w in enumerate(own[: len(own) - need + 1])]
    return spark.createDataFrame(out, "word string, template int, label string, place int, size int, need int, words array<string>")


def matching_blocks(blocks: DataFrame, index: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The join: blocks (key columns and tokens array<string>, the block's distinct template words in the global order)
    with templates: key columns, label, template and containment, one row for each pair that reaches its threshold."""
    keys = [c for c in blocks.columns if c != "tokens"]
    each = blocks.select(*keys, "tokens", F.posexplode("tokens").alias("at", "word"))
    left = F.least(F.col("size") - F.col("place"), F.size("tokens") - F.col("at"))
    pairs = each.join(F.broadcast(index), "word").where((F.size("tokens") >= F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "words"))
    return pairs.where(shared >= F.col("need")).select(*keys, "label", "template", (shared / F.col("size")).alias("containment")).distinct()


def matching_windows(near: DataFrame, index: DataFrame, rare: list[str], windows: list[int]) -> DataFrame:
    """The join for notices that cross line ends: near (key columns and _t, the text) with templates: key columns, label,
    template and containment, that of the best window around a place where text and template first meet.

    Each place of a prefix word carries the words around it as far as the longest window reaches, so the rows are no
    more than the places, and the work for each is bounded by the templates.
    """
    keys, reach = [c for c in near.columns if c != "_t"], max(windows, default=1)

    def places(w: Column) -> Column:
        def around(x: Column, i: Column) -> Column:
            at = F.least(i, F.lit(reach - 1))
            return F.when(x.isin(*rare), F.struct(x.alias("word"), at.alias("at"), F.slice(w, i - at + 1, at + reach).alias("around")))

        return F.filter(F.transform(w, around), lambda x: x.isNotNull())

    each = near.select(*keys, F.explode(let(words_of(F.col("_t")), places)).alias("_p")).select(*keys, "_p.*")
    sizes = index.withColumn("window", F.element_at(F.array(*map(F.lit, windows)), F.col("template") + 1)) if windows else index.withColumn("window", F.lit(1))
    pairs = each.join(F.broadcast(sizes), "word")
    own = F.least("at", F.col("window") - 1)
    pairs = pairs.select(*keys, "label", "template", "size", "need", "words", "place", "window", own.alias("at"), F.slice("around", F.col("at") - own + 1, own + F.col("window")).alias("around"))
    left = F.size(F.array_intersect("around", F.slice("words", F.col("place") + 1, F.col("size") - F.col("place"))))
    shared = F.array_max(F.transform(F.sequence(F.lit(0), "at"), lambda i: F.size(F.array_intersect(F.slice("around", i + 1, F.col("window")), "words"))))
    best = pairs.where(left >= F.col("need")).select(*keys, "label", "template", "size", "need", shared.alias("shared"))
    return best.where(F.col("shared") >= F.col("need")).select(*keys, "label", "template", (F.col("shared") / F.col("size")).alias("containment")).distinct()


def phrase_places(words: Column) -> list[tuple[str, Column]]:
    """For each phrase its label and the places (from 0) where it starts."""
    def starts(phrase: tuple[str, ...]) -> Column:
        def here(w: Column, i: Column) -> Column:
            met = w == phrase[0]
            for k, x in enumerate(phrase[1:], 1):
                met = met & F.coalesce(F.get(words, i + k) == x, F.lit(False))
            return F.when(met, i.cast("long"))

        return F.filter(F.transform(words, here), lambda x: x.isNotNull())

    return [(label, starts(phrase)) for label, phrase in PHRASES]


def scan_licenses(docs: DataFrame, text_column: str = "text", templates=TEMPLATES, threshold: str = "0.8", keep: list[str] | None = None, wrapped: bool = True, salts: int = 64) -> DataFrame:
    """The columns of docs (or those in keep) and license struct: n_words long, places array<long> (starts of phrases, sorted),
    base_labels and labels array<string> (sorted), score double (the largest containment, 0 where no template matches).

    Blocks are lines; with wrapped, windows of words across line ends as well (matching_windows). Rows with equal text are
    answered alike; null and empty texts have no words, no labels and a score of 0; an empty table gives none. An existing
    column called license is replaced. Word frequencies are counted over all rows first; the only thing collected is a
    count for each word of the templates.

    Matches, one row a different text, meet their documents by the text's hashes. Copies of a text with a notice are dealt
    to `salts` tasks, and documents without a prefix word, among them all empty ones, have no key that could meet.
    """
    spark, rows = docs.sparkSession, template_rows(templates)
    vocabulary = sorted({w for _, _, words in rows for w in words})
    order = word_order(docs, vocabulary, text_column)
    ordered = F.array(*(F.lit(w) for w in sorted(vocabulary, key=order.__getitem__)))
    index = prefix_index(spark, rows, order, threshold)
    rare = sorted({w for _, _, words in rows for w in sorted(words, key=order.__getitem__)[: len(words) - needed(len(words), threshold) + 1]})
    names = [c for c in (docs.columns if keep is None else keep) if c != "license"]

    def base(words: Column) -> Column:
        # without the last word of every phrase there is no place to look for
        none = F.array().cast("array<long>")
        places = [(label, F.when(F.array_contains(words, "license"), x).otherwise(none)) for label, x in phrase_places(words)]
        labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(x) > 0, F.lit(label)) for label, x in places)), lambda x: x.isNotNull())))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.array_sort(F.concat(*(x for _, x in places))).alias("places"),
            labels.alias("base_labels"),
            F.arrays_overlap(words, F.array(*map(F.lit, rare))).alias("near"),
        )

    lower = lower_ascii(F.coalesce(F.col(text_column), F.lit("")))
    own = docs.select(F.struct(*names).alias("_row"), F.xxhash64(text_column).alias("_h1"), F.xxhash64(F.reverse(F.col(text_column))).alias("_h2"), let(lower, lambda t: let(words_of(t), base)).alias("_base"))
    # blocks only of texts that hold a word of a prefix at all, one of each different text
    near = docs.select(lower.alias("_t"), F.xxhash64(text_column).alias("_h1"), F.xxhash64(F.reverse(F.col(text_column))).alias("_h2")).where(F.arrays_overlap(words_of(F.col("_t")), F.array(*map(F.lit, rare))))
    blocks = near.select("_h1", "_h2", F.explode(F.split("_t", "\n")).alias("_line")).select("_h1", "_h2", F.array_intersect(ordered, words_of(F.col("_line"))).alias("tokens")).where(F.size("tokens") > 0)
    matches = matching_blocks(blocks.distinct(), index, vocabulary)
    if wrapped:
        # a window within a line has no more of a template than the line
        matches = matches.unionByName(matching_windows(near.where(F.contains("_t", F.lit("\n"))), index, rare, window_sizes(templates, threshold)))
    found = matches.groupBy("_h1", "_h2").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_score"))
    told = F.xxhash64(F.lit(0), *(F.col("_row").getField(c) for c, kind in docs.dtypes if c in names and "map<" not in kind and "variant" not in kind))
    salt = F.pmod(told, F.lit(salts)).cast("int")
    # what has no rare word meets nothing: it is dealt by its own hash
    apart = F.when(F.col("_base.near"), F.col("_h1")).otherwise(told)
    own = own.select("_row", "_base", apart.alias("_h1"), F.when(F.col("_base.near"), F.col("_h2")).alias("_h2"), salt.alias("_salt"))
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = own.join(found, ["_h1", "_h2", "_salt"], "left")
    labels = F.array_sort(F.array_union("_base.base_labels", F.coalesce("_labels", F.array().cast("array<string>"))))
    return joined.select("_row.*", F.struct("_base.n_words", "_base.places", "_base.base_labels", labels.alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score")).alias("license"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """scan_licenses of all documents; a row for each, nulls as there."""
    found = scan_licenses(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    places = F.col("license.places")
    return found.select(
        "doc_id", "license.n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join("license.base_labels", ",").alias("base_labels"), F.array_join("license.labels", ",").alias("labels"), "license.score",
    )


def _sql() -> str:
    gaps = _GAPS
    lists = ", ".join(f"({n}, '{label}', [{', '.join(repr(w) for w in words)}], {needed(len(words), '0.8')})" for n, label, words in template_rows())
    marks = " OR ".join("(" + " AND ".join(f"lead(w, {k}) OVER o = '{x}'" if k else f"w = '{x}'" for k, x in enumerate(p)) + ")" for _, p in PHRASES)
    label = " ".join("WHEN " + " AND ".join(f"lead(w, {k}) OVER o = '{x}'" if k else f"w = '{x}'" for k, x in enumerate(p)) + f" THEN '{name}'" for name, p in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '{gaps}'), lambda x: x <> '') AS ws FROM d),
e AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
p AS (SELECT rid, i, CASE {label} END AS label, {marks} AS hit FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
b AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS ls FROM p WHERE hit GROUP BY rid),
t(no, label, words, need) AS (VALUES {lists}),
l AS (SELECT rid, string_split_regex(unnest(string_split(t, chr(10))), '{gaps}') AS lw FROM d),
m AS (SELECT rid, label, len(list_intersect(lw, words)) / len(words) AS c FROM l, t WHERE len(list_intersect(lw, words)) >= need),
s AS (SELECT rid, list(DISTINCT label) AS ls, max(c) AS score FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.ls, s.ls))), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM d JOIN w USING (rid) LEFT JOIN b USING (rid) LEFT JOIN s USING (rid)
"""


SQL = _sql()
