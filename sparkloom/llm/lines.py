"""Line-first cleaning: rules for punctuation, navigation and boilerplate are evaluated per line, failing lines go, and a
document goes if it loses too much of its text. Built-in functions only, and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import common

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
_MARKS = "#*$%&|<>!{}"
#: Phrases of page furniture in English, German, French and Spanish, matched in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password", "log in to", "lorem ipsum",
    "powered by", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use", "use cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "jetzt anmelden", "nach oben", "newsletter abonnieren", "nutzungsbedingungen", "passwort vergessen", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "cliquez ici", "haut de page", "lire la suite", "mentions légales", "mot de passe oublié", "politique de confidentialité", "se connecter", "tous droits réservés",
    "aceptar cookies", "aviso legal", "haga clic aquí", "iniciar sesión", "ir al contenido", "leer más", "política de privacidad", "suscríbete", "términos de uso", "todos los derechos reservados",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often and in however many lambdas body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of `width` words found twice or more, the first included.

    Windows become 64-bit hashes with their places and are sorted; neighbours with equal hashes are repeated windows,
    and the words that they cover are counted in the order of their places: no step is quadratic in the length.
    """

    def grams(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))).alias("h"), i.alias("at")))
        return F.sort_array(F.slice(each, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))))

    def repeated(g: Column) -> Column:
        found = F.filter(g, lambda x, i: F.coalesce(x["h"] == F.get(g, i + 1)["h"], F.lit(False)) | F.coalesce((i > 0) & (x["h"] == F.get(g, F.greatest(i - 1, F.lit(0)))["h"]), F.lit(False)))
        return F.sort_array(F.transform(found, lambda x: x["at"]))

    def covered(places: Column) -> Column:
        own = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) > width, let(grams(words), lambda g: let(repeated(g), covered))).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, furniture: Column) -> Column:
    """Whether a line breaks a rule. furniture: whether its document has a boilerplate phrase at all.

    Punctuation: over a tenth of the characters are marks, or fewer than four words end without a closing mark.
    Navigation: three or more bars or arrows. Boilerplate: a phrase of BOILERPLATE.
    """
    return (
        (count_of(line, _MARKS) * 10 > F.length(line))
        | (count_of(line, "|>»•·") >= 3)
        | ~line.rlike(rf"{_WORD}{_SPACE}+{_WORD}+{_SPACE}+{_WORD}+{_SPACE}+{_WORD}|[.!?:;]{_SPACE}*$")
        | (furniture & F.lower(line).rlike("|".join(BOILERPLATE)))
    )


def clean_lines(docs: DataFrame, text_column: str = "text", max_lost: float = 0.5) -> DataFrame:
    """The columns of docs and rules struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_failed_lines, chars, lost_chars (long), base_failed, kept (boolean), clean_text string (the lines that fail no
    rule).

    chars and lost_chars count the lines with a word; a document is kept if neither the base rules fail nor more than
    max_lost of them is lost. Null and empty texts have no words, so the base rules fail them; their clean_text is
    empty. An existing column called rules is replaced; repeated rows are each answered.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(F.col("_lower"), F.lit(phrase))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column, has_phrase: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, l: a + F.length(l))
        return let(
            F.filter(lines, lambda l: ~line_fails(l, has_phrase)),
            lambda good: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(good)).cast("long").alias("n_failed_lines"),
                total(lines).alias("chars"),
                (total(lines) - total(good)).alias("lost_chars"),
                F.array_join(good, "\n").alias("clean_text"),
            ),
        )

    names = [c for c in docs.columns if c != "rules"]
    rows = docs.select(F.struct(*names).alias("_row"), text.alias("_text"))
    rows = rows.select("_row", "_text", F.lower("_text").alias("_lower"))
    rows = rows.select(
        "_row",
        let(words_of(F.col("_text")), of_words).alias("w"),
        count_of(F.col("_text"), _SYMBOLS).alias("n_symbols"),
        # the flag is bound outside the lambda over lines: inlined there, it would search the whole text once a line
        let(furniture, lambda has: let(F.filter(F.split("_text", "\n"), lambda l: l.rlike(_WORD)), lambda x: of_lines(x, has))).alias("l"),
    )
    failed = (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    kept = ~failed & (F.col("l.lost_chars") <= max_lost * F.col("l.chars"))
    rules = F.struct("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "l.n_failed_lines", "l.chars", "l.lost_chars", failed.alias("base_failed"), kept.alias("kept"), "l.clean_text")
    return rows.select("_row.*", rules.alias("rules"))


def op1_line_rules(spark, sf_dir: str) -> DataFrame:
    """clean_lines of all documents; a row for each, nulls as there."""
    done = clean_lines(common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")))


def _sql() -> str:
    has = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}')),
f AS (SELECT rid, l, length(l) AS n,
        (length(l) - length(translate(l, '{_MARKS}', ''))) * 10 > length(l)
        OR length(l) - length(translate(l, '|>»•·', '')) >= 3
        OR NOT regexp_matches(l, '{word}{space}+{word}+{space}+{word}+{space}+{word}|[.!?:;]{space}*$')
        OR {has} AS bad FROM l),
s AS (SELECT rid, count(*) - count(DISTINCT l) AS dups, count(*) FILTER (bad) AS n_bad, sum(n) AS chars, coalesce(sum(n) FILTER (bad), 0) AS lost FROM f GROUP BY rid),
t AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{_SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_bad, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(chars, 0) AS chars
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN s USING (rid)),
u AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * lost_chars <= chars AS kept, n_failed_lines, lost_chars FROM u
"""


SQL = _sql()
