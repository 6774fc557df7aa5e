"""Text functions on columns. All run inside the JVM; none calls Python per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# --- fixed values: patterns whose matches must equal the expected results -----------------
LINK = r"(?U)http[s]*:\/\/[^\s]+"
LINK_CHARS = r"http[\p{L}\p{N}_:/\.\=\#\?\-\$\&]+"
BRACKETS = r"[\(\)\[\]\{\}]"
CONTROLS = r"[\n\t]"
MENTION = r"@([\p{L}\p{N}_]+)"
TOKEN = r"[\p{L}\p{N}_]{2,}"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
WHITESPACE_RUN = r"[\s\x0b\x1c-\x1f\x85\p{Z}]{2,}"
KEYWORDS = ("gme", "gamestop")
LINK_MARK = "[link]"
TERM_MARK = "<<<<<<<<<<<<<GME>>>>>>>>>>>>>>>"
SEPARATOR = "..."
# --- end of fixed values ------------------------------------------------------------------


def post_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit(" "), body)


def text_length(text: Column) -> Column:
    return F.char_length(text)


def replace_links(text: Column) -> Column:
    return F.regexp_replace(text, LINK, LINK_MARK)


def replace_links_chars(text: Column) -> Column:
    return F.regexp_replace(text, LINK_CHARS, LINK_MARK)


def clean_text(text: Column) -> Column:
    """Line ends and brackets to spaces, lower case, links to a mark."""
    flat = F.regexp_replace(F.regexp_replace(text, "\n", " "), BRACKETS, " ")
    return replace_links_chars(F.lower(flat))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def keyword_pattern(keywords: Sequence[str]) -> str:
    return "(?iu)(?:" + "|".join(keywords) + ")"


def highlight_terms(text: Column, keywords: Sequence[str] = KEYWORDS, mark: str = TERM_MARK) -> Column:
    return F.regexp_replace(text, keyword_pattern(keywords), mark.replace("\\", "\\\\").replace("$", "\\$"))


def matches_query(text: Column, query: str = "|".join(KEYWORDS)) -> Column:
    return text.rlike(f"(?iu)(?:{query})")


def standardize(text: Column, mode: str = "lower_and_strip_punctuation") -> Column:
    if mode not in ("lower", "strip_punctuation", "lower_and_strip_punctuation"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode.startswith("lower"):
        text = F.lower(text)
    if mode.endswith("strip_punctuation"):
        text = F.regexp_replace(text, PUNCTUATION, "")
    return text


def words(text: Column) -> Column:
    """Words between runs of white space; empty text has none."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def tokenize_word(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def extract_mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def _grams(units: Column, n: int, glue: str) -> Column:
    def gram(first: Column, i: Column) -> Column:
        parts = [first]
        for j in range(1, n):
            parts += ([F.lit(glue)] if glue else []) + [F.get(units, i + j)]
        return F.concat(*parts)

    grams = F.transform(F.slice(units, 1, F.size(units) - n + 1), gram)
    return F.when(F.size(units) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """Word n-grams of every length from ``lo`` to ``hi``.

    Pass a column that already holds the tokens, so that they are not computed again per n-gram.
    """
    parts = [tokens if n == 1 else _grams(tokens, n, " ") for n in range(lo, hi + 1)]
    return F.concat(*parts)


def collapse_whitespace(text: Column) -> Column:
    """Lower case, runs of white space as one space (a single line end stays)."""
    return F.regexp_replace(F.lower(text), WHITESPACE_RUN, " ")


def char_ngrams(chars: Column, lo: int, hi: int) -> Column:
    """Character n-grams; pass ``characters(collapse_whitespace(text))`` as a stored column."""
    return F.concat(*[_grams(chars, n, "") for n in range(lo, hi + 1)])


def longest_char_ngrams(chars: Column, lo: int, hi: int) -> Column:
    """The longest n-gram of at most ``hi`` characters at every place that has one of ``lo`` or more."""

    def gram(first: Column, i: Column) -> Column:
        return F.concat(first, *[F.get(chars, i + j) if j < lo else F.coalesce(F.get(chars, i + j), F.lit("")) for j in range(1, hi)])

    grams = F.transform(F.slice(chars, 1, F.size(chars) - lo + 1), gram)
    return F.when(F.size(chars) >= lo, grams).otherwise(F.array().cast("array<string>"))
