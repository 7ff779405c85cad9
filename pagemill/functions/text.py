"""Folding and tokenising of text for search.

Lengths and offsets count code points. White space is the wide class of the web platform.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space incl. no-break and ideographic spaces, line separators and the byte-order mark.
WIDE_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_'’-]*"
#: Scripts that are written without spaces.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def fold_text(text: str | None) -> str:
    """Compatibility forms unified, accents dropped, lower case."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    apart = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    bare = "".join(c for c in apart if not unicodedata.category(c).startswith("M"))
    return unicodedata.normalize("NFC", bare).lower()


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text)


def trim_wide(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WIDE_SPACE}+|{WIDE_SPACE}+$", "")


def one_line(text: Column) -> Column:
    return trim_wide(F.regexp_replace(text, f"{WIDE_SPACE}+", " "))


def _counts(term: Column) -> Column:
    return (F.length(term) >= 2) | term.rlike(r"\p{N}")


def terms(folded: Column) -> Column:
    """The terms of a folded text, in order, with repetitions.

    Words of two characters or more (one, if it is a number); spans of a script without spaces
    give overlapping pairs of characters.
    """
    found = F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(WORD), F.lit(0))
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    of_span = lambda s: (
        F.when(~s.rlike(f"[{UNSPACED}]"), F.when(_counts(s), F.array(s)).otherwise(F.array().cast("array<string>")))
        .when(F.length(s) == 1, F.array(s)).otherwise(pairs(s))
    )
    spans = lambda w: F.regexp_extract_all(w, F.lit(f"[{UNSPACED}]+|[^{UNSPACED}]+"), F.lit(0))
    mixed = F.flatten(F.transform(found, lambda w: F.flatten(F.transform(spans(w), of_span))))
    return F.when(folded.rlike(f"[{UNSPACED}]"), mixed).otherwise(F.filter(found, _counts))


def excerpt(text: Column, limit: int = 160) -> Column:
    """One line of at most ``limit`` characters; cut at a space if that keeps half of it."""
    line = one_line(text)
    head = F.substring(line, 1, limit + 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(head, " ") > 0) & (space >= limit // 2), space).otherwise(F.lit(limit))
    cut = F.concat(trim_wide(F.substring(line, F.lit(1), at)), F.lit("…"))
    return F.when(F.length(line) <= limit, line).otherwise(cut)


def record_excerpt(text: Column, limit: int = 160) -> Column:
    line = one_line(text)
    cut = F.concat(F.regexp_replace(F.substring(line, 1, limit), rf"({WIDE_SPACE}|[.…])+$", ""), F.lit("…"))
    return F.when(F.length(line) <= limit, line).otherwise(cut)


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & swapped)


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
