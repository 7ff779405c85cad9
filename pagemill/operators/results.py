"""Search results: highlight ranges, snippets and the fixed result row."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import escape_html, fold_text

SNIPPET, CONTEXT = 160, 60
#: The fields of a result; the second line may be null.
FIELDS = ("id", "type", "route", "href", "title", "pageTitle", "excerpt", "snippetHtml",
          "sectionId", "anchor", "description", "component", "snippetText", "matches", "group", "item")


def match_ranges(text: str, terms: list[str]) -> list[list[int]]:
    """Ranges [first, last] of characters whose folded form is a term; touching ranges are one."""
    pieces: list[str] = []
    for c in text or "":
        if pieces and unicodedata.category(c).startswith("M"):
            pieces[-1] += c
        else:
            pieces.append(c)
    folded, starts, at = "", [], 0
    for piece in pieces:
        f = fold_text(piece)
        starts += [(at, at + len(piece) - 1)] * len(f)
        folded += f
        at += len(piece)
    if folded != fold_text(text):
        return []
    found = []
    for term in {fold_text(t) for t in terms if t}:
        i = folded.find(term)
        while i >= 0:
            a, b = starts[i][0], starts[i + len(term) - 1][1]
            if fold_text(text[a : b + 1]) == term:
                found.append([a, b])
            i = folded.find(term, i + 1)
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def snippet(text: str, ranges: list[list[int]], length: int = SNIPPET, context: int = CONTEXT) -> tuple[str, list[list[int]]]:
    """The text around its first match, and the ranges within it."""
    text = text or ""
    if not ranges:
        return (text, []) if len(text) <= length else (text[:length] + "…", [])
    low, high = max(0, ranges[0][0] - context), min(len(text), ranges[0][1] + 1 + context)
    before, after = "…" if low else "", "…" if high < len(text) else ""
    move = len(before) - low
    inside = [[max(a, low) + move, min(b, high - 1) + move] for a, b in ranges if b >= low and a < high]
    return before + text[low:high] + after, inside


def highlight(text: str, ranges: list[list[int]], tag: str = "mark", class_name: str = "") -> str:
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    opening = f'<{tag} class="{esc(class_name)}">' if class_name else f"<{tag}>"
    out, at = [], 0
    for a, b in sorted(ranges or []):
        a, b = max(0, a), min(len(text) - 1, b)
        if a < at or b < a:
            continue
        out += [esc(text[at:a]), opening, esc(text[a : b + 1]), f"</{tag}>"]
        at = b + 1
    return "".join([*out, esc(text[at:])])


def units(text: str, ranges: list[list[int]]) -> tuple[str, list[list[int]]]:
    """A text as UTF-16 units (one character each) and ranges of characters as ranges of units."""
    if all(ord(c) < 0x10000 for c in text):
        return text, ranges
    ends, at, out = [], 0, []
    for c in text:
        two = ord(c) - 0x10000
        out += [c] if two < 0 else [chr(0xD800 + (two >> 10)), chr(0xDC00 + (two & 0x3FF))]
        at = len(out)
        ends.append(at)
    return "".join(out), [[ends[a - 1] if a else 0, ends[b] - 1] for a, b in ranges]


def _joined(text: str) -> str:
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


SHAPED = T.StructType().add("html", T.StringType()).add("text", T.StringType()).add("ranges", T.ArrayType(T.ArrayType(T.IntegerType())))


def shape(text: str, terms: list[str]) -> tuple[str, str, list[list[int]]]:
    """Marked snippet, plain snippet and the match ranges of a text, in UTF-16 units with both ends."""
    whole, ranges = units(text, match_ranges(text, terms))
    part, inside = snippet(whole, ranges)
    return _joined(highlight(part, inside)), _joined(part), ranges


@F.pandas_udf(SHAPED)
def shaped(text: pd.Series, terms: pd.Series) -> pd.DataFrame:
    rows = [shape(t or "", list(x) if x is not None else []) for t, x in zip(text, terms, strict=True)]
    return pd.DataFrame(rows, columns=["html", "text", "ranges"])


def results(hits: DataFrame, entries: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Hits (qid, rank, doc, score) with the sixteen fields; only result rows reach Python.

    ``entries`` has doc and the entry's fields; those it lacks are empty (the first eight) or null.
    """
    have = {c.lower() for c in entries.columns}
    col = lambda c: F.col(c) if c.lower() in have else F.lit(None).cast("string")
    rows = hits.join(entries, "doc").join(query_terms.select("qid", F.col("tokens").alias("terms_")), "qid", "left")
    rows = rows.withColumn("s_", shaped(F.coalesce(col("content"), F.lit("")), F.col("terms_")))
    text = lambda *cs: F.coalesce(*[col(c) for c in cs], F.lit(""))
    href = F.when(F.coalesce(col("anchor"), F.lit("")) != "", F.concat(text("route"), F.lit("#"), col("anchor"))).otherwise(text("route"))
    matches = F.when(F.size("s_.ranges") > 0, F.array(F.struct(F.lit("content").alias("key"), F.col("s_.ranges").alias("indices"))))
    return rows.select(
        "qid", "rank", "doc", "score", text("id").alias("id"), text("type").alias("type"), text("route").alias("route"), href.alias("href"),
        text("title").alias("title"), text("pageTitle", "title").alias("pageTitle"), text("excerpt", "description").alias("excerpt"),
        F.col("s_.html").alias("snippetHtml"), col("sectionId").alias("sectionId"), col("anchor").alias("anchor"), col("description").alias("description"),
        col("component").alias("component"), F.col("s_.text").alias("snippetText"), matches.alias("matches"), col("group").alias("group"), col("item").alias("item"),
    )


__all__ = ["FIELDS", "escape_html", "highlight", "match_ranges", "results", "snippet"]
