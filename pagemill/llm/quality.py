"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a boolean expression over the text that says "reject". On a sample each rule is
timed and its rejections are counted; rules then run in the order of rejections per second, and
a text stops at the first rule that rejects it (``CASE`` evaluates lazily). The order changes the
work, never the verdict.

Defined results: null or blank text has no words and is rejected by ``few_words``; ties and
repeated rows get equal verdicts; an empty table gives an empty table; very long texts are measured
whole, in one row; other columns pass through,
and a clash with a measure's name raises ``ValueError``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, n_words, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DUP_LINE_PERCENT = 40
#: Symbols per hundred words; characters per word.
MAX_SYMBOL_PERCENT = 10
WORD_LENGTH = (2, 14)
#: Rows on which costs and selectivities are estimated. They set the order of rules only.
SAMPLE_ROWS = 2000


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    """Lines that hold a word, as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again, from the hashes in order: linear but for one sort."""

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        at = F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])), x["i"]
            ),
        )
        return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

    def gaps(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, repeated), gaps)


def n_repeat_words(text: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text.

    Windows are compared by 64-bit hashes within one text.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.when(n > WINDOW, some).otherwise(F.lit(0))

    return let(words(text), of).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": n_lines,
}


@dataclass(frozen=True)
class Rule:
    """``fails(m)`` is true where the rule rejects; ``m(name)`` gives a measure, ``m("text")`` the text."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_passages", lambda m: 100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > MAX_SYMBOL_PERCENT * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > MAX_DUP_LINE_PERCENT * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < WORD_LENGTH[0] * m("n_words")) | (m("word_chars") > WORD_LENGTH[1] * m("n_words"))),
    Rule("no_lower_case", lambda m: ~m("text").rlike(r"\p{Ll}") & m("text").rlike(r"\p{Lu}")),
)


def _from_text(text: Column) -> Callable[[str], Column]:
    return lambda name: F.coalesce(text, F.lit("")) if name == "text" else MEASURES[name](text)


def cascade_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per second on a random sample of about ``sample_rows`` texts of all partitions, with both figures."""
    texts = df.select(F.col(text).alias("text"))
    part = min(1.0, sample_rows / max(1, df.select(F.lit(1)).count()))
    sample = texts.sample(part, seed=1).persist()
    try:
        rows = max(1, sample.count())

        def timed(fails: Column) -> tuple[float, float]:
            began = time.perf_counter()
            hit = sample.agg(F.count_if(fails).alias("n")).first()["n"]
            return time.perf_counter() - began, hit / rows

        measure = _from_text(F.col("text"))
        timed(F.col("text").isNull())
        idle = min(timed(F.col("text").isNull())[0] for _ in range(2))
        found = []
        for rule in rules:
            runs = [timed(rule.fails(measure)) for _ in range(2)]
            found.append((rule, max(min(t for t, _ in runs) - idle, 1e-4), runs[0][1]))
    finally:
        sample.unpersist()
    return by_rejections_per_cost(found)


def by_rejections_per_cost(found: list[tuple[Rule, float, float]]) -> list[tuple[Rule, float, float]]:
    """Rules with their cost and the part they reject; of equal ones the cheaper first."""
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def _verdict(order: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated."""
    first, *rest = order
    out = F.when(first.fails(measure), F.lit(first.name))
    for rule in rest:
        out = out.when(rule.fails(measure), F.lit(rule.name))
    return out


def rejected_by(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Column:
    """The cascade over a text column: the rule that rejects, or null for a text to keep."""
    order = [rule for rule, _, _ in cascade_order(df, text, rules, sample_rows)]
    return _verdict(order, _from_text(F.col(text)))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows whose text passes every rule, with their columns."""
    return df.where(rejected_by(df, text, rules, sample_rows).isNull())


def report(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with all measures, ``base_failed`` and the cascade's ``kept``."""
    added = [*MEASURES, "base_failed", "kept"]
    if clash := {c.lower() for c in df.columns} & set(added):
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    order = [rule for rule, _, _ in cascade_order(df, text, rules, sample_rows)]
    whole = F.col(text)
    out = df.withColumns({name: of(whole) for name, of in MEASURES.items()})
    verdict = _verdict(order, lambda name: F.coalesce(whole, F.lit("")) if name == "text" else F.col(name))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & verdict.isNull())
