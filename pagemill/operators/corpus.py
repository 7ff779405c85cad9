"""Page markdown and the line-addressed corpus, from section blocks.

Blocks have site_id, route, path (array<int>, declared order), anchor and markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WIDE_SPACE, trim_wide
from . import richtext as T
from . import selectors as S

PAGE = ("site_id", "route")


def visible(sections: DataFrame, excluded_components: list[str] = ()) -> DataFrame:
    """Sections without hidden or excluded ones and all that is below them; anchors of their top-level sections."""
    key = [*PAGE]
    bad = F.coalesce(F.col("hidden"), F.lit(False)) | F.coalesce(F.col("component").isin(list(excluded_components)), F.lit(False))
    gone = sections.where(bad).select(*key, F.col("path").alias("up")).distinct()
    ups = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i)))
    under = sections.select(*key, "path", ups.alias("up")).join(gone, [*key, "up"], "left_semi").select(*key, "path").distinct()
    tops = sections.where(F.size("path") == 1).select(*key, F.col("path").alias("top"), F.col("anchor").alias("top_anchor"))
    out = sections.join(under, [*key, "path"], "left_anti").withColumn("top", F.slice("path", 1, 1))
    return out.join(tops, [*key, "top"], "left").withColumn("anchor", F.coalesce("top_anchor", "anchor")).drop("top", "top_anchor")


def blocks(sections: DataFrame) -> DataFrame:
    """Trimmed, non-empty blocks."""
    return sections.withColumn("markdown", trim_wide(F.col("markdown"))).where("markdown <> ''")


def page_markdown(sections: DataFrame) -> DataFrame:
    """site_id, route and the page's markdown: its blocks in order, a blank line between them."""
    rows = F.sort_array(F.collect_list(F.struct("path", "markdown")))
    return blocks(sections).groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda x: x["markdown"]), "\n\n").alias("markdown"))


def n_lines(markdown: Column) -> Column:
    return F.size(F.split(markdown, "\n")).cast("long")


def leading_heading(markdown: Column) -> Column:
    found = F.regexp_extract(F.split_part(markdown, F.lit("\n"), F.lit(1)), r"^ {0,3}#{1,6}\s+(.*?)\s*#*\s*$", 1)
    return F.nullif(found, F.lit(""))


def segments(sections: DataFrame) -> DataFrame:
    """Blocks with start_line, end_line and title; a blank line lies between two of them."""
    before = Window.partitionBy(*PAGE).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks(sections).withColumn("lines", n_lines(F.col("markdown")))
    out = out.withColumn("start_line", 1 + F.coalesce(F.sum(F.col("lines") + 1).over(before), F.lit(0)))
    return out.select(*PAGE, "path", "anchor", "start_line", (F.col("start_line") + F.col("lines") - 1).alias("end_line"), leading_heading(F.col("markdown")).alias("title"), "markdown")


def manifest(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages that have text, with their number of lines and segments, without the text."""
    per = segments(sections).groupBy(*PAGE).agg(F.max("end_line").alias("lines"), F.count("*").alias("segments"))
    return pages.join(per, list(PAGE))


def build_corpus(pages: DataFrame, sections: DataFrame, exclude: list[str] = (), knowledge: bool = False) -> DataFrame:
    """Pages of the corpus that have text: site_id, ord, route, title, description, knowledge, markdown, lines, segments in their order.

    A page's markdown and its segments are one row. ``sections`` are visible ones.
    """
    chosen = S.select_corpus(pages, exclude, knowledge).withColumn("is_knowledge", F.lit(False))
    if knowledge:
        flag = S.partition_knowledge(pages).select("site_id", "route", "ord", "is_knowledge")
        chosen = chosen.drop("is_knowledge").join(flag, ["site_id", "route", "ord"])
    one = F.struct("path", "anchor", "start_line", "end_line", "title", "markdown")
    held = segments(sections).groupBy(*PAGE).agg(F.max("end_line").alias("lines"), F.sort_array(F.collect_list(one)).alias("segments"))
    held = held.withColumn("markdown", F.array_join(F.transform("segments", lambda x: x["markdown"]), "\n\n"))
    return chosen.join(held, list(PAGE)).select("site_id", "ord", "route", "title", "description", F.col("is_knowledge").alias("knowledge"), "markdown", "lines", "segments")


def corpus_manifest(corpus: DataFrame) -> DataFrame:
    """A corpus without its texts."""
    listed = F.transform("segments", lambda x: F.struct(x["anchor"].alias("anchor"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["title"].alias("title")))
    return corpus.select("site_id", "ord", "route", "title", "description", "knowledge", "lines", listed.alias("segments"))


def with_shown_records(sections: DataFrame, shown: DataFrame, record: DataFrame | None = None) -> DataFrame:
    """Page markdown with what sections show: after a section its values, in their order.

    ``shown``: site_id, route, dom_id (a section's anchor), pos, name, value (JSON text). Of sections
    with one id the first shows them. ``record``: site_id, route, value of pages that are a record's.
    """
    own = blocks(sections).select(*PAGE, "path", F.lit(0).alias("slot"), F.lit(0).cast("long").alias("pos"), "markdown")
    first = sections.groupBy(*PAGE, F.coalesce("dom_id", "anchor").alias("dom_id")).agg(F.min("path").alias("path"))
    rows = shown.where("value is not null and value <> 'null'").join(first, [*PAGE, "dom_id"])
    nth = F.row_number().over(Window.partitionBy(*PAGE, "name", "value").orderBy("path", "pos"))
    rows = rows.withColumn("again", nth > 1).select(*PAGE, "path", F.lit(1).alias("slot"), F.col("pos").cast("long").alias("pos"), T.shown_markdown_udf("name", "value", "again").alias("markdown"))
    every = own.unionByName(rows)
    if record is not None:
        last = record.select(*PAGE, F.lit(None).cast("array<int>").alias("path"), F.lit(2).alias("slot"), F.lit(0).cast("long").alias("pos"), T.record_markdown_udf("value").alias("markdown"))
        every = every.unionByName(last)
    rows = F.sort_array(F.collect_list(F.struct((F.col("slot") == 2).alias("end"), "path", "slot", "pos", "markdown")))
    return every.where("markdown <> ''").groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda x: x["markdown"]), "\n\n").alias("markdown"))


def shown_labels(shown: DataFrame) -> DataFrame:
    """Values shown by sections (site_id, route, pos, name, value): comment label, and whether an equal one came before."""
    r = F.row_number().over(Window.partitionBy(*PAGE, "name", "value").orderBy("pos"))
    safe = F.replace(F.col("name"), F.lit("--"), F.lit("-"))
    return shown.withColumn("again", r > 1).withColumn(
        "label", F.concat(F.lit("<!-- "), safe, F.when(F.col("again"), F.lit(": as above")).otherwise(F.lit("")), F.lit(" -->"))
    )


def fence(body: Column) -> Column:
    """A code fence longer than any run of backticks within."""
    runs = F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), 1 + F.coalesce(F.array_max(runs), F.lit(0))))


def description(own: Column, social: Column, sections_summary: Column) -> Column:
    """A page's own description, else its social one, else its sections' first summary."""
    some = lambda c: F.nullif(trim_wide(c), F.lit(""))
    return F.coalesce(some(own), some(social), some(sections_summary))


def blockquote(text: Column) -> Column:
    lines = F.transform(F.split(trim_wide(text), "\n"), lambda x: F.regexp_replace(F.concat(F.lit("> "), x), f"{WIDE_SPACE}+$", ""))
    return F.array_join(lines, "\n")
