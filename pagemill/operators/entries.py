"""Search entries of pages and their sections.

Pages are as in ``selectors``, with keywords (array) if there are such. Sections have site_id,
route, path (array<int>), hidden, component, section_id, anchor, param_title and doc (JSON text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import corpus as C
from . import richtext as T
from . import selectors as S

FIELDS = ("site_id", "ord", "path", "id", "type", "route", "sectionId", "anchor", "component", "title", "pageTitle", "content", "excerpt", "description", "keywords", "weight")


def _shaped(df: DataFrame, **columns) -> DataFrame:
    none = {"path": F.array().cast("array<int>"), "keywords": F.lit(None).cast("array<string>"), "weight": F.lit(0.6), "ord": F.lit(None).cast("long")}
    return df.select(*[columns.get(c, none.get(c, F.lit(None).cast("string"))).alias(c) for c in FIELDS])


def of_pages(pages: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """An entry for each searchable page with a title or a description."""
    p = S.select_searchable(pages, exclude)
    title, about = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    keywords = F.col("keywords") if "keywords" in pages.columns else F.array().cast("array<string>")
    route = F.coalesce("route", F.lit("/"))
    return _shaped(
        p.where((title != "") | (about != "")), site_id=F.col("site_id"), ord=F.col("ord"), id=F.concat(F.lit("page:"), route), type=F.lit("page"), route=route, title=title,
        description=about, keywords=F.coalesce(keywords, F.array().cast("array<string>")), content=F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(about, F.lit(""))),
        weight=F.when(route == "/", F.lit(1.0)).otherwise(F.lit(0.8)),
    )


def of_sections(pages: DataFrame, sections: DataFrame, exclude: list[str] = (), excluded_components: list[str] = ()) -> DataFrame:
    """An entry for each shown section of a searchable page that has a title or text; an excluded or hidden one goes with what is below it."""
    p = S.select_searchable(pages, exclude).select("site_id", "route", "ord", F.col("title").alias("page_title"))
    s = C.visible(sections, excluded_components).withColumn("got", T.extract_udf("doc")).join(p, ["site_id", "route"])
    title = F.coalesce(F.nullif("got.title", F.lit("")), F.nullif("param_title", F.lit("")), F.lit(""))
    s = s.withColumns({"entry_title": title, "words": X.trim_wide(F.array_join("got.parts", " "))}).where("entry_title <> '' or words <> ''")
    name = F.coalesce("section_id", F.lit("unknown"))
    return _shaped(
        s, site_id=F.col("site_id"), ord=F.col("ord"), path=F.col("path"), id=F.concat(F.lit("section:"), "route", F.lit(":"), name), type=F.lit("section"), route=F.col("route"),
        sectionId=name, anchor=F.col("anchor"), component=F.coalesce("component", F.lit("unknown")), title=F.col("entry_title"), pageTitle=F.coalesce("page_title", F.lit("")),
        content=F.col("words"), excerpt=X.excerpt(F.col("words")),
    )


def extract(pages: DataFrame, sections: DataFrame, exclude: list[str] = (), excluded_components: list[str] = (), with_pages: bool = True, with_sections: bool = True) -> DataFrame:
    """Entries of pages and of their sections, by ``ord`` and ``path`` in their order."""
    kinds = [of_pages(pages, exclude)] * with_pages + [of_sections(pages, sections, exclude, excluded_components)] * with_sections
    return kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])


def envelope(entries: DataFrame, locale: str) -> DataFrame:
    """What an index of a site says about itself: site_id, version, locale, count."""
    return entries.groupBy("site_id").agg(F.count("*").alias("count")).select("site_id", F.lit("1.0").alias("version"), F.lit(locale).alias("locale"), "count")


def write(entries: DataFrame, path: str) -> None:
    """Entries by site, in their order within files."""
    entries.repartition("site_id").sortWithinPartitions("site_id", "ord", "path").write.mode("overwrite").partitionBy("site_id").json(path)
