"""Which pages each audience sees: DataFrames of pages to DataFrames of pages.

Pages have site_id, ord, route, title, label, description, hidden, noindex, has_content,
is_dynamic, knowledge. "At or under a branch" is an equi-join on exploded ancestors, never a
prefix comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes as R


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def at_or_under(pages: DataFrame, branches: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of pages with branches (site_id, route) that hold them."""
    held = pages.select("site_id", "route", F.explode(R.ancestors(F.col("route"))).alias("up"))
    held = held.join(branches.select("site_id", F.col("route").alias("up")).distinct(), ["site_id", "up"], "left_semi")
    return pages.join(held.select("site_id", "route").distinct(), ["site_id", "route"], how)


def closed_folders(pages: DataFrame) -> DataFrame:
    return pages.where(R.is_container(F.col("has_content")) & (_yes("noindex") | _yes("hidden"))).select("site_id", "route")


def knowledge_roots(pages: DataFrame) -> DataFrame:
    return pages.where(_yes("knowledge") & F.col("route").isNotNull()).select("site_id", "route")


def exclusions(pages: DataFrame, exclude: list[str]) -> DataFrame:
    given = pages.select("site_id").distinct().select("site_id", F.explode(R.normalize_exclude(F.array(*[F.lit(x) for x in exclude]).cast("array<string>"))).alias("route"))
    return given


def excluded_branches(pages: DataFrame, exclude: list[str] = ()) -> DataFrame:
    return exclusions(pages, list(exclude)).unionByName(closed_folders(pages)).unionByName(knowledge_roots(pages)).distinct()


def own_rules() -> Column:
    """What a page's own fields say about its being indexed."""
    return (
        F.col("route").isNotNull() & (F.col("route") != "") & (F.col("route") != R.NOT_FOUND_ROUTE)
        & ~R.is_dynamic(F.col("route"), F.col("is_dynamic")) & ~_yes("noindex") & ~_yes("hidden") & ~R.has_draft_segment(F.col("route"))
    )


def indexable(pages: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Containers included."""
    return at_or_under(pages.where(own_rules()), excluded_branches(pages, exclude), "left_anti")


def select_indexable(pages: DataFrame, exclude: list[str] = (), branch: str | None = None) -> DataFrame:
    out = indexable(pages, exclude).where(~R.is_container(F.col("has_content")))
    if branch is not None:
        out = out.where(F.array_contains(R.ancestors(F.col("route")), branch))
    return out


def select_searchable(pages: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """As indexable pages, but pages of version folders may be ``noindex``."""
    return select_indexable(pages.withColumn("noindex", _yes("noindex") & ~R.in_version_folder(F.col("route"))), exclude)


def markdown_rule(pages: DataFrame, exclude: list[str] = (), markdown: bool = True) -> DataFrame:
    """site_id, route, ord, and whether the page's own markdown is public (``page``), and that of a record at its route (``record``)."""
    bare = pages.select("site_id", "route", "ord")
    if not markdown:
        return bare.withColumns({"page": F.lit(False), "record": F.lit(False)})
    public = select_indexable(pages, exclude).select("site_id", "route", "ord", F.lit(True).alias("page"))
    open_ = at_or_under(pages, excluded_branches(pages, list(exclude)), "left_anti").where(
        (F.col("route") != "") & (F.col("route") != R.NOT_FOUND_ROUTE) & ~R.is_dynamic(F.col("route"), F.lit(False)) & ~R.has_draft_segment(F.col("route"))
    ).select("site_id", "route", "ord", F.lit(True).alias("record"))
    out = bare.join(public, ["site_id", "route", "ord"], "left").join(open_, ["site_id", "route", "ord"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("page", "record")})


def partition_knowledge(pages: DataFrame) -> DataFrame:
    """``pages`` with ``is_knowledge``: flagged, or under a flagged page."""
    under = at_or_under(pages.where(F.col("route").isNotNull()), knowledge_roots(pages), "left_semi").select("site_id", "route", F.lit(True).alias("under_"))
    out = pages.join(under.dropDuplicates(["site_id", "route"]), ["site_id", "route"], "left")
    return out.withColumn("is_knowledge", _yes("knowledge") | _yes("under_")).drop("under_")


def select_corpus(pages: DataFrame, exclude: list[str] = (), knowledge: bool = False) -> DataFrame:
    """Indexable pages; with ``knowledge`` also knowledge pages, hidden or not, but never drafts or exclusions."""
    public = select_indexable(pages, exclude)
    if not knowledge:
        return public
    known = partition_knowledge(pages).where(
        F.col("is_knowledge") & F.col("route").isNotNull() & ~R.is_container(F.col("has_content"))
        & ~R.is_dynamic(F.col("route"), F.col("is_dynamic")) & ~R.has_draft_segment(F.col("route"))
    ).drop("is_knowledge")
    known = at_or_under(known, exclusions(pages, list(exclude)), "left_anti")
    both = public.select("*", F.lit(0).alias("n_")).unionByName(known.select("*", F.lit(1).alias("n_")))
    first = F.row_number().over(Window.partitionBy("site_id", "route", "ord").orderBy("n_"))
    return both.withColumn("n_", first).where("n_ = 1").drop("n_")


def group_pages(pages: DataFrame, exclude: list[str] = (), branch: str | None = None) -> DataFrame:
    """site_id, group_route (null: root), heading, group_ord, route, ord, title of indexable pages.

    A page's group is the longest indexable container above it; groups go by their first page,
    the root group first.
    """
    leaves = select_indexable(pages, exclude, branch)
    boxes = indexable(pages, exclude).where(R.is_container(F.col("has_content")))
    if branch is not None:
        boxes = boxes.where(F.col("route") != branch)
    boxes = boxes.groupBy("site_id", F.col("route").alias("up")).agg(F.min(F.struct("ord", "title", "label")).alias("box"))
    near = (
        leaves.select("site_id", "route", F.explode(R.ancestors(F.col("route"))).alias("up")).where("up <> route")
        .join(boxes, ["site_id", "up"]).groupBy("site_id", "route").agg(F.max_by(F.struct("up", "box"), F.length("up")).alias("g"))
    )
    out = leaves.join(near, ["site_id", "route"], "left").withColumn("group_route", F.col("g.up"))
    heading = F.coalesce(F.nullif(F.col("g.box.title"), F.lit("")), F.nullif(F.col("g.box.label"), F.lit("")), F.col("g.up"))
    first = F.min("ord").over(Window.partitionBy("site_id", "group_route"))
    return out.select("site_id", "group_route", heading.alias("heading"), F.when(F.col("group_route").isNull(), F.lit(-1)).otherwise(first).cast("long").alias("group_ord"), "route", "ord", "title", "label", "description")


def index_branches(pages: DataFrame, exclude: list[str] = (), min_pages: int = R.DEFAULT_BRANCH_MIN_PAGES) -> DataFrame:
    """Top-level containers with enough indexable pages: site_id, route, title, count."""
    tops = indexable(pages, exclude).where(R.is_container(F.col("has_content")) & (R.depth(F.col("route")) == 1))
    held = select_indexable(pages, exclude).select("site_id", F.explode(R.ancestors(F.col("route"))).alias("route"))
    counts = held.groupBy("site_id", "route").agg(F.count("*").alias("count"))
    return tops.join(counts, ["site_id", "route"]).where(F.col("count") >= min_pages).select("site_id", "route", F.coalesce(F.nullif("title", F.lit("")), F.nullif("label", F.lit("")), F.col("route")).alias("title"), "count")


def translate_routes(pages: DataFrame, translations: DataFrame) -> DataFrame:
    """``pages`` with ``shown_route``: translations (site_id, locale, route, translated) of the route or its nearest ancestor."""
    ups = pages.select("site_id", "locale", "route", F.explode(R.ancestors(F.col("route"))).alias("up")).where("up <> '/' or up = route").distinct()
    near = (
        ups.join(translations.withColumnRenamed("route", "up"), ["site_id", "locale", "up"])
        .groupBy("site_id", "locale", "route").agg(F.max_by(F.struct("up", "translated"), F.length("up")).alias("t"))
    )
    out = pages.join(near, ["site_id", "locale", "route"], "left")
    moved = F.concat(F.col("t.translated"), F.substring(F.col("route"), F.length("t.up") + 1, F.length("route")))
    return out.withColumn("shown_route", F.coalesce(moved, F.col("route"))).drop("t")


def record_routes(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Detail pages of queries: site_id, name, route, pattern, field, path (of local queries).

    ``pages`` also has ``query`` and ``fetch_path`` (or null) and ``parent``; ``queries`` has
    site_id, name, url, field. A page's query is its own, else its parent's, else its site's if
    it is a top-level page (the query of the page ``/``).
    """
    q = F.struct("query", F.col("fetch_path").alias("path"))
    base = R.record_route_base(F.col("route"))
    detail = pages.withColumn("base", base).where("base is not null").withColumn("up", F.coalesce("parent", "base"))
    parents = pages.select("site_id", F.col("route").alias("up"), F.when(F.col("query").isNotNull(), q).alias("pq"))
    site = pages.where("route = '/' and query is not null").select("site_id", q.alias("sq"))
    out = detail.join(parents, ["site_id", "up"], "left").join(site, "site_id", "left").withColumn(
        "got", F.coalesce(F.when(F.col("query").isNotNull(), q), F.col("pq"), F.when(R.depth(F.col("base")) <= 1, F.col("sq")))
    ).where("got is not null")
    out = out.select("site_id", F.col("got.query").alias("name"), F.col("base").alias("route"), F.col("route").alias("pattern"), F.col("got.path").alias("path"), "ord")
    out = out.join(queries.select("site_id", "name", "url", "field"), ["site_id", "name"], "left")
    first = F.row_number().over(Window.partitionBy("site_id", "name").orderBy("ord"))
    return out.withColumn("n", first).where("n = 1").select("site_id", "name", "route", "pattern", F.when(F.col("url").isNull(), F.col("path")).alias("path"), "field")
