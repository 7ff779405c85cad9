"""Batches of requests for pages' markdown, by markdown path or by a page's own address.

A path's language prefix goes, its translated route is turned back, and what is left meets the
pages in equi-joins. Everything is by (site_id, path): no request is compared with all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes as R
from . import selectors as S

NO_LOCALES = "array<string>"


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"[?#].*$", "")


def _or_root(path: Column) -> Column:
    tidy = F.regexp_replace(path, "/+$", "")
    return F.when(tidy == "", F.lit("/")).otherwise(tidy)


def _parent(route: Column) -> Column:
    return _or_root(F.regexp_replace(route, "/[^/]+$", ""))


def _translated(rows: DataFrame, route: str, translations: DataFrame | None, to: str, back: bool = False) -> DataFrame:
    """``rows`` (site_id, locale) with ``to``: the translation of ``route`` or, with ``back``, what is shown at it."""
    if translations is None:
        return rows.withColumn(to, F.col(route))
    if back:
        # of several routes with one translation the smallest is meant
        translations = translations.groupBy("site_id", "locale", F.col("translated").alias("t_")).agg(F.min("route").alias("translated")).withColumnRenamed("t_", "route")
    keys = rows.select("site_id", "locale", F.col(route).alias("route")).where("route is not null").distinct()
    found = S.translate_routes(keys, translations).withColumnsRenamed({"route": route, "shown_route": to})
    return rows.join(found, ["site_id", "locale", route], "left")


def _named(rows: DataFrame, sites: DataFrame | None, translations: DataFrame | None) -> DataFrame:
    """``rows`` (site_id, at: a page's path or null) with locale, home, over, route and shown.

    ``home`` is the language without a prefix, ``over`` whether the path spells that one's out,
    ``shown`` the route as its language shows it.
    """
    if sites is None:
        rows = rows.withColumns({"home": F.lit(None).cast("string"), "locales": F.array().cast(NO_LOCALES)})
    else:
        own = F.col("domain_locale") if "domain_locale" in sites.columns else F.lit(None).cast("string")
        known = sites.select("site_id", F.coalesce(own, "default_locale").alias("home"), F.coalesce("locales", F.array().cast(NO_LOCALES)).alias("locales"))
        rows = rows.join(known, "site_id", "left")
    first = F.get(R.segments(F.col("at")), F.lit(0))
    asked = F.when(F.array_contains("locales", first), first)
    rows = rows.withColumn("asked_", asked).withColumn("locale", F.coalesce("asked_", "home"))
    rest = F.when(F.col("asked_").isNull(), F.col("at")).otherwise(F.substring("at", F.length("asked_") + 2, 1 << 30))
    rows = rows.withColumns({"over": F.coalesce(F.col("asked_") == F.col("home"), F.lit(False)), "rest": _or_root(rest)})
    rows = _translated(rows, "rest", translations, "route", back=True)
    return _translated(rows, "route", translations, "shown", back=False).drop("asked_", "locales")


def _place(shown: Column, locale: Column, home: Column, markdown: bool) -> Column:
    """Where a page is, or its markdown, as its language shows it."""
    prefixed = locale.isNotNull() & home.isNotNull() & (locale != home)
    if not markdown:
        return R.localized(shown, locale, home)
    return F.concat(F.when(prefixed, F.concat(F.lit("/"), locale)).otherwise(F.lit("")), F.lit("/"), R.markdown_filename(shown))


def _answers(asked: DataFrame, pages: DataFrame, public: DataFrame, markdown: bool, sites: DataFrame | None, translations: DataFrame | None, closed: DataFrame | None) -> DataFrame:
    is_index = F.coalesce(F.col("is_index"), F.lit(False)) if "is_index" in pages.columns else F.lit(False)
    box = R.is_container(F.col("has_content"))
    nth = F.row_number().over(Window.partitionBy("site_id", "route").orderBy("ord"))
    known = pages.where("route is not null").withColumn("nth_", nth).where("nth_ = 1").select("site_id", "route", F.lit(True).alias("known"), box.alias("box"), "redirect")
    content = pages.where(~box & ~R.is_dynamic(F.col("route"), F.col("is_dynamic")) & (F.col("route") != R.NOT_FOUND_ROUTE))
    above = content.select("site_id", "ord", F.col("route").alias("leaf"), F.explode(R.ancestors(F.col("route"))).alias("route"), is_index.alias("index_"))
    first = above.where("leaf <> route").groupBy("site_id", "route").agg(
        F.min_by("leaf", "ord").alias("leaf"), F.min_by("leaf", F.when(F.col("index_") & (F.col("leaf") == F.concat(F.when(F.col("route") == "/", F.lit("")).otherwise(F.col("route")), F.lit("/index"))), F.col("ord"))).alias("inside")
    )
    base = R.record_route_base(F.col("route"))
    templates = pages.where(base.isNotNull()).groupBy("site_id", base.alias("base")).agg(F.min_by("route", "ord").alias("template"))
    shown = public.select("site_id", F.col("route").alias("answer"), F.lit(True).alias("public")).distinct()

    out = _named(asked, sites, translations)
    out = out.join(known, ["site_id", "route"], "left").join(first, ["site_id", "route"], "left")
    out = out.withColumn("base", _parent(F.col("route"))).join(templates, ["site_id", "base"], "left")
    inside = F.coalesce("box", F.lit(False)) & F.col("inside").isNotNull()
    out = out.withColumn("answer", F.when(inside, F.col("inside")).otherwise(F.col("route"))).join(shown, ["site_id", "answer"], "left")
    is_record = F.col("known").isNull() & F.col("template").isNotNull()
    out = out.withColumn("record_", F.coalesce(is_record, F.lit(False)))
    if closed is not None:
        shut = S.at_or_under(out.where("record_").select("site_id", "route").distinct(), closed, "left_semi").withColumn("shut", F.lit(True))
        out = out.join(shut, ["site_id", "route"], "left")
    else:
        out = out.withColumn("shut", F.lit(None).cast("boolean"))

    # where written redirects lead, if that is a page of the site
    to = pages.where("redirect is not null").select("site_id", "redirect").distinct()
    local = F.col("redirect").startswith("/") & ~F.col("redirect").startswith("//")
    to = _named(to.where(local).withColumn("at", _or_root(_bare(F.col("redirect")))), sites, translations)
    to = to.join(known.select("site_id", "route", "known"), ["site_id", "route"], "left").withColumn("base", _parent(F.col("route"))).join(templates, ["site_id", "base"], "left")
    there = to.where("known or template is not null").select("site_id", "redirect", F.concat(_place(F.col("rest"), F.col("locale"), F.col("home"), True), F.regexp_extract("redirect", r"[?#].*$", 0)).alias("there"))
    out = out.join(there, ["site_id", "redirect"], "left") if markdown else out.withColumn("there", F.lit(None).cast("string"))
    out = _translated(out, "leaf", translations, "leaf_shown")

    stands = F.coalesce("known", F.lit(False)) | F.col("record_")
    moved = stands & (F.col("over") | (F.col("rest") != F.col("shown")))
    boxed = F.coalesce("box", F.lit(False)) & ~inside & F.col("leaf").isNotNull()
    kind = (
        F.when(F.col("route").isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(moved, F.lit(False)) | F.col("redirect").isNotNull() | boxed, F.lit("redirect"))
        .when(F.col("record_"), F.when(F.col("shut").isNull(), F.lit("record")).otherwise(F.lit("notFound")))
        .when(F.coalesce("public", F.lit(False)), F.lit("page"))
        .otherwise(F.lit("notFound"))
    )
    status = F.when(F.coalesce(moved, F.lit(False)) & (F.col("kind") == "redirect"), 301).when(F.col("kind") == "redirect", 302).when(F.col("kind") == "notFound", 404).when(F.col("kind").isNotNull(), 200)
    place = lambda c: _place(F.col(c), F.col("locale"), F.col("home"), markdown)
    location = F.when(F.col("kind") == "redirect", F.when(F.coalesce(moved, F.lit(False)), place("shown")).otherwise(F.coalesce("there", "redirect", place("leaf_shown"))))
    route = F.when(F.col("kind") == "page", F.col("answer")).when(F.col("kind") == "record", F.col("template"))
    return out.withColumn("kind", kind).select("site_id", "path", "kind", status.alias("status"), location.alias("location"), route.alias("route"))


def resolve_markdown(requests: DataFrame, pages: DataFrame, public: DataFrame, sites: DataFrame | None = None, translations: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """Answers to ``.md`` requests (site_id, path): kind, status, location, route (a record's: its template).

    ``public`` are the pages with public markdown: they answer 200. A language's untranslated route
    and the spelt-out prefix of the language that has none lead to the right place with 301; a
    page's own redirect and a container (to its first page) with 302; an index page answers for its
    container; a template takes any last segment unless its route is at or under one of ``closed``
    (site_id, route); all else is 404. A path that is not markdown's has a null kind. Locations are
    markdown paths where they name a page of the site. ``sites`` (site_id, default_locale, locales
    and, if there is such, domain_locale, the language of the host that was asked) and
    ``translations`` (site_id, locale, route, translated) are for sites with several languages.
    """
    if sites is None:
        asked = requests.withColumn("at", R.markdown_filename_route(F.col("path")))
    else:
        locales = F.coalesce("locales_", F.array().cast(NO_LOCALES))
        asked = requests.join(sites.select("site_id", F.col("locales").alias("locales_")), "site_id", "left")
        asked = asked.withColumn("at", R.page_path(F.col("path"), locales)).drop("locales_")
    return _answers(asked, pages, public, True, sites, translations, closed)


def resolve_address(requests: DataFrame, pages: DataFrame, public: DataFrame, sites: DataFrame | None = None, translations: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """The same for pages' own addresses (site_id, path): redirects lead to addresses, not to markdown."""
    path = F.coalesce(F.nullif("path", F.lit("")), F.lit("/"))
    return _answers(requests.withColumn("at", _or_root(_bare(path))), pages, public, False, sites, translations, closed)
