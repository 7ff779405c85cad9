"""Agent index, sitemap and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes as R
from ..functions.text import escape_xml, one_line
from . import selectors as S
from .corpus import blockquote

ROOT_HEADING = "Pages"
SIGNALS = ("search", "ai-input", "ai-train")


def index_entry(title: Column, url: Column, about: Column) -> Column:
    line = F.nullif(one_line(about), F.lit(""))
    return F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"), F.coalesce(F.concat(F.lit(": "), line), F.lit("")))


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_records(pages: DataFrame, records: DataFrame | None) -> DataFrame:
    """``pages``, then a page for each record entry (site_id, ord, type, route, title, excerpt) that has a route."""
    if records is None:
        return pages
    last = pages.groupBy("site_id").agg((F.max("ord") + 1).alias("after_"))
    found = records.where("type = 'record' and route is not null and route <> ''").join(last, "site_id", "left")
    rows = found.select("site_id", (F.coalesce("after_", F.lit(0)) + F.col("ord")).alias("ord"), "route", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("excerpt", F.lit("")).alias("description"))
    return pages.unionByName(rows, allowMissingColumns=True)


def site_index_lines(pages: DataFrame, sites: DataFrame, exclude: list[str] = (), branch: str | None = None, translations: DataFrame | None = None, records: DataFrame | None = None, root_heading: str = ROOT_HEADING) -> DataFrame:
    """site_id, section, line, text. ``sites``: site_id, title, description, address, and if there are such base, locale, default_locale, domain.

    ``translations`` as ``selectors.translate_routes`` takes them; ``locale`` is the index's language.
    """
    where = sites.select("site_id", "address", _has(sites, "base", "string").alias("base"), _has(sites, "locale", "string").alias("locale"), _has(sites, "default_locale", "string").alias("default_locale"), _has(sites, "domain", "string").alias("domain"))
    grouped = S.group_pages(with_records(pages, records), exclude, branch).join(where, "site_id", "left")
    if translations is None:
        grouped = grouped.withColumn("shown_route", F.col("route"))
    else:
        foreign = translations.join(where.where("locale <> default_locale").select("site_id", "locale"), ["site_id", "locale"], "left_semi")
        grouped = S.translate_routes(grouped, foreign)
    url = R.markdown_url(F.col("shown_route"), F.col("locale"), F.col("default_locale"), F.col("address"), F.col("base"), F.col("domain"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("label", F.lit("")), F.col("route"))
    entries = grouped.select("site_id", F.col("group_ord").alias("section"), F.col("ord").alias("line"), index_entry(title, url, F.col("description")).alias("text"))
    heading = F.concat(F.lit("## "), F.coalesce(F.nullif("heading", F.lit("")), F.lit(root_heading)))
    heads = grouped.select("site_id", F.col("group_ord").alias("section"), F.lit(-1).cast("long").alias("line"), F.concat(heading, F.lit("\n")).alias("text")).distinct()
    named = sites.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif(_has(sites, "name", "string"), F.lit("")), F.lit("Site")))
    if branch is not None:
        own = pages.where(F.col("route") == branch).select("site_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("label", F.lit(""))).alias("t"), F.col("description").alias("d"))
        named = named.join(own, "site_id", "left").withColumns({"title": F.coalesce("t", "title"), "description": F.col("d")})
    top = named.select("site_id", F.lit(-3).cast("long").alias("section"), F.lit(0).cast("long").alias("line"), F.concat(F.lit("# "), "title").alias("text"))
    quote = named.where("trim(coalesce(description, '')) <> ''").select("site_id", F.lit(-2).cast("long").alias("section"), F.lit(0).cast("long").alias("line"), blockquote(F.col("description")).alias("text"))
    return top.unionByName(quote).unionByName(heads).unionByName(entries)


def site_index(pages: DataFrame, sites: DataFrame, exclude: list[str] = (), branch: str | None = None, **more) -> DataFrame:
    """site_id and the document: sections with a blank line between them, a line feed at the end. A site's document is one row."""
    lines = site_index_lines(pages, sites, exclude, branch, **more)
    block = lines.groupBy("site_id", "section").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("ls"))
    block = block.withColumn("t", F.concat_ws("\n", F.transform("ls", lambda x: x["text"])))
    whole = block.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("section", "t"))).alias("bs"))
    return whole.select("site_id", F.concat(F.concat_ws("\n\n", F.transform("bs", lambda x: x["t"])), F.lit("\n")).alias("document"))


def sitemap_entries(pages: DataFrame, sites: DataFrame, locales: DataFrame, translations: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """site_id, ord, route, loc, lastmod, changefreq, priority, alternates (hreflang, url).

    ``pages`` also has locale, canonical, lastmod, changefreq, priority and, if there are such,
    is_index; ``sites`` has site_id, address, default_locale, noindex and, if there are such,
    trailing_slash; ``locales`` has site_id, locale, n (order) and, if there are such, domain. Index
    pages are listed at their folder. Closed folders, hidden and noindex pages, knowledge, templates
    and pages with another canonical address stay out; of pages with one address the first stays.
    ``records`` are entries as in ``with_records``: listed with their templates' flags, without a date.
    """
    alive = pages.where(
        ~R.is_dynamic(F.col("route"), F.col("is_dynamic")) & ~R.is_container(F.col("has_content")) & (F.col("route") != R.NOT_FOUND_ROUTE) & (F.col("route") != "")
    ).withColumn("shown_at", R.nav_route(F.col("route"), _has(pages, "is_index", "boolean")))
    if records is not None:
        base = R.record_route_base(F.col("route"))
        templates = pages.where(base.isNotNull()).withColumn("base_", base).withColumn("first_", F.row_number().over(Window.partitionBy("site_id", base).orderBy("ord"))).where("first_ = 1")
        asked = records.where("type = 'record' and route <> ''").select("site_id", F.col("ord").alias("nth_"), F.col("route").alias("at_"), F.expr("case when regexp_replace(route, '/[^/]+$', '') = '' then '/' else regexp_replace(route, '/[^/]+$', '') end").alias("base_"))
        after = pages.groupBy("site_id").agg((F.max("ord") + 1).alias("after_"))
        # a record whose route is a page of its own is that page
        asked = asked.join(alive.select("site_id", F.col("shown_at").alias("at_")), ["site_id", "at_"], "left_anti")
        rows = asked.join(templates, ["site_id", "base_"]).join(after, "site_id")
        rows = rows.withColumns({"shown_at": F.col("at_"), "ord": F.col("after_") + F.col("nth_"), "lastmod": F.lit(None).cast("string"), "canonical": F.lit(None).cast("string")})
        alive = alive.unionByName(rows.select(*alive.columns))
    alive = alive.where(~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("noindex", F.lit(False)))
    alive = S.at_or_under(alive, S.closed_folders(pages).unionByName(S.knowledge_roots(pages)), "left_anti")
    site = sites.where("address is not null and not coalesce(noindex, false)").select("site_id", "address", "default_locale", _has(sites, "trailing_slash", "boolean").alias("slash"))
    out = alive.drop("route").withColumnRenamed("shown_at", "route").join(site, "site_id")
    domains = locales.select("site_id", "locale", "n", _has(locales, "domain", "string").alias("domain"))

    def at(rows: DataFrame) -> DataFrame:
        """With the address of ``route`` in ``locale``."""
        if translations is not None:
            rows = S.translate_routes(rows, translations.join(site.select("site_id", F.col("default_locale").alias("locale")), ["site_id", "locale"], "left_anti"))
        shown = F.col("shown_route") if translations is not None else F.col("route")
        own = F.col("domain")
        path = F.when(own.isNotNull(), shown).otherwise(R.localized(shown, F.col("locale"), F.col("default_locale")))
        return rows.withColumn("url", R.page_url(path, F.col("address"), F.lit(""), F.col("slash"), own))

    named = at(out.join(domains.drop("n"), ["site_id", "locale"], "left")).withColumnRenamed("url", "loc").where("canonical is null or canonical = loc")
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("site_id", "loc").orderBy("ord"))).where("nth = 1")
    named = named.select("site_id", "ord", "route", "loc", "lastmod", "changefreq", "priority", "address", "default_locale", "slash")
    several = domains.groupBy("site_id").agg(F.count("*").alias("c")).where("c >= 2").select("site_id")
    wanted = domains.join(several, "site_id", "left_semi").select("site_id", "n", "locale", "domain", F.col("locale").alias("hreflang"))
    default = site.select("site_id", F.col("default_locale").alias("locale")).join(wanted.select("site_id", "locale", "domain"), ["site_id", "locale"])
    wanted = wanted.unionByName(default.select("site_id", F.lit(1 << 30).alias("n"), "locale", "domain", F.lit("x-default").alias("hreflang")))
    each = at(named.select("site_id", "ord", "route", "address", "default_locale", "slash").join(wanted, "site_id"))
    per = each.groupBy("site_id", "ord").agg(F.sort_array(F.collect_list(F.struct("n", "hreflang", "url"))).alias("ls"))
    none = F.array().cast("array<struct<hreflang:string,url:string>>")
    return named.join(per, ["site_id", "ord"], "left").select(
        "site_id", "ord", "route", "loc", F.split_part("lastmod", F.lit("T"), F.lit(1)).alias("lastmod"), "changefreq",
        F.when(F.col("priority") != "0", F.col("priority")).alias("priority"),
        F.coalesce(F.transform("ls", lambda x: F.struct(x["hreflang"].alias("hreflang"), x["url"].alias("url"))), none).alias("alternates"),
    )


def sitemap_xml(entries: DataFrame) -> DataFrame:
    """site_id and the document, of sites that have an entry. A site's document is one row."""
    tag = lambda name: F.coalesce(F.concat(F.lit(f"    <{name}>"), escape_xml(F.nullif(name, F.lit(""))), F.lit(f"</{name}>\n")), F.lit(""))
    optional = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", tag(name)).otherwise(F.lit(""))
    link = lambda a: F.concat(F.lit('    <xhtml:link rel="alternate" hreflang="'), escape_xml(a["hreflang"]), F.lit('" href="'), escape_xml(a["url"]), F.lit('" />\n'))
    one = F.concat(F.lit("  <url>\n"), tag("loc"), optional("lastmod"), optional("changefreq"), optional("priority"), F.array_join(F.transform("alternates", link), ""), F.lit("  </url>\n"))
    first = entries.withColumn("nth", F.row_number().over(Window.partitionBy("site_id", "loc").orderBy("ord"))).where("nth = 1")
    rows = first.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("ord", "loc", one.alias("x")))).alias("xs"), F.max(F.size("alternates")).alias("a"))
    space = F.when(F.col("a") > 0, F.lit(' xmlns:xhtml="http://www.w3.org/1999/xhtml"')).otherwise(F.lit(""))
    return rows.select("site_id", F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'), space, F.lit(">\n"),
        F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</urlset>\n")).alias("document"))


def content_signals(signals: Column) -> Column:
    """``search=yes, ai-train=no`` of a map; values other than yes, no, true and false are left out."""
    one = lambda k: F.concat(F.lit(f"{k}="), F.when(signals[k].isin("true", "yes"), F.lit("yes")).when(signals[k].isin("false", "no"), F.lit("no")))
    return F.concat_ws(", ", *[one(k) for k in SIGNALS])


def at_host_root(address: Column, base: Column) -> Column:
    path = F.regexp_extract(address, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(address.isNotNull(), path.isin("", "/")).otherwise(R.base_path(base) == "")


def robots_txt(sites: DataFrame) -> DataFrame:
    """site_id and document of sites (site_id, address, base, allow, disallow, signals, sitemaps); null if there is nothing to say.

    If there are such columns: ``crawl_delay`` (text), and ``sitemap``, whether the site's own one is named first.
    """
    empty = F.array().cast("array<string>")
    lines = lambda name, c: F.transform(F.coalesce(c, empty), lambda x: F.concat(F.lit(f"{name}: "), x))
    said = F.nullif(content_signals(F.col("signals")), F.lit(""))
    delay = F.nullif(_has(sites, "crawl_delay", "string"), F.lit("0"))
    own = F.when(F.coalesce(_has(sites, "sitemap", "boolean"), F.lit(False)) & F.col("address").isNotNull(), F.concat(F.regexp_replace("address", "/+$", ""), F.lit("/sitemap.xml")))
    some = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(empty)
    rules = F.concat(some(F.concat(F.lit("Content-Signal: "), said)), lines("Allow", F.col("allow")), lines("Disallow", F.col("disallow")), some(F.concat(F.lit("Crawl-delay: "), delay)))
    maps = F.concat(some(own), F.filter(F.coalesce("sitemaps", empty), lambda x: x.isNotNull() & (x != "")))
    head = F.array_join(F.concat(F.array(F.lit("User-agent: *")), rules), "\n")
    named = F.when(F.size(maps) > 0, F.concat(F.lit("\n"), F.array_join(lines("Sitemap", maps), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.when((F.size(rules) > 0) | (F.size(maps) > 0), F.concat(head, F.lit("\n"), named))
    return sites.select("site_id", F.when(at_host_root(F.col("address"), F.col("base")), text).alias("document"))
