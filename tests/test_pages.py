from pyspark.sql import functions as F

from pagemill.functions import routes as R
from pagemill.functions import text as X
from pagemill.operators import corpus as C
from pagemill.operators import richtext as T
from pagemill.operators import selectors as S
from pagemill.operators import site as SI

SCHEMA = "site_id string, ord long, route string, title string, label string, description string, hidden boolean, noindex boolean, has_content boolean, is_dynamic boolean, knowledge boolean"


def graph(spark, rows):
    full = [("s", i, route, route.strip("/") or "Home", None, None, *(flags.get(k) for k in ("hidden", "noindex", "has_content", "is_dynamic", "knowledge"))) for i, (route, flags) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def routes_of(df):
    return [r["route"] for r in df.orderBy("ord").collect()]


PAGES = [
    ("/", {}), ("/about", {}), ("/kb", {"knowledge": True}), ("/kb/pricing", {}), ("/kbase", {}), ("/blog/:slug", {"is_dynamic": True}), ("/_draft/x", {}), ("/404", {}),
    ("/docs", {"has_content": False}), ("/docs/a", {}), ("/closed", {"has_content": False, "noindex": True}), ("/closed/x", {}), ("/thanks", {"noindex": True}),
    ("/docs/v1", {"has_content": False, "noindex": True}), ("/docs/v1/guide", {}), ("/private/x", {}),
]


def test_selectors(spark):
    pages = graph(spark, PAGES)
    assert routes_of(S.select_indexable(pages, ["private/"])) == ["/", "/about", "/kbase", "/docs/a"]
    assert routes_of(S.select_indexable(pages, branch="/docs")) == ["/docs/a"]
    assert routes_of(S.select_searchable(pages)) == ["/", "/about", "/kbase", "/docs/a", "/docs/v1/guide", "/private/x"]
    assert routes_of(S.select_corpus(pages, ["/private"], knowledge=True)) == ["/", "/about", "/kb", "/kb/pricing", "/kbase", "/docs/a"]
    assert routes_of(S.partition_knowledge(pages).where("is_knowledge")) == ["/kb", "/kb/pricing"]


def test_groups_and_branches(spark):
    rows = [("/", {}), ("/docs", {"has_content": False}), *[(f"/docs/p{i}", {}) for i in range(5)], ("/docs/in", {"has_content": False}), ("/docs/in/x", {})]
    pages = graph(spark, rows)
    groups = {r["route"]: r["group_route"] for r in S.group_pages(pages).collect()}
    assert groups["/"] is None and groups["/docs/p1"] == "/docs" and groups["/docs/in/x"] == "/docs/in"
    assert [(r["route"], r["count"]) for r in S.index_branches(pages).collect()] == [("/docs", 6)]
    assert S.index_branches(pages, min_pages=7).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    pages = graph(spark, PAGES)
    want = S.group_pages(pages).orderBy("ord").collect()
    assert all(S.group_pages(pages.repartition(n)).orderBy("ord").collect() == want for n in (1, 7, 64))


def test_versions_and_names(spark):
    v = spark.createDataFrame([(x,) for x in ("v2", "v10", "v2.1", "v2.10", "v2.9", "v1")], "v string")
    assert [r["v"] for r in v.orderBy(R.version_key(F.col("v")).desc()).collect()] == ["v10", "v2.10", "v2.9", "v2.1", "v2", "v1"]
    names = spark.createDataFrame([("/", "index.md"), ("/a/b", "a/b.md"), ("/a/", "a.md")], "r string, n string")
    assert all(r["g"] == r["n"] for r in names.select(R.markdown_filename(F.col("r")).alias("g"), "n").collect())
    back = spark.createDataFrame([("index.md",), ("/a/b.md",), ("a.txt",), (".md",)], "p string").select(R.markdown_filename_route(F.col("p")).alias("r"))
    assert [r["r"] for r in back.collect()] == ["/", "/a/b", None, None]
    fill = spark.createDataFrame([("/m/:slug", "a post"), ("/:slug", "x"), ("/m/:slug/cv", "x"), ("/m/:s", None)], "p string, h string")
    assert [r["x"] for r in fill.select(R.fill_pattern(F.col("p"), F.col("h")).alias("x")).collect()] == ["/m/a%20post", "/x", None, None]


def test_index_and_sitemap_documents(spark):
    pages = graph(spark, [("/", {}), ("/docs", {"has_content": False}), ("/docs/a", {})])
    sites = spark.createDataFrame([("s", "Site", "Two\nlines", None)], "site_id string, title string, description string, address string")
    assert SI.site_index(pages, sites).first()["document"] == "# Site\n\n> Two\n> lines\n\n## Pages\n\n- [Home](/index.md)\n\n## docs\n\n- [docs/a](/docs/a.md)\n"
    wide = pages.withColumns({c: F.lit(None).cast("string") for c in ("canonical", "lastmod", "changefreq", "priority")}).withColumn("locale", F.lit("en"))
    where = spark.createDataFrame([("s", "https://a.org", "en", False)], "site_id string, address string, default_locale string, noindex boolean")
    none = spark.createDataFrame([("s", "en", 0)], "site_id string, locale string, n int")
    found = SI.sitemap_entries(wide, where, none)
    assert [r["loc"] for r in found.orderBy("ord").collect()] == ["https://a.org/", "https://a.org/docs/a"]
    assert SI.sitemap_xml(found).first()["document"].count("<url>") == 2


def test_corpus_lines_slice_back(spark):
    rows = [("s", "/p", [1], "a", "# One\ntext"), ("s", "/p", [2, 1], "b", "```\n# no title\n```"), ("s", "/p", [2], "b", "  \n"), ("s", "/q", [1], "c", " ")]
    sections = spark.createDataFrame(rows, "site_id string, route string, path array<int>, anchor string, markdown string")
    whole = {r["route"]: r["markdown"] for r in C.page_markdown(sections).collect()}
    assert set(whole) == {"/p"}
    lines = whole["/p"].split("\n")
    got = C.segments(sections).orderBy("path").collect()
    assert all("\n".join(lines[r["start_line"] - 1 : r["end_line"]]) == r["markdown"] for r in got)
    assert [r["title"] for r in got] == ["One", None]


def test_hidden_and_excluded_sections_go_with_what_is_below(spark):
    rows = [("s", "/p", [1], True, "x", "a"), ("s", "/p", [1, 1], None, "x", "b"), ("s", "/p", [2], None, "Skip", "c"), ("s", "/p", [3], None, "x", "d"), ("s", "/p", [3, 1], None, "x", "e")]
    sections = spark.createDataFrame(rows, "site_id string, route string, path array<int>, hidden boolean, component string, anchor string")
    assert [(r["path"], r["anchor"]) for r in C.visible(sections, ["Skip"]).orderBy("path").collect()] == [([3], "d"), ([3, 1], "d")]


def text(t, *marks):
    return {"type": "text", "text": t, "marks": list(marks)}


def test_rich_text():
    doc = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 1, "role": "pretitle"}, "content": [text("Label")]},
        {"type": "heading", "attrs": {"level": 1}, "content": [text("Title")]},
        {"type": "paragraph", "content": [text("go "), text("there", {"type": "link", "attrs": {"href": "/x"}})]},
        {"type": "codeBlock", "content": [text("secret()")]},
        {"type": "blockquote", "content": [{"type": "paragraph", "content": [text("quoted")]}]},
        {"type": "inset_ref", "attrs": {"alt": "A chart", "component": "Chart"}}, {"type": "inset_placeholder", "attrs": {"refId": "1"}},
        {"type": "image", "attrs": {"alt": "alt text", "src": "a.png"}},
    ]}
    title, parts = T.extract(doc)
    assert title == "Title" and parts == ["Label", "Title", "go there", "there", "quoted", "A chart", "alt text"]
    assert "[there](/x)" in T.markdown(doc) and "> quoted" in T.markdown(doc) and "Chart" not in T.markdown(doc)
    assert T.json_block("a ```` b").startswith("`````json")


def test_records():
    boat = {"$name": "heron", "name": "Grey Heron", "harbour": "North quay", "image": "/a.png", "site": "https://x.org"}
    assert T.record_text(boat) == "Grey Heron North quay"
    entry = T.record_entry(boat, "boats", {"route": "/boats"})
    assert entry["id"] == "record:boats:heron" and entry["title"] == "Grey Heron" and entry["route"] == "/boats/heron"
    assert T.record_entry(boat, "boats") is None and T.words_of({"content": [{"type": "text", "text": "a "}, {"type": "text", "text": "b"}]}) == "a b"
    whole = {"$name": "n", "hero": {"title": "Hi", "count": 3}, "list": [{"title": "There"}]}
    assert T.is_whole(whole) and T.record_text(whole) == "Hi 3 There"
    body = {"type": "doc", "content": [{"type": "paragraph", "content": [text("words")]}]}
    assert T.record_blocks({"content": body}) == ["words"]
    assert T.record_blocks({"a": 1, "b": {"c": body}})[1] == "<!-- b.c -->\n\nwords"
    assert T.record_entry({"description": "x"}, "g") is None


def test_origins_and_excerpts(spark):
    rows = [("HTTPS://A.org:443/x", "https://a.org"), ("http://b.org:8080", "http://b.org:8080"), ("ftp://x", None), ("", None), ("http://c.org:80", "http://c.org")]
    got = spark.createDataFrame(rows, "u string, want string").select(R.origin(F.col("u")).alias("o"), "want").collect()
    assert all(r["o"] == r["want"] for r in got)
    long = "word " * 60
    cut = spark.createDataFrame([(long,), ("a  b",), ("x" * 200,)], "t string").select(X.excerpt(F.col("t")).alias("e")).collect()
    assert cut[0]["e"] == ("word " * 32).strip() + "…" and cut[1]["e"] == "a b" and cut[2]["e"] == "x" * 160 + "…"


def test_sitemap_languages_domains_index_pages_and_records(spark):
    rows = [("/", {}), ("/docs/index", {}), ("/about", {}), ("/blog/:slug", {"is_dynamic": True}), ("/h/:x", {"is_dynamic": True, "hidden": True})]
    pages = graph(spark, rows).withColumns({c: F.lit(None).cast("string") for c in ("canonical", "changefreq", "priority")}).withColumns({"locale": F.lit("fr"), "lastmod": F.lit("2024-01-02T03"), "is_index": F.col("route") == "/docs/index"})
    sites = spark.createDataFrame([("s", "https://a.org/", "en", False, True)], "site_id string, address string, default_locale string, noindex boolean, trailing_slash boolean")
    locales = spark.createDataFrame([("s", "en", 0, None), ("s", "fr", 1, None), ("s", "de", 2, "https://a.de")], "site_id string, locale string, n int, domain string")
    words = spark.createDataFrame([("s", "fr", "/about", "/propos")], "site_id string, locale string, route string, translated string")
    records = spark.createDataFrame([("s", 0, "record", "/blog/one", "One", ""), ("s", 1, "record", "/h/two", "Two", ""), ("s", 2, "page", "/blog/x", "", "")], "site_id string, ord long, type string, route string, title string, excerpt string")
    got = SI.sitemap_entries(pages, sites, locales, words, records).orderBy("ord").collect()
    assert [(r["loc"], r["lastmod"]) for r in got] == [("https://a.org/fr/", "2024-01-02"), ("https://a.org/fr/docs/", "2024-01-02"), ("https://a.org/fr/propos/", "2024-01-02"), ("https://a.org/fr/blog/one/", None)]
    assert [(a["hreflang"], a["url"]) for a in got[2]["alternates"]] == [("en", "https://a.org/about/"), ("fr", "https://a.org/fr/propos/"), ("de", "https://a.de/about"), ("x-default", "https://a.org/about/")]


def test_site_index_of_a_language_with_records(spark):
    pages = graph(spark, [("/", {}), ("/about", {})])
    sites = spark.createDataFrame([("s", None, None, "https://a.org", "fr", "en")], "site_id string, title string, description string, address string, locale string, default_locale string")
    words = spark.createDataFrame([("s", "fr", "/about", "/propos")], "site_id string, locale string, route string, translated string")
    records = spark.createDataFrame([("s", 0, "record", "/blog/one", "One", "First\nline")], "site_id string, ord long, type string, route string, title string, excerpt string")
    got = SI.site_index(pages, sites, translations=words, records=records).first()["document"]
    assert got == "# Site\n\n## Pages\n\n- [Home](https://a.org/fr/index.md)\n- [about](https://a.org/fr/propos.md)\n- [One](https://a.org/fr/blog/one.md): First line\n"


def test_table_headers_are_no_search_text():
    cell = lambda kind: {"type": kind, "content": [{"type": "paragraph", "content": [text(kind)]}]}
    doc = {"type": "doc", "content": [{"type": "table", "content": [{"type": "tableRow", "content": [cell("tableHeader"), cell("tableCell")]}]}]}
    assert T.extract(doc) == (None, ["tableCell"])


def test_requests_on_a_language_s_own_host(spark):
    from pagemill.operators import requests as RQ

    pages = spark.createDataFrame([("s", 0, "/blog", None, None, None), ("s", 1, "/new", None, "/blog", None)], "site_id string, ord long, route string, has_content boolean, redirect string, is_dynamic boolean")
    sites = spark.createDataFrame([("s", "en", ["en", "fr"], "fr")], "site_id string, default_locale string, locales array<string>, domain_locale string")
    words = spark.createDataFrame([("s", "fr", "/blog", "/blogue")], "site_id string, locale string, route string, translated string")
    asked = spark.createDataFrame([("s", p) for p in ("/blogue.md", "/blog.md", "/fr/blogue.md", "/en/blog.md", "/new.md", None)], "site_id string, path string")
    got = {r["path"]: (r["status"], r["location"]) for r in RQ.resolve_markdown(asked, pages, pages.where("redirect is null"), sites, words).collect()}
    assert got == {"/blogue.md": (200, None), "/blog.md": (301, "/blogue.md"), "/fr/blogue.md": (301, "/blogue.md"), "/en/blog.md": (200, None), "/new.md": (302, "/blog.md"), None: (None, None)}
    none = RQ.resolve_address(asked.limit(0), pages, pages.limit(0), sites, words)
    assert none.count() == 0
