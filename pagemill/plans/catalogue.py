"""Named queries over the driver's tables, with the SQL that states each of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as CF
from ..functions import routes as R
from ..functions import text as X
from ..operators import corpus as C
from ..operators import entries as EN
from ..operators import requests as RQ
from ..operators import richtext as T
from ..operators import results as RS
from ..operators import search as SE
from ..operators import selectors as S
from ..operators import site as SI
from ..sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_INDEXES: dict = {}


def _index(spark: SparkSession, sf_dir: str) -> SE.Index:
    """The index of the documents, written once for a session and read by every query."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        _INDEXES[at] = SE.build(A.document_entries(spark, sf_dir))
    return _INDEXES[at]


# search ---------------------------------------------------------------------------------------

_TERM = r"""list_filter(regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''’-]*'), lambda w: length(w) >= 2 OR regexp_matches(w, '\p{{N}}'))"""
_T = _TERM.format
_DOCS = f"""
e AS (SELECT doc_id AS doc, split_part(text, chr(10), 1) AS title, text FROM documents),
d AS (SELECT doc, title, text, {_T('title')} AS tt, {_T('text')} AS bt FROM e),
x AS (SELECT doc, unnest(tt) AS term, 1 AS t, 0 AS b FROM d UNION ALL SELECT doc, unnest(bt), 0, 1 FROM d),
p AS (SELECT term, doc, sum(t) AS tf_title, sum(b) AS tf_body FROM x GROUP BY term, doc),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
len AS (SELECT doc, len(tt) AS lt, len(bt) AS lb FROM d),
st AS (SELECT count(*) AS n, avg(lt) AS mt, avg(lb) AS mb FROM len)"""
_QUERIES = f"""
q AS (SELECT item_id AS qid, text FROM benchmark),
qt AS (SELECT qid, text, {_T("text")} AS ts FROM q)"""
_SCORE = """
s AS (
  SELECT qid, doc, round(sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)) * 0.6, 6) AS score
  FROM (SELECT w.qid, p.doc, w.mult, df.df, st.n, 3.0 * p.tf_title / (1 - 0.5 + 0.5 * lt / mt) + p.tf_body / (1 - 0.75 + 0.75 * lb / mb) AS tf
        FROM w JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc) CROSS JOIN st) GROUP BY qid, doc)"""


@query(f"WITH {_DOCS} SELECT doc, term, CAST(sum(tf_title) AS BIGINT) AS tf_title, CAST(sum(tf_body) AS BIGINT) AS tf_body FROM p GROUP BY doc, term")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.select("doc", "term", "tf_title", "tf_body")


@query(f"SELECT doc_id, CAST(len({_T('text')}) AS BIGINT) AS n_terms, array_to_string(list_sort(list_distinct({_T('text')})), ' ') AS terms FROM documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = A.table(spark, sf_dir, "documents").select("doc_id", X.fold("text").alias("f"))
    terms = folded.select("doc_id", X.terms(F.col("f")).alias("t"))
    return terms.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join(F.sort_array(F.array_distinct("t")), " ").alias("terms"))


@query(f"WITH {_DOCS} SELECT term, CAST(df AS BIGINT) AS df FROM df")
def term_dictionary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).dictionary()


@query(f"WITH {_DOCS} SELECT CAST(n AS BIGINT) AS n, round(mt, 9) AS avg_title, round(mb, 9) AS avg_body FROM st")
def doc_lengths_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _index(spark, sf_dir).stats()
    return s.select("n", F.round("avg_title", 9).alias("avg_title"), F.round("avg_body", 9).alias("avg_body"))


_TOP = "SELECT qid, CAST(r AS INT) AS rank, doc, score, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r, count(*) OVER (PARTITION BY qid) AS total FROM s) WHERE r <= 10"
_EXACT = "w AS (SELECT DISTINCT qid, unnest(ts) AS term, 1.0 AS mult FROM qt)"


@query(f"WITH {_DOCS}, {_QUERIES}, {_EXACT}, {_SCORE} {_TOP}")
def bm25f_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return SE.rank(index, A.benchmark_queries(spark, sf_dir), prefix=False, fuzzy=False, phrase=False).drop("fuzzy")


_LAST = "l AS (SELECT qid, ts[len(ts)] AS pre FROM qt WHERE len(ts) > 0)"
_COMPLETE = f"{_LAST}, c AS (SELECT qid, term, df FROM (SELECT qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df DESC, term) AS r FROM l JOIN df ON length(pre) >= 2 AND starts_with(term, pre)) WHERE r <= 24)"


@query(f"WITH {_DOCS}, {_QUERIES}, {_COMPLETE} SELECT qid, term, CAST(df AS BIGINT) AS df FROM c")
def prefix_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    asked = SE.query_terms(A.benchmark_queries(spark, sf_dir)).where(F.size("tokens") > 0)
    return SE.completions(index.dictionary(), asked.select("qid", F.try_element_at("tokens", F.lit(-1)).alias("prefix")))


_PREFIX = f"{_COMPLETE}, w AS (SELECT qid, term, max(mult) AS mult FROM (SELECT DISTINCT qid, unnest(ts) AS term, 1.0 AS mult FROM qt UNION ALL SELECT qid, term, 0.5 FROM c) GROUP BY qid, term)"


@query(f"WITH {_DOCS}, {_QUERIES}, {_PREFIX}, {_SCORE} {_TOP}")
def bm25f_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return SE.rank(index, A.benchmark_queries(spark, sf_dir), fuzzy=False, phrase=False).drop("fuzzy")


@query(f"""WITH {_DOCS}, {_QUERIES}, {_EXACT}, {_SCORE},
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r, count(*) OVER (PARTITION BY qid) AS total FROM s),
b AS (SELECT h.qid, h.doc, total, round(score * CASE WHEN len(ts) > 1 AND contains(lower(strip_accents(title)) || ' ' || lower(strip_accents(d.text)), lower(strip_accents(qt.text))) THEN 1.35 ELSE 1.0 END, 6) AS score
      FROM h JOIN d USING (doc) JOIN qt USING (qid) WHERE r <= 200)
SELECT qid, CAST(r AS INT) AS rank, doc, score, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM b) WHERE r <= 10""")
def phrase_boost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return SE.rank(index, A.benchmark_queries(spark, sf_dir), prefix=False, fuzzy=False).drop("fuzzy")


_TYPOS = "VALUES (1, 'eand'), (2, 'teh'), (3, 'thsoe'), (4, 'lemnet'), (5, 'ionsther'), (6, 'einhiet')"


def _typos(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT cast(col1 AS long) AS qid, col2 AS text FROM {_TYPOS}")


_NEAR = f"""m AS (SELECT CAST(qid AS BIGINT) AS qid, token FROM ({_TYPOS}) v(qid, token)),
sc AS (SELECT term, df FROM (SELECT term, df, row_number() OVER (PARTITION BY left(term, 1) ORDER BY term) AS at_ FROM df) WHERE at_ <= 400),
nr AS (SELECT qid, token, term, df, row_number() OVER (PARTITION BY qid, token ORDER BY df DESC, term) AS r
       FROM m JOIN sc ON left(term, 1) = left(token, 1) WHERE length(token) >= 4 AND term <> token AND abs(length(term) - length(token)) <= 1 AND damerau_levenshtein(term, token) <= 1)"""


@query(f"WITH {_DOCS}, {_NEAR} SELECT qid, token, term, CAST(df AS BIGINT) AS df, CAST(r AS INT) AS r FROM nr WHERE r <= 8")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _typos(spark).select("qid", F.col("text").alias("token"))
    return SE.corrections(_index(spark, sf_dir).dictionary(), wanted)


@query(f"""WITH {_DOCS}, {_NEAR},
ex AS (SELECT qid, token AS term, 1.0 AS mult FROM m), hit AS (SELECT DISTINCT qid FROM ex JOIN p USING (term)),
w AS (SELECT * FROM ex WHERE qid IN (FROM hit) UNION ALL SELECT DISTINCT qid, term, 1.0 FROM nr WHERE r <= 8 AND qid NOT IN (FROM hit)), {_SCORE}
SELECT qid, CAST(r AS INT) AS rank, doc, score, CAST(total AS BIGINT) AS total, qid NOT IN (FROM hit) AS fuzzy
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r, count(*) OVER (PARTITION BY qid) AS total FROM s) WHERE r <= 10""")
def bm25f_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.rank(_index(spark, sf_dir), _typos(spark), prefix=False, phrase=False)


@query(r"""SELECT i, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS terms FROM (SELECT i, flatten(list_transform(regexp_extract_all(x, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+|[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai} ]+'),
 lambda s: CASE WHEN NOT regexp_matches(s, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]') THEN CASE WHEN length(s) >= 2 OR regexp_matches(s, '\p{N}') THEN [s] ELSE [] END
   WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda k: substr(s, k, 2)) END)) AS t FROM (VALUES (1, '東京都'), (2, '京'), (3, 'iphone用 ab'), (4, 'ภาษาไทย'), (5, 'a 7 bc')) v(i, x))""")
def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT col1 AS i, X FROM (SELECT col1, col2 AS X FROM VALUES (1, '東京都'), (2, '京'), (3, 'iphone用 ab'), (4, 'ภาษาไทย'), (5, 'a 7 bc'))")
    t = rows.select("i", X.terms(F.col("X")).alias("t"))
    return t.select("i", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("terms"))


@query()
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = A.document_entries(spark, sf_dir)
    queries = A.benchmark_queries(spark, sf_dir)
    index = _index(spark, sf_dir)
    hits = SE.rank(index, queries)
    shaped = entries.select("doc", F.concat(F.lit("page:"), "doc").alias("id"), F.lit("page").alias("type"), F.concat(F.lit("/d"), "doc").alias("route"), "title", "content", X.excerpt(F.col("content")).alias("excerpt"))
    return RS.results(hits, shaped, SE.scored_terms(index, queries).withColumnRenamed("terms", "tokens"))


@query(f"""WITH {_DOCS}, {_NEAR}, ex AS (SELECT m.qid, m.token AS term FROM m JOIN (SELECT DISTINCT term FROM p) p ON p.term = m.token)
SELECT qid, term, NULL AS token FROM ex UNION ALL SELECT qid, term, CASE WHEN r = 1 THEN token END FROM nr WHERE r <= 8 AND qid NOT IN (SELECT qid FROM ex)""")
def returned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each term that a query was scored with; ``token`` where it is the correction of one."""
    found = SE.scored_terms(_index(spark, sf_dir), _typos(spark), prefix=False)
    token = F.get(F.filter("corrections", lambda x: x["to"] == F.col("term")), F.lit(0))["token"]
    return found.select("qid", "corrections", F.explode("terms").alias("term")).select("qid", "term", token.alias("token"))


@query("""SELECT * FROM (VALUES (1, 'Un <mark>Café</mark> &lt;ici&gt;', 'Un Café <ici>', '3-6'), (2, '<mark>abab</mark>', 'abab', '0-3'), (3, 'none', 'none', ''),
 (4, '😀 <mark>zeb</mark>', '😀 zeb', '3-5'), (5, '', '', ''),
 (6, '…' || repeat('x', 59) || ' <mark>needle</mark> ' || repeat('y', 59) || '…', '…' || repeat('x', 59) || ' needle ' || repeat('y', 59) || '…', '101-106')) t(i, html, text, ranges)""")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Un Café <ici>", ["cafe"]), (2, "abab", ["ab"]), (3, "none", ["x"]), (4, "😀 zeb", ["zeb"]), (5, None, ["x"]), (6, "x" * 100 + " needle " + "y" * 100, ["needle"])], "i int, t string, terms array<string>")
    got = rows.select("i", RS.shaped("t", "terms").alias("s"))
    ranges = F.array_join(F.transform("s.ranges", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",")
    return got.select("i", F.col("s.html").alias("html"), F.col("s.text").alias("text"), ranges.alias("ranges"))


# page graph -----------------------------------------------------------------------------------

_GRAPH = """
n AS (SELECT *, '/r' || n_regionkey || CASE WHEN n_nationkey % 5 = 0 THEN '/v' ELSE '/n' END || n_nationkey AS place,
             CAST(n_regionkey AS BIGINT) * 1000000000 + (CAST(n_nationkey AS BIGINT) + 1) * 1000000 AS o FROM nation),
g AS (
  SELECT CAST(r_regionkey AS BIGINT) * 1000000000 AS ord, '/r' || r_regionkey AS route, r_name AS title, false AS has_content, r_regionkey % 5 = 4 AS hidden, false AS noindex, false AS knowledge FROM region
  UNION ALL SELECT o, place, n_name, CASE WHEN n_nationkey % 2 = 0 THEN false END, false, n_nationkey % 7 = 3, n_nationkey % 6 = 5 FROM n
  UNION ALL SELECT o + s_suppkey, place || CASE WHEN s_suppkey % 17 = 0 THEN '/_s' WHEN s_suppkey % 19 = 0 THEN '/:s' ELSE '/s' END || s_suppkey, s_name, NULL, s_suppkey % 11 = 0, s_suppkey % 13 = 0, false
    FROM supplier JOIN n ON s_nationkey = n_nationkey),
br AS (SELECT route AS b FROM g WHERE (has_content = false AND (noindex OR hidden)) OR knowledge UNION SELECT '/r1'),
i AS (SELECT * FROM g WHERE NOT hidden AND NOT noindex AND NOT contains(route, '/:') AND NOT contains(route, '/_')
        AND NOT EXISTS (SELECT 1 FROM br WHERE route = b OR starts_with(route, b || '/'))),
leaf AS (SELECT * FROM i WHERE has_content IS NULL OR has_content)"""
EXCLUDE = ["r1/"]


@query(f"WITH {_GRAPH} SELECT ord, route, title FROM leaf")
def select_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_indexable(A.page_graph(spark, sf_dir), EXCLUDE).select("ord", "route", "title")


@query(f"""WITH {_GRAPH.replace("n_nationkey % 7 = 3", "n_nationkey % 7 = 3 AND n_nationkey % 5 <> 0").replace("s_suppkey % 13 = 0, false", "s_suppkey % 13 = 0 AND n_nationkey % 5 <> 0, false")}
SELECT ord, route, title FROM leaf""")
def select_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_searchable(A.page_graph(spark, sf_dir), EXCLUDE).select("ord", "route", "title")


@query(f"WITH {_GRAPH} SELECT ord, route FROM leaf")
def corpus_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_corpus(A.page_graph(spark, sf_dir), EXCLUDE).select("ord", "route")


_KNOWN = "k AS (SELECT *, knowledge OR EXISTS (SELECT 1 FROM g r WHERE r.knowledge AND (g.route = r.route OR starts_with(g.route, r.route || '/'))) AS is_knowledge FROM g)"


@query(f"""WITH {_GRAPH}, {_KNOWN} SELECT ord, route FROM leaf UNION SELECT ord, route FROM k WHERE is_knowledge AND has_content IS DISTINCT FROM false
AND NOT contains(route, '/:') AND NOT contains(route, '/_') AND NOT (route = '/r1' OR starts_with(route, '/r1/'))""")
def corpus_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_corpus(A.page_graph(spark, sf_dir), EXCLUDE, knowledge=True).select("ord", "route")


@query(f"WITH {_GRAPH}, {_KNOWN} SELECT route, is_knowledge FROM k")
def knowledge_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.partition_knowledge(A.page_graph(spark, sf_dir)).select("route", "is_knowledge")


@query(f"WITH {_GRAPH} SELECT route FROM g WHERE EXISTS (SELECT 1 FROM br WHERE route = b OR starts_with(route, b || '/'))")
def excluded_branch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.page_graph(spark, sf_dir)
    return S.at_or_under(pages, S.excluded_branches(pages, EXCLUDE), "left_semi").select("route")


@query(f"WITH {_GRAPH}, c AS (SELECT route AS b FROM g WHERE has_content = false AND (noindex OR hidden)) SELECT route FROM g WHERE EXISTS (SELECT 1 FROM c WHERE route = b OR starts_with(route, b || '/'))")
def closed_folder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.page_graph(spark, sf_dir)
    return S.at_or_under(pages, S.closed_folders(pages), "left_semi").select("route")


_BOX = "x AS (SELECT leaf.ord, leaf.route, arg_max(b.route, length(b.route)) AS group_route, arg_max(b.title, length(b.route)) AS heading FROM leaf LEFT JOIN (SELECT * FROM i WHERE has_content = false) b ON starts_with(leaf.route, b.route || '/') GROUP BY leaf.ord, leaf.route)"


@query(f"WITH {_GRAPH}, {_BOX} SELECT ord, route, group_route, heading, CASE WHEN group_route IS NULL THEN -1 ELSE min(ord) OVER (PARTITION BY group_route) END AS group_ord FROM x")
def group_nearest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_pages(A.page_graph(spark, sf_dir), EXCLUDE).select("ord", "route", "group_route", "heading", "group_ord")


@query(f"WITH {_GRAPH} SELECT t.route, t.title, CAST(count(*) AS BIGINT) AS count FROM i t JOIN leaf ON starts_with(leaf.route, t.route || '/') WHERE t.has_content = false AND t.route NOT LIKE '/%/%' GROUP BY t.route, t.title HAVING count(*) >= 5")
def index_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_branches(A.page_graph(spark, sf_dir), EXCLUDE).select("route", "title", "count")


@query(f"""WITH {_GRAPH}, t(b, v) AS (VALUES ('/r0', '/zone'), ('/r2/n8', '/huit'), ('/r3', '/trois'))
SELECT route, coalesce(arg_max(v || substr(route, length(b) + 1), length(b)), route) AS shown_route FROM g LEFT JOIN t ON route = b OR starts_with(route, b || '/') GROUP BY route""")
def route_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.page_graph(spark, sf_dir).withColumn("locale", F.lit("fr"))
    t = spark.sql("SELECT 'site' AS site_id, 'fr' AS locale, col1 AS route, col2 AS translated FROM VALUES ('/r0', '/zone'), ('/r2/n8', '/huit'), ('/r3', '/trois')")
    return S.translate_routes(pages, t).select("route", "shown_route")


@query("SELECT v, CAST(row_number() OVER (ORDER BY a DESC) AS INT) AS place FROM (SELECT v, list_transform(string_split(substr(v, 2), '.'), lambda x: CAST(x AS INT)) AS a FROM (VALUES ('v2'), ('v10'), ('v2.1'), ('v2.10'), ('v2.9'), ('v1')) t(v))")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql("SELECT col1 AS v FROM VALUES ('v2'), ('v10'), ('v2.1'), ('v2.10'), ('v2.9'), ('v1'), ('vx'), ('2')").where(R.is_version_folder(F.col("v")))
    from pyspark.sql import Window

    return v.select("v", F.row_number().over(Window.orderBy(R.version_key(F.col("v")).desc())).alias("place"))  # an inline list


@query(f"WITH {_GRAPH} SELECT route, regexp_matches(route, '/v[0-9]+(\\.[0-9]+)*(/|$)') AS versioned, CAST(len(list_filter(string_split(route, '/'), lambda s: s <> '')) AS INT) AS depth FROM g")
def in_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_graph(spark, sf_dir).select("route", R.in_version_folder(F.col("route")).alias("versioned"), R.depth(F.col("route")).alias("depth"))


# names, urls, site artifacts --------------------------------------------------------------------

_WEB = r"""
u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site_id, rtrim(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '\.html$', ''), '/') AS r0, html FROM pages),
p AS (SELECT page_id, site_id, CASE WHEN r0 = '' THEN '/' ELSE r0 END AS route, regexp_extract(html, '(?s)<html[^>]*lang="([^"]*)"', 1) AS locale,
             regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS article FROM u)"""


@query(f"WITH {_WEB} SELECT page_id, CASE WHEN route = '/' THEN 'index.md' ELSE substr(route, 2) || '.md' END AS filename, route AS back, CASE WHEN route = '/' THEN 'llms.txt' ELSE substr(route, 2) || '/llms.txt' END AS branch FROM p")
def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.col("route")
    return A.web_pages(spark, sf_dir).select("page_id", R.markdown_filename(route).alias("filename"), R.markdown_filename_route(R.markdown_filename(route)).alias("back"), R.branch_index_filename(route).alias("branch"))


@query(f"""WITH {_WEB} SELECT page_id, 'https://' || site_id || CASE WHEN locale <> 'en' THEN '/' || locale ELSE '' END || CASE WHEN route = '/' THEN '/index' ELSE route END || '.md' AS url,
 '/base' || CASE WHEN locale <> 'en' THEN '/' || locale ELSE '' END || CASE WHEN route = '/' THEN '/index' ELSE route END || '.md' AS rooted,
 'https://' || site_id || CASE WHEN locale <> 'en' THEN '/' || locale || CASE WHEN route = '/' THEN '' ELSE route END ELSE route END || CASE WHEN locale = 'en' AND route = '/' THEN '' ELSE '/' END AS page FROM p""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, en, none = A.web_pages(spark, sf_dir), F.lit("en"), F.lit(None).cast("string")
    address = F.concat(F.lit("https://"), "site_id", F.lit("/"))
    at = R.markdown_url(F.col("route"), F.col("locale"), en, address, none)
    rooted = R.markdown_url(F.col("route"), F.col("locale"), en, none, F.lit("base/"))
    page = R.page_url(R.localized(F.col("route"), F.col("locale"), en), address, none, F.lit(True))
    return p.select("page_id", at.alias("url"), rooted.alias("rooted"), page.alias("page"))


def _sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.web_pages(spark, sf_dir)
    none = F.lit(None).cast("string")
    pages = p.select("site_id", F.col("page_id").alias("ord"), "route", "locale", "title", (F.col("page_id") % 9 == 4).alias("noindex"), (F.col("page_id") % 13 == 6).alias("hidden"),
                     F.lit(None).cast("boolean").alias("has_content"), F.lit(None).cast("boolean").alias("is_dynamic"), F.lit(False).alias("knowledge"), none.alias("canonical"),
                     F.lit("2024-05-06T07:08:09Z").alias("lastmod"), none.alias("changefreq"), F.lit("0.5").alias("priority"))
    sites = p.select("site_id").distinct().select("site_id", F.concat(F.lit("https://"), "site_id").alias("address"), F.lit("en").alias("default_locale"), F.lit(False).alias("noindex"))
    locales = p.select("site_id").distinct().select("site_id", F.posexplode(F.array(F.lit("en"), F.lit("fr"))).alias("n", "locale"))
    return SI.sitemap_entries(pages, sites, locales)


_MAP = f"""{_WEB}, m AS (SELECT page_id AS ord, site_id, route, 'https://' || site_id || CASE WHEN locale <> 'en' THEN '/' || locale || CASE WHEN route = '/' THEN '' ELSE route END ELSE route END AS loc FROM p WHERE page_id % 9 <> 4 AND page_id % 13 <> 6),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, loc ORDER BY ord) AS nth FROM m) WHERE nth = 1)"""


@query(f"WITH {_MAP} SELECT site_id, ord, route, loc, '2024-05-06' AS lastmod, '0.5' AS priority FROM f")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemap(spark, sf_dir).drop("alternates", "changefreq")


@query(f"""WITH {_MAP} SELECT site_id, ord, unnest(['en', 'fr', 'x-default']) AS hreflang,
unnest(['https://' || site_id || route, 'https://' || site_id || '/fr' || CASE WHEN route = '/' THEN '' ELSE route END, 'https://' || site_id || route]) AS url FROM f""")
def sitemap_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemap(spark, sf_dir).select("site_id", "ord", F.explode("alternates").alias("a")).select("site_id", "ord", "a.hreflang", "a.url")


@query(f"""WITH {_MAP}, x AS (SELECT site_id, ord, '  <url>' || chr(10) || '    <loc>' || replace(loc, '&', '&amp;') || '</loc>' || chr(10)
 || '    <lastmod>2024-05-06</lastmod>' || chr(10) || '    <priority>0.5</priority>' || chr(10)
 || '    <xhtml:link rel="alternate" hreflang="en" href="https://' || site_id || route || '" />' || chr(10)
 || '    <xhtml:link rel="alternate" hreflang="fr" href="https://' || site_id || '/fr' || CASE WHEN route = '/' THEN '' ELSE route END || '" />' || chr(10)
 || '    <xhtml:link rel="alternate" hreflang="x-default" href="https://' || site_id || route || '" />' || chr(10) || '  </url>' || chr(10) AS t FROM f)
SELECT site_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">' || chr(10) || string_agg(t, '' ORDER BY ord) || '</urlset>' || chr(10) AS document FROM x GROUP BY site_id""")
def sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SI.sitemap_xml(_sitemap(spark, sf_dir))


def _sites(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'site' AS site_id, 'Regions' AS title, 'Suppliers by\\nregion' AS description, 'https://example.com/' AS address")


_LINES = f"""{_GRAPH}, {_BOX}, y AS (SELECT x.*, leaf.title, CASE WHEN group_route IS NULL THEN -1 ELSE min(x.ord) OVER (PARTITION BY group_route) END AS section FROM x JOIN leaf ON leaf.ord = x.ord),
lines AS (SELECT CAST(-3 AS BIGINT) AS section, CAST(0 AS BIGINT) AS line, '# Regions' AS text UNION ALL SELECT -2, 0, '> Suppliers by' || chr(10) || '> region'
 UNION ALL SELECT DISTINCT section, -1, '## ' || coalesce(heading, 'Pages') || chr(10) FROM y
 UNION ALL SELECT section, ord, '- [' || title || '](https://example.com' || route || '.md): About ' || title FROM y)"""


@query(f"WITH {_LINES} SELECT section, line, text FROM lines")
def site_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SI.site_index_lines(A.page_graph(spark, sf_dir), _sites(spark), EXCLUDE).drop("site_id")


@query(f"WITH {_LINES}, b AS (SELECT section, string_agg(text, chr(10) ORDER BY line) AS t FROM lines GROUP BY section) SELECT 'site' AS site_id, string_agg(t, chr(10) || chr(10) ORDER BY section) || chr(10) AS document FROM b")
def site_index_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SI.site_index(A.page_graph(spark, sf_dir), _sites(spark), EXCLUDE)


@query("SELECT * FROM (VALUES ('a', 'User-agent: *' || chr(10) || 'Content-Signal: search=yes, ai-train=no' || chr(10) || 'Allow: /' || chr(10) || 'Disallow: /x' || chr(10) || chr(10) || 'Sitemap: https://a.org/sitemap.xml' || chr(10)), ('b', NULL), ('c', NULL), ('d', 'User-agent: *' || chr(10) || chr(10) || 'Sitemap: https://d.org/s.xml' || chr(10)), ('e', 'User-agent: *' || chr(10) || 'Crawl-delay: 10' || chr(10) || chr(10) || 'Sitemap: https://e.org/sitemap.xml' || chr(10)), ('f', 'User-agent: *' || chr(10) || 'Disallow: /y' || chr(10))) t(site_id, document)")
def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SI.robots_txt(spark.sql("""SELECT * FROM VALUES
      ('a', 'https://a.org', '', array('/'), array('/x'), map('search', 'yes', 'ai-train', 'false', 'ai-input', 'maybe'), array('https://a.org/sitemap.xml'), null, false),
      ('b', 'https://b.org/docs/', '', array('/'), array('/x'), map('search', 'yes'), array('https://b.org/s.xml'), null, true),
      ('c', null, '', null, null, null, null, null, true), ('d', null, '/', null, null, null, array('https://d.org/s.xml'), null, null),
      ('e', 'https://e.org/', null, null, null, null, null, '10', true), ('f', null, '', null, array('/y'), null, null, '0', false) AS t(site_id, address, base, allow, disallow, signals, sitemaps, crawl_delay, sitemap)"""))


@query("SELECT * FROM (VALUES (1, 'https://a.org', true), (2, 'http://b.org:8080', false), (3, NULL, true), (4, 'https://c.org', true), (5, NULL, true), (6, NULL, false)) t(i, own, ok)")
def accepts_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES (1, 'HTTPS://A.org:443/x', array('https://a.org')), (2, 'http://b.org:8080', array('https://a.org')), (3, '', array('https://a.org')), (4, 'https://c.org/', array()), (5, 'ftp://x', null), (6, 'ftp://x', array()) AS t(i, o, e)")
    site = F.array(F.lit("https://c.org"))
    return rows.select("i", R.origin(F.col("o")).alias("own"), R.accepts_origin(R.expected_origins(F.col("e").cast("array<string>")), F.col("o"), site).alias("ok"))


_SPOKEN = "site_id string, path string"
_ROOMS = [("/", None, None, None), ("/blog", None, None, None), ("/blog/:slug", None, None, None), ("/docs", False, None, None), ("/docs/intro", None, None, None), ("/shop", False, None, None), ("/shop/index", None, None, True),
          ("/old", None, "/blog#latest", None), ("/file", None, "/files/a.pdf", None), ("/kb/notes/:slug", None, None, None), ("/quiet", None, None, None)]


def _languages(spark: SparkSession, resolve, paths: list[str]) -> DataFrame:
    pages = spark.createDataFrame([("s", i, *r, None) for i, r in enumerate(_ROOMS)], "site_id string, ord long, route string, has_content boolean, redirect string, is_index boolean, is_dynamic boolean")
    sites = spark.createDataFrame([("s", "en", ["en", "fr"])], "site_id string, default_locale string, locales array<string>")
    words = spark.createDataFrame([("s", "fr", "/blog", "/blogue"), ("s", "fr", "/docs", "/guide")], "site_id string, locale string, route string, translated string")
    closed = spark.createDataFrame([("s", "/kb")], "site_id string, route string")
    asked = spark.createDataFrame([("s", p) for p in paths], _SPOKEN)
    public = pages.where("route <> '/quiet' and redirect is null and has_content is null")
    return resolve(asked, pages, public, sites, words, closed).drop("site_id")


@query("""SELECT * FROM (VALUES ('/index.md', 'page', 200, NULL, '/'), ('/fr/index.md', 'page', 200, NULL, '/'), ('/fr/blogue.md', 'page', 200, NULL, '/blog'), ('/fr/blog.md', 'redirect', 301, '/fr/blogue.md', NULL),
 ('/en/blog.md', 'redirect', 301, '/blog.md', NULL), ('/fr/docs.md', 'redirect', 301, '/fr/guide.md', NULL), ('/fr/guide.md', 'redirect', 302, '/fr/guide/intro.md', NULL), ('/fr/guide/intro.md', 'page', 200, NULL, '/docs/intro'),
 ('/docs.md', 'redirect', 302, '/docs/intro.md', NULL), ('/shop.md', 'page', 200, NULL, '/shop/index'), ('/old.md', 'redirect', 302, '/blog.md#latest', NULL), ('/file.md', 'redirect', 302, '/files/a.pdf', NULL),
 ('/blog/hello.md', 'record', 200, NULL, '/blog/:slug'), ('/fr/blogue/hello.md', 'record', 200, NULL, '/blog/:slug'), ('/kb/notes/x.md', 'notFound', 404, NULL, NULL), ('/quiet.md', 'notFound', 404, NULL, NULL),
 ('/fr/nope.md', 'notFound', 404, NULL, NULL), ('/blog', NULL, NULL, NULL, NULL), ('/fr/', NULL, NULL, NULL, NULL), ('/fr/.md', NULL, NULL, NULL, NULL)) t(path, kind, status, location, route)""")
def md_language_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = "/index.md /fr/index.md /fr/blogue.md /fr/blog.md /en/blog.md /fr/docs.md /fr/guide.md /fr/guide/intro.md /docs.md /shop.md /old.md /file.md /blog/hello.md /fr/blogue/hello.md /kb/notes/x.md /quiet.md /fr/nope.md /blog /fr/ /fr/.md"
    return _languages(spark, RQ.resolve_markdown, paths.split())


@query("""SELECT * FROM (VALUES ('/', 'page', 200, NULL, '/'), ('', 'page', 200, NULL, '/'), ('/fr', 'page', 200, NULL, '/'), ('/fr/', 'page', 200, NULL, '/'), ('/fr/blogue', 'page', 200, NULL, '/blog'), ('/fr/blog', 'redirect', 301, '/fr/blogue', NULL),
 ('/docs', 'redirect', 302, '/docs/intro', NULL), ('/fr/guide', 'redirect', 302, '/fr/guide/intro', NULL), ('/old', 'redirect', 302, '/blog#latest', NULL), ('/blog/hello', 'record', 200, NULL, '/blog/:slug'),
 ('/kb/notes/x', 'notFound', 404, NULL, NULL), ('/quiet', 'notFound', 404, NULL, NULL), ('/nowhere', 'notFound', 404, NULL, NULL)) t(path, kind, status, location, route)""")
def address_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, RQ.resolve_address, ["", *"/ /fr /fr/ /fr/blogue /fr/blog /docs /fr/guide /old /blog/hello /kb/notes/x /quiet /nowhere".split()])


@query(r"""WITH """ + _GRAPH + """, f AS (SELECT g.route, min(l.route) FILTER (l.ord = (SELECT min(k.ord) FROM g k WHERE k.has_content IS DISTINCT FROM false AND NOT contains(k.route, '/:') AND starts_with(k.route, g.route || '/'))) AS leaf
  FROM g JOIN g l ON starts_with(l.route, g.route || '/') AND l.has_content IS DISTINCT FROM false GROUP BY g.route, g.ord)
SELECT g.route || '.md' AS path, CASE WHEN g.has_content = false AND leaf IS NOT NULL THEN 'redirect' WHEN leaf_.route IS NOT NULL THEN 'page' ELSE 'notFound' END AS kind,
 CASE WHEN g.has_content = false AND leaf IS NOT NULL THEN 302 WHEN leaf_.route IS NOT NULL THEN 200 ELSE 404 END AS status,
 CASE WHEN g.has_content = false THEN leaf || '.md' END AS location
FROM g LEFT JOIN f ON f.route = g.route LEFT JOIN leaf leaf_ ON leaf_.route = g.route""")
def md_request_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.page_graph(spark, sf_dir).withColumn("redirect", F.lit(None).cast("string"))
    requests = pages.select("site_id", F.concat("route", F.lit(".md")).alias("path"))
    return RQ.resolve_markdown(requests, pages, S.select_indexable(pages, EXCLUDE)).select("path", "kind", "status", "location")


@query(f"""WITH {_GRAPH} SELECT route, route IN (SELECT route FROM leaf) AS page,
 NOT contains(route, '/:') AND NOT contains(route, '/_') AND NOT EXISTS (SELECT 1 FROM br WHERE g.route = b OR starts_with(g.route, b || '/')) AS record FROM g""")
def markdown_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown_rule(A.page_graph(spark, sf_dir), EXCLUDE).select("route", "page", "record")


@query("""SELECT * FROM (VALUES ('/fr/blogue', '/fr/blogue.md', '/fr/blogue'), ('/fr', '/fr/index.md', '/fr'), ('/', '/index.md', '/'), ('/blog/x', '/blog/x.md', '/blog/x'), ('/french', '/french.md', '/french')) t(path, markdown, back)""")
def locale_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.createDataFrame([(x,) for x in ("/fr/blogue", "/fr", "/", "/blog/x", "/french")], "path string")
    own = F.array(F.lit("fr"), F.lit("de"))
    made = paths.withColumn("markdown", R.markdown_path(F.col("path"), own))
    return made.withColumn("back", R.page_path(F.col("markdown"), own))


@query("""SELECT * FROM (VALUES ('/docs/index', true, '/docs', 'fr/search-index.json'), ('/index', true, '/', 'fr/search-index.json'), ('/docs/index', false, '/docs/index', 'fr/search-index.json'), ('/x', true, '/x', 'fr/search-index.json')) t(route, is_index, nav, file)""")
def nav_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("/docs/index", True), ("/index", True), ("/docs/index", False), ("/x", True)], "route string, is_index boolean")
    return rows.select("route", "is_index", R.nav_route(F.col("route"), F.col("is_index")).alias("nav"), R.search_index_filename(F.lit("fr"), F.lit("en")).alias("file"))


@query("""SELECT * FROM (VALUES (1, true, true, '', true, 5, ''), (2, false, false, '', false, 5, ''), (3, true, false, '/kb,/a', true, 3, 'exclud'), (4, true, true, '/x', false, 5, '')) t(i, idx, md, exclude, branches, least, unknown)""")
def agents_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [None, {"agents": False}, {"agents": {"markdown": False, "exclude": [" kb/ ", "", "/a"], "branchMinPages": 3, "exclud": 1}}, {"agents": {"exclude": "x", "branchIndexes": False, "branchMinPages": "7"}}]
    rows = []
    for i, c in enumerate(given, 1):
        a = CF.agents_config(c)
        rows.append((i, a["index"], a["markdown"], ",".join(a["exclude"]), a["branchIndexes"], a["branchMinPages"], ",".join(CF.unknown_agents_keys(c))))
    return spark.createDataFrame(rows, "i int, idx boolean, md boolean, exclude string, branches boolean, least int, unknown string")


@query("""SELECT * FROM (VALUES (1, true, 'pages,sections,headings,paragraphs,links,lists', ''), (2, false, 'pages,sections,headings,paragraphs,lists', '/kb')) t(i, enabled, included, excluded)""")
def search_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [None, {"search": {"enabled": False, "include": {"links": False}, "exclude": {"routes": ["/kb"]}}}]
    rows = [(i, c["enabled"], ",".join(k for k, v in c["include"].items() if v), ",".join(c["exclude"]["routes"])) for i, c in enumerate(map(CF.search_config, given), 1)]
    return spark.createDataFrame(rows, "i int, enabled boolean, included string, excluded string")


# entries, records, corpus -----------------------------------------------------------------------

_CUT = r"""CASE WHEN length(l) <= 160 THEN l ELSE trim(substr(l, 1, CASE WHEN instr(substr(l, 1, 161), ' ') > 0 AND length(substr(l, 1, 161)) - instr(reverse(substr(l, 1, 161)), ' ') >= 80 THEN length(substr(l, 1, 161)) - instr(reverse(substr(l, 1, 161)), ' ') ELSE 160 END)) || '…' END"""


@query(rf"WITH o AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM documents) SELECT doc_id, {_CUT} AS excerpt FROM o")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


_ENTRY = rf"""{_WEB}, w AS (SELECT *, trim(regexp_replace(regexp_replace(article, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS words, trim(regexp_replace(h1, '\s+', ' ', 'g')) AS head FROM p),
t AS (SELECT page_id, 'page:' || route AS id, 'page' AS type, route, title, title AS content, '' AS description, NULL AS sectionId, NULL AS anchor, NULL AS component, NULL AS pageTitle, NULL AS excerpt, CASE WHEN route = '/' THEN 1.0 ELSE 0.8 END AS weight FROM w WHERE title <> ''),
c AS (SELECT *, trim(head || ' ' || words) AS l FROM w),
s AS (SELECT page_id, 'section:' || route || ':article' AS id, 'section' AS type, route, head AS title, l AS content, NULL AS description, 'article' AS sectionId, 'section-article' AS anchor, 'Article' AS component, title AS pageTitle, {_CUT} AS excerpt, 0.6 AS weight FROM c
  UNION ALL SELECT page_id, 'section:' || route || ':more', 'section', route, 'More', '', NULL, 'more', 'section-more', 'List', title, '', 0.6 FROM w WHERE page_id % 3 <> 0)"""


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every web page as a site of its own, with an article that holds a promotion, and a list that is a draft on every third."""
    p = A.web_pages(spark, sf_dir).withColumn("site_id", F.concat(F.lit("p"), "page_id"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    pages = p.select("site_id", F.col("page_id").cast("long").alias("ord"), "route", "title", none.alias("label"), none.alias("description"), no.alias("hidden"), no.alias("noindex"), no.alias("has_content"), no.alias("is_dynamic"), no.alias("knowledge"))
    flat = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    text = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    level = F.struct(F.lit(1).alias("level"))
    node = lambda kind, t: F.struct(F.lit(kind).alias("type"), level.alias("attrs"), text(t).alias("content"))
    doc = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(node("heading", flat("h1")), node("paragraph", flat(F.regexp_replace("article", "<[^>]*>", " ")))).alias("content")))
    one = lambda path, name, component, doc, hidden, title: p.select(
        "site_id", "route", F.array(*[F.lit(x) for x in path]).alias("path"), hidden.alias("hidden"), F.lit(component).alias("component"), F.lit(name).alias("section_id"), F.lit(f"section-{name}").alias("anchor"), F.lit(title).cast("string").alias("param_title"), doc.alias("doc"))
    return pages, one([1], "article", "Article", doc, no, None).unionByName(one([1, 1], "promo", "Promo", doc, no, None)).unionByName(one([2], "more", "List", none, F.col("page_id") % 3 == 0, "More"))


_COLUMNS = ("id", "type", "route", "title", "content", "description", "sectionId", "anchor", "component", "pageTitle", "excerpt", "weight")
_LIST = "page_id, id, type, route, title, content, description, sectionId, anchor, component, pageTitle, excerpt, CAST(weight AS DOUBLE) AS weight"


@query(f"WITH {_ENTRY} SELECT {_LIST} FROM t")
def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.of_pages(_site(spark, sf_dir)[0]).select(F.col("ord").alias("page_id"), *_COLUMNS)


@query(f"WITH {_ENTRY} SELECT {_LIST} FROM s")
def section_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.of_sections(*_site(spark, sf_dir), excluded_components=["Promo"]).select(F.col("ord").alias("page_id"), *_COLUMNS)


@query(f"WITH {_ENTRY}, r AS (SELECT 'record:parts:' || p_partkey AS id, 'record' AS type, p_name AS title FROM part) SELECT id, type, title FROM t UNION ALL SELECT id, type, title FROM s UNION ALL SELECT * FROM r")
def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = EN.extract(*_site(spark, sf_dir), excluded_components=["Promo"])
    return found.unionByName(_parts(spark, sf_dir), allowMissingColumns=True).select("id", "type", "title")


@query(f"WITH {_ENTRY} SELECT 'p' || page_id AS site_id, '1.0' AS version, 'en' AS locale, CAST(count(*) AS BIGINT) AS count FROM (SELECT page_id FROM t UNION ALL SELECT page_id FROM s) GROUP BY page_id")
def index_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.envelope(EN.extract(*_site(spark, sf_dir), excluded_components=["Promo"]), "en")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    record = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.lit("/img/x.png").alias("photo"), F.col("p_size").alias("size")))
    return T.record_entries(part.select("p_partkey", record.alias("record")), "parts", {"route": "/parts/"})


@query("""SELECT p_partkey, 'record:parts:' || p_partkey AS id, '/parts/' || p_partkey AS route, p_name AS title, p_name || ' ' || p_brand AS content, p_name || ' ' || p_brand AS excerpt, 0.7::DOUBLE AS weight,
 '{"title": "' || p_name || '", "brand": "' || p_brand || '", "photo": "/img/x.png", "size": ' || p_size || '}' AS item FROM part""")
def record_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "id", "route", "title", "content", "excerpt", "weight", "item")


_RECORDS = {
    1: ({"$name": "a post", "title": "R & D", "image": "/i.png", "n": 3.0}, {"pattern": "/m/:slug"}),
    2: ({"title": "R & D  lab", "link": "https://x.org"}, {"route": "/lab"}),
    3: ({"title": "no page"}, {}),
    4: ({"$name": "k", "hero": {"title": "Hi", "count": 3.0, "on": True}, "list": [{"title": "There", "tags": ["a", "b"]}]}, {"route": "/all/"}),
    5: ({"$name": "z", "name": "Name", "about": "x", "description": "word " * 50}, {"route": "/z", "search": {"fields": ["about", "name"], "weight": 2}}),
    6: ({"$name": "q", "title": "own", "route": "/own/place"}, {}),
    7: ({"title": "t", "handle": "h/1"}, {"pattern": "/p/:h", "field": "handle"}),
    8: ({"title": "t"}, {"pattern": "/:a/:b"}),
}


@query("""SELECT * FROM (VALUES (1, 'record:g:a post', '/m/a%20post', 'R & D', 'R & D', 'R & D', 0.7::DOUBLE, '{"title": "R & D", "n": 3}'),
 (2, 'record:g:r-&-d-lab', '/lab/r-&-d-lab', 'R & D  lab', 'R & D  lab', 'R & D lab', 0.7, '{"title": "R & D  lab", "link": "https://x.org"}'),
 (4, 'record:g:k', '/all/k', 'Hi', 'Hi 3 There a b', 'Hi 3 There a b', 0.7, '{"title": "Hi", "count": 3, "on": true}'),
 (5, 'record:g:z', '/z/z', 'Name', 'x Name', repeat('word ', 31) || 'word…', 2.0, '{"name": "Name", "about": "x"}'),
 (6, 'record:g:q', '/own/place', 'own', 'own', 'own', 0.7, '{"title": "own"}'),
 (7, 'record:g:t', '/p/h%2F1', 't', 't h/1', 't h/1', 0.7, '{"title": "t", "handle": "h/1"}')) t(i, id, route, title, content, excerpt, weight, item)""")
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [T.record_entries(spark.createDataFrame([(i, json.dumps(r))], "i int, record string"), "g", c) for i, (r, c) in _RECORDS.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("i", "id", "route", "title", "content", "excerpt", "weight", "item")


_TURN = """b AS (SELECT conv_id, turn, trim('## ' || role || chr(10) || chr(10) || text, ' ' || chr(10)) AS md FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    return c.select(F.lit("chat").alias("site_id"), F.concat(F.lit("/c"), "conv_id").alias("route"), F.array(F.col("turn").cast("int")).alias("path"), F.lit(None).cast("string").alias("anchor"),
                    F.concat(F.lit("## "), "role", F.lit("\n\n"), "text").alias("markdown"), "conv_id")


@query(f"WITH {_TURN} SELECT '/c' || conv_id AS route, string_agg(md, chr(10) || chr(10) ORDER BY turn) AS markdown FROM b GROUP BY conv_id")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_markdown(_turns(spark, sf_dir)).drop("site_id")


_SEG = f"{_TURN}, l AS (SELECT *, len(string_split(md, chr(10))) AS n FROM b), g AS (SELECT *, 1 + coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l)"


@query(f"WITH {_SEG} SELECT '/c' || conv_id AS route, CAST(turn AS INT) AS turn, CAST(st AS BIGINT) AS start_line, CAST(st + n - 1 AS BIGINT) AS end_line, substr(split_part(md, chr(10), 1), 4) AS title FROM g")
def corpus_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments(_turns(spark, sf_dir)).select("route", F.col("path")[0].alias("turn"), "start_line", "end_line", "title")


@query(f"WITH {_SEG} SELECT '/c' || conv_id AS route, CAST(max(st + n - 1) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS segments FROM g GROUP BY conv_id")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return C.manifest(turns.select("site_id", "route").distinct(), turns).drop("site_id")


@query("SELECT conv_id, turn, '<!-- ' || role || CASE WHEN row_number() OVER (PARTITION BY conv_id, role, length(text) % 3 ORDER BY turn) > 1 THEN ': as above' ELSE '' END || ' -->' AS label FROM conversations")
def shown_records_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    shown = c.select(F.lit("chat").alias("site_id"), F.col("conv_id").cast("string").alias("route"), F.col("turn").alias("pos"), F.col("role").alias("name"), (F.length("text") % 3).cast("string").alias("value"), "conv_id", "turn")
    return C.shown_labels(shown).select("conv_id", "turn", "label")


@query("""SELECT doc_id, replace(replace(replace(replace(replace(split_part(text, chr(10), 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS title FROM documents""")
def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.escape_html(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


_RICH = """{"type":"doc","content":[{"type":"heading","attrs":{"level":1},"content":[{"type":"text","text":"Gala"}]},{"type":"paragraph","content":[{"type":"text","text":"See "},{"type":"text","text":"tickets","marks":[{"type":"link","attrs":{"href":"/t"}}]},{"type":"inset_ref","attrs":{"alt":"a map"}}]},{"type":"codeBlock","content":[{"type":"text","text":"x = 1"}]}]}"""


@query("""SELECT 'Gala' AS title, 'Gala | See ticketsa map | tickets' AS parts, '# Gala' || chr(10) || chr(10) || 'See [tickets](/t)a map' || chr(10) || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' AS markdown""")
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = spark.createDataFrame([(_RICH,)], "doc string")
    return doc.select(T.extract_udf("doc").alias("e"), T.markdown_udf("doc").alias("markdown")).select("e.title", F.concat_ws(" | ", "e.parts").alias("parts"), "markdown")


_BODY = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "words"}]}]}
_CHART = {"type": "doc", "content": [{"type": "chart"}]}


@query("""SELECT * FROM (VALUES (1, 'words'), (2, 'words'), (3, '```json' || chr(10) || '{' || chr(10) || '  "a": 1' || chr(10) || '}' || chr(10) || '```' || chr(10) || chr(10) || '<!-- b.c -->' || chr(10) || chr(10) || 'words'),
 (4, '```json' || chr(10) || '[' || chr(10) || '  1,' || chr(10) || '  "x"' || chr(10) || ']' || chr(10) || '```'), (5, '````json' || chr(10) || '"a ``` b"' || chr(10) || '````'),
 (6, '```json' || chr(10) || '{' || chr(10) || '  "x": {}' || chr(10) || '}' || chr(10) || '```'), (7, 'kept as JSON')) t(i, markdown)""")
def record_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [{"content": _BODY}, {"body": {"content": _BODY}}, {"a": 1.0, "b": {"c": _BODY}}, [1, "x"], "a ``` b", {"x": {}}, {"c": _CHART}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values, 1)], "i int, value string").select("i", T.record_markdown_udf("value").alias("m"))
    return rows.select("i", F.when(F.col("m").contains('"chart"') & F.col("m").startswith("```json"), "kept as JSON").otherwise(F.col("m")).alias("markdown"))


@query("""SELECT '/p' AS route, 'first' || chr(10) || chr(10) || '<!-- a-b -->' || chr(10) || chr(10) || '```json' || chr(10) || '1' || chr(10) || '```' || chr(10) || chr(10) || 'second' || chr(10) || chr(10) || '<!-- a-b: as above -->' || chr(10) || chr(10) || '<!-- t -->' || chr(10) || chr(10) || '<!-- t.content -->' || chr(10) || chr(10) || 'words' || chr(10) || chr(10) || 'words' AS markdown""")
def section_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame([("s", "/p", [1], "one", "one", "first"), ("s", "/p", [2], "two", "two", "second"), ("s", "/p", [3], "two", "two", " ")], "site_id string, route string, path array<int>, anchor string, dom_id string, markdown string")
    shown = spark.createDataFrame([("s", "/p", "one", 0, "a--b", "1"), ("s", "/p", "one", 1, "none", "null"), ("s", "/p", "two", 2, "a--b", "1"), ("s", "/p", "two", 3, "t", json.dumps({"content": _BODY})), ("s", "/p", "gone", 4, "x", "2")], "site_id string, route string, dom_id string, pos int, name string, value string")
    record = spark.createDataFrame([("s", "/p", json.dumps({"content": _BODY}))], "site_id string, route string, value string")
    return C.with_shown_records(sections, shown, record).select("route", "markdown")


_CORPUS = f"{_GRAPH}, {_KNOWN}, z AS (SELECT ord, route, title, is_knowledge FROM k WHERE route IN (SELECT route FROM leaf) OR (is_knowledge AND has_content IS DISTINCT FROM false AND NOT contains(route, '/:') AND NOT contains(route, '/_') AND NOT (route = '/r1' OR starts_with(route, '/r1/'))))"


@query(f"WITH {_CORPUS} SELECT ord, route, title, is_knowledge AS knowledge, CAST(5 AS BIGINT) AS lines, '# ' || title || chr(10) || 'text' || chr(10) || chr(10) || 'more' || chr(10) || 'of it' AS markdown, title || ':1-2 :4-5' AS segments FROM z")
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.page_graph(spark, sf_dir)
    one = lambda n, text: pages.select("site_id", "route", F.array(F.lit(n)).alias("path"), F.lit(None).cast("string").alias("anchor"), text.alias("markdown"))
    sections = one(1, F.concat(F.lit("# "), "title", F.lit("\ntext "))).unionByName(one(2, F.lit("  "))).unionByName(one(3, F.lit("more\nof it")))
    corpus = C.build_corpus(pages, sections, EXCLUDE, knowledge=True)
    listed = C.corpus_manifest(corpus).select("ord", F.array_join(F.transform("segments", lambda x: F.concat(F.coalesce(x["title"], F.lit("")), F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"))), " ").alias("segments"))
    return corpus.select("ord", "route", "title", "knowledge", "lines", "markdown").join(listed, "ord")


_DETAIL = [("/", "home", None, None, 0), ("/blog", None, None, None, 1), ("/blog/:slug", None, None, None, 2), ("/team", "people", "/team.json", None, 3), ("/team/:who", None, None, None, 4), ("/deep", None, None, None, 5), ("/deep/er", None, None, None, 6), ("/deep/er/:id", None, None, None, 7), ("/x/:a/:b", "people", None, None, 8), ("/staff/:who", "people", None, None, 9)]


@query("SELECT * FROM (VALUES ('home', '/blog', '/blog/:slug', NULL, 'slug'), ('people', '/team', '/team/:who', '/team.json', NULL)) t(name, route, pattern, path, field)")
def record_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("s", *r) for r in _DETAIL], "site_id string, route string, query string, fetch_path string, parent string, ord long")
    queries = spark.createDataFrame([("s", "home", "https://x.org", "slug"), ("s", "people", None, None)], "site_id string, name string, url string, field string")
    return S.record_routes(pages, queries).drop("site_id")


@query("SELECT * FROM (VALUES (1, 'own'), (2, 'social'), (3, 'summary'), (4, NULL)) t(i, description)")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, " own ", "social", "summary"), (2, " ", "social", "summary"), (3, None, "", "summary"), (4, None, None, " ")], "i int, a string, b string, c string")
    return rows.select("i", C.description(F.col("a"), F.col("b"), F.col("c")).alias("description"))


@query("SELECT * FROM (VALUES ('/old.md', 'redirect', 302, '/new.md?a=1#x'), ('/gone.md', 'redirect', 302, '/nowhere'), ('/out.md', 'redirect', 302, 'https://x.org/y'), ('/new.md', 'page', 200, NULL), ('/b/anything.md', 'record', 200, NULL), ('/no.md', 'notFound', 404, NULL), ('/new', NULL, NULL, NULL)) t(path, kind, status, location)")
def md_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("/old", "/new?a=1#x"), ("/gone", "/nowhere"), ("/out", "https://x.org/y"), ("/new", None), ("/b/:id", None)]
    pages = spark.createDataFrame([("s", i, r, to, None, None) for i, (r, to) in enumerate(rows)], "site_id string, ord long, route string, redirect string, has_content boolean, is_dynamic boolean")
    asked = spark.createDataFrame([("s", p) for p in ("/old.md", "/gone.md", "/out.md", "/new.md", "/b/anything.md", "/no.md", "/new")], "site_id string, path string")
    return RQ.resolve_markdown(asked, pages, pages.where("redirect is null")).select("path", "kind", "status", "location")
