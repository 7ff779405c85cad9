"""Inverted index, BM25F ranking in query batches, completions and spelling fallback.

Entries have doc, title, content and weight. Everything is a join on terms: postings meet query
terms, scores are sums by (query, document), the best of each query come from a bounded rank.
Scores are rounded to 6 places before they are compared; ties go to the smaller document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import new_path, written

K1, B_TITLE, B_BODY, W_TITLE, W_BODY, WEIGHT = 1.2, 0.5, 0.75, 3.0, 1.0, 0.6
PREFIX_MIN, PREFIX_CAP, PREFIX_PART = 2, 24, 0.5
FUZZY_MIN, FUZZY_SCAN, FUZZY_KEEP = 4, 400, 8
PHRASE_WINDOW, PHRASE_BOOST = 200, 1.35


@dataclass
class Index:
    """A written index: its tables, and the one row of statistics.

    ``docs``: doc, weight and the folded texts. ``postings``: term, doc, tf_title, tf_body, len_title,
    len_body, weight, sorted by term within files, so that readers skip row groups. ``terms``: term, df.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    avg_title: float
    avg_body: float

    def dictionary(self) -> DataFrame:
        """term, df."""
        return self.terms

    def lengths(self) -> DataFrame:
        return self.docs.select("doc", "len_title", "len_body", "weight")

    def stats(self) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([(self.n, self.avg_title, self.avg_body)], "n long, avg_title double, avg_body double")


def build(entries: DataFrame, path: str | None = None) -> Index:
    """Fold, cut and write once, to ``path`` or a new folder of the shared one; ``open_index`` reads it again."""
    spark = entries.sparkSession
    path = path or new_path(spark, "index")
    folded = entries.select("doc", "weight", X.fold("title").alias("title_folded"), X.fold("content").alias("body_folded"))
    cut = folded.select("*", X.terms(F.col("title_folded")).alias("title_terms"), X.terms(F.col("body_folded")).alias("body_terms"))
    docs = written(cut.withColumns({"len_title": F.size("title_terms").cast("long"), "len_body": F.size("body_terms").cast("long")}), f"{path}/docs")
    one = lambda t, a, b: F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(a).alias("t"), F.lit(b).alias("b")))
    rows = docs.select("doc", "len_title", "len_body", "weight", F.explode(F.concat(one("title_terms", 1, 0), one("body_terms", 0, 1))).alias("x"))
    rows = rows.groupBy("x.term", "doc", "len_title", "len_body", "weight").agg(F.sum("x.t").alias("tf_title"), F.sum("x.b").alias("tf_body"))
    # by range, so that a term that most documents hold is cut over several files
    written(rows.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc"), f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    written(postings.groupBy("term").agg(F.count("*").alias("df")), f"{path}/terms")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    written(docs.agg(F.count("*").alias("n"), mean("len_title").alias("avg_title"), mean("len_body").alias("avg_body")), f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    docs, postings, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms", "stats"))
    return Index(docs, postings, terms, *stats.first())


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, text, folded, tokens of queries (qid, text)."""
    return queries.select("qid", "text", X.fold("text").alias("folded")).withColumn("tokens", X.terms(F.col("folded")))


def completions(dictionary: DataFrame, prefixes: DataFrame, cap: int = PREFIX_CAP) -> DataFrame:
    """qid, term, df of dictionary terms that begin with (qid, prefix): the ``cap`` most frequent."""
    p = prefixes.where(F.length("prefix") >= PREFIX_MIN).withColumn("head", F.substring("prefix", 1, PREFIX_MIN))
    d = dictionary.withColumn("head", F.substring("term", 1, PREFIX_MIN))
    hit = d.join(p, "head").where(F.col("term").startswith(F.col("prefix")))
    return hit.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("df"), "term"))).where(F.col("r") <= cap).select("qid", "term", "df")


def corrections(dictionary: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, token, term, df, r: terms one edit away among the first 400 with the same first letter."""
    scan = dictionary.withColumn("head", F.substring("term", 1, 1))
    scan = scan.withColumn("at", F.row_number().over(Window.partitionBy("head").orderBy("term"))).where(F.col("at") <= FUZZY_SCAN)
    w = wanted.where(F.length("token") >= FUZZY_MIN).withColumn("head", F.substring("token", 1, 1))
    near = scan.join(w, "head").where((F.abs(F.length("term") - F.length("token")) <= 1) & (F.col("term") != F.col("token")))
    near = near.where(X.within_one_edit(F.col("term"), F.col("token")))
    r = F.row_number().over(Window.partitionBy("qid", "token").orderBy(F.desc("df"), "term"))
    return near.withColumn("r", r).where(F.col("r") <= FUZZY_KEEP).select("qid", "token", "term", "df", "r")


def score(index: Index, weights: DataFrame) -> DataFrame:
    """qid, doc, score of weighted query terms (qid, term, mult); only their postings are read."""
    part = lambda tf, length, mean, b: F.lit(0.0) if mean == 0 else F.col(tf) / (1 - b + b * F.col(length) / mean)
    tf = W_TITLE * part("tf_title", "len_title", index.avg_title, B_TITLE) + W_BODY * part("tf_body", "len_body", index.avg_body, B_BODY)
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = index.postings.join(weights.join(index.dictionary(), "term"), "term")
    scored = rows.select("qid", "doc", "weight", (F.col("mult") * idf * tf * (K1 + 1) / (tf + K1)).alias("s"))
    return scored.groupBy("qid", "doc").agg(F.round(F.sum("s") * F.coalesce(F.first("weight"), F.lit(WEIGHT)), 6).alias("score"))


def top(scored: DataFrame, limit: Column | int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", r).where(F.col("rank") <= limit)


def weights_of(index: Index, asked: DataFrame, prefix: bool) -> DataFrame:
    """qid, term, mult and place (kind, n) of exact terms, in the query's order, and, for the last token, completions."""
    exact = asked.select("qid", F.posexplode(F.array_distinct("tokens")).alias("n", "term"))
    exact = exact.select("qid", "term", F.lit(1.0).alias("mult"), F.struct(F.lit(0).alias("kind"), F.col("n").cast("long").alias("n")).alias("place"))
    if not prefix:
        return exact
    last = asked.where((F.size("tokens") > 0) & ~F.col("text").rlike(f"{X.WIDE_SPACE}$")).select("qid", F.try_element_at("tokens", F.lit(-1)).alias("prefix"))
    more = completions(index.dictionary(), last).select("qid", "term", F.lit(PREFIX_PART).alias("mult"), F.struct(F.lit(1).alias("kind"), (-F.col("df")).alias("n")).alias("place"))
    return exact.unionByName(more).groupBy("qid", "term").agg(F.max("mult").alias("mult"), F.min("place").alias("place"))


def _in_order(place: Column, value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), value.alias("value")))), lambda x: x["value"])


def scored_terms(index: Index, queries: DataFrame, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """qid, terms, corrections of the queries that match: what ``rank`` scores with.

    ``terms`` are dictionary terms: a query's own in its order and completions, the commonest first,
    or else its corrections, by token and the commonest first. ``corrections`` (token and the
    commonest term for it, in the query's order) is null unless the fallback answered.
    """
    asked, dictionary = query_terms(queries), index.dictionary()
    found = weights_of(index, asked, prefix).join(dictionary, "term", "left_semi").groupBy("qid").agg(_in_order(F.col("place"), F.col("term")).alias("terms"))
    pair = "array<struct<token:string,to:string>>"
    found = found.withColumn("corrections", F.lit(None).cast(pair))
    if not fuzzy:
        return found
    missed = asked.join(found.select("qid"), "qid", "left_anti").select("qid", F.posexplode(F.array_distinct("tokens")).alias("n", "token"))
    near = corrections(dictionary, missed.select("qid", "token")).join(missed, ["qid", "token"])
    first = F.when(F.col("r") == 1, F.struct("token", F.col("term").alias("to")))
    near = near.groupBy("qid").agg(
        F.array_distinct(_in_order(F.struct("n", "r"), F.col("term"))).alias("terms"),
        F.filter(_in_order(F.struct("n", "r"), first), lambda x: x.isNotNull()).cast(pair).alias("corrections"),
    )
    return found.unionByName(near)


def rank(index: Index, queries: DataFrame, limit: int = 10, prefix: bool = True, fuzzy: bool = True, phrase: bool = True) -> DataFrame:
    """qid, rank, doc, score, total, fuzzy for a batch of queries (qid, text)."""
    asked = query_terms(queries)
    weights = weights_of(index, asked, prefix).drop("place")
    flags = asked.select("qid", F.lit(False).alias("fuzzy"))
    if fuzzy:
        # a query has hits if the dictionary has a term of it
        missed = asked.join(weights.join(index.dictionary(), "term", "left_semi").select("qid"), "qid", "left_anti")
        near = corrections(index.dictionary(), missed.select("qid", F.explode(F.array_distinct("tokens")).alias("token")))
        weights = weights.unionByName(near.select("qid", "term").distinct().withColumn("mult", F.lit(1.0)))
        flags = flags.join(missed.select("qid", F.lit(True).alias("missed")), "qid", "left").select("qid", F.coalesce("missed", F.lit(False)).alias("fuzzy"))
    scored = score(index, weights)
    totals = scored.groupBy("qid").agg(F.count("*").alias("total")).join(flags, "qid")
    columns = ["qid", "rank", "doc", "score", "total", "fuzzy"]
    if not phrase:
        return top(scored, limit).join(totals, "qid").select(*columns)
    head = top(scored, max(limit, PHRASE_WINDOW)).join(totals, "qid")
    many = asked.where(F.size("tokens") > 1).select("qid", "folded")
    found = (
        head.where((F.col("rank") <= PHRASE_WINDOW) & ~F.col("fuzzy")).select("qid", "doc").join(many, "qid")
        .join(index.docs.select("doc", F.concat_ws(" ", "title_folded", "body_folded").alias("whole")), "doc")
        .where(F.contains("whole", "folded")).select("qid", "doc", F.lit(PHRASE_BOOST).alias("boost"))
    )
    lifted = head.drop("rank").join(found, ["qid", "doc"], "left").withColumn("score", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 6))
    return top(lifted, limit).select(*columns)
