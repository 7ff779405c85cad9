"""The driver's tables as the engine's model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search entries; the title is the first line."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"), F.lit(0.6).alias("weight")
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every benchmark item as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions hold nations, nations hold suppliers; flags by remainders of the keys."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    no = F.lit(False)
    r = region.select(
        (F.col("r_regionkey").cast("long") * 10**9).alias("ord"), F.concat(F.lit("/r"), "r_regionkey").alias("route"), F.col("r_name").alias("title"),
        no.alias("has_content"), (F.col("r_regionkey") % 5 == 4).alias("hidden"), no.alias("noindex"), no.alias("knowledge"),
    )
    letter = F.when(F.col("n_nationkey") % 5 == 0, F.lit("/v")).otherwise(F.lit("/n"))
    place = F.concat(F.lit("/r"), "n_regionkey", letter, "n_nationkey")
    at = F.col("n_regionkey").cast("long") * 10**9 + (F.col("n_nationkey").cast("long") + 1) * 10**6
    n = nation.select(
        at.alias("ord"), place.alias("route"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, no).alias("has_content"), no.alias("hidden"),
        (F.col("n_nationkey") % 7 == 3).alias("noindex"), (F.col("n_nationkey") % 6 == 5).alias("knowledge"),
    )
    k = F.col("s_suppkey")
    leaf = F.concat(place, F.when(k % 17 == 0, F.lit("/_s")).when(k % 19 == 0, F.lit("/:s")).otherwise(F.lit("/s")), k)
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (at + k).alias("ord"), leaf.alias("route"), F.col("s_name").alias("title"), F.lit(None).cast("boolean").alias("has_content"),
        (k % 11 == 0).alias("hidden"), (k % 13 == 0).alias("noindex"), no.alias("knowledge"),
    )
    none = F.lit(None).cast("string")
    return r.unionByName(n).unionByName(s).select(
        F.lit("site").alias("site_id"), "*", F.lit(None).cast("boolean").alias("is_dynamic"), none.alias("label"), F.concat(F.lit("About "), "title").alias("description")
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, site_id (host), route, locale, title, h1 and article text of raw pages."""
    html = F.col("html")
    pick = lambda pattern: F.regexp_extract(html, pattern, 1)
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    route = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("site_id"), F.when(route == "", F.lit("/")).otherwise(route).alias("route"),
        pick('(?s)<html[^>]*lang="([^"]*)"').alias("locale"), pick("(?s)<title>(.*?)</title>").alias("title"), pick("(?s)<h1[^>]*>(.*?)</h1>").alias("h1"),
        pick("(?s)<article[^>]*>(.*?)</article>").alias("article"),
    )
