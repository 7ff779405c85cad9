"""A site's content as JSON files, one site and language a file, to the model's tables; text artifacts to files.

Rich text and parameters stay JSON text, with their keys in the order written. Fields that a file
lacks are null, others are ignored, and a file that is no JSON object, or has no pages, has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = """struct<route: string, title: string, label: string, description: string, keywords: array<string>, hidden: boolean, hasContent: boolean,
isDynamic: boolean, isIndex: boolean, knowledge: boolean, redirect: string, rewrite: string, lastModified: string, parent: string, sections: string,
seo: struct<noindex: boolean, ogDescription: string, canonical: string, changefreq: string, priority: string>>"""
SITE = f"config string, pages array<{PAGE}>"
SECTION = T.ArrayType(T.StructType().add("path", T.ArrayType(T.IntegerType())).add("section_id", T.StringType()).add("anchor", T.StringType()).add("component", T.StringType()).add("hidden", T.BooleanType()).add("param_title", T.StringType()).add("doc", T.StringType()))


def _flat(sections, above: tuple[int, ...] = ()) -> Iterator[tuple]:
    for i, s in enumerate(sections if isinstance(sections, list) else [], 1):
        if not isinstance(s, dict):
            continue
        path, name, stable = (*above, i), s.get("id") or s.get("stableId"), s.get("stableId") or s.get("id")
        params, doc = s.get("params"), s.get("content")
        title = params.get("title") if isinstance(params, dict) else None
        yield (
            list(path), None if name is None else str(name), None if stable is None else f"section-{stable}", s.get("component") or s.get("type"), s.get("hidden") is True,
            title if isinstance(title, str) else None, json.dumps(doc, ensure_ascii=False) if isinstance(doc, dict) else None,
        )
        yield from _flat(s.get("subsections"), path)


@F.pandas_udf(SECTION)
def flat_sections(sections: pd.Series) -> pd.Series:
    """A tree of sections as rows: [2, 1] is the first one in the second."""
    return sections.map(lambda x: list(_flat(json.loads(x))) if x else [])


def read_sites(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites, pages and sections of ``<path>/<site_id>/<locale>.json``, columns as the operators take them; ``ord`` is a page's place."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    site = files.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("site_id"), F.regexp_extract(file, r"([^/]+)\.json$", 1).alias("locale"), F.from_json("value", SITE).alias("s"))
    sites = site.where("s is not null").select("site_id", "locale", F.col("s.config").alias("config"))
    pages = site.select("site_id", "locale", F.posexplode("s.pages").alias("ord", "p")).withColumn("ord", F.col("ord").cast("long"))
    renamed = {"has_content": "hasContent", "is_dynamic": "isDynamic", "is_index": "isIndex", "lastmod": "lastModified"}
    same = ("route", "title", "label", "description", "keywords", "hidden", "knowledge", "redirect", "rewrite", "parent")
    seo = {"noindex": "noindex", "og_description": "ogDescription", "canonical": "canonical", "changefreq": "changefreq", "priority": "priority"}
    graph = pages.select(
        "site_id", "locale", "ord", *[F.col(f"p.{c}").alias(c) for c in same], *[F.col(f"p.{c}").alias(n) for n, c in renamed.items()], *[F.col(f"p.seo.{c}").alias(n) for n, c in seo.items()]
    )
    sections = pages.select("site_id", "locale", F.col("p.route").alias("route"), F.explode(flat_sections("p.sections")).alias("x")).select("site_id", "locale", "route", "x.*")
    return sites, graph, sections


def write_texts(artifacts: DataFrame, path: str) -> None:
    """Artifacts (site_id, file, text) as text: a folder for each, with one part file that holds the text as it is."""
    whole = artifacts.select("site_id", "file", F.coalesce("text", F.lit("")).alias("value"))
    whole.repartition("site_id", "file").write.mode("overwrite").option("lineSep", "\n").partitionBy("site_id", "file").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """site_id, file, text as ``write_texts`` wrote them."""
    rows = spark.read.option("basePath", path).schema("value string, site_id string, file string").text(path, wholetext=True)
    return rows.select("site_id", "file", F.regexp_replace("value", r"\n\z", "").alias("text"))
