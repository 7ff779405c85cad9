"""From raw documents to token ids: quality, language, near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) with ``docs`` as its predecessor left them, and returns a
frame that is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, langid, mixing, neardup, quality
from pagemill.llm.common import cut_lineage, read, tidied

#: A text needs a language, and most of its words in it.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one language; texts without letters go."""
    model = langid.train(docs.where(langid.learnable(F.col("doc_id"), F.col("lang"))))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return neardup.group(docs).where("kept").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to twice)."""
    return mixing.expand(mixing.mix(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and a digest of what they decode to."""
    both = bpe.decode(bpe.encode(docs))
    return both.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The language model and the subset sums cannot be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with tidied(spark) as kept:
        for i, (_, stage) in enumerate(STAGES):
            write = kept if i == len(STAGES) - 1 else cut_lineage
            docs = write(stage(spark, docs, sf_dir))
    return docs
