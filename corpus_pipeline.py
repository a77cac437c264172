"""A corpus pipeline over documents: toxicity, line dedup, near duplicates, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage works on every row that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from gridspark.llm.storage import materialize, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among them, calls toxic go."""
    return toxicity.accepted(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites leave the texts; every document stays, and n_chars follows its text. A text of such lines
    alone stays whole, so that the next stage sees copies."""
    out = line_dedup.without_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a Jaccard of 0.8 on five words; op5 has its own values) stays."""
    return ngram_join.keep_one(docs, percent=80, k=5)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which the documents that are left are read, in the mix of their sources."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The toxicity model is trained, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
