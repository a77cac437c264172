"""Queries over the text tables: thin calls of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, mixing, ngram_join, oracles, quality_model, quality_rules, secret_scan, substring_dedup, toxicity, vector_codes, warc_revisits, whitening
from .storage import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    spans = secret_scan.span_text(F.col("base_spans"))
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.crawl_records(read_table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_boilerplate(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed_lines")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_errors(*vector_codes.compress(read_table(spark, sf_dir, "embeddings")))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc_revisits": warc_revisits.sql(),
    "op4_quality_rules": oracles.QUALITY,
    "op5_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op8_line_dedup": line_dedup.sql(),
    "op9_benchmark_decontamination": oracles.CONTAMINATION,
    "op10_source_mixing": mixing.sql(),
    "op12_vector_codes": vector_codes.sql(),
}
