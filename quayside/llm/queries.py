"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import language_id, license_scan, line_dedup, max_sketch, mtree, packing, pii, pivot_index, quality_classifier, quality_rules, sentencepiece, simhash, spelling
from quayside.llm.common import finished, ship, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepiece.sentencepiece_n_best(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return finished(spark, "op2", lambda: mtree.top_products(vectors))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), inside=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), labels)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return finished(spark, "op11", lambda: pivot_index.near_vectors(vectors))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(spark, "op12", lambda: max_sketch.lexical_search(docs, table(spark, sf_dir, "benchmark")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(spark, "op13", lambda: spelling.spelling_variants(docs))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_exact_top_k, op3_license_scan, op4_language_id, op5_best_fit_packing, op6_quality_rules, op7_pii, op8_simhash, op9_line_dedup, op10_quality_classifier, op11_embedding_near_dedup, op12_ranked_search, op13_spelling_variants)}
SQL = {"op2_exact_top_k": mtree.SQL, "op3_license_scan": license_scan.sql(), "op6_quality_rules": quality_rules.sql(), "op9_line_dedup": line_dedup.SQL, "op11_embedding_near_dedup": pivot_index.SQL, "op12_ranked_search": max_sketch.SQL}
