"""Registered queries of the corpus operators: (query, SQL or None) by name. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import byte_bpe, collocations, decontamination, html_labeller, jaccard_join, language, oracle, pitman_yor, quality_rules, simhash, substrings, token_files, weak_labels, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_labeller.extract(pages, html_labeller.trained(pages))


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = weak_labels.label_model(docs)
    return weak_labels.score(docs, model, weak_labels.train(docs, model))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pitman_yor.score(docs, *pitman_yor.train(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    found = decontamination.with_members(decontamination.contaminated(table(spark, sf_dir, "documents"), benchmark), benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.max("consistency").alias("consistency"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_labeller": (op1_html_labeller, None),
    "op2_weak_labels": (op2_weak_labels, None),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_simhash": (op4_simhash, None),
    "op5_substrings": (op5_substrings, None),
    "op6_token_files": (op6_token_files, None),
    "op7_pitman_yor": (op7_pitman_yor, None),
    "op8_decontamination": (op8_decontamination, None),
    "op9_language": (op9_language, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_collocations": (op11_collocations, oracle.COLLOCATIONS),
    "op12_whitening": (op12_whitening, None),
    "op13_jaccard_join": (op13_jaccard_join, oracle.JACCARD_JOIN),
}
