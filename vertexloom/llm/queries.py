"""Registered queries: each operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vertexloom.llm import alignment, byte_bpe, cap_filters, dart_minhash, hard_negatives, language_id, licenses, line_dedup, packing, pstable_ann, quality, token_store, url_filter, vectors
from vertexloom.llm.common import held_out, table
from vertexloom.operators.scratch import Scratch, scratch_root


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs)
    found = language_id.language_labels(docs, model)
    labelled = docs.select("doc_id", held_out().alias("held_out"), found.alias("found"))
    return labelled.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", F.size("found.spans").alias("n_spans"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.quality_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def line_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, Scratch(spark))
    return kept.select(
        "doc_id",
        F.coalesce("__n_lines", F.lit(0)).alias("n_lines"),
        F.size("__removed").alias("n_removed"),
        F.array_join("__removed", ",").alias("removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


def document_path() -> Column:
    """A tree over the documents: source, thousand, hundred; every hundredth is a licence file.

    The table has no paths.  Ids divisible by 10,000 and by 1,000 lie one and two
    levels higher, so that there are licence files at every level.
    """
    doc, hundred, thousand = F.col("doc_id"), F.expr("doc_id div 100"), F.expr("doc_id div 1000")
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return (
        F.when(doc % 10_000 == 0, F.concat_ws("/", source, F.lit("LICENSE")))
        .when(doc % 1_000 == 0, F.concat_ws("/", source, thousand, F.lit("LICENSE")))
        .when(doc % 100 == 0, F.concat_ws("/", source, thousand, hundred, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", source, thousand, hundred, F.concat(doc, F.lit(".txt"))))
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", document_path().alias("path"))
    return licenses.find_licenses(docs, Scratch(spark)).drop("text")


def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dart_minhash.near_duplicates(docs, Scratch(spark))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def byte_bpe_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.of_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pstable_ann.nearest(rows, Scratch(spark), F.col("vec_id") % 20 == 0)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return token_store.read_digests(spark, path)


def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.of_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = cap_filters.cosine_links(rows, Scratch(spark))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = own.select("vec_id", label.alias("label"), F.col("embedding").alias("v"))
    return hard_negatives.hard_negatives(rows, Scratch(spark), F.col("vec_id") % 100 == 0)


#: Rules of the registered query: host, beginning of the path, allow.
URL_RULES = [
    ("com", "/", True),
    ("example.com", "/en/", False),
    ("www.example.com", "/en/", True),
    ("net", "/es/", False),
    ("net", "/fr/", False),
]


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge_urls(pages, URL_RULES, Scratch(spark)).drop("url")


def alignment_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(docs, Scratch(spark))


ALL = {
    "op1_language_id": language,
    "op2_quality": quality_scores,
    "op3_line_dedup": line_dedup_digest,
    "op4_licenses": license_scan,
    "op5_dart_minhash": minhash,
    "op6_packing": packed,
    "op7_byte_bpe": byte_bpe_digest,
    "op8_multiprobe_ann": nearest_vectors,
    "op9_token_files": token_files,
    "op10_cap_filters": embedding_duplicates,
    "op11_hard_negatives": negatives,
    "op12_url_filter": url_verdicts,
    "op13_alignment": alignment_digests,
    "pipeline": corpus_pipeline.run,
}
