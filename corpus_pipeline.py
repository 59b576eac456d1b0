"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on what its predecessor kept;
between stages the documents are written as Parquet and read again, so a lost
executor costs the current stage only.  All stages but the last return the
columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import dart_minhash, language_id, line_dedup, packing, quality
from vertexloom.operators.scratch import Scratch

MIN_LANGUAGE_SCORE = 0.5

#: No stage's scores can be written in SQL: the classifiers compress and train, hashing
#: and packing are procedural.  tests/llm compares the stages with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold of the classifier."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    scored = docs.withColumn("__score", quality.quality_score(docs, model))
    return scored.where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those of no letters, or too mixed or unsure, go."""
    model = language_id.fit_languages(docs)
    labelled = docs.withColumn("__found", language_id.language_labels(docs, model))
    sure = (F.col("__found.lang") != language_id.UNKNOWN) & (F.col("__found.score") >= MIN_LANGUAGE_SCORE)
    return labelled.where(sure).drop("__found")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated runs of lines; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs, Scratch(spark))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.size("__removed") > 0, length).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Rows that share this id and its text are one document and one of them stays;
    of a class without any id, one row stays.
    """
    found = dart_minhash.near_duplicates(docs, Scratch(spark)).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stays = found.groupBy(F.col("doc_id").alias("__doc_id")).agg(F.min("text_key").alias("__key")).where("__doc_id IS NOT NULL")
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumn("__md5", text)
    same = (F.col("doc_id").cast("long") == F.col("__doc_id")) & (F.col("__md5") == F.col("__key"))
    kept = own.join(stays, same, "left_semi")
    # A class without any id keeps the first of its texts by key.
    nameless = found.where("class_id IS NULL").groupBy("component").agg(F.min("text_key").alias("__key")).select("__key")
    kept = kept.unionByName(own.where("doc_id IS NULL").join(nameless, F.col("__md5") == F.col("__key"), "left_semi"))
    return kept.dropDuplicates(["doc_id", "__md5"]).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents kept, and the sequences they lie in."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_each),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
