"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns what it keeps.

All but the last return the columns of `docs`. Every stage reads all rows of its predecessor, learns from labelled rows
among them, and acts on every decision: rejected documents are gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colforge.llm import decontaminate, language, near_dup, packing, toxicity
from colforge.llm.common import crc_fold, free_name, materialize, prepare, shared_dir, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def _row_key() -> Column:
    """64 bits of doc_id and text, never null: the same wherever and however often a row is read."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull())


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without letters, or with two languages alike, they go."""
    model = language.train(docs, crc_fold("doc_id", 4) != 2)
    # Judged beside the row, so that columns named like the operator's come through as they were.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    kept = language.identify(rows, model).where("lang_pred <> 'und' AND NOT lang_ambiguous")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half. Learns from labelled documents outside fold 0 of 5."""
    model = toxicity.train(docs.where(crc_fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return _columns(toxicity.score(docs, model, name).where(F.col(name) < 0.5), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group tied by five-word shingles at 0.8 or more.

    Rows are told apart by doc_id and text. Only rows equal in both are one document; a doc_id under several texts names
    several documents. Rows with a null doc_id are compared like the others and come after those with one; without any
    word each of them stays.
    """
    keyed = docs.select("doc_id", "text", _row_key().alias("__key"))
    # Rows without an id that are equal need one comparison; the others are read in place.
    compared = keyed.where("doc_id IS NOT NULL").unionByName(keyed.where("doc_id IS NULL").dropDuplicates(["__key"]))
    found = near_dup.near_duplicates(compared.select(F.col("__key").alias("doc_id"), "text"), words=5, percent=80)
    found = found.select(F.col("doc_id").alias("__key"), "component_id", (F.col("n_shingles") == 0).alias("blank")).distinct()
    named = keyed.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    named = materialize(named.join(found, "__key"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__key")).alias("first"))
    # Whether a kept row has equals of which one stays.
    several = (F.col("rows") > 1) & ~(F.col("blank") & F.col("doc_id").isNull())
    kept = materialize(named.join(first.select(F.col("first.__key").alias("__key")), "__key", "left_semi").select("__key", several.alias("__several")))
    rows = docs.withColumn("__key", _row_key()).join(kept, "__key")
    return _columns(rows.where("NOT __several"), docs).unionByName(_columns(rows.where("__several").dropDuplicates(["__key"]), docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; each text under a doc_id is judged for itself."""
    keyed = docs.select(_row_key().alias("doc_id"), "text")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct()
    return docs.join(found, _row_key() == found["__key"], "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and their place in it."""
    return packing.pack(docs, _tokenizer(), capacity=2048, end_id=0)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Trained models, sketches and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet to the shared folder and read again by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{shared_dir(spark)}/colforge/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
