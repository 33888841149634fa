"""Corpus pipeline: language ID, quality, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; `run` writes it to the shared
folder and hands the rows it reads back to the next stage. All stages but the last return the columns of docs. Null and
empty texts are rejected by the first stage (no letter); repeated rows of one document end as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import decontam, langid, minhash, packing, quality
from tickloom.llm.common import materialize, remainder, small_batches, small_enough
from tickloom.llm.queries import THRESHOLD, quality_rows, table, tokenizer_path

MIN_LANGUAGE_SCORE = 0.2  # out-of-place similarity below which no language is accepted
CACHED_CHUNKS = 120_000  # of the encoder, as its workers serve the other stages too
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be sent to all tasks


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in gone (doc_id)."""
    gone = materialize(gone.select(F.col("doc_id").alias("_gone")).where("_gone IS NOT NULL").distinct())
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST_IDS) else gone
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    profiles = langid.train_profiles(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = langid.predictor(profiles)("text")
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= MIN_LANGUAGE_SCORE))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(quality_rows(docs, table(spark, sf_dir, "labels")))
    return docs.where(quality.scorer(spark, model)("text") >= THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    marked = materialize(minhash.near_duplicates(docs, shingle=5, threshold=0.8))
    kept = _without(docs, marked.where("NOT kept"))
    repeated = marked.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL")
    return kept if small_enough(repeated, 0) else kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _without(docs, decontam.leaks(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids and their places in sequences."""
    return packing.pack(packing.cut(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, cache=CACHED_CHUNKS))


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None  # trained models and the packing have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
