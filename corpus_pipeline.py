"""Cleaning of a corpus: toxic documents, exact copies, near copies, repeated passages, packing.

Each stage takes the documents that the one before kept and, but for the last, returns the
columns of documents.  No SQL expresses a learned filter, so the stages are tested against
plain versions of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from tapewire.llm.common import documents, in_few_files, saved
from tapewire.llm.queries import tokenizer
from tapewire.sources.sinks import work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A passage goes from here on: bytes that also stand in a document of smaller id.
PASSAGE, SEED = 200, 32
#: Documents that are sent to Python at once (a batch is held whole, in several copies), and documents of a file.
BATCH, FILE_DOCUMENTS = 2000, 4000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(stage: Stage) -> Stage:
    """``stage`` with batches of BATCH rows for Python, if the session has larger ones: from then on, as
    what it returns runs later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH:
            spark.conf.set(_BATCH, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``ids`` (one column ``_gone``); rows without an id stay."""
    left = docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_gone"), "left_anti")
    return in_few_files(left, docs.count(), FILE_DOCUMENTS)


@in_batches
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model learned from the labels of ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = saved(toxicity.score(spark, docs, model), "toxicity")
    return without(docs, scores.where("score >= 0.5 and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one of smallest id."""
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark, work_dir(spark, "digest_index")))


@in_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one of smallest id."""
    groups = near_dedup.near_groups(docs, width=5, percent=80)
    return without(docs, groups.where("not kept").select(F.col("doc_id").alias("_gone")).distinct())


@in_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also stand in a document of smaller id; ``n_chars`` follows."""
    keyed = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    left = suffix_dedup.remove_repeats(docs, length=PASSAGE, seed=SEED, with_text=True)
    cut = left.where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), "kept_text")
    shorter = saved(cut.groupBy("_id", "_text").agg(F.first("kept_text").alias("kept_text")), "cut_texts")
    text = F.coalesce("kept_text", "text")
    out = keyed.join(shorter.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("_sha") == F.col("_text")), "left")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


@in_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, window=4096)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
