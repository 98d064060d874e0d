"""A corpus pipeline: language, toxicity, near duplicates, decontamination,
packing.  Each stage takes all rows that the one before kept; all but the last
return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stocktake.llm import decontam, langid, near, packing, toxicity
from stocktake.llm.common import Workspace

TOKENIZER, END = "word_bpe_49k.json", 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no learned language explains, and those without a
    letter (null and empty texts, too); learn from the labelled part of ``docs``.
    Without labels only documents without a letter go; repeated rows, null ids
    and further columns are kept as they are; an empty table stays empty."""
    return langid.drop_unidentified(docs, langid.training_text(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents; learn from those of ``docs`` that ``labels`` marks.
    Without labels the grammar's own lists count.  Null ids match no label;
    repeated rows go or stay together; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the least id.
    Texts without words to compare stay; of repeated rows one stays; null ids
    come last in a group; an empty table stays empty."""
    return near.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.  Texts without words, null ids
    and further columns stay; repeated rows go or stay together; without
    benchmark or documents nothing changes."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents left into training windows: one row for each piece.
    Null and empty texts have one id, the end; repeated rows and null ids are
    packed like others; an empty table gives no piece."""
    return packing.digest_pieces(packing.pack(docs, public_tokenizers.path(TOKENIZER), END))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("packing", packed),
]

#: suffix automata, learned grammars and tokenizers have no SQL; tests hold each
#: stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read
    again by the next.  The last table is dropped when the driver ends."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
