"""A training-data pipeline of four operators: quality filter, near-dedup, decontamination, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last adds the ids of each kept text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from methylake.llm import decontaminate, minhash, pieces_fst, quality
from methylake.llm.common import written
from methylake.llm.queries import table, tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this table's labelled rows, predicts as good."""
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, k=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's SentencePiece ids, and the text that they decode to."""
    return pieces_fst.with_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", keep_good), ("near_dedup", keep_distinct), ("decontamination", keep_uncontaminated), ("sentencepiece", to_pieces)]

#: SQL can express neither the learned filter nor the segmentation: see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
