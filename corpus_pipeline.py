"""A corpus pipeline: quality, toxicity, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the next one gets as its documents after it has
been written and read back. All but the last return the columns of the documents.

Defined results, in every stage: null texts count as empty, and nulls in other columns don't matter; rows with a null
id are judged by their text and stay where a choice needs an id; repeated rows are judged alike and stay together (of
near copies with different ids one id stays, with all its rows); texts are read whole, whatever their length; further
columns pass through unchanged, also those named as an operator's results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_dp, decontaminate, ngram_join, quality_knn, toxicity
from quillspark.llm.registered import table, tokenizer_path
from quillspark.llm.store import written


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The documents for which ``condition`` holds on the columns that ``judge`` adds to doc_id and text. Other columns
    are packed away meanwhile, so that none is taken for a result."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("__rest__"))
    out = judge(packed).where(condition)
    return out.select(*[F.col(f"`{c}`" if c in ("doc_id", "text") else f"__rest__.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return judged(docs, lambda d: quality_knn.score_quality(d, table(spark, sf_dir, "labels")), "predicted = 1")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return judged(docs, lambda d: toxicity.score_toxicity(d, table(spark, sf_dir, "labels")), "predicted = 0")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 0.8 of their five-word shingles."""
    return ngram_join.keep_one(docs, "doc_id", "text", 5, 80, 100).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    return judged(docs, lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark")), "NOT contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    return bpe_dp.encode_texts(docs, tokenizer_path(), digests=False).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("quality", quality), ("toxicity", toxic), ("ngram_join", near_copies), ("decontaminate", benchmark), ("bpe_encode", encode)]

#: The classifiers and the tokenizer can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
