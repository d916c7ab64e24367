"""A training corpus from raw documents: quality rules, one of each near-duplicate group, repeated passages out, sources mixed, BPE ids.

Each stage is written as Parquet and read again as the next one's documents. Null and empty texts fail the quality rules and go there; an empty table
stays empty. Rows with equal doc_id and text become one in the second stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.bpe import encode_texts
from palimpsest.llm.common import shared_dir
from palimpsest.llm.mixing import mixed_documents
from palimpsest.llm.ngram_join import one_of_each
from palimpsest.llm.passages import remove_passages
from palimpsest.llm.quality import keep_quality

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingle sets with similarity 0.8 or more connect."""
    return one_of_each(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that near-duplicate an earlier document's."""
    return remove_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them, by shard and in each shard's order."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    return encode_texts(docs, TOKENIZER).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("tokens", tokens)]

#: The classifier, the min-hashes and the tokenizer have no SQL form. Brute-force tests cover the operators of all stages and `one_of_each`.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
