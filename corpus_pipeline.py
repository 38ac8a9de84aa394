"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and is the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparloom.llm.common import materialize, table
from sparloom.llm.decontaminate import drop_contaminated
from sparloom.llm.mixing import mix_sources
from sparloom.llm.queries import tokenizer_path
from sparloom.llm.simhash import drop_near_duplicates
from sparloom.llm.token_files import read_token_files, write_token_files
from sparloom.llm.toxicity import drop_toxic, train_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train_on(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix, in the order of the files: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, tokenizer_path(), memo=400_000))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: A string kernel, SimHash and a tokenizer are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, wide=True)
    return STAGES[-1][1](spark, docs, sf_dir)
