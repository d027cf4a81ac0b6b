"""Training-data pipeline over the documents table; stages are written and reread as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import bpe, fertility, line_chunks, mixing, ngram_join
from statuta.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the text."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text passes the base rule and its script's fertility band; null texts go."""
    return fertility.keep(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of passages that stood in an earlier one; texts may become empty."""
    # n_chars is counted anew; carried along, it would keep both uses of the texts from sharing an exchange
    return _recounted(line_chunks.dedup(docs.select(*[c for c in COLUMNS if c != "n_chars"]))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; documents without words have none and stay."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time the mix takes them, the last one of a source cut at its budget."""
    return _recounted(mixing.mix(docs.select(*COLUMNS)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_encoding", encoding),
]

#: Most stages are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its rows, and the next one reads them."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
