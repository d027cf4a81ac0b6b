"""Columns of callers kept apart from the operators' own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) as strings, for Python workers: a nullable integer would lose digits on its way into pandas."""
    return docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))


def rekeyed(result: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The result with the column ``key`` in its own type and under its own name again."""
    kind = docs.schema[key].dataType
    return result.select(F.col("key").cast(kind).alias(key), *[c for c in result.columns if c != "key"])


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named c0, c1, ... and the new names of those asked for, so that an operator's
    columns cannot clash with any of them; ``toDF(*docs.columns)`` names them back."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return inner, [f"c{docs.columns.index(n)}" for n in names]
