"""Writers: article previews and partition-replacing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_preview(articles: DataFrame, path: str, fmt: str = "json") -> None:
    """Parsed articles for review, as JSON lines or parquet."""
    articles.write.mode("overwrite").format(fmt).save(path)


def replace_laws(df: DataFrame, path: str, key: str | None = None, salts: int = 8, law: str = "law_no") -> None:
    """Replace exactly the laws present in ``df``; other partitions stay as they are.

    Rows are dealt by law and a salt of the key (if not given, of all other columns that can be hashed): a law has
    at most ``salts`` files, and one big law is written by as many tasks.
    """
    hashed = [key] if key else [n for n, kind in df.dtypes if n != law and "map<" not in kind]
    (df.repartition(law, F.pmod(F.xxhash64(*hashed), F.lit(salts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(law).parquet(path))
