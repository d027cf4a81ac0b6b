"""The stored corpus: tables by law for loads, tables by key and by id for lookups.

Loads read and overwrite only the partitions of the laws in a batch.  Lookups join tables that are stored in
buckets of their join key, so that the questions travel to the corpus and never the corpus to the questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import STATUTE_KEY
from ..plans.ingest import incremental_load
from ..session import cut_lineage
from .readers import read_by_law
from .writers import replace_laws

#: Laws of one batch that are sent to every task to prune the stored tables; a larger batch is joined without.
PRUNING_LAWS = 100_000
#: Table -> the column of its partitions.
TABLES = {"articles": "law_no", "chunks": "law_no", "edges": "source_law_no"}


def read_laws(spark: SparkSession, path: str, wanted: DataFrame, law: str = "law_no") -> DataFrame:
    """Rows of the laws that ``wanted(law_no)`` names; only their partitions are read.

    The laws prune the partitions at run time.  The comparison keeps every law; without one the optimizer does
    not take the names for a filter worth waiting for.
    """
    laws = wanted.select(F.col("law_no").alias(law)).distinct().where(F.col(law) >= "")
    few = laws.limit(PRUNING_LAWS + 1).count() <= PRUNING_LAWS
    return read_by_law(spark, path, law).join(F.broadcast(laws) if few else laws, law, "left_semi")


def create_store(path: str, articles: DataFrame, chunks: DataFrame, edges: DataFrame) -> None:
    """First snapshot, each table partitioned by law."""
    for name, rows in zip(TABLES, (articles, chunks, edges), strict=True):
        replace_laws(rows, f"{path}/{name}", law=TABLES[name])


def load_batch(spark: SparkSession, path: str, incoming: DataFrame) -> dict[str, DataFrame]:
    """Loads a batch of articles into the store and returns what ``incremental_load`` found.

    Articles, chunks and edges of the laws in the batch are read and written, all others are neither.
    """
    laws = cut_lineage(incoming.select("law_no").distinct())
    stored = {name: read_laws(spark, f"{path}/{name}", laws, law) for name, law in TABLES.items()}
    result = incremental_load(incoming, stored["articles"], stored["chunks"], stored["edges"])
    # the next snapshot is fixed before any of its sources is overwritten
    fixed = {name: cut_lineage(result[name]) for name in TABLES}
    result |= fixed | {name: cut_lineage(result[name]) for name in ("removed", "summary")}
    for name, law in TABLES.items():
        replace_laws(fixed[name], f"{path}/{name}", law=law)
        left = laws.select(F.col("law_no").alias(law)).join(fixed[name].select(law).distinct(), law, "left_anti")
        drop_laws(spark, f"{path}/{name}", law, [r[0] for r in left.collect()])
    return result


def drop_laws(spark: SparkSession, path: str, law: str, names: list[str]) -> None:
    """Removes partitions that a load left without rows: overwriting reaches only those that have some."""
    jvm = spark.sparkContext._jvm
    for name in names:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{law}={name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# --- lookups ---------------------------------------------------------------------

def store_lookup(rows: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Rows as a table of sorted buckets of ``keys``: one file per bucket, so that a join sorts buckets but never moves them.

    ``buckets`` should be no fewer than the shuffle partitions of the jobs that join it, else Spark deals it out anew.
    """
    (rows.repartition(buckets, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return rows.sparkSession.table(table)


def store_lookups(articles: DataFrame, links: DataFrame, name: str, path: str, buckets: int) -> dict[str, DataFrame]:
    """The corpus for ``retrieve_resolved``: links by article key and by id, and articles by id.

    Links are made here, once per load, and not in each retrieval.
    """
    links = cut_lineage(links)
    return {"links": store_lookup(links, f"{name}_links_by_key", f"{path}/links_by_key", STATUTE_KEY, buckets),
            "links_by_id": store_lookup(links, f"{name}_links_by_id", f"{path}/links_by_id", ["id"], buckets),
            "articles": store_lookup(articles, f"{name}_articles_by_id", f"{path}/articles_by_id", ["id"], buckets)}
