"""Load statute files as they arrive: one incremental load per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.ingest import incremental_load, parse_laws
from ..sources.readers import cut_lines, law_names, with_folder


def arriving_lines(spark: SparkSession, path: str) -> DataFrame:
    """New files below ``path`` as lines, each file once."""
    raw = spark.readStream.schema("value string").option("wholetext", "true").format("text").load(path)
    return with_folder(cut_lines(raw.select(F.col("_metadata.file_path").alias("file"), "value")))


def load_arrivals(spark: SparkSession, path: str, checkpoint: str,
                  snapshot: Callable[[], tuple[DataFrame, ...]],
                  publish: Callable[[dict[str, DataFrame], int], None]) -> DataStreamWriter:
    """Writer that loads every batch of arrived files.

    ``snapshot`` reads the stored articles, chunks and, where there are some, edges; ``publish`` writes the next snapshot.
    A replayed batch gives the same snapshot, since loading is keyed by article.
    """
    def load(batch: DataFrame, epoch: int) -> None:
        incoming = parse_laws(batch, law_names(batch)).withColumn("source_type", F.lit("mevzuat"))
        publish(incremental_load(incoming, *snapshot()), epoch)

    return arriving_lines(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
