"""Session defaults and the one lineage cut used by the composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "statuta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings are left to the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; where that is unset, as in tests, it is a folder below the
    warehouse, which all of them can reach as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder.

    Reliable checkpoints survive the loss of executors, and what follows reads the stored
    rows instead of computing them again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
