"""Approximate vector search: coarse cells with inverted lists, probed and ranked exactly.

The cells are trained on a bounded sample; every vector is then put into the list of its nearest cell.  A
query looks into the lists of its ``probes`` nearest cells and ranks what is there by the exact cosine.  Lists
are cut into blocks of bounded size, so that a cell that holds a third of all vectors is the work of many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import BLOCK_BYTES, best_found, block_top_k, unit, vector_top_k
from .ordered import explode_rows

#: Vectors that the cells are trained on: those with the least hashes of their ids.
SAMPLE_ROWS = 20_000
#: Cells grow with the root of the number of vectors up to this many; training gives each some sample rows.
MAX_CELLS, ROWS_PER_CELL, ROUNDS = 1_024, 16, 12
_ROWS = "cell int, block int, id bigint, vector array<double>"


@dataclass
class VectorIndex:
    """Unit centers of the cells, blocks of each cell's list, and the lists as a table partitioned by cell."""

    centers: np.ndarray
    blocks: list[int]
    rows: DataFrame


def _trained(cells: int):
    """Spherical k-means from evenly drawn starts; a cell that loses all rows takes the worst placed one."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("h")["vector"])
        centers = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
        for _ in range(ROUNDS):
            near = x @ centers.T
            own = near.argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, x)
            for lost, row in zip(np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0), np.argsort(near.max(axis=1)), strict=False):
                sums[lost] = x[row]
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
        return pd.DataFrame({"cell": np.arange(len(centers)), "center": list(centers)})
    return run


def _placed(centers: np.ndarray, probes: int):
    """(cell, id, vector) of each row in its ``probes`` nearest cells."""
    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                near = unit(pdf["vector"]) @ centers.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(pdf)), cells.shape[1])
                yield pd.DataFrame({"cell": cells.ravel().astype(np.int32), "id": pdf["id"].to_numpy()[at], "vector": pdf["vector"].to_numpy()[at]})
    return run


def _clean(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())


def build_index(vectors: DataFrame, path: str, cells: int | None = None, block_bytes: int = BLOCK_BYTES) -> VectorIndex:
    """Trains the cells, writes every vector of ``vectors(v_id, vector)`` below ``path`` by its cell.

    The sample is bounded; the assignment reads all rows, and only centers and one count per cell come back.
    """
    spark, rows = vectors.sparkSession, _clean(vectors, "v_id")
    n = rows.count()
    if not n:
        return VectorIndex(np.zeros((0, 1)), [], spark.createDataFrame([], _ROWS))
    wanted = cells or min(MAX_CELLS, math.isqrt(n) or 1, max(1, min(n, SAMPLE_ROWS) // ROWS_PER_CELL))
    sample = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(SAMPLE_ROWS)
    found = sample.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_trained(wanted), "cell int, center array<double>").orderBy("cell").collect()
    centers = np.array([r["center"] for r in found])
    placed = rows.mapInPandas(_placed(centers, 1), "cell int, id bigint, vector array<double>")
    # files are cut by cell and salt, so that a large cell has several writers
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int"))
    dealt.repartition("cell", "salt").drop("salt").write.mode("overwrite").partitionBy("cell").parquet(path)
    return open_index(spark, path, centers, block_bytes)


def open_index(spark: SparkSession, path: str, centers: np.ndarray, block_bytes: int = BLOCK_BYTES) -> VectorIndex:
    """The index over lists that are written already; a block of a list holds at most ``block_bytes`` of vectors or so."""
    lists = spark.read.schema("cell int, id bigint, vector array<double>").parquet(path)
    counts = {r["cell"]: r["n"] for r in lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_block = max(1, block_bytes // (8 * centers.shape[1]))
    blocks = [max(1, math.ceil(counts.get(c, 0) / per_block)) for c in range(len(centers))]
    return VectorIndex(centers, blocks, lists.withColumn("block", F.pmod(F.xxhash64("id"), _blocks_of(blocks)).cast("int")))


def _blocks_of(blocks: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, blocks)), F.col("cell"))


def approximate_top_k(queries: DataFrame, index: VectorIndex, k: int, probes: int) -> DataFrame:
    """(q_id, v_id, similarity, rank): the k best by cosine among the lists of the ``probes`` nearest cells.

    With as many probes as cells the result is exact.  Only lists of probed cells are read and shuffled.
    """
    spark = queries.sparkSession
    if not len(index.centers):
        return spark.createDataFrame([], "q_id bigint, v_id bigint, similarity double, rank int")
    placed = _clean(queries, "q_id").mapInPandas(_placed(index.centers, probes), "cell int, id bigint, vector array<double>")
    asked = explode_rows(placed, F.sequence(F.lit(0), _blocks_of(index.blocks) - 1), "_n", "block").drop("_n")
    # run-time pruning: the cells that queries probe decide which partitions of the lists are read; the comparison
    # keeps every cell, but without one the optimizer does not take them for a filter
    probed = placed.select("cell").distinct().where("cell >= 0")
    held = index.rows.join(F.broadcast(probed), "cell")
    place = F.xxhash64("cell", "block").alias("block")  # one number for cell and block
    both = held.select(place, F.lit(False).alias("is_query"), "id", "vector").unionByName(asked.select(place, F.lit(True).alias("is_query"), "id", "vector"))
    dealt = both.repartition("block").sortWithinPartitions("block", "is_query")
    partial = dealt.mapInPandas(block_top_k(k), "q_id bigint, v_id bigint, similarity double")
    return best_found(partial, k)


def calibrated_probes(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, sample_rows: int = 512) -> int:
    """The fewest probes whose lists hold the share ``target`` of the exact k neighbours of a sample of queries.

    How many are needed hangs on the vectors: few where they lie in clusters, many where they fill space evenly.
    The sample is those ``sample_rows`` queries with the least hashes; a count per rank of cell comes back.
    """
    if not len(index.centers):
        return 1
    centers = index.centers
    some = _clean(queries, "q_id").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    exact = vector_top_k(some.withColumnRenamed("id", "q_id"), index.rows.select(F.col("id").alias("v_id"), "vector"), k)
    listed = exact.join(index.rows.select(F.col("id").alias("v_id"), "cell"), "v_id").groupBy("q_id").agg(F.collect_list("cell").alias("cells"))
    asked = some.withColumnRenamed("id", "q_id").join(listed, "q_id").select("vector", "cells")

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                near = unit(pdf["vector"]) @ centers.T
                place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                yield pd.DataFrame({"probe": np.concatenate([place[i, np.asarray(c)] for i, c in enumerate(pdf["cells"])]) + 1})

    counted = asked.mapInPandas(run, "probe int").groupBy("probe").agg(F.count(F.lit(1)).alias("n")).orderBy("probe").collect()
    reached, whole = 0, sum(r["n"] for r in counted)
    for r in counted:
        reached += r["n"]
        if reached >= target * whole:
            return r["probe"]
    return len(centers)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, hit, recall): the share of the exact neighbours that were found."""
    hits = exact.select("q_id", "v_id").join(found.select("q_id", "v_id", F.lit(1).alias("hit")), ["q_id", "v_id"], "left")
    return hits.agg(F.countDistinct("q_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hit")).withColumn(
        "recall", F.col("hit") / F.col("wanted"))
