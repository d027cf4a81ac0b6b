"""Ordered operators that stay parallel inside one group.

A plain window over a group puts the whole group into one task.  One statute
file or one law may hold a third of all rows, so the work is done in two levels:
inside blocks of consecutive positions, and over one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000


def _block(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size)


def _with_summary(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their block's summary; null keys and positions meet null ones.

    Many small groups make as many summary rows as rows: they are merged, never collected for a broadcast.
    """
    names = [*keys, "_block"]
    right = summary.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(names)], *[c for c in summary.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(names)]
    return rows.join(right.hint("merge"), same).drop(*[f"_s{i}" for i in range(len(names))])


def running_count(df: DataFrame, keys: list[str], position: str, flag: Column, out: str,
                  block: int = BLOCK) -> DataFrame:
    """Count of rows so far (inclusive, by position within keys) where ``flag`` holds."""
    marked = df.withColumn("_block", _block(position, block)).withColumn("_flag", flag.cast("bigint"))
    inner = Window.partitionBy(*keys, "_block").orderBy(position)
    counted = marked.withColumn("_inner", F.sum("_flag").over(inner))
    summary = marked.groupBy(*keys, "_block").agg(F.sum("_flag").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, "_block", F.coalesce(
        F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (_with_summary(counted, summary, keys)
            .withColumn(out, F.col("_before") + F.col("_inner"))
            .drop("_block", "_flag", "_inner", "_before"))


def neighbour(df: DataFrame, keys: list[str], position: str, value: Column, out: str, offset: int,
              block: int = BLOCK) -> DataFrame:
    """Value of the row before (offset -1) or behind (offset 1) within keys; null at the ends.

    ``value`` must not be null, since null is what marks the missing neighbour.
    """
    marked = df.withColumn("_block", _block(position, block))
    order = F.col(position).asc() if offset < 0 else F.col(position).desc()
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    edge = F.max_by(value, position) if offset < 0 else F.min_by(value, position)
    summary = marked.groupBy(*keys, "_block").agg(edge.alias("_edge"))
    block_order = F.col("_block").asc() if offset < 0 else F.col("_block").desc()
    summary = summary.select(*keys, "_block", F.lag("_edge").over(
        Window.partitionBy(*keys).orderBy(block_order)).alias("_outer"))
    near = marked.withColumn("_near", F.lag(value).over(inner))
    # only rows at the edge of a block go on to meet the summary; all others have their neighbour
    inside = near.where(F.col("_near").isNotNull()).withColumn(out, F.col("_near"))
    edges = _with_summary(near.where(F.col("_near").isNull()), summary, keys).withColumn(out, F.col("_outer")).drop("_outer")
    return inside.unionByName(edges).drop("_block", "_near")


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; aggregated before the shuffle.

    ``order`` columns sort ascending; negate numbers for descending.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    payload = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(payload, rank).alias("_row"))
    return best.select("_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, out: str = "rank") -> DataFrame:
    """First ``limit`` rows per key; Spark prunes each partition before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= limit)


def explode_rows(df: DataFrame, values: Column, position: str, value: str) -> DataFrame:
    """One row per array element with its position; rows with an empty array drop out.

    The outer form is used on purpose: for the plain one the optimizer adds a test of the
    array size below, which computes an expensive array expression again.
    """
    rows = df.select("*", F.posexplode_outer(values).alias(position, value))
    return rows.where(F.col(position).isNotNull())
