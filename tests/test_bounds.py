"""What one task or the driver holds does not grow with the tables: plans of the mended steps."""

from pyspark.sql import functions as F

from statuta.catalog import checks_joins, inputs
from statuta.operators import candidates as C
from statuta.operators.ordered import neighbour
from statuta.sources import readers


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_candidates_grow_with_the_questions(spark):
    rows = spark.range(100).withColumnRenamed("id", "q_id")
    assert C.by_question(rows, 100).rdd.getNumPartitions() == 4
    assert C.by_question(rows, 54_000_000).rdd.getNumPartitions() == 5_400


def test_joined_candidates_are_dealt_by_question_only(spark, tmp_path):
    """The tables are dealt out below the join; above it nothing goes to as many tasks as there are cores."""
    spark.range(50).selectExpr("id o_orderkey", "id % 7 o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id % 50 l_orderkey", "id l_partkey", "cast(id % 4 as int) l_linenumber", "0.1D l_discount").coalesce(1).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    inputs.derived(spark, str(tmp_path), "asked")
    cands = checks_joins._cands(spark, str(tmp_path))
    plan = _plan(cands)
    assert "RepartitionByExpression [q_id" in plan[:plan.index("Join")] and "\nRepartition " not in plan[:plan.index("Join")]
    assert cands.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_summaries_of_small_groups_are_not_broadcast(spark):
    rows = spark.range(100).select(F.col("id").alias("file"), F.lit(1).alias("line_no"), F.col("id").alias("v"))
    found = neighbour(rows, ["file"], "line_no", F.col("v"), "next", 1)
    found.collect()
    assert "strategy=merge" in _plan(found)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_links_of_an_item_are_looked_for_once(spark):
    html = '<div class="birkarar"><a href="/BB/1">x</a><titles>T</titles></div><div class="birkarar"><a href="/y">ohne</a></div>'
    rows = readers.listed_decisions(spark.createDataFrame([(1, html)], "page_id long, html string"), "https://x")
    assert _plan(rows).count("(?is)^<a(?=") == 1
    assert [(r.url, r.title) for r in rows.collect()] == [("https://x/BB/1", "T")]
