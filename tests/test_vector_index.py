"""Approximate vector search: lists hold every vector, exact ranking, recall, hot cells, empty input."""

import numpy as np
from pyspark.sql import functions as F

from statuta.operators import lookup
from statuta.operators import vector_index as I


def _clusters(spark, n=1500, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim)) * 3
    x = centers[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.4
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "v_id long, vector array<double>").repartition(4)


def _asked(vectors):
    return vectors.where("v_id % 50 = 0").select(F.col("v_id").alias("q_id"), "vector")


def test_index_holds_every_vector_and_reaches_the_recall(spark, tmp_path):
    vectors = _clusters(spark)
    index = I.build_index(vectors, str(tmp_path / "lists"))
    assert index.rows.count() == 1500 and index.rows.select("id").distinct().count() == 1500
    asked = _asked(vectors)
    exact = lookup.vector_top_k(asked, vectors, 8)
    probes = I.calibrated_probes(index, vectors.where("v_id % 50 <> 0").select(F.col("v_id").alias("q_id"), "vector"), 8, sample_rows=200)
    assert probes < len(index.centers) / 2
    measured = I.recall(I.approximate_top_k(asked, index, 8, probes), exact).first()
    assert measured["wanted"] == 240 and measured["recall"] >= 0.9


def test_all_probes_are_exact_with_many_blocks_in_a_hot_cell(spark, tmp_path):
    """A third of the vectors are equal; blocks are so small that every list has several."""
    vectors = _clusters(spark, 600).withColumn("vector", F.when(F.col("v_id") % 3 == 0, F.array(*[F.lit(float(c)) for c in range(12)])).otherwise(F.col("vector")))
    index = I.build_index(vectors, str(tmp_path / "lists"), cells=5, block_bytes=12 * 8 * 20)
    assert max(index.blocks) >= 10
    asked = _asked(vectors)
    pairs = lambda df: sorted((r.q_id, r["rank"], r.v_id) for r in df.collect())
    assert pairs(I.approximate_top_k(asked, index, 8, 5)) == pairs(lookup.vector_top_k(asked, vectors, 8))


def test_only_lists_of_probed_cells_are_read(spark, tmp_path):
    vectors = _clusters(spark)
    index = I.build_index(vectors, str(tmp_path / "lists"))
    plan = I.approximate_top_k(_asked(vectors).limit(1), index, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_exact_blocks_are_bounded_by_bytes(spark):
    vectors = _clusters(spark, 300)
    asked = _asked(vectors)
    pairs = lambda df: sorted((r.q_id, r["rank"], r.v_id) for r in df.collect())
    assert pairs(lookup.vector_top_k(asked, vectors, 4, block_bytes=12 * 8 * 30)) == pairs(lookup.vector_top_k(asked, vectors, 4, vector_blocks=1))


def test_empty_and_null_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "v_id long, vector array<double>")
    index = I.build_index(none, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "q_id long, vector array<double>")
    assert I.approximate_top_k(asked, index, 3, 2).count() == 0 and I.calibrated_probes(index, asked, 3) == 1
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "v_id long, vector array<double>")
    index = I.build_index(some, str(tmp_path / "some"))
    assert [(r.q_id, r.v_id) for r in I.approximate_top_k(asked, index, 1, 9).collect()] == [(1, 3)]
