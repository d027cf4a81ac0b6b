"""Neighbours across blocks: only the rows at the edge of a block are joined with the summary."""

from pyspark.sql import functions as F

from statuta.operators.ordered import neighbour


def test_only_edges_of_blocks_meet_the_summary(spark):
    rows = [(law, n) for law in ("a", "b", None) for n in (*range(0, 40, 3), 95, 96, 230)]
    df = spark.createDataFrame(rows, "law string, n long")
    for offset in (-1, 1):
        found = neighbour(df, ["law"], "n", F.col("n"), "other", offset, block=10)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "isnull(_near" in plan[plan.index("Join"):] and "_value" not in plan
        assert found.columns == ["law", "n", "other"]
        want = []
        for law in ("a", "b", None):
            own = [n for k, n in rows if k == law]
            others = [None, *own[:-1]] if offset < 0 else [*own[1:], None]
            want += [(law, n, o) for n, o in zip(own, others)]
        key = lambda r: (r[0] or "", r[1])
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
