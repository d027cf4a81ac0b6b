"""Number gaps: the same numbers as a brute force, and no absent number in a shuffle."""

from statuta.operators import quality as K


def _articles(spark, rows):
    return spark.createDataFrame([(law, "madde", no) for law, no in rows], "law_no string, article_type string, article_no string")


def test_gaps_by_brute_force_with_copies_null_laws_and_other_numbers(spark):
    rows = [("a", "3"), ("a", "3"), ("a", "9"), ("a", "10"), ("a", "25000"), ("b", "7"), ("c", "5"), ("c", "-4"), ("c", "5/A"),
            ("c", None), (None, "2"), (None, "2"), (None, "4"), (None, "5")]
    found = sorted(((r.law_no or "", r.n) for r in K.number_gaps(_articles(spark, rows)).collect()))
    want = [("a", i) for i in range(3, 25001) if i not in (3, 9, 10, 25000)] + [("c", i) for i in range(-3, 5)]
    want += [("", i) for i in range(2, 6)]   # no row counts as there where the law is missing
    assert found == sorted(want)


def test_absent_numbers_are_never_shuffled(spark):
    """A wide gap is expanded behind the last shuffle and join."""
    plan = K.number_gaps(_articles(spark, [("a", "1"), ("a", "900000")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "Generate" not in plan[plan.index("Join"):]
