"""Retrieval accuracy against expected results.

``cases(case_id, resolved_question, decision_intent, top_docs)``: nulls mean the case does
not state that expectation.  ``results`` has the same columns with what was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome per case; a check is null where the case states no expectation."""
    got = results.select("case_id", F.col("resolved_question").alias("got_question"),
                         F.col("decision_intent").alias("got_intent"), F.col("top_docs").alias("got_docs"))
    joined = cases.join(got, "case_id", "left")
    docs = F.coalesce(F.col("got_docs"), F.array().cast("array<string>"))
    wanted = F.col("top_docs")
    stated = lambda c, test: F.when(F.col(c).isNotNull(), F.coalesce(test, F.lit(False)))
    return joined.select(
        "case_id",
        stated("resolved_question", F.col("resolved_question") == F.col("got_question")).alias("resolved_ok"),
        stated("decision_intent", F.col("decision_intent") == F.col("got_intent")).alias("intent_ok"),
        F.when(F.size(wanted) > 0, F.coalesce(F.get(wanted, F.lit(0)) == F.get(docs, F.lit(0)), F.lit(False))
               ).alias("top1_ok"),
        stated("top_docs", F.size(F.array_except(wanted, docs)) == 0).alias("coverage_ok"),
        stated("top_docs", F.slice(docs, 1, F.greatest(F.size(wanted), F.lit(0))) == wanted).alias("prefix_ok"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """Passed and applicable counts of every check, in one aggregate."""
    checks = ["resolved", "intent", "top1", "coverage", "prefix"]
    return outcomes.agg(
        F.count("*").alias("cases"),
        *[e for c in checks for e in (F.count_if(f"{c}_ok").alias(f"{c}_passed"),
                                      F.count(f"{c}_ok").alias(f"{c}_total"))])
