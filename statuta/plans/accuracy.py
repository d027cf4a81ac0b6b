"""Accuracy of the whole retrieval over a table of golden questions, and counts of its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.evaluate import accuracy, case_results
from ..session import cut_lineage
from .retrieval import resolve_questions, retrieve_resolved

#: What the extraction of a requested part may end in.
STATUSES = ("matched", "partial_match", "not_structured", "not_requested")


def golden_results(cases: DataFrame, links: DataFrame, articles: DataFrame, turns: DataFrame | None = None, **stages: object) -> DataFrame:
    """Outcome per golden question of the job itself: ``cases(case_id, question, resolved_question, decision_intent,
    top_docs[, conv_id])``, documents as ``law|type|number`` in the wanted order.

    A question without any document has an empty list; one row per case goes through the job.
    """
    asked = cases.select(F.col("case_id").alias("q_id"), "question", *(["conv_id"] if "conv_id" in cases.columns else []))
    resolved = cut_lineage(resolve_questions(asked, turns))
    ranked = retrieve_resolved(resolved, links, articles, **stages)
    named = F.concat_ws("|", "law_no", "article_type", "article_no")
    # at most FINAL_LIMIT rows per question
    docs = ranked.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", named.alias("doc")))), lambda x: x["doc"]).alias("top_docs"))
    results = resolved.select("q_id", F.col("resolved").alias("resolved_question"), "decision_intent").join(docs, "q_id", "left")
    return case_results(cases, results.withColumnRenamed("q_id", "case_id"))


def golden_accuracy(cases: DataFrame, links: DataFrame, articles: DataFrame, turns: DataFrame | None = None, **stages: object) -> DataFrame:
    """Passed and applicable counts of every check over all golden questions."""
    return accuracy(golden_results(cases, links, articles, turns, **stages))


def watched(ranked: DataFrame, name: str = "retrieval") -> tuple[DataFrame, Observation]:
    """The result, and counts of its rows per retrieval source and extraction status that fill up while it is written.

    Nothing is read twice: the counts are taken from the rows as they pass.
    """
    seen = Observation(name)
    sources = [F.count_if(F.col("retrieval_source") == s).alias(f"source_{s}") for s in V.SOURCE_PRIORITY]
    statuses = [F.count_if(F.col("extraction_status") == s).alias(f"status_{s}") for s in STATUSES]
    cut = F.count_if(F.col("rank") == V.FINAL_LIMIT).alias("full_lists")
    return ranked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rank") == 1).alias("answered"), cut, *sources, *statuses), seen
