"""Audit of given answers against their sources.

``answers(q_id, answer)``; ``sources(q_id, rank, kind, ...)`` with kind article or
decision.  Each source is tested on its own and the results are folded per question
before anything is shuffled, so long source lists never meet in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.answers import (cites_article, decision_label, first_unsupported,
                                 forbidden_case_term, term_groups)
from ..functions.text import canon, source_name, strip


def audit_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``valid`` and the first failing ``reason`` per answer."""
    groups = len(V.UNSUPPORTED_TERMS)
    text = answers.select("q_id", "answer", canon(F.col("answer")).alias("_canon"))
    article = F.col("kind") == "article"
    name = source_name(F.col("source_type"), F.col("law_name"), F.col("regulation_name"))
    label = canon(decision_label(F.col("chamber"), F.col("case_no"), F.col("decision_no")))
    cited = F.when(article, cites_article(F.col("_canon"), name, F.col("law_no"),
                                          F.coalesce("article_type", F.lit("madde")), F.col("article_no"))
                   ).otherwise(F.contains("_canon", label))
    tested = (sources.join(text.select("q_id", "_canon"), "q_id")
              .withColumn("_terms", term_groups(F.col("text"))).withColumn("_cited", cited))
    folded = tested.groupBy("q_id").agg(
        F.bool_or("_cited").alias("cited"), F.bool_or(~article).alias("has_decision"),
        *[F.bool_or(F.get("_terms", F.lit(i))).alias(f"t{i}") for i in range(groups)])
    joined = text.join(folded, "q_id", "left")
    forbidden = F.when(~F.col("has_decision"), forbidden_case_term(F.col("answer")))
    unsupported = first_unsupported(term_groups(F.col("answer")), [F.col(f"t{i}") for i in range(groups)])
    reason = F.coalesce(
        F.when(strip(F.coalesce("answer", F.lit(""))) == "", F.lit("empty_answer")),
        F.when(F.col("cited").isNull(), F.lit("no_sources")),
        F.concat(F.lit("unsupported_legal_term:"), unsupported),
        F.concat(F.lit("forbidden_case_term:"), forbidden),
        F.when(~F.col("cited"), F.lit("no_allowed_reference")),
        F.lit("ok"))
    return joined.select("q_id", "answer", reason.alias("reason")).withColumn(
        "valid", F.col("reason") == "ok")
