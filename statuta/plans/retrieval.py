"""Whole retrieval result for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.questions import is_case_number_query, is_generic_decision_query, wants_decisions
from ..functions.refs import extract_requested, extraction_status, resolve_context
from ..functions.text import preview
from ..operators.candidates import (article_links, by_question, expand_cited, expand_previous, merge_candidates,
                                    rank_candidates, union_candidates)
from ..operators.history import clean_history
from ..operators.keywords import keyword_search
from ..operators.lookup import REGULATION_LOOKUP_KEY, STATUTE_KEY, best_chunk_articles, located, vector_top_k
from ..operators.ordered import explode_rows
from ..operators.parsing import last_history_refs, normalised, parse_resolved, per_distinct
from ..session import cut_lineage


def resolve_questions(questions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Normalised and context-resolved question with its references and flags.

    ``questions(q_id, question[, conv_id])``; ``turns(conv_id, turn, text[, role])`` is the history, of which
    the last messages count, clipped.
    """
    raw = F.col("question")
    flagged = per_distinct(questions, "question", lambda d: d
                           .withColumn("case_query", F.coalesce(is_case_number_query(raw), F.lit(False)))
                           .withColumn("generic_query", F.coalesce(is_generic_decision_query(raw), F.lit(False)))
                           .withColumn("gated", F.col("case_query") | F.col("generic_query"))
                           .withColumn("normalised", F.when(F.col("gated"), F.coalesce(raw, F.lit(""))).otherwise(normalised("question"))))
    if turns is None:
        out = flagged.withColumn("resolved", F.col("normalised"))
    else:
        with_role = turns if "role" in turns.columns else turns.withColumn("role", F.lit("user"))
        out = flagged.join(last_history_refs(clean_history(with_role)), "conv_id", "left").withColumn(
            "resolved", F.when(F.col("gated"), F.col("normalised")).otherwise(
                resolve_context(F.col("normalised"), F.col("last_ref")))).drop("last_ref")
        # The rewritten question depends on the conversation; stored once, parsed once.
        out = cut_lineage(out)
    parsed = per_distinct(out, "resolved", lambda d: parse_resolved(d, "resolved").withColumn(
        "wants_decisions", F.coalesce(wants_decisions(F.col("resolved")), F.lit(False))))
    none = F.array().cast("array<struct<law_no:string,article_no:string,article_type:string>>")
    return (parsed.withColumn("refs", F.when(F.col("gated"), none).otherwise(F.col("refs")))
            .withColumn("decision_intent", F.col("gated") | F.col("wants_decisions")))


_SLIM = ["q_id", "id", "source_type", "law_no", "article_type", "article_no", "cited", "previous",
         "retrieval_source", "similarity", "ord"]


def _slim(df: DataFrame, **extra: F.Column) -> DataFrame:
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df.select(*_SLIM)


def explicit_candidates(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """Articles the questions name, statutes first, at most ten per question."""
    null_sim = F.lit(None).cast("double")
    refs = (explode_rows(resolved.select("q_id", "refs"), F.col("refs"), "ord", "r")
            .select("q_id", F.col("ord").cast("bigint").alias("ord"), "r.*").where(F.col("law_no").isNotNull()))
    statutes = links.where(F.col("source_type") == "mevzuat")
    direct = _slim(located(refs, statutes, STATUTE_KEY),
                   retrieval_source=F.lit("direct_article_lookup"), similarity=null_sim)
    asked = (explode_rows(resolved.where(~F.col("gated")).select("q_id", "regulation_refs"),
                          F.col("regulation_refs"), "ord", "r")
             .select("q_id", F.col("ord").cast("bigint").alias("ord"), "r.*"))
    regulations = links.where(F.col("source_type") == "yonetmelik")
    from_regulation = _slim(
        located(asked, regulations, REGULATION_LOOKUP_KEY),
        retrieval_source=F.lit("direct_yonetmelik_lookup"),
        similarity=null_sim)
    return merge_candidates(by_question(union_candidates(direct, from_regulation), resolved.count()), V.EXPLICIT_LIMIT, "id")


def semantic_candidates(resolved: DataFrame, explicit: DataFrame, links: DataFrame, vectors: DataFrame,
                        chunk_vectors: DataFrame) -> DataFrame:
    """Vector search, only for questions without a directly named article."""
    open_questions = vectors.join(resolved.where(~F.col("gated")).select("q_id"), "q_id", "left_semi").join(
        explicit.select("q_id").distinct(), "q_id", "left_anti")
    hits = vector_top_k(open_questions, chunk_vectors.select("v_id", "vector"), V.SEMANTIC_COUNT)
    found = best_chunk_articles(hits.drop("rank"), chunk_vectors, links)
    return _slim(found)


def retrieve(questions: DataFrame, articles: DataFrame, edges: DataFrame | None = None,
             turns: DataFrame | None = None, question_vectors: DataFrame | None = None,
             chunk_vectors: DataFrame | None = None, keyword: bool = True,
             exact_bonus: float = 0.0) -> DataFrame:
    """Ranked documents per question with score, extraction status and preview."""
    resolved = cut_lineage(resolve_questions(questions, turns))
    links = cut_lineage(article_links(articles, edges))
    return retrieve_resolved(resolved, links, articles, question_vectors, chunk_vectors, keyword, exact_bonus)


def retrieve_resolved(resolved: DataFrame, links: DataFrame, articles: DataFrame,
                      question_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None,
                      keyword: bool = True, exact_bonus: float = 0.0, links_by_id: DataFrame | None = None,
                      key_counts: DataFrame | None = None) -> DataFrame:
    """The same from resolved questions and article links.

    ``links_by_id`` are the same links where a store keeps them by id as well, ``key_counts`` its frequency table of
    keyword keys.  Only ids and keys travel until the final list is fixed; article texts are joined to
    the at most eighteen winners of a question.
    """
    explicit = explicit_candidates(resolved, links)
    links = links if links_by_id is None else links_by_id
    parts = [explicit]
    if question_vectors is not None and chunk_vectors is not None:
        parts.append(semantic_candidates(resolved, explicit, links, question_vectors, chunk_vectors))
    if keyword:
        order = [F.col("law_no"), F.col("article_type"), F.col("article_no"), F.col("id")]
        open_text = resolved.where(~F.col("gated")).select("q_id", F.col("resolved").alias("question"))
        bodies = articles.where(F.col("source_type") == "mevzuat").select(
            "id", "text", "law_no", "article_type", "article_no")
        hits = keyword_search(open_text, bodies, V.KEYWORD_COUNT, order, counts=key_counts)
        parts.append(_slim(hits.select("q_id", "id", "ord", "retrieval_source").join(links, "id"),
                           similarity=F.lit(None).cast("double")))
    merged = merge_candidates(by_question(union_candidates(*parts), resolved.count()), V.MERGED_LIMIT, "id")
    merged = merge_candidates(expand_previous(merged), V.PREVIOUS_LIMIT, "id")
    merged = merge_candidates(expand_cited(merged), V.FINAL_LIMIT, "id").drop("cited")
    context = resolved.select("q_id", "resolved", "decision_intent", "ask", "context", "refs")
    ranked = rank_candidates(merged.join(context, "q_id"), "context", V.FINAL_LIMIT, exact_bonus)
    regulation = F.col("source_type") == "yonetmelik"
    bodies = articles.select("id", "text", "paragraphs", "regulation_name", F.when(
        regulation, F.col("regulation_name")).otherwise(F.col("law_name")).alias("law_name"))
    found = ranked.join(bodies, "id").withColumn(
        "matched_text", extract_requested(F.col("text"), F.col("ask"), F.col("paragraphs")))
    return found.select(
        "q_id", F.col("resolved").alias("resolved_question"), "decision_intent", "rank", "id", "source_type",
        "law_no", "law_name", "regulation_name", "article_type", "article_no", "retrieval_source", "rank_score",
        "similarity", "matched_text",
        extraction_status(F.col("ask"), F.col("paragraphs"), F.col("matched_text")).alias("extraction_status"),
        preview(F.col("matched_text"), F.col("text")).alias("preview"),
        "ask", "text", "paragraphs")
