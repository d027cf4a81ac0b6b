"""Set-at-a-time question parsing.

Parsing is the costly part of a question, and popular questions repeat.  Each distinct text
is therefore parsed once: texts are made distinct before the shuffle, parsed in parallel and
joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import normalise_question
from ..functions.refs import intra_request, last_law_ref, parse_intra_refs, parse_refs, parse_regulation_refs
from ..functions.text import built_once, canon
from .candidates import ranking_context


def normalised(column: str) -> Column:
    """The normalised question, never null.

    Being not nullable matters: a later join on it would otherwise add a null test that the
    optimizer pushes below the distinct step, where it parses every row.
    """
    return built_once(f"normalised:{column}", lambda: F.coalesce(
        normalise_question(F.col(column)), F.lit("")))


def references(canonical: str) -> Column:
    return built_once(f"refs:{canonical}", lambda: parse_refs(F.col(canonical)))


def per_distinct(df: DataFrame, column: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``parse`` to the distinct values of a text column and join its columns back; null is a value."""
    parsed = parse(df.select(column).distinct())
    right = parsed.withColumnRenamed(column, "_value")
    return df.join(right, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def asked_alike(questions: DataFrame) -> DataFrame:
    """(q_id, asked): what each question id asks, as its texts with the times it has each.

    Without history and vectors a result follows from ``asked`` alone.  Rows without an id are no one question: they
    are told apart by their text.
    """
    each = questions.select("q_id", "question").repartition("q_id").groupBy("q_id", "question").agg(F.count(F.lit(1)).alias("times"))
    texts = F.sort_array(F.collect_list(F.struct("question", "times")))
    own = each.groupBy("q_id", F.when(F.col("q_id").isNull(), F.struct("question")).alias("_alone")).agg(texts.alias("texts"))
    return own.select("q_id", F.struct(F.col("q_id").isNotNull().alias("known"), "texts").alias("asked"))


def one_of_each(alike: DataFrame) -> DataFrame:
    """(q_id, question, asked): all rows of one question id of those that ask the same."""
    first = alike.groupBy("asked").agg(F.min("q_id").alias("q_id"))
    rows = first.select("q_id", "asked", F.explode("asked.texts").alias("_t"))
    return rows.select("q_id", "_t.question", "asked", F.explode(F.array_repeat(F.lit(0), F.col("_t.times").cast("int"))).alias("_n")).drop("_n")


def with_normalised(df: DataFrame, question: str, out: str = "normalised") -> DataFrame:
    return per_distinct(df, question, lambda d: d.withColumn(out, normalised(question)))


def with_refs(df: DataFrame, text: str, out: str = "refs") -> DataFrame:
    """Article references of a (normalised, resolved) question."""
    return per_distinct(df, text, lambda d: d.withColumn("_c", canon(F.col(text))).withColumn(
        out, references("_c")).drop("_c"))


def parse_resolved(distinct: DataFrame, text: str) -> DataFrame:
    """All that is read from a resolved question: references, requested part, ranking context."""
    staged = (distinct.withColumn("canonical", canon(F.col(text)))
              .withColumn("refs", references("canonical"))
              .withColumn("regulation_refs", parse_regulation_refs(F.col("canonical"))))
    return with_request(staged, text).withColumn(
        "context", ranking_context(F.col("canonical"), F.col("refs")))


def with_request(df: DataFrame, text: str, out: str = "ask") -> DataFrame:
    """Paragraph and item request of a question, as ``intra`` references and as ``ask``."""
    return (df.withColumn("_n", normalised(text)).withColumn("_n", canon(F.col("_n")))
            .withColumn("intra", built_once("intra", lambda: parse_intra_refs(F.col("_n"))))
            .withColumn(out, built_once("ask", lambda: intra_request(F.col("intra")))).drop("_n"))


def last_history_refs(turns: DataFrame) -> DataFrame:
    """Last reference with a law per conversation: last turn first, last reference in it.

    An aggregate, not a window, so one long conversation does not fill one task.
    """
    parsed = per_distinct(turns.select("conv_id", "turn", "text"), "text", lambda d: d.withColumn(
        "_c", canon(F.col("text"))).withColumn("_r", references("_c")).select("text", last_law_ref(F.col("_r")).alias("ref")))
    return (parsed.groupBy("conv_id")
            .agg(F.max_by("ref", F.when(F.col("ref").isNotNull(), F.col("turn"))).alias("last_ref"))
            .where(F.col("last_ref").isNotNull()))
