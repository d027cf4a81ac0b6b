"""Incremental corpus loading: hashes, change detection, upsert, chunks, citation edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import cited_articles
from ..functions.structure import build_structure, chunks
from ..functions.text import article_number_key, content_hash, strip
from .ordered import best_per_key, explode_rows, top_per_key

ARTICLE_KEY = ["law_no", "article_type", "article_no"]
REGULATION_KEY = ["law_no", "regulation_name", "article_type", "article_no"]


def _same_key(keys: list[str], left: str = "l", right: str = "r") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def clean_records(records: DataFrame, columns: list[str], body: str = "text") -> DataFrame:
    """Trim every field (missing becomes empty) and drop records with a blank body."""
    trimmed = records.select(*[
        strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in columns else F.col(c)
        for c in records.columns])
    return trimmed.where(F.col(body) != "")


def article_id(keys: list[str] = ARTICLE_KEY) -> Column:
    """Deterministic id from the natural key, the same on every run."""
    return F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) for k in keys])


def unresolved_ids(records: DataFrame, stored: DataFrame, keys: list[str] = ARTICLE_KEY) -> DataFrame:
    """Records without a stored article id; a load is only complete when this is empty."""
    return records.alias("l").join(stored.alias("r"), _same_key(keys), "left_anti")


def chunk_counts(chunk_rows: DataFrame, keys: list[str] = ARTICLE_KEY) -> DataFrame:
    return chunk_rows.groupBy(*keys).agg(F.count("*").alias("chunk_count"))


def detect_changes(incoming: DataFrame, stored: DataFrame, counts: DataFrame,
                   keys: list[str] = ARTICLE_KEY) -> DataFrame:
    """Each incoming record with its hash and the reason it has to be (re)processed.

    new, content_changed, missing_chunks or same.
    """
    hashed = incoming.withColumn("content_hash", content_hash(F.col("text")))
    old = stored.select(*keys, F.col("content_hash").alias("stored_hash"), F.lit(True).alias("is_stored"))
    joined = hashed.join(old, keys, "left").join(counts, keys, "left")
    count = F.coalesce(F.col("chunk_count"), F.lit(0))
    reason = (F.when(F.col("is_stored").isNull(), "new")
              .when(~F.col("content_hash").eqNullSafe(F.col("stored_hash")), "content_changed")
              .when(count == 0, "missing_chunks").otherwise("same"))
    return (joined.withColumn("chunk_count", count).withColumn("reason", reason)
            .withColumn("changed", reason != "same").drop("is_stored", "stored_hash"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str] = ARTICLE_KEY) -> DataFrame:
    """Next snapshot: incoming rows replace stored rows of the same key, others stay."""
    untouched = stored.alias("l").join(incoming.alias("r"), _same_key(keys), "left_anti")
    return untouched.unionByName(incoming, allowMissingColumns=True)


def latest_version(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the highest version."""
    return best_per_key(versions, keys, [-F.col(version)])


def replace_derived(stored: DataFrame, rebuilt: DataFrame, parent: str, rebuilt_parents: DataFrame) -> DataFrame:
    """Derived rows after delete-then-insert: all rows of a rebuilt parent are replaced.

    A parent rebuilt to nothing loses its rows, hence the separate parent list.
    """
    parents = rebuilt_parents.select(parent).distinct()
    return stored.join(parents, parent, "left_anti").unionByName(rebuilt, allowMissingColumns=True)


def with_structure(articles: DataFrame, text: str = "text") -> DataFrame:
    return articles.withColumn("paragraphs", build_structure(F.col(text)))


def chunk_rows(articles: DataFrame, model: str = "external", dim: int = 64) -> DataFrame:
    """One row per chunk with its index, hash and parent id."""
    pieces = explode_rows(articles.select("id", *ARTICLE_KEY, "text"), chunks(F.col("text")), "chunk_index", "chunk_text")
    return pieces.select(
        F.col("id").alias("article_id"), *ARTICLE_KEY, "chunk_index", "chunk_text",
        content_hash(F.col("chunk_text")).alias("chunk_hash"),
        F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"))


def load_summary(changes: DataFrame) -> DataFrame:
    """Articles, changed, skipped and chunks to add, per reason and in total."""
    added = F.when(F.col("changed"), F.size(chunks(F.col("text")))).otherwise(0)
    return (changes.withColumn("_added", added).groupBy("reason").agg(
        F.count("*").alias("articles"), F.count_if("changed").alias("changed"),
        F.count_if(~F.col("changed")).alias("skipped"), F.sum("_added").alias("chunks_added")))


def citation_edges(articles: DataFrame, compatible: bool = False) -> DataFrame:
    """Citation graph of the plain articles, one row per distinct edge of an article."""
    bodies = articles.where(F.col("article_type") == "madde")
    keyed = bodies.select(*[F.col(k).alias(f"source_{k}") for k in ARTICLE_KEY], "text")
    edges = explode_rows(keyed, cited_articles(F.col("text"), F.col("source_law_no"), compatible), "ord", "edge")
    return edges.select(
        "source_law_no", "source_article_type", "source_article_no",
        F.col("edge.law_no").alias("target_law_no"), F.lit("madde").alias("target_article_type"),
        F.col("edge.article_no").alias("target_article_no"),
        F.col("edge.ref_type").alias("ref_type"), F.col("edge.raw_match").alias("raw_match"), "ord")


def missing_decisions(incoming: DataFrame, stored: DataFrame, min_text: int = 100) -> DataFrame:
    """Decisions to load: number given and not stored yet, text long enough."""
    usable = incoming.where((F.coalesce("application_no", F.lit("")) != "")
                            & (F.length(F.coalesce("text", F.lit(""))) >= min_text))
    return usable.join(stored.select("application_no").distinct(), "application_no", "left_anti")


def compare_store(source: DataFrame, stored: DataFrame, expected: DataFrame, drift: int = 10) -> DataFrame:
    """Per law: numbers only in the source, only in the store, and count drift.

    ``expected`` has ``law_no`` and ``expected_count``.
    """
    a = source.select("law_no", "article_no").distinct().withColumn("in_source", F.lit(1))
    b = stored.select("law_no", "article_no").distinct().withColumn("in_store", F.lit(1))
    numeric = F.col("article_no").rlike(r"^\d+$")
    per_law = a.join(b, ["law_no", "article_no"], "full_outer").groupBy("law_no").agg(
        F.count("in_source").alias("source_count"), F.count("in_store").alias("store_count"),
        F.count_if(F.col("in_store").isNull() & numeric).alias("only_in_source"),
        F.count_if(F.col("in_source").isNull() & numeric).alias("only_in_store"))
    return per_law.join(expected, "law_no", "left").withColumn(
        "drifted", F.abs(F.col("source_count") - F.col("expected_count")) > drift)


def record_report(articles: DataFrame, limit: int = 10) -> DataFrame:
    """First and last records of each law in article order."""
    key = article_number_key(F.col("article_no"))
    keyed = articles.withColumn("_key", F.struct("article_type", key.alias("no")))
    first = top_per_key(keyed, ["law_no"], [F.col("_key").asc()], limit).withColumn("part", F.lit("first"))
    last = top_per_key(keyed, ["law_no"], [F.col("_key").desc()], limit).withColumn("part", F.lit("last"))
    return first.unionByName(last).drop("_key")
