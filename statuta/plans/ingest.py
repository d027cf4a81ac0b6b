"""From raw statute text to the searchable corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus
from ..operators.segment import segment_articles
from ..session import cut_lineage


def parse_laws(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Articles of raw statute files with structure, hash and id.

    Repeated articles are stored under the plain type as ``N/A``, the original type kept,
    since questions ask for them in that form.
    """
    articles = segment_articles(lines, names)
    repeated = F.col("article_type") == "mukerrer_madde"
    stored = articles.select(
        "file", "pos", "law_no", "law_name",
        F.col("article_type").alias("original_type"),
        F.when(repeated, "madde").otherwise(F.col("article_type")).alias("article_type"),
        F.when(repeated, F.concat("article_no", F.lit("/A"))).otherwise(F.col("article_no")).alias("article_no"),
        "text")
    return corpus.with_structure(stored).withColumn("id", corpus.article_id())


EDGE_SOURCE = {"law_no": "source_law_no", "article_type": "source_article_type", "article_no": "source_article_no"}


def incremental_load(incoming: DataFrame, stored: DataFrame, stored_chunks: DataFrame,
                     stored_edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Next snapshot of articles, chunks and edges; only changed articles are read for chunks and citations.

    Without stored edges all articles are read for theirs.  ``removed`` names the stored articles of the
    loaded laws that the load no longer holds; they stay in the snapshot.
    """
    changes = cut_lineage(corpus.detect_changes(
        incoming, stored, corpus.chunk_counts(stored_chunks)))
    rows = changes.drop("reason", "changed", "chunk_count")
    articles = corpus.upsert(stored, rows)
    changed = changes.where("changed")
    chunks = corpus.replace_derived(
        stored_chunks, corpus.chunk_rows(changed), "article_id", changed.select(F.col("id").alias("article_id")))
    if stored_edges is None:
        edges = corpus.citation_edges(articles)
    else:
        rebuilt = changed.select(*[F.col(k).alias(v) for k, v in EDGE_SOURCE.items()]).distinct()
        edges = stored_edges.join(rebuilt, list(EDGE_SOURCE.values()), "left_anti").unionByName(corpus.citation_edges(changed))
    removed = stored.join(incoming.select("law_no").distinct(), "law_no", "left_semi").join(
        incoming.select(*corpus.ARTICLE_KEY), corpus.ARTICLE_KEY, "left_anti").select("id", *corpus.ARTICLE_KEY)
    return {"changes": changes, "articles": articles, "chunks": chunks, "edges": edges, "removed": removed,
            "summary": corpus.load_summary(changes)}
