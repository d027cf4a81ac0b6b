"""Candidate documents of a question: keys, priorities, merging, expansion, ranking.

All windows partition by ``q_id`` (or ``q_id`` and a document key), so one
hash shuffle by question serves every step here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.aliases import detect_law
from ..functions.refs import mentions_previous_article
from ..functions.text import literal_map
from .ordered import top_per_key

DEFAULTS = {
    "id": ("bigint", None), "source_type": ("string", "mevzuat"), "law_no": ("string", None),
    "law_name": ("string", None), "regulation_name": ("string", None),
    "article_type": ("string", "madde"), "article_no": ("string", None), "text": ("string", ""),
    "chunk_text": ("string", ""), "similarity": ("double", None), "chunk_index": ("int", None),
    "retrieval_source": ("string", "semantic_or_keyword"),
}


def normalise_candidates(df: DataFrame) -> DataFrame:
    """All candidate columns present, with their defaults where a value is missing."""
    extra = [c for c in df.columns if c not in DEFAULTS]
    cols = []
    for name, (kind, default) in DEFAULTS.items():
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        cols.append((F.coalesce(value, F.lit(default)) if default is not None else value).alias(name))
    return df.select(*extra, *cols)


def document_key(source_type: str = "source_type", law_no: str = "law_no", regulation: str = "regulation_name",
                 law_name: str = "law_name", article_type: str = "article_type",
                 article_no: str = "article_no") -> Column:
    """Identity of a document: regulations carry their name, statutes do not."""
    text = lambda c, d="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    kind = text(source_type, "mevzuat")
    name = F.when(kind == "yonetmelik", F.coalesce(
        F.nullif(F.col(regulation), F.lit("")), F.col(law_name), F.lit(""))).otherwise("")
    return F.struct(kind.alias("source_type"), text(law_no).alias("law_no"), name.alias("name"),
                    text(article_type, "madde").alias("article_type"), text(article_no).alias("article_no"))


def priority(source: Column) -> Column:
    table = literal_map(V.SOURCE_PRIORITY)
    return F.coalesce(table[source], F.lit(V.OTHER_PRIORITY))


def _strength(df: DataFrame) -> DataFrame:
    return (df.withColumn("_prio", priority(F.col("retrieval_source")))
            .withColumn("_sim", F.coalesce("similarity", F.lit(0.0))))


#: Questions whose candidates one task sorts and carries, with the lists of what they cite.
QUESTIONS_PER_TASK = 10_000


def by_question(df: DataFrame, questions: int) -> DataFrame:
    """Candidates dealt out by question, in parts that do not grow with the number of questions.

    All windows of merging, expansion and ranking run in these parts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-questions // QUESTIONS_PER_TASK)), "q_id")


def union_candidates(*parts: DataFrame) -> DataFrame:
    """Lists one behind the other: order within a list kept, later lists come later."""
    out = None
    for stage, part in enumerate(parts):
        placed = part.withColumn("stage", F.lit(stage)).withColumn("nth", F.lit(0))
        out = placed if out is None else out.unionByName(placed, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """First row per (question, document)."""
    return top_per_key(df, key, [F.col(order)], 1, "_rn").drop("_rn")


def _place(df: DataFrame) -> list[Column]:
    """Order of a list, or of lists one behind the other."""
    return [F.col(c) for c in ("stage", "ord", "nth") if c in df.columns]


def merge_candidates(df: DataFrame, limit: int, key: str = "doc_key") -> DataFrame:
    """Best version per document, ordered by strength then first sight, cut at ``limit``.

    ``ord`` becomes the new position in the list.
    """
    same = Window.partitionBy("q_id", key)
    place = F.struct(*_place(df))
    strongest = same.orderBy(F.desc("_prio"), F.desc("_sim"), place.asc())
    listed = Window.partitionBy("q_id").orderBy(F.desc("_prio"), F.desc("_sim"), F.asc("_first"))
    best = (_strength(df).withColumn("_first", F.min(place).over(same))
            .withColumn("_rn", F.row_number().over(strongest)).where(F.col("_rn") == 1))
    return (best.withColumn("ord", F.row_number().over(listed).cast("bigint"))
            .where(F.col("ord") <= limit).drop("_prio", "_sim", "_first", "_rn", "stage", "nth"))


# --- ranking -------------------------------------------------------------------

def ranking_context(question: Column, refs: Column) -> Column:
    """First law of the references (else of the question), numeric anchors, reference keys."""
    with_law = F.filter(refs, lambda r: F.coalesce(r["law_no"], F.lit("")) != "")
    anchors = F.filter(F.transform(refs, lambda r: F.when(
        r["article_no"].rlike(r"^\d+$"), r["article_no"].try_cast("bigint"))), lambda n: n.isNotNull())
    return F.struct(
        F.coalesce(F.get(with_law, F.lit(0))["law_no"], detect_law(question)).alias("law_no"),
        anchors.alias("anchors"),
        F.transform(refs, lambda r: F.concat_ws("|", r["law_no"], r["article_type"], r["article_no"])).alias("keys"))


def rank_score(context: Column, source: Column, similarity: Column, law_no: Column,
               article_type: Column, article_no: Column, exact_bonus: float = 0.0) -> Column:
    """Source priority, similarity, same-law and nearness bonuses, expansion penalties.

    ``exact_bonus`` is 0 by default: the observed order never gets it.
    """
    number = F.when(article_no.rlike(r"^\d+$"), article_no.try_cast("bigint"))
    distance = F.array_min(F.transform(context["anchors"], lambda a: F.abs(a - number)))
    near = None
    for within, bonus in V.DISTANCE_BONUS:
        near = F.when(distance <= within, bonus) if near is None else near.when(distance <= within, bonus)
    penalty = literal_map({k: int(v) for k, v in V.SOURCE_PENALTY.items()})[source].cast("double")
    exact = F.array_contains(context["keys"], F.concat_ws("|", law_no, article_type, article_no))
    return (priority(source).cast("double")
            + F.coalesce(similarity, F.lit(0.0)) * V.SIMILARITY_WEIGHT
            + F.when(exact, exact_bonus).otherwise(0.0)
            + F.when(context["law_no"] == law_no, V.SAME_LAW_BONUS).otherwise(0.0)
            + F.coalesce(near, F.lit(0.0)) - F.coalesce(penalty, F.lit(0.0)))


def rank_candidates(df: DataFrame, context: str = "context", limit: int | None = None,
                    exact_bonus: float = 0.0) -> DataFrame:
    """Order by score, then strength, then incoming position."""
    scored = _strength(df).withColumn("rank_score", rank_score(
        F.col(context), F.col("retrieval_source"), F.col("similarity"), F.col("law_no"),
        F.col("article_type"), F.col("article_no"), exact_bonus))
    window = Window.partitionBy("q_id").orderBy(
        F.desc("rank_score"), F.desc("_prio"), F.desc("_sim"), F.asc("ord"))
    ranked = scored.withColumn("rank", F.row_number().over(window)).drop("_prio", "_sim")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


# --- expansion -------------------------------------------------------------------

def article_links(articles: DataFrame, edges: DataFrame | None, present: int = V.PREVIOUS_LIMIT, extra: int = V.GRAPH_EXTRA) -> DataFrame:
    """Slim lookup row per article: its id and key, its previous article where the body
    mentions one, and the articles it cites.

    The cited list keeps the first ``present + extra`` distinct existing targets.  That is exact for an
    expansion that takes at most ``extra`` new documents and meets at most ``present`` ones already there;
    ``expand_cited`` refuses larger limits than its list was made for.
    """
    slim = articles.select(
        "id", "source_type", "law_no", "regulation_name", "article_type", "article_no",
        mentions_previous_article(F.col("text")).alias("mentions_previous"))
    statutes = slim.where(F.col("source_type") == "mevzuat")
    doc = F.struct("id", "law_no", "article_type", "article_no")
    targets = statutes.select(F.col("law_no").alias("target_law_no"),
                              F.col("article_type").alias("target_article_type"),
                              F.col("article_no").alias("target_article_no"), doc.alias("target"))
    if edges is None:
        cited = statutes.limit(0).select("id", F.array(doc).alias("cited"))
    else:
        sources = statutes.select(F.col("law_no").alias("source_law_no"),
                                  F.col("article_type").alias("source_article_type"),
                                  F.col("article_no").alias("source_article_no"), "id")
        links = (edges.groupBy("source_law_no", "source_article_type", "source_article_no",
                               "target_law_no", "target_article_type", "target_article_no")
                 .agg(F.min("ord").alias("ord"))
                 .join(targets, ["target_law_no", "target_article_type", "target_article_no"])
                 .join(sources, ["source_law_no", "source_article_type", "source_article_no"]))
        first = top_per_key(links, ["id"], [F.col("ord")], present + extra, "_n")
        cited = first.groupBy("id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_n", "target"))), lambda x: x["target"]).alias("cited"))
    linked = slim.join(cited, "id", "left")
    # The previous article, with what it cites in turn.
    number = F.when((F.col("article_type") == "madde") & F.col("article_no").rlike(r"^\d+$"),
                    F.col("article_no").try_cast("bigint"))
    before = (linked.where((F.col("source_type") == "mevzuat") & (F.col("article_type") == "madde"))
              .select("law_no", F.col("article_no").alias("_prev_no"),
                      F.struct("id", "law_no", "article_type", "article_no", "cited").alias("previous")))
    wanted = linked.withColumn("_prev_no", F.when(
        F.col("mentions_previous") & (F.col("source_type") == "mevzuat") & (number > 1),
        (number - 1).cast("string")))
    return wanted.join(before, ["law_no", "_prev_no"], "left").drop("_prev_no")


_CARRIED = ["id", "law_no", "article_type", "article_no"]
_DOCS = "array<struct<id:bigint,law_no:string,article_type:string,article_no:string>>"


def _extras(df: DataFrame, extras: Column, source: str, limit: int) -> DataFrame:
    """Each row followed by the documents ``extras`` names, new ones only, at most ``limit``.

    Rows and their extras come out of one explode, so the candidates are read once.
    """
    own = F.struct(F.lit(0).alias("stage"), F.lit(0).alias("nth"), F.lit(None).cast(
        f"struct<id:bigint,law_no:string,article_type:string,article_no:string,cited:{_DOCS}>").alias("doc"))
    added = F.transform(extras, lambda d, i: F.struct(
        F.lit(1).alias("stage"), i.alias("nth"), d.alias("doc")))
    both = F.when(extras.isNotNull(), F.concat(F.array(own), added)).otherwise(F.array(own))
    rows = df.withColumn("_x", F.explode(both))
    extra = F.col("_x.stage") == 1
    pick = lambda c: F.when(extra, F.col(f"_x.doc.{c}")).otherwise(F.col(c)).alias(c)
    kept = [c for c in df.columns if c not in _CARRIED + [
        "ord", "retrieval_source", "similarity", "source_type", "cited", "previous", "mentions_previous"]]
    flat = rows.select(
        *kept, *[pick(c) for c in _CARRIED],
        F.when(extra, F.lit("mevzuat")).otherwise(F.col("source_type")).alias("source_type"),
        F.when(extra, F.lit(source)).otherwise(F.col("retrieval_source")).alias("retrieval_source"),
        F.when(~extra, F.col("similarity")).alias("similarity"),
        F.when(extra, F.col("_x.doc.cited")).otherwise(F.col("cited")).alias("cited"),
        F.col("_x.stage").alias("stage"), "ord", F.col("_x.nth").alias("nth"))
    fresh = Window.partitionBy("q_id", "id").orderBy("stage", "ord", "nth")
    nth = Window.partitionBy("q_id", "stage").orderBy("ord", "nth")
    return (flat.withColumn("_rn", F.row_number().over(fresh)).where(F.col("_rn") == 1)
            .withColumn("_nth", F.row_number().over(nth))
            .where((F.col("stage") == 0) | (F.col("_nth") <= limit)).drop("_rn", "_nth"))


def expand_previous(df: DataFrame, limit: int = V.PREVIOUS_EXTRA) -> DataFrame:
    """Add the previous article of candidates whose body mentions it."""
    previous = F.when(F.col("previous").isNotNull(), F.array("previous"))
    return _extras(df, previous, "previous_article_ref", limit)


def expand_cited(df: DataFrame, limit: int = V.GRAPH_EXTRA, extra: int = V.GRAPH_EXTRA) -> DataFrame:
    """Add the articles that candidates cite, one hop; ``extra`` is what the lists of ``article_links`` were made for."""
    if limit > extra:
        raise ValueError(f"the cited lists hold {extra} new articles, not {limit}; pass extra to article_links")
    docs = F.transform("cited", lambda d: d.withField("cited", F.lit(None).cast(_DOCS)))
    return _extras(df, docs, "reference_graph", limit)

