"""Lookups, search, merging, expansion, ranking and the whole retrieval result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import content_hash
from ..operators import candidates as C
from ..operators import corpus, keywords, lookup, parsing, vector_index
from ..plans import retrieval
from ..plans.accuracy import golden_accuracy
from ..session import cut_lineage, shared_folder
from ..sources import corpus_store
from ..sources.readers import read_by_law
from ..sources.writers import replace_laws
from .inputs import VIEWS, cte, derived, spread, table

Q: dict = {}


def register(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


_big = lambda c: F.col(c).cast("bigint").alias(c)


# --- lookups -------------------------------------------------------------------

@register("j01_direct_articles", cte("asked_refs", "statutes") + """
SELECT r.q_id, CAST(r.ord AS BIGINT) AS ord, s.id, s.law_no, s.article_type, s.article_no FROM asked_refs r
JOIN statutes s ON s.law_no = r.law_no AND s.article_no = r.article_no AND s.article_type = r.article_type""")
def _(spark, sf):
    found = lookup.direct_articles(derived(spark, sf, "asked_refs"), derived(spark, sf, "statutes"))
    return found.select("q_id", _big("ord"), "id", "law_no", "article_type", "article_no")


@register("j01_stored_articles", cte("asked_refs", "statutes") + """
SELECT r.q_id, CAST(r.ord AS BIGINT) AS ord, s.id, s.law_no, s.article_type, s.article_no FROM asked_refs r
JOIN statutes s ON s.law_no = r.law_no AND s.article_no = r.article_no AND s.article_type = r.article_type""")
def _(spark, sf):
    """The lookup against a table that is stored in buckets of the article key."""
    name = f"articles_{uuid.uuid4().hex}"
    stored = corpus_store.store_lookup(derived(spark, sf, "statutes"), name, f"{shared_folder(spark)}/{name}", lookup.STATUTE_KEY, _buckets(spark))
    return lookup.direct_articles(derived(spark, sf, "asked_refs"), stored).select("q_id", _big("ord"), "id", "law_no", "article_type", "article_no")


def _buckets(spark):
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("s04_wanted_laws", cte("asked", "statutes") + " SELECT id, law_no, article_no FROM statutes WHERE law_no IN (SELECT law_no FROM asked)")
def _(spark, sf):
    """The laws that questions name, out of a table stored by law."""
    path = f"{shared_folder(spark)}/laws-{uuid.uuid4().hex}"
    replace_laws(derived(spark, sf, "statutes").select("id", "law_no", "article_no"), path)
    return corpus_store.read_laws(spark, path, derived(spark, sf, "asked")).select("id", "law_no", "article_no")


@register("s05_load_of_touched_laws", cte("statutes") + """, e AS (SELECT id, law_no, article_type, article_no,
  CASE WHEN law_no IN ('6098', '6100') AND id % 3 = 0 THEN concat(text, ' değişik') ELSE text END AS text FROM statutes)
SELECT law_no, count(*) AS articles, count(CASE WHEN text LIKE '% değişik' THEN 1 END) AS changed FROM e GROUP BY law_no""")
def _(spark, sf):
    """A batch of two laws loaded into the store: its laws are replaced, the others stay."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    articles = derived(spark, sf, "statutes").select("id", "source_type", "law_no", "law_name", "article_type", "article_no", "text").withColumn(
        "content_hash", content_hash(F.col("text")))
    articles = cut_lineage(articles)
    corpus_store.create_store(path, articles, corpus.chunk_rows(articles), corpus.citation_edges(articles))
    edited = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" değişik"))).otherwise(F.col("text"))
    corpus_store.load_batch(spark, path, articles.where(F.col("law_no").isin("6098", "6100")).withColumn("text", edited).drop("content_hash"))
    return read_by_law(spark, f"{path}/articles").groupBy("law_no").agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(F.col("text").endswith(" değişik")).alias("changed"))


@register("j02_direct_regulations", cte("asked", "statutes") + """
SELECT a.q_id, s.id, s.law_no, concat(s.law_name, ' Yönetmeliği') AS law_name, s.article_no FROM asked a
JOIN statutes s ON s.law_no = a.law_no AND s.article_no = CAST(a.n AS VARCHAR) AND s.article_type = 'madde'""")
def _(spark, sf):
    regs = derived(spark, sf, "statutes").withColumn("source_type", F.lit("yonetmelik")).withColumn(
        "regulation_name", F.concat("law_name", F.lit(" Yönetmeliği")))
    names = regs.select("law_no", "regulation_name").distinct()
    asked = derived(spark, sf, "asked").join(names, "law_no").select(
        "q_id", "law_no", "regulation_name", F.col("n").cast("string").alias("article_no"), F.lit("madde").alias("article_type"))
    return lookup.direct_regulation_articles(asked, regs).select("q_id", "id", "law_no", "law_name", "article_no")


@register("j03_by_ids", "SELECT l_orderkey, l_linenumber, p_partkey AS id, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"))
    return lookup.by_ids(ids, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"))


@register("j04_keyword_matches", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def _(spark, sf):
    texts = spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")))
    return keywords.substring_matches(table(spark, sf, "benchmark"), texts, "text", "body", "item_id", "doc_id")


# One word of every passage, over whole documents: short patterns and common runs of characters.
_ONE_WORD = """w AS (SELECT item_id, string_split(text, ' ')[item_id % 7 + 1] AS word FROM benchmark),
u AS (SELECT DISTINCT lower(word) AS lw FROM w WHERE length(word) > 0)"""


@register("j04_one_word_questions", f"""WITH {_ONE_WORD}, d AS (SELECT doc_id, source, lower(text) AS lt FROM documents),
hits AS (SELECT lw, doc_id, source FROM u JOIN d ON contains(lt, lw)),
top AS (SELECT *, row_number() OVER (PARTITION BY lw ORDER BY source, doc_id) AS ord FROM hits QUALIFY ord <= 8)
SELECT item_id AS q_id, doc_id AS id, CAST(ord AS BIGINT) AS ord FROM w JOIN top ON lw = lower(word)""")
def _(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.get(F.split("text", " "), (F.col("item_id") % 7).cast("int")).alias("question"))
    texts = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source"))
    return keywords.keyword_search(asked, texts, 8, [F.col("source"), F.col("id")]).select("q_id", "id", "ord")


@register("j04_stored_counts", f"""WITH {_ONE_WORD}, d AS (SELECT doc_id, lower(text) AS lt FROM documents)
SELECT item_id, count(*) AS documents FROM w JOIN d ON length(word) > 0 AND contains(lt, lower(word)) GROUP BY item_id""")
def _(spark, sf):
    """The same search over a frequency table that is stored with the corpus."""
    asked = table(spark, sf, "benchmark").select("item_id", F.get(F.split("text", " "), (F.col("item_id") % 7).cast("int")).alias("question"))
    texts = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    counts = cut_lineage(keywords.key_counts(texts))
    # counted once per distinct word, so that no pair of an item and a document becomes a row
    worded = asked.select("item_id", F.lower("question").alias("question"))
    hits = keywords.substring_matches(worded.select("question").distinct(), texts, "question", "text", "question", "id", counts)
    found = hits.groupBy("question").agg(F.count(F.lit(1)).alias("documents"))
    return worded.join(found, "question").groupBy("item_id").agg(F.sum("documents").alias("documents"))


@register("j04_short_keywords", cte("statutes") + """, pat AS (
SELECT p_partkey AS q_id, (([upper(p_name), p_brand, p_type, '(2) ' || p_type, p_name || ' hükmü ' || p_type, ') ' || p_name || ' b) ' || p_brand]))[p_partkey % 6 + 1] AS question FROM part),
u AS (SELECT DISTINCT lower(question) AS lq FROM pat),
hits AS (SELECT lq, id, law_no, article_type, article_no FROM u JOIN statutes ON contains(lower(text), lq)),
top AS (SELECT *, row_number() OVER (PARTITION BY lq ORDER BY law_no, article_type, article_no, id) AS ord FROM hits QUALIFY ord <= 4)
SELECT q_id, id, CAST(ord AS BIGINT) AS ord FROM pat JOIN top ON lq = lower(question)""")
def _(spark, sf):
    forms = [F.upper("p_name"), F.col("p_brand"), F.col("p_type"), F.concat(F.lit("(2) "), "p_type"), F.concat("p_name", F.lit(" hükmü "), "p_type"),
             F.concat(F.lit(") "), "p_name", F.lit(" b) "), "p_brand")]
    q = F.get(F.array(*forms), (F.col("p_partkey") % 6).cast("int"))
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("q_id"), q.alias("question"))
    order = [F.col(c) for c in ("law_no", "article_type", "article_no", "id")]
    return keywords.keyword_search(asked, derived(spark, sf, "statutes"), V.KEYWORD_COUNT, order).select("q_id", "id", "ord")


_COS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS q_id, b.vec_id AS v_id, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, v_id) AS rank FROM p)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return (e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector")),
            e.select(F.col("vec_id").alias("v_id"), F.col("embedding").alias("vector")))


@register("j05_chunk_vectors", _COS + " SELECT q_id, v_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM t WHERE rank <= 8")
def _(spark, sf):
    return lookup.vector_top_k(*_vectors(spark, sf), V.SEMANTIC_COUNT).select(
        "q_id", "v_id", _big("rank"), F.round("similarity", 6).alias("similarity"))


def _index(spark, sf, cells=None):
    _q, v = _vectors(spark, sf)
    return vector_index.build_index(v, f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}", cells)


@register("j05_all_cells_probed", _COS + " SELECT q_id, v_id, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM t WHERE rank <= 8")
def _(spark, sf):
    """With every cell probed, the inverted lists give the exact result."""
    index = _index(spark, sf, 12)
    found = vector_index.approximate_top_k(_vectors(spark, sf)[0], index, V.SEMANTIC_COUNT, len(index.centers))
    return found.select("q_id", "v_id", _big("rank"), F.round("similarity", 6).alias("similarity"))


@register("j05_approximate_recall", """
SELECT count(*) AS queries, 8 * count(*) AS wanted, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0""")
def _(spark, sf):
    """Recall at 8 against the exact search, for every hundredth vector, with the number of probes fitted on other rows."""
    q, v = _vectors(spark, sf)
    index = _index(spark, sf)
    probes = vector_index.calibrated_probes(index, q.where("q_id % 100 <> 0"), V.SEMANTIC_COUNT)
    q = q.where("q_id % 100 = 0")
    found = vector_index.approximate_top_k(q, index, V.SEMANTIC_COUNT, probes)
    measured = vector_index.recall(found, lookup.vector_top_k(q, v, V.SEMANTIC_COUNT))
    return measured.select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"))


# Two documents make one article; a document has the vector of its number, so many similarities tie.
_BEST = """
WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT doc_id AS v_id, doc_id - doc_id % 2 AS article_id, e FROM documents, n JOIN v ON vec_id = doc_id % n),
p AS (SELECT v.vec_id AS q_id, c.v_id, c.article_id, list_cosine_similarity(v.e, c.e) AS sim FROM v, c),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, v_id) AS rank FROM p),
b AS (SELECT q_id, article_id, max(sim) AS sim, min_by(v_id, rank) AS chunk FROM t WHERE rank <= 8 GROUP BY ALL)
"""


@register("j06_best_chunk_articles", _BEST + """
SELECT q_id, doc_id AS id, chunk AS chunk_index, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, doc_id) AS ord
FROM b JOIN documents ON doc_id = article_id""")
def _(spark, sf):
    q, v = _vectors(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    owned = docs.select(F.col("id").alias("v_id"), (F.col("id") % v.count()).alias("own"))
    chunks = owned.join(v.select(F.col("v_id").alias("own"), "vector"), "own")
    hits = lookup.vector_top_k(q, chunks.select("v_id", "vector"), V.SEMANTIC_COUNT).drop("rank")
    rows = owned.select("v_id", (F.col("v_id") - F.col("v_id") % 2).alias("article_id"), F.col("v_id").alias("chunk_index"), F.lit("").alias("chunk_text"))
    return lookup.best_chunk_articles(hits, rows, docs).select(
        "q_id", "id", "chunk_index", F.round("similarity", 6).alias("similarity"), "ord")


@register("j07_decision_vectors", """
WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS q_id, b.vec_id AS own, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b),
d AS (SELECT o_orderkey AS id, o_orderstatus AS chamber, o_orderkey % n AS own FROM orders, n),
t AS (SELECT q_id, id, chamber, sim, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 12) DESC, id) AS rank FROM s JOIN d USING (own)
      QUALIFY rank <= 5)
SELECT q_id, id, chamber, round(sim, 6) AS similarity FROM t""")
def _(spark, sf):
    q, v = _vectors(spark, sf)
    decisions = _decisions(spark, sf).select("id", "chamber")
    owned = decisions.select(F.col("id").alias("v_id"), (F.col("id") % v.count()).alias("own")).join(
        v.select(F.col("v_id").alias("own"), "vector"), "own")
    hits = lookup.vector_top_k(q, owned.select("v_id", "vector"), V.DECISION_COUNT, vector_blocks=3)
    return hits.withColumnRenamed("v_id", "id").join(decisions, "id").select("q_id", "id", "chamber", F.round("similarity", 6).alias("similarity"))


def _decisions(spark, sf):
    o, year = table(spark, sf, "orders"), (F.col("o_custkey") % 35 + 1990).cast("string")
    no = F.col("o_orderkey").cast("string")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("chamber"), F.concat(year, F.lit("/"), no).alias("case_no"),
                    F.concat(F.lit("K "), F.col("o_custkey").cast("string")).alias("decision_no"),
                    F.concat(F.lit("bkz. 2001/"), F.col("o_custkey").cast("string"), F.lit(" sayılı karar")).alias("text"))


@register("j08_case_number_search", """
WITH d AS (SELECT o_orderkey AS id, concat(CAST(1990 + o_custkey % 35 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)) AS case_no,
  concat('K ', CAST(o_custkey AS VARCHAR)) AS decision_no, concat('bkz. 2001/', CAST(o_custkey AS VARCHAR), ' sayılı karar') AS text FROM orders),
q AS (SELECT c_custkey AS q_id, 0 AS nth, concat(CAST(1990 + c_custkey % 35 AS VARCHAR), '/', CAST(c_custkey AS VARCHAR)) AS num FROM customer
      UNION ALL SELECT c_custkey, 1, concat('2001/', CAST(c_custkey AS VARCHAR)) FROM customer),
h AS (SELECT q_id, id, min(nth) AS nth FROM q JOIN d ON contains(case_no, num) OR contains(decision_no, num) OR contains(text, num) GROUP BY q_id, id)
SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY nth, id) AS rank FROM h QUALIFY rank <= 5""")
def _(spark, sf):
    no = F.col("c_custkey").cast("string")
    q = F.concat((F.col("c_custkey") % 35 + 1990).cast("string"), F.lit(" / "), no, F.lit(" E. veya 2001/"), no, F.lit(" K."))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("q_id"), q.alias("question"))
    return lookup.case_number_search(asked, _decisions(spark, sf), V.CASE_COUNT).select("q_id", "id", _big("rank"))


# --- merging and ranking ---------------------------------------------------------

# Candidates: document number n + id for a question asking for n.
VIEWS["cands"] = ("""
SELECT c.q_id, c.id, c.line, c.sim, c.line * 10 + c.id AS ord, a.n, a.form, a.law_no AS asked_law,
  CASE WHEN c.id % 4 = 3 THEN '4721' ELSE a.law_no END AS law_no, CAST(a.n + c.id AS VARCHAR(20)) AS article_no,
  CASE c.line WHEN 1 THEN 'semantic' WHEN 2 THEN 'keyword' WHEN 3 THEN 'direct_article_lookup' WHEN 4 THEN 'reference_graph'
    WHEN 5 THEN 'semantic_or_keyword' WHEN 6 THEN 'previous_article_ref' ELSE 'other' END AS retrieval_source
FROM (SELECT l_orderkey AS q_id, l_partkey % 6 AS id, CAST(l_linenumber AS BIGINT) AS line, MAX(l_discount) AS sim FROM lineitem
      GROUP BY l_orderkey, l_partkey % 6, l_linenumber) c
JOIN asked a ON a.q_id = c.q_id""", ["asked"])
_PRIO = """CASE retrieval_source WHEN 'direct_article_lookup' THEN 100 WHEN 'direct_yonetmelik_lookup' THEN 95 WHEN 'semantic' THEN 70
 WHEN 'semantic_or_keyword' THEN 60 WHEN 'keyword' THEN 50 WHEN 'reference_graph' THEN 30 WHEN 'previous_article_ref' THEN 20 ELSE 10 END"""


def _cands(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    # candidates of a question lie together; parts of a fixed number are not put together again, so that no task sorts many
    df = derived(spark, sf, "cands").repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "q_id")
    return df.withColumn("similarity", F.when(F.col("line") < 4, F.col("sim"))).drop("sim")


_MERGED = cte("cands") + f""", s AS (SELECT *, {_PRIO} AS prio, CASE WHEN line < 4 THEN sim ELSE 0 END AS s0, CASE WHEN line < 4 THEN sim END AS similarity FROM cands),
b AS (SELECT *, min(ord) OVER (PARTITION BY q_id, id) AS fst, row_number() OVER (PARTITION BY q_id, id ORDER BY prio DESC, s0 DESC, ord) AS rn FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prio DESC, s0 DESC, fst) AS pos FROM b WHERE rn = 1)"""


@register("w01_merge_candidates", _MERGED + " SELECT q_id, id, retrieval_source, round(similarity, 6) AS similarity, pos AS ord FROM m WHERE pos <= 3")
def _(spark, sf):
    return C.merge_candidates(_cands(spark, sf), 3, "id").select("q_id", "id", "retrieval_source", F.round("similarity", 6).alias("similarity"), "ord")


@register("w02_keep_first", cte("cands") + " SELECT q_id, id, ord FROM cands QUALIFY row_number() OVER (PARTITION BY q_id, id ORDER BY ord) = 1")
def _(spark, sf):
    return C.keep_first(_cands(spark, sf), ["q_id", "id"]).select("q_id", "id", "ord")


@register("w03_document_key", cte("statutes") + """
SELECT id, concat_ws('|', CASE WHEN p_size % 2 = 0 THEN 'yonetmelik' ELSE 'mevzuat' END, law_no,
  CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN concat(law_name, ' Y') ELSE law_name END ELSE '' END, 'madde', article_no) AS key FROM statutes""")
def _(spark, sf):
    even = F.col("p_size") % 2 == 0
    rows = derived(spark, sf, "statutes").withColumn("source_type", F.when(even, "yonetmelik")).withColumn(
        "regulation_name", F.when(F.col("p_size") % 4 == 0, F.concat("law_name", F.lit(" Y"))).otherwise("")).withColumn(
        "article_type", F.lit(None).cast("string"))
    return rows.select("id", C.document_key().alias("k")).select("id", F.concat_ws("|", "k.source_type", "k.law_no", "k.name", "k.article_type", "k.article_no").alias("key"))


@register("w04_normalised_candidates", cte("cands") + """
SELECT q_id, id, 'mevzuat' AS source_type, law_no, 'madde' AS article_type, article_no, '' AS text, '' AS chunk_text, round(CASE WHEN line < 4 THEN sim END, 6) AS similarity, retrieval_source FROM cands""")
def _(spark, sf):
    return C.normalise_candidates(_cands(spark, sf)).select("q_id", "id", "source_type", "law_no", "article_type", "article_no", "text", "chunk_text",
                                                            F.round("similarity", 6).alias("similarity"), "retrieval_source")


@register("w05_source_priority", cte("cands") + f" SELECT q_id, id, ord, CAST({_PRIO} AS BIGINT) AS priority FROM cands")
def _(spark, sf):
    return _cands(spark, sf).select("q_id", "id", "ord", C.priority(F.col("retrieval_source")).cast("bigint").alias("priority"))


@register("w06_ranking_context", cte("asked_refs") + """
SELECT q_id, any_value(law_no) AS law_no, string_agg(article_no, ',' ORDER BY ord) AS anchors FROM asked_refs GROUP BY q_id""")
def _(spark, sf):
    return _contexts(spark, sf).select("q_id", "context.law_no", F.concat_ws(",", F.transform("context.anchors", lambda a: a.cast("string"))).alias("anchors"))


def _contexts(spark, sf):
    asked = parsing.with_normalised(derived(spark, sf, "questions").select("q_id", "question"), "question")
    return parsing.per_distinct(asked, "normalised", lambda d: parsing.parse_resolved(d, "normalised")).select("q_id", "context")


# Distance of document n + id to the numbers a question form names.
_DIST = """CASE form WHEN 1 THEN greatest(0, id - 3) WHEN 4 THEN greatest(0, id - 4)
  WHEN 2 THEN ([0, 1, 0, 1, 1, 0])[id + 1] ELSE id END"""
_SCORE = f"""({_PRIO}) + coalesce(CASE WHEN line < 4 THEN sim END, 0) * 20.0 + CASE WHEN law_no = asked_law THEN 120.0 ELSE 0 END
 + CASE WHEN {_DIST} = 0 THEN 150.0 WHEN {_DIST} = 1 THEN 60.0 WHEN {_DIST} <= 3 THEN 30.0 WHEN {_DIST} <= 5 THEN 10.0 ELSE 0 END
 - CASE retrieval_source WHEN 'reference_graph' THEN 20.0 WHEN 'previous_article_ref' THEN 30.0 ELSE 0 END"""


@register("w07_rank_score", cte("cands") + f" SELECT q_id, id, ord, round(CAST({_SCORE} AS DOUBLE), 6) AS score FROM cands")
def _(spark, sf):
    rows = _cands(spark, sf).join(_contexts(spark, sf), "q_id")
    score = C.rank_score(F.col("context"), F.col("retrieval_source"), F.col("similarity"), F.col("law_no"), F.lit("madde"), F.col("article_no"))
    return rows.select("q_id", "id", "ord", F.round(score, 6).alias("score"))


@register("w08_ranked_candidates", cte("cands") + f""", s AS (SELECT *, round(CAST({_SCORE} AS DOUBLE), 9) AS score, {_PRIO} AS prio, coalesce(CASE WHEN line < 4 THEN sim END, 0) AS s0 FROM cands)
SELECT q_id, id, ord, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, prio DESC, s0 DESC, ord) AS rank FROM s QUALIFY rank <= 5""")
def _(spark, sf):
    rows = _cands(spark, sf).withColumn("article_type", F.lit("madde")).join(_contexts(spark, sf), "q_id")
    return C.rank_candidates(rows, "context", 5).select("q_id", "id", "ord", _big("rank"))


@register("w09_stage_caps", _MERGED + """, x AS (SELECT q_id, id, pos FROM m WHERE pos <= 4),
y AS (SELECT *, 100 AS prio FROM x UNION ALL SELECT q_id, id + 6, 1000 + pos, 20 FROM x),
z AS (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY prio DESC, pos) AS ord FROM y)
SELECT q_id, id, ord FROM z WHERE ord <= 6""")
def _(spark, sf):
    first = C.merge_candidates(_cands(spark, sf), 4, "id").withColumn("retrieval_source", F.lit("direct_article_lookup")).withColumn(
        "similarity", F.lit(None).cast("double"))
    extra = first.withColumn("id", F.col("id") + 6).withColumn("retrieval_source", F.lit("previous_article_ref"))
    return C.merge_candidates(C.union_candidates(first, extra), 6, "id").select("q_id", "id", "ord")


@register("t06_candidate_union", cte("cands") + """
SELECT q_id, id, CAST(0 AS BIGINT) AS stage, ord, retrieval_source FROM cands UNION ALL SELECT q_id, id, 1, ord, 'keyword' FROM cands""")
def _(spark, sf):
    rows = _cands(spark, sf).select("q_id", "id", "ord", "retrieval_source")
    return C.union_candidates(rows, rows.withColumn("retrieval_source", F.lit("keyword"))).select("q_id", "id", _big("stage"), "ord", "retrieval_source")


# --- expansion and the whole result ------------------------------------------------

_ST = cte("asked_refs", "questions", "statutes") + """, st AS (SELECT *, n % 4 AS b, lower(text) AS lt FROM statutes),
edges AS (
  SELECT id AS src, 1 AS eo, '6098' AS tl, CAST(p_size + 1 AS VARCHAR) AS tn FROM st WHERE b = 2 AND article_type = 'madde'
  UNION ALL SELECT id, 2, law_no, CAST(n + 1 AS VARCHAR) FROM st WHERE b = 2 AND article_type = 'madde'
  UNION ALL SELECT id, 1, '6098', CAST(p_size AS VARCHAR) FROM st WHERE b = 3 AND article_type = 'madde'),
cited AS (SELECT e.src, e.eo, t.id FROM edges e JOIN st t ON t.law_no = e.tl AND t.article_no = e.tn AND t.article_type = 'madde'),
prev AS (SELECT a.id AS src, p.id FROM st a JOIN st p ON p.law_no = a.law_no AND p.article_type = 'madde' AND p.n = a.n - 1 WHERE a.b = 1 AND a.article_type = 'madde' AND a.n > 1),
explicit AS (SELECT r.q_id, s.id, 100 AS prio, row_number() OVER (PARTITION BY r.q_id ORDER BY r.ord) AS pos FROM asked_refs r
  JOIN st s ON s.law_no = r.law_no AND s.article_no = r.article_no AND s.article_type = r.article_type)"""


def _links(spark, sf):
    articles = derived(spark, sf, "statutes")
    return C.article_links(articles, corpus.citation_edges(articles))


def _explicit(spark, sf):
    resolved = cut_lineage(retrieval.resolve_questions(derived(spark, sf, "questions").select("q_id", "question")))
    return retrieval.explicit_candidates(resolved, cut_lineage(_links(spark, sf)))


_PREV = """, pc AS (SELECT m.q_id, p.id, min(m.pos) AS pos FROM {m} m JOIN prev p ON p.src = m.id
  WHERE NOT EXISTS (SELECT 1 FROM {m} o WHERE o.q_id = m.q_id AND o.id = p.id) GROUP BY m.q_id, p.id),
pe AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY pos, id) AS k FROM pc QUALIFY k <= 4)"""


@register("j09_previous_article", _ST + _PREV.format(m="explicit") + " SELECT q_id, id, k AS ord FROM pe")
def _(spark, sf):
    rows = C.expand_previous(_explicit(spark, sf)).where(F.col("retrieval_source") == "previous_article_ref")
    return C.merge_candidates(rows, V.PREVIOUS_EXTRA, "id").select("q_id", "id", "ord")


@register("j10_cited_articles", _ST + """, gc AS (SELECT m.q_id, c.id, min(m.pos * 100 + c.eo) AS pos FROM explicit m JOIN cited c ON c.src = m.id
  WHERE NOT EXISTS (SELECT 1 FROM explicit o WHERE o.q_id = m.q_id AND o.id = c.id) GROUP BY m.q_id, c.id)
SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY pos) AS ord FROM gc QUALIFY ord <= 6""")
def _(spark, sf):
    rows = C.expand_cited(_explicit(spark, sf)).where(F.col("retrieval_source") == "reference_graph")
    return C.merge_candidates(rows, V.GRAPH_EXTRA, "id").select("q_id", "id", "ord")


@register("j14_open_questions", _ST + " SELECT q_id FROM questions WHERE q_id NOT IN (SELECT q_id FROM explicit)")
def _(spark, sf):
    found = _explicit(spark, sf).select("q_id").distinct()
    return derived(spark, sf, "questions").join(found, "q_id", "left_anti").select("q_id")


@register("j14_semantic_fallback", _ST + """, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS q_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b
      WHERE a.vec_id IN (SELECT q_id FROM questions) AND a.vec_id NOT IN (SELECT q_id FROM explicit)),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, id) AS ord FROM p QUALIFY ord <= 8)
SELECT t.q_id, t.id, round(t.sim, 6) AS similarity FROM t JOIN st ON st.id = t.id""")
def _(spark, sf):
    resolved = cut_lineage(retrieval.resolve_questions(derived(spark, sf, "questions").select("q_id", "question")))
    links = cut_lineage(_links(spark, sf))
    q, v = _vectors(spark, sf)
    rows = v.withColumn("article_id", F.col("v_id")).withColumn("chunk_index", F.lit(0)).withColumn("chunk_text", F.lit(""))
    found = retrieval.semantic_candidates(resolved, retrieval.explicit_candidates(resolved, links), links, q, rows)
    return found.select("q_id", "id", F.round("similarity", 6).alias("similarity"))


_P22 = _ST + """, uq AS (SELECT DISTINCT lower(normalised) AS lq FROM (SELECT CASE form WHEN 5 THEN concat(alias, ' ', CAST(n AS VARCHAR), ' 2. fıkra')
   WHEN 4 THEN concat(alias, ' m. ', CAST(n AS VARCHAR), ' ve devamı') ELSE question END AS normalised FROM questions)),
rq AS (SELECT *, CASE form WHEN 5 THEN concat(alias, ' ', CAST(n AS VARCHAR), ' 2. fıkra') WHEN 4 THEN concat(alias, ' m. ', CAST(n AS VARCHAR), ' ve devamı') ELSE question END AS resolved FROM questions),
kh AS (SELECT lq, id, row_number() OVER (PARTITION BY lq ORDER BY law_no, article_type, article_no, id) AS k FROM uq JOIN st ON contains(lt, lq) QUALIFY k <= 4),
kw AS (SELECT q_id, id, 50 AS prio, 1000000 + k AS pos FROM rq JOIN kh ON lq = lower(resolved)),
u1 AS (SELECT q_id, id, max(prio) AS prio, min(pos) AS pos FROM (SELECT * FROM explicit UNION ALL SELECT * FROM kw) GROUP BY q_id, id),
m1 AS (SELECT q_id, id, prio, np AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prio DESC, pos) AS np FROM u1) WHERE np <= 10)
""" + _PREV.format(m="m1") + """,
m2 AS (SELECT q_id, id, prio, np AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prio DESC, pos) AS np FROM (
   SELECT * FROM m1 UNION ALL SELECT q_id, id, 20, 1000 + k FROM pe)) WHERE np <= 12),
gc AS (SELECT m.q_id, c.id, min(m.pos * 100 + c.eo) AS pos FROM m2 m JOIN cited c ON c.src = m.id
  WHERE NOT EXISTS (SELECT 1 FROM m2 o WHERE o.q_id = m.q_id AND o.id = c.id) GROUP BY m.q_id, c.id),
ge AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY pos) AS k FROM gc QUALIFY k <= 6),
m3 AS (SELECT q_id, id, prio, np AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY prio DESC, pos) AS np FROM (
   SELECT * FROM m2 UNION ALL SELECT q_id, id, 30, 1000 + k FROM ge)) WHERE np <= 18),
dist AS (SELECT m.q_id, m.id, min(abs(CAST(s.article_no AS BIGINT) - CAST(r.article_no AS BIGINT))) AS d FROM m3 m JOIN st s ON s.id = m.id JOIN asked_refs r ON r.q_id = m.q_id GROUP BY m.q_id, m.id),
sc AS (SELECT m.*, s.law_no, s.article_type, s.article_no, s.text, s.b, s.p_name, s.p_type, s.p_brand, s.p_size, q.form, q.resolved,
   m.prio + CASE WHEN s.law_no = q.law_no THEN 120 ELSE 0 END + CASE WHEN d = 0 THEN 150 WHEN d = 1 THEN 60 WHEN d <= 3 THEN 30 WHEN d <= 5 THEN 10 ELSE 0 END
   - CASE m.prio WHEN 30 THEN 20 WHEN 20 THEN 30 ELSE 0 END AS score
   FROM m3 m JOIN st s ON s.id = m.id JOIN rq q ON q.q_id = m.q_id JOIN dist x ON x.q_id = m.q_id AND x.id = m.id),
fin AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, prio DESC, pos) AS rank,
   CASE WHEN form = 5 THEN CASE b WHEN 1 THEN concat('(2) ', p_type, ' için: a) ', p_brand, ' uygulanır. b) ', CAST(p_size AS VARCHAR), ' gün beklenir.')
     WHEN 2 THEN concat('(2) 6098 sayılı Kanunun ', CAST(p_size + 1 AS VARCHAR), ' inci maddesi saklıdır.')
     WHEN 3 THEN concat('a) ', p_name, ' b) ', p_brand, ' c) TBK ', CAST(p_size AS VARCHAR)) END END AS found FROM sc)
SELECT q_id, resolved AS resolved_question, form = 9 AS decision_intent, rank, id, law_no, article_type, article_no,
  CASE prio WHEN 100 THEN 'direct_article_lookup' WHEN 50 THEN 'keyword' WHEN 30 THEN 'reference_graph' ELSE 'previous_article_ref' END AS retrieval_source,
  CAST(score AS DOUBLE) AS rank_score, found AS matched_text,
  CASE WHEN form <> 5 THEN 'not_requested' WHEN b = 0 THEN 'not_structured' ELSE 'matched' END AS extraction_status,
  left(coalesce(found, text), 300) AS preview FROM fin"""


def _retrieve(spark, sf):
    articles = corpus.with_structure(derived(spark, sf, "statutes"))
    questions = derived(spark, sf, "questions").select("q_id", "question")
    return retrieval.retrieve(questions, articles, corpus.citation_edges(articles))


@register("p22_retrieval", _P22)
def _(spark, sf):
    return _retrieve(spark, sf).select(
        "q_id", "resolved_question", "decision_intent", _big("rank"), "id", "law_no", "article_type", "article_no", "retrieval_source",
        "rank_score", "matched_text", "extraction_status", "preview")


@register("p22_stored_corpus", _P22)
def _(spark, sf):
    """The same result over a corpus that is stored in buckets, with its links and its key counts."""
    articles = cut_lineage(corpus.with_structure(derived(spark, sf, "statutes")))
    name = f"corpus_{uuid.uuid4().hex}"
    links = C.article_links(articles, corpus.citation_edges(articles))
    stored = corpus_store.store_lookups(articles, links, name, f"{shared_folder(spark)}/{name}", _buckets(spark))
    counts = cut_lineage(keywords.key_counts(articles))
    resolved = cut_lineage(retrieval.resolve_questions(derived(spark, sf, "questions").select("q_id", "question")))
    return retrieval.retrieve_resolved(resolved, stored["links"], stored["articles"], links_by_id=stored["links_by_id"], key_counts=counts).select(
        "q_id", "resolved_question", "decision_intent", _big("rank"), "id", "law_no", "article_type", "article_no", "retrieval_source",
        "rank_score", "matched_text", "extraction_status", "preview")


@register("a07_accuracy_of_the_job", _P22.rpartition("\nSELECT q_id, resolved AS")[0] + """,
w AS (SELECT q_id, list(concat_ws('|', s.law_no, s.article_type, s.article_no) ORDER BY pos) AS want FROM explicit e JOIN st s ON s.id = e.id GROUP BY q_id),
g AS (SELECT q_id, list(concat_ws('|', law_no, article_type, article_no) ORDER BY rank) AS got FROM fin GROUP BY q_id),
o AS (SELECT rq.q_id, want, coalesce(got, []) AS got FROM rq LEFT JOIN w ON w.q_id = rq.q_id LEFT JOIN g ON g.q_id = rq.q_id)
SELECT count(*) AS cases, count(*) AS resolved_passed, count(*) AS resolved_total, count(*) AS intent_passed, count(*) AS intent_total,
  count(CASE WHEN want[1] = got[1] THEN 1 END) AS top1_passed, count(want) AS top1_total,
  count(CASE WHEN want IS NOT NULL AND list_has_all(got, want) THEN 1 END) AS coverage_passed, count(want) AS coverage_total,
  count(CASE WHEN got[1:len(want)] = want THEN 1 END) AS prefix_passed, count(want) AS prefix_total FROM o""")
def _(spark, sf):
    """Golden questions, what they mean and the articles they name, through the whole retrieval."""
    articles = cut_lineage(corpus.with_structure(derived(spark, sf, "statutes")))
    links = cut_lineage(C.article_links(articles, corpus.citation_edges(articles)))
    number = F.col("n").cast("string")
    meant = F.when(F.col("form") == 5, F.concat("alias", F.lit(" "), number, F.lit(" 2. fıkra"))).when(
        F.col("form") == 4, F.concat("alias", F.lit(" m. "), number, F.lit(" ve devamı"))).otherwise(F.col("question"))
    named = derived(spark, sf, "asked_refs").join(derived(spark, sf, "statutes").select(*corpus.ARTICLE_KEY), corpus.ARTICLE_KEY)
    wanted = named.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("|", *corpus.ARTICLE_KEY).alias("doc")))),
                                                   lambda x: x["doc"]).alias("top_docs"))
    cases = derived(spark, sf, "questions").select(F.col("q_id").alias("case_id"), "question", meant.alias("resolved_question"),
                                                   (F.col("form") == 9).alias("decision_intent")).join(wanted.withColumnRenamed("q_id", "case_id"), "case_id", "left")
    return golden_accuracy(cases, links, articles)


# --- incremental loading ------------------------------------------------------------

def _change_inputs(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("law_no"), F.lit("madde").alias("article_type"),
                                            F.col("c_custkey").cast("string").alias("article_no"), F.col("c_custkey").alias("k"), F.col("c_name").alias("text"))
    stored = c.where(F.col("k") % 5 != 0).withColumn("content_hash", content_hash(F.col("text")))
    edited = F.when(F.col("k") % 3 == 0, F.concat("text", F.lit(" değişik"))).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    incoming = c.where(F.col("k") % 11 != 0).withColumn("text", edited)
    o = table(spark, sf, "orders").where(F.col("o_custkey") % 7 != 0).select(F.col("o_custkey").cast("string").alias("article_no"))
    chunks = o.join(c.select("law_no", "article_type", "article_no"), "article_no")
    return incoming, stored, corpus.chunk_counts(chunks)


_CHANGES = """
WITH cc AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey),
ch AS (SELECT c_mktsegment AS law_no, CAST(c_custkey AS VARCHAR) AS article_no, coalesce(n, 0) AS chunk_count,
  CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 3 = 0 THEN 'content_changed' WHEN coalesce(n, 0) = 0 THEN 'missing_chunks' ELSE 'same' END AS reason
  FROM customer LEFT JOIN cc ON o_custkey = c_custkey WHERE c_custkey % 11 <> 0)"""


@register("j11_change_detection", _CHANGES + " SELECT *, reason <> 'same' AS changed FROM ch")
def _(spark, sf):
    return corpus.detect_changes(*_change_inputs(spark, sf)).select("law_no", "article_no", "chunk_count", "reason", "changed")


@register("j12_missing_decisions", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('2020/', CAST(o_custkey AS VARCHAR)) END AS application_no,
  repeat(o_orderpriority, CAST(o_orderkey % 30 AS INTEGER)) AS text FROM orders)
SELECT application_no, o_orderkey FROM d WHERE application_no <> '' AND length(text) >= 100
  AND application_no NOT IN (SELECT concat('2020/', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal > 0)""")
def _(spark, sf):
    inc = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(
        F.concat(F.lit("2020/"), F.col("o_custkey").cast("string"))).alias("application_no"),
        F.repeat(F.col("o_orderpriority"), (F.col("o_orderkey") % 30).cast("int")).alias("text"))
    stored = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.concat(F.lit("2020/"), F.col("c_custkey").cast("string")).alias("application_no"))
    return corpus.missing_decisions(inc, stored).select("application_no", "o_orderkey")


@register("j13_compare_store", """
WITH a AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey % 5 <> 0),
x AS (SELECT coalesce(a.c_nationkey, b.c_nationkey) AS nk, a.c_custkey AS ak, b.c_custkey AS bk FROM a FULL JOIN b ON a.c_nationkey = b.c_nationkey AND a.c_custkey = b.c_custkey),
e AS (SELECT c_nationkey, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM customer GROUP BY 1)
SELECT CAST(nk AS VARCHAR) AS law_no, count(ak) AS source_count, count(bk) AS store_count, count(CASE WHEN bk IS NULL THEN 1 END) AS only_in_source,
  count(CASE WHEN ak IS NULL THEN 1 END) AS only_in_store, any_value(n) AS expected_count, abs(count(ak) - any_value(n)) > 10 AS drifted
FROM x JOIN e ON e.c_nationkey = nk GROUP BY nk""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("law_no"), F.col("c_custkey").alias("k"),
                                            F.col("c_custkey").cast("string").alias("article_no"), "c_acctbal")
    expected = c.groupBy("law_no").agg(F.count_if(F.col("c_acctbal") > 0).alias("expected_count"))
    return corpus.compare_store(c.where(F.col("k") % 11 != 0), c.where(F.col("k") % 5 != 0), expected)


@register("j15_unresolved_ids", """
SELECT c_mktsegment AS law_no, CAST(c_custkey AS VARCHAR) AS article_no FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 5 = 0""")
def _(spark, sf):
    incoming, stored, _counts = _change_inputs(spark, sf)
    return corpus.unresolved_ids(incoming, stored).select("law_no", "article_no")


@register("j15_distinct_ids", cte("statutes") + " SELECT law_no, count(*) AS articles, count(*) AS ids FROM statutes GROUP BY law_no")
def _(spark, sf):
    rows = derived(spark, sf, "statutes").withColumn("key_id", corpus.article_id())
    return rows.groupBy("law_no").agg(F.count("*").alias("articles"), F.countDistinct("key_id").alias("ids"))


@register("a02_chunk_counts", """SELECT c_mktsegment AS law_no, CAST(c_custkey AS VARCHAR) AS article_no, count(*) AS chunk_count
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 7 <> 0 GROUP BY 1, 2""")
def _(spark, sf):
    return _change_inputs(spark, sf)[2].select("law_no", "article_no", "chunk_count")


@register("a12_load_summary", _CHANGES + """ SELECT reason, count(*) AS articles, count(CASE WHEN reason <> 'same' THEN 1 END) AS changed,
 count(CASE WHEN reason = 'same' THEN 1 END) AS skipped, count(CASE WHEN reason <> 'same' THEN 1 END) AS chunks_added FROM ch GROUP BY reason""")
def _(spark, sf):
    return corpus.load_summary(corpus.detect_changes(*_change_inputs(spark, sf)))


