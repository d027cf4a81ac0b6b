"""Set differences, quality checks, reports and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import corpus, evaluate
from ..operators import quality as K
from .inputs import VIEWS, cte, derived, table

Q: dict = {}


def register(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


# Line items as numbered sequences: law = order, number = line number, 7 numbers expected.
_LINE = "SELECT CAST(l_orderkey AS VARCHAR) AS law_no, 'madde' AS article_type, CAST(l_linenumber AS VARCHAR) AS article_no, l_partkey AS pos FROM lineitem"


def _sequences(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("law_no"), F.lit("madde").alias("article_type"),
                                               F.col("l_linenumber").cast("string").alias("article_no"), F.col("l_partkey").alias("pos"))


def _expected(spark, sf):
    """Per order: line numbers 1 to 1 + custkey % 7, and the lettered extra 2/A."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("law_no"), F.lit("madde").alias("article_type"),
                                          (F.col("o_custkey") % 7 + 1).cast("int").alias("hi"))
    ranges = o.select("law_no", "article_type", F.lit(None).cast("string").alias("single"), F.lit(1).alias("lo"), "hi")
    extras = o.select("law_no", "article_type", F.lit("2/A").alias("single"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    return K.expand_numbers(ranges.unionByName(extras))


_EXP = """WITH ex AS (SELECT CAST(o_orderkey AS VARCHAR) AS law_no, 'madde' AS article_type, CAST(i AS VARCHAR) AS article_no
  FROM orders, LATERAL (SELECT unnest(range(1, o_custkey % 7 + 2)) AS i) UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'madde', '2/A' FROM orders),
li AS (""" + _LINE + ")"


@register("t01_expected_numbers", _EXP + " SELECT * FROM ex")
def _(spark, sf):
    return _expected(spark, sf)


@register("t02_missing_numbers", _EXP + """ SELECT * FROM ex WHERE law_no IN (SELECT law_no FROM li)
AND NOT EXISTS (SELECT 1 FROM li WHERE li.law_no = ex.law_no AND li.article_no = ex.article_no)""")
def _(spark, sf):
    return K.missing_numbers(_expected(spark, sf), _sequences(spark, sf))


@register("t03_unexpected_numbers", _EXP + """ SELECT DISTINCT law_no, article_type, article_no FROM li
WHERE NOT EXISTS (SELECT 1 FROM ex WHERE li.law_no = ex.law_no AND li.article_no = ex.article_no)""")
def _(spark, sf):
    return K.unexpected_numbers(_expected(spark, sf), _sequences(spark, sf))


# Expected numbers of the real laws against derived statutes.
_SPEC = " UNION ALL ".join(
    f"SELECT '{law}' AS law_no, '{kind}' AS article_type, " + form for law, kind, first, last, extras in V.EXPECTED_NUMBERS
    for form in [f"CAST(i AS VARCHAR) AS article_no FROM range({first}, {last + 1}) r(i)", *[f"'{x}' AS article_no" for x in extras]])


@register("t02_missing_statute_articles", cte("statutes") + f""", ex AS ({_SPEC}) SELECT DISTINCT ex.* FROM ex
WHERE law_no IN (SELECT law_no FROM statutes) AND NOT EXISTS (SELECT 1 FROM statutes s WHERE s.law_no = ex.law_no AND s.article_type = ex.article_type AND s.article_no = ex.article_no)""")
def _(spark, sf):
    return K.missing_numbers(K.expected_numbers(spark), derived(spark, sf, "statutes"))


@register("t04_number_gaps", """WITH s AS (SELECT l_suppkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS law_no, i AS n FROM s, LATERAL (SELECT unnest(range(lo, hi + 1)) AS i)
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.l_suppkey AND l.l_partkey = i)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("law_no"), F.lit("madde").alias("article_type"),
                                               F.col("l_partkey").cast("string").alias("article_no"))
    return K.number_gaps(rows)


# Statutes with faults: wrong prefixes, empty and short bodies, leaked headings, glued headers.
VIEWS["faulty"] = ("""
SELECT id, id AS pos, law_no, law_name, article_type, article_no, n, p_name, p_size,
  CASE id % 8 WHEN 0 THEN concat('X ', text) WHEN 1 THEN concat(law_name, ' ', label, ' ', article_no, ': ')
    WHEN 2 THEN concat(law_name, ' ', label, ' ', article_no, ': kısa ', p_name)
    WHEN 3 THEN concat(text, ' İKİNCİ BÖLÜM Genel Hükümler ', text)
    WHEN 4 THEN concat(text, ' Madde ', CAST(n + 1 AS VARCHAR(20)), '-Sonraki ', text) ELSE concat(text, ' ', text, ' ', text) END AS text
FROM (SELECT s.*, CASE article_type WHEN 'ek' THEN 'Ek Madde' WHEN 'gecici' THEN 'Geçici Madde' ELSE 'Madde' END AS label FROM statutes s) AS x""",
                   ["numbered", "typed", "bodies", "statutes"])
_FAULT = cte("faulty") + """, f AS (SELECT *, concat(law_name, ' ', CASE article_type WHEN 'ek' THEN 'Ek Madde' WHEN 'gecici' THEN 'Geçici Madde' ELSE 'Madde' END, ' ', article_no, ': ') AS prefix,
  trim(text) AS t FROM faulty),
g AS (SELECT *, starts_with(t, prefix) AS ok, CASE WHEN starts_with(t, prefix) THEN trim(substring(t, length(prefix) + 1)) ELSE t END AS body FROM f)"""
# An empty body loses the blank behind the colon, so its prefix does not match either.


@register("q01_prefix_check", _FAULT + " SELECT id, ok AS prefix_ok FROM g")
def _(spark, sf):
    return K.with_body(derived(spark, sf, "faulty")).select("id", "prefix_ok")


@register("q02_empty_bodies", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 4 = 0")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("K").alias("law_name"), F.lit("özel").alias("article_type"),
                                               F.lit("1").alias("article_no"), F.when(F.col("l_partkey") % 4 == 0, " \n ").otherwise("metin").alias("text"))
    return K.with_body(rows).where(F.col("body") == "").select("l_orderkey", "l_linenumber", "l_partkey")


@register("q03_short_bodies", _FAULT + " SELECT id, CAST(length(body) AS BIGINT) AS size FROM g WHERE length(body) < 120")
def _(spark, sf):
    return K.with_body(derived(spark, sf, "faulty")).where(F.length("body") < V.SHORT_BODY).select("id", F.length("body").cast("bigint").alias("size"))


@register("q04_heading_leaks", _FAULT + " SELECT id, CASE WHEN id % 8 = 3 THEN 'İKİNCİ BÖLÜM;Genel Hükümler' ELSE '' END AS leaks FROM g")
def _(spark, sf):
    return derived(spark, sf, "faulty").select("id", F.array_join(K.heading_leaks(F.col("text")), ";").alias("leaks"))


@register("q04_heading_lines", """SELECT p_partkey, (['LINE_HEADING::amaç','LINE_HEADING::kapsam','LINE_HEADING::yürürlük;LINE_HEADING::yürütme',''])[p_partkey % 4 + 1] AS leaks FROM part""")
def _(spark, sf):
    head = F.get(F.array(F.lit("Amaç"), F.lit("  KAPSAM "), F.lit("Yürürlük\r\nYürütme\nyürürlük"), F.lit("Amaç ve kapsam")), (F.col("p_partkey") % 4).cast("int"))
    text = F.concat("p_name", F.lit("\n"), head, F.lit("\n"), "p_type")
    return table(spark, sf, "part").select("p_partkey", F.array_join(K.heading_leaks(text), ";").alias("leaks"))


@register("q05_embedded_headers", _FAULT + " SELECT id, regexp_matches(body, '(?i)\\bMadde\\s+\\d+\\s*-\\b') AS embedded FROM g".replace("\\\\", "\\"))
def _(spark, sf):
    return K.with_body(derived(spark, sf, "faulty")).select("id", K.has_embedded_header(F.col("body")).alias("embedded"))


@register("q06_regulation_fields", """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 3 = 0 THEN 'missing_field' END,
  CASE WHEN c_custkey % 4 = 0 THEN 'invalid_type' END, CASE WHEN c_custkey % 3 = 0 THEN 'invalid_source_type' END, CASE WHEN c_custkey % 5 = 0 THEN 'empty_content' END) AS errors,
  concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'regulation_name' END, CASE WHEN c_custkey % 5 = 0 THEN 'text' END, CASE WHEN c_custkey % 3 = 0 THEN 'source_type' END) AS missing FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("6698").alias("law_no"), F.when(k % 7 != 0, F.col("c_name")).alias("regulation_name"),
                                               F.lit("1").alias("article_no"), F.when(k % 4 == 0, "bölüm").otherwise("madde").alias("article_type"),
                                               F.when(k % 5 == 0, "").otherwise("metin").alias("text"), F.when(k % 3 != 0, "yonetmelik").alias("source_type"))
    return K.regulation_errors(rows).select("c_custkey", F.array_join("errors", ",").alias("errors"), F.array_join("missing_fields", ",").alias("missing"))


@register("q07_suspicion_reasons", """SELECT p_partkey, (['çok kısa','çok kısa;başlık bozukluğu olası','çok kısa;ek madde sızıntısı','geçici madde sızıntısı','',
  'çok kısa;değişiklik dipnotu sızıntısı','dipnot sızıntısı','karar dipnotu sızıntısı'])[p_partkey % 8 + 1] AS reasons FROM part""")
def _(spark, sf):
    pad = F.repeat(F.lit("uzun metin "), 9)
    forms = [F.lit("kısa"), F.lit("Madde 5 (Mülga: 2005)"), F.lit("bkz. ek madde 3"), F.concat(pad, F.lit("GEÇİCİ MADDE 2")), F.concat(pad, "p_name"),
             F.lit("“x” ibaresi “y” olarak değiştirilmiştir"), F.concat(pad, F.lit("madde metninden çıkarılmıştır")), F.concat(pad, F.lit("Anayasa Mahkemesinin 2010 tarihli Kararı ile"))]
    text = F.get(F.array(*forms), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(K.suspicion_reasons(text, F.lit("madde")), ";").alias("reasons"))


@register("q08_decision_text_class", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN length(text) < 1000 THEN 'short' ELSE 'ok' END AS class FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.decision_text_class(F.when(F.col("doc_id") % 9 != 0, F.col("text"))).alias("class"))


# Repeats and misplaced rows: every 13th article appears again, every 17th at an early place.
VIEWS["loaded"] = ("""
SELECT id, pos, law_no, law_name, article_type, article_no, n, text FROM faulty
UNION ALL SELECT id + 1000000, pos + 1000000, law_no, law_name, article_type, article_no, n, text FROM faulty WHERE id % 13 = 0""",
                   ["numbered", "typed", "bodies", "statutes", "faulty"])


@register("a06_duplicate_keys", cte("loaded") + " SELECT law_no, article_type, article_no, count(*) AS occurrences FROM loaded GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return K.duplicate_keys(derived(spark, sf, "loaded"))


@register("a06_later_duplicates", cte("loaded") + " SELECT id, law_no, article_type, article_no FROM loaded QUALIFY row_number() OVER (PARTITION BY law_no, article_type, article_no ORDER BY pos) > 1")
def _(spark, sf):
    return K.later_duplicates(derived(spark, sf, "loaded")).select("id", "law_no", "article_type", "article_no")


@register("w10_order_check", """SELECT law_no, pos, n FROM (SELECT CAST(l_suppkey AS VARCHAR) AS law_no, pos, l_partkey AS n, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY pos) AS before
 FROM (SELECT l_suppkey, l_orderkey * 100000 + l_linenumber * 10000 + min(l_partkey) AS pos, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber)) WHERE before > n""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("n"))
    rows = li.select(F.col("l_suppkey").cast("string").alias("law_no"), F.lit("madde").alias("article_type"),
                     (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("n")).alias("pos"), "n", F.col("n").cast("string").alias("article_no"))
    return K.order_errors(rows).select("law_no", "pos", "n")


@register("q09_quality_report", _FAULT + f""", ex AS ({_SPEC}), l AS (SELECT * FROM g UNION ALL SELECT * REPLACE (id + 1000000 AS id, pos + 1000000 AS pos) FROM g WHERE id % 13 = 0),
r AS (SELECT law_no, article_type, article_no, 'prefix' AS "check" FROM l WHERE NOT ok
 UNION ALL SELECT law_no, article_type, article_no, 'empty' FROM l WHERE body = ''
 UNION ALL SELECT law_no, article_type, article_no, 'short' FROM l WHERE length(body) < 120
 UNION ALL SELECT law_no, article_type, article_no, 'heading_leak' FROM l WHERE contains(body, 'İKİNCİ BÖLÜM')
 UNION ALL SELECT law_no, article_type, article_no, 'embedded_header' FROM l WHERE regexp_matches(body, '(?i)\\bMadde\\s+\\d+\\s*-\\b')
 UNION ALL SELECT law_no, article_type, article_no, 'duplicate' FROM l WHERE id >= 1000000
 UNION ALL SELECT DISTINCT law_no, article_type, article_no, 'missing' FROM ex WHERE law_no IN (SELECT law_no FROM l) AND NOT EXISTS (
   SELECT 1 FROM l s WHERE s.law_no = ex.law_no AND s.article_type = ex.article_type AND s.article_no = ex.article_no)
 UNION ALL SELECT law_no, article_type, min(article_no), 'ordering' FROM (
   SELECT *, lag(n) OVER (PARTITION BY law_no, article_type ORDER BY pos) AS bn FROM l) WHERE bn > n GROUP BY law_no, article_type)
SELECT law_no, article_type, article_no, "check", count(*) AS findings FROM r GROUP BY ALL""".replace("\\\\", "\\"))
def _(spark, sf):
    report = K.quality_report(derived(spark, sf, "loaded"), K.expected_numbers(spark))
    return report.groupBy("law_no", "article_type", "article_no", "check").agg(F.count("*").alias("findings"))


_Q09 = Q["q09_quality_report"][1]


@register("a11_quality_status", _Q09[:_Q09.rindex("SELECT law_no, article_type, article_no, \"check\", count(*)")] + """
SELECT law_no, count(CASE WHEN "check" IN ('duplicate','prefix','missing','ordering','embedded_header') THEN 1 END) AS errors,
  count(CASE WHEN "check" IN ('short','heading_leak') THEN 1 END) AS warnings,
  CASE WHEN count(CASE WHEN "check" IN ('duplicate','prefix','missing','ordering','embedded_header') THEN 1 END) > 0 THEN 'FAIL'
       WHEN count(CASE WHEN "check" IN ('short','heading_leak') THEN 1 END) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM r GROUP BY law_no""")
def _(spark, sf):
    rows = derived(spark, sf, "loaded")
    return K.quality_status(K.quality_report(rows, K.expected_numbers(spark)), rows)


@register("a11_status_classes", """WITH c AS (SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 1 END) AS e, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS w FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS law_no, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings,
  CASE WHEN coalesce(e, 0) > 0 THEN 'FAIL' WHEN coalesce(w, 0) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    check = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 4 == 0), "prefix").when(F.col("o_orderstatus") == "O", "short").otherwise("empty")
    report = o.select(F.col("o_custkey").cast("string").alias("law_no"), check.alias("check"))
    return K.quality_status(report, table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("law_no")))


# --- reports ----------------------------------------------------------------------

@register("a01_loaded_laws", """WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END AS law_no, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Kanun ', lang) END AS law_name, doc_id FROM documents)
SELECT law_no, count(*) AS articles, count(DISTINCT law_no) AS laws, min_by(law_name, CASE WHEN law_name <> '' THEN doc_id END) AS law_name FROM d WHERE law_no <> '' GROUP BY ROLLUP (law_no)""")
def _(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.when(k % 10 == 0, " ").otherwise(F.col("source")).alias("law_no"),
                                                F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("Kanun "), "lang")).alias("law_name"), k.alias("pos"))
    return K.loaded_laws(rows)


@register("a03_type_distribution", "SELECT source AS law_no, lang AS article_type, count(*) AS articles FROM documents GROUP BY ALL")
def _(spark, sf):
    return K.type_distribution(derived(spark, sf, "doc_articles"))


@register("a04_structure_quality", cte("statutes") + """, c AS (SELECT law_no, CASE WHEN id % 11 = 0 THEN 'missing' ELSE (['single_fikra_only','multi_fikra_with_bents','multi_fikra','multi_fikra_with_bents'])[n % 4 + 1] END AS class FROM statutes)
SELECT law_no, count(*) AS total, count(CASE class WHEN 'missing' THEN 1 END) AS missing, count(CASE class WHEN 'single_fikra_only' THEN 1 END) AS single_fikra_only,
 count(CASE class WHEN 'single_fikra_with_bents' THEN 1 END) AS single_fikra_with_bents, count(CASE class WHEN 'multi_fikra' THEN 1 END) AS multi_fikra,
 count(CASE class WHEN 'multi_fikra_with_bents' THEN 1 END) AS multi_fikra_with_bents FROM c GROUP BY law_no""")
def _(spark, sf):
    return K.structure_quality(_structured(spark, sf))


def _structured(spark, sf):
    return corpus.with_structure(derived(spark, sf, "statutes")).withColumn(
        "paragraphs", F.when(F.col("id") % 11 != 0, F.col("paragraphs"))).withColumn("pos", F.col("n"))


@register("a05_structure_samples", cte("statutes") + """, c AS (SELECT law_no, n, article_no, CASE WHEN id % 11 = 0 THEN 'missing' ELSE (['single_fikra_only','multi_fikra_with_bents','multi_fikra','multi_fikra_with_bents'])[n % 4 + 1] END AS class FROM statutes)
SELECT law_no, class, article_no FROM c QUALIFY row_number() OVER (PARTITION BY law_no, class ORDER BY n) <= 3""")
def _(spark, sf):
    return K.structure_samples(_structured(spark, sf)).select("law_no", "class", "article_no")


_CASES = """WITH d AS (SELECT l.doc_id AS case_id, quality, toxic, source, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _cases(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    k, docs = F.col("doc_id"), F.array("source", "lang")
    cases = d.select(k.alias("case_id"), F.when(k % 3 != 0, F.col("source")).alias("resolved_question"),
                     F.when(k % 4 == 0, F.col("toxic") == 1).alias("decision_intent"), F.when(k % 5 != 0, docs).alias("top_docs"))
    got = d.select(k.alias("case_id"), F.when(F.col("quality") == 1, F.col("source")).otherwise("x").alias("resolved_question"),
                   F.lit(False).alias("decision_intent"), F.when(F.col("quality") == 1, docs).otherwise(F.array("lang", "source")).alias("top_docs"))
    return evaluate.case_results(cases, got.where(k % 7 != 0))


_OUT = _CASES + """, o AS (SELECT case_id, CASE WHEN case_id % 3 <> 0 THEN case_id % 7 <> 0 AND quality = 1 END AS resolved_ok,
 CASE WHEN case_id % 4 = 0 THEN case_id % 7 <> 0 AND toxic = 0 END AS intent_ok, CASE WHEN case_id % 5 <> 0 THEN case_id % 7 <> 0 AND quality = 1 END AS top1_ok,
 CASE WHEN case_id % 5 <> 0 THEN case_id % 7 <> 0 END AS coverage_ok, CASE WHEN case_id % 5 <> 0 THEN case_id % 7 <> 0 AND quality = 1 END AS prefix_ok FROM d)"""


@register("a07_retrieval_accuracy", _OUT + " SELECT count(*) AS cases, " + ", ".join(
    f"count(CASE WHEN {c}_ok THEN 1 END) AS {c}_passed, count({c}_ok) AS {c}_total" for c in ("resolved", "intent", "top1", "coverage", "prefix")) + " FROM o")
def _(spark, sf):
    return evaluate.accuracy(_cases(spark, sf))


@register("a08_ordered_prefix", _OUT + " SELECT case_id, prefix_ok, top1_ok, coverage_ok FROM o")
def _(spark, sf):
    return _cases(spark, sf).select("case_id", "prefix_ok", "top1_ok", "coverage_ok")


@register("a09_decision_statistics", """SELECT count(*) AS total, count(CASE WHEN length(t) > 0 THEN 1 END) AS with_text, count(CASE WHEN length(t) = 0 THEN 1 END) AS without_text,
 count(CASE WHEN length(t) BETWEEN 1 AND 999 THEN 1 END) AS short_text, count(*) - count(DISTINCT source) AS duplicate_urls, count(CASE WHEN doc_id % 4 = 0 THEN 1 END) AS missing_title
FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS t FROM documents)""")
def _(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.when(k % 9 != 0, F.col("text")).alias("text"), F.col("source").alias("url"), F.when(k % 4 != 0, F.col("lang")).alias("title"))
    return K.decision_statistics(rows, ["title"])


@register("a10_random_sample", "SELECT doc_id, source FROM documents ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 5")
def _(spark, sf):
    return K.random_sample(table(spark, sf, "documents").select("doc_id", "source"), 5, key="doc_id")


@register("a13_mixed_values", """WITH f AS (SELECT l_orderkey, min_by(l_returnflag, pos) AS fr, min_by(l_linestatus, pos) AS fs FROM (SELECT *, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS pos FROM lineitem) GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, concat_ws(',', CASE WHEN l_returnflag <> fr THEN 'l_returnflag' END, CASE WHEN l_linestatus <> fs THEN 'l_linestatus' END) AS mixed
FROM lineitem l JOIN f ON f.l_orderkey = l.l_orderkey WHERE l_returnflag <> fr OR l_linestatus <> fs""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
                                               ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("pos"))
    return K.mixed_values(rows, "l_orderkey", ["l_returnflag", "l_linestatus"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join("mixed", ",").alias("mixed"))


@register("a14_parser_assertions", cte("statutes") + """SELECT law_no, min(n) AS first_no, max(n) AS last_no, count(*) AS articles,
 concat_ws(',', CASE WHEN min(n) <> 1 THEN 'first_number' END, CASE WHEN count(*) < 100 THEN 'too_few' END, CASE WHEN NOT contains(min_by(text, n), '(1)') THEN 'opening_phrase' END,
   CASE WHEN max(n) < 112 THEN 'last_number' END) AS failed FROM statutes GROUP BY law_no""")
def _(spark, sf):
    return K.parser_assertions(derived(spark, sf, "statutes"), opening="(1)", min_last=112).withColumn("failed", F.array_join("failed", ","))


@register("w11_number_preview", cte("statutes") + """SELECT law_no, article_type, article_no FROM statutes
ORDER BY CASE article_type WHEN 'madde' THEN 0 WHEN 'ek' THEN 1 ELSE 2 END, n, law_no LIMIT 20""")
def _(spark, sf):
    return K.number_preview(derived(spark, sf, "statutes")).select("law_no", "article_type", "article_no")


@register("w12_special_articles", cte("statutes") + """, s AS (SELECT law_no, article_type, CASE WHEN p_size % 7 = 0 THEN concat(article_no, '/A') ELSE article_no END AS article_no FROM statutes),
x AS (SELECT *, article_type AS listing FROM s WHERE article_type IN ('ek', 'gecici', 'ek_gecici') UNION ALL SELECT *, 'repeated' FROM s WHERE article_no LIKE '%/A')
SELECT listing, law_no, article_type, article_no FROM x QUALIFY row_number() OVER (PARTITION BY listing ORDER BY law_no, article_no, article_type) <= 50""")
def _(spark, sf):
    no = F.when(F.col("p_size") % 7 == 0, F.concat("article_no", F.lit("/A"))).otherwise(F.col("article_no"))
    return K.special_articles(derived(spark, sf, "statutes").withColumn("article_no", no)).select("listing", "law_no", "article_type", "article_no")


