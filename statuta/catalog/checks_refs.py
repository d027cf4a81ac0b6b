"""Reference parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aliases, refs
from ..functions.text import canon
from ..operators import corpus
from ..operators.ordered import explode_rows
from ..operators import parsing
from .inputs import cte, derived, spread, table

Q: dict = {}


def register(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


def _order_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 110 + 1).alias("n"), (F.col("o_orderkey") % 6).alias("k"))


_N = "SELECT o_orderkey, o_custkey % 110 + 1 AS n, o_orderkey % 6 AS k FROM orders"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _by(k, *values):
    out = None
    for i, v in enumerate(values):
        v = v if not isinstance(v, str) else F.lit(v)
        out = F.when(F.col(k) == i, v) if out is None else out.when(F.col(k) == i, v)
    return out


def _parsed(df, question):
    asked = parsing.with_normalised(df.select("o_orderkey", question.alias("_q")), "_q")
    rows = explode_rows(parsing.with_refs(asked, "normalised"), F.col("refs"), "ord", "r")
    return rows.select("o_orderkey", F.col("ord").cast("bigint").alias("ord"), "r.*")


@register("r01_law_alias", cte("questions") + "SELECT q_id, law_no FROM questions")
def _(spark, sf):
    return derived(spark, sf, "questions").select("q_id", aliases.detect_law(canon(F.col("question"))).alias("law_no"))


@register("r01_longest_alias", f"""SELECT o_orderkey, (['6325','2004','2576','4721','4857',NULL])[k + 1] AS law_no FROM ({_N})""")
def _(spark, sf):
    q = _by("k", "Arabuluculuk ve TBK: Hukuk Uyuşmazlıklarında Arabuluculuk Kanunu", "icra iflas ve TCK",
            "BİM ile Bölge İdare Mahkemeleri Kanunu", "TBK, Türk Medeni Kanunu", "İş Kanunu", "tbkx tck1")
    return _order_rows(spark, sf).select("o_orderkey", aliases.detect_law(canon(q)).alias("law_no"))


@register("r02_regulation_alias", f"""
SELECT o_orderkey, (['6698','6502','4857','6325','6102',NULL])[k + 1] AS law_no,
 (['Veri Sorumluları Sicili Hakkında Yönetmelik','Mesafeli Sözleşmeler Yönetmeliği','İş Kanununa İlişkin Çalışma Süreleri Yönetmeliği',
   'Hukuk Uyuşmazlıklarında Arabuluculuk Kanunu Yönetmeliği','Ticaret Sicili Yönetmeliği',NULL])[k + 1] AS regulation_name FROM ({_N})""")
def _(spark, sf):
    q = _by("k", "KVKK Yönetmeliği 5", "Mesafeli Sözleşmeler Yön. 3", "4857 Çalışma Süreleri Yönetmeliği", "Arabuluculuk Yönetmeliği 1",
            "Ticaret Sicili Yön 7", "Yönetmelik")
    return _order_rows(spark, sf).select("o_orderkey", aliases.detect_regulation(canon(q)).alias("r")).select(
        "o_orderkey", "r.law_no", "r.regulation_name")


@register("r03_names_a_law", f"SELECT o_orderkey, k IN (0, 2, 4) AS named FROM ({_N})")
def _(spark, sf):
    q = _by("k", F.concat(F.lit("TBK "), _s("n")), F.concat(F.lit("Tebligat "), _s("n")), F.concat(F.lit("6098 sayılı Kanun "), _s("n")),
            F.concat(F.lit("madde "), _s("n")), "Türk Medeni Kanunu", "arabuluculuk nedir")
    return _order_rows(spark, sf).select("o_orderkey", aliases.names_a_law(canon(q)).alias("named"))


@register("r04_alias_subsets", cte("asked") + "SELECT q_id, law_no, true AS is_short, true AS is_explicit FROM asked")
def _(spark, sf):
    asked = derived(spark, sf, "asked").select("q_id", canon(F.col("alias")).alias("alias"))
    return asked.join(aliases.alias_frame(spark), "alias").select("q_id", "law_no", "is_short", "is_explicit")


@register("r05_question_refs", cte("asked_refs") + "SELECT q_id, CAST(ord - 1 AS BIGINT) AS ord, law_no, article_no, article_type FROM asked_refs")
def _(spark, sf):
    rows = derived(spark, sf, "questions").withColumn("o_orderkey", F.col("q_id"))
    return _parsed(rows, F.col("question")).withColumnRenamed("o_orderkey", "q_id")


@register("r05_single_refs", f"""
SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, (['6098','6100','4857',NULL,'5271','7201'])[k + 1] AS law_no, CAST(n AS VARCHAR) AS article_no, 'madde' AS article_type FROM ({_N})""")
def _(spark, sf):
    n = _s("n")
    q = _by("k", F.concat(F.lit("TBK m"), n), F.concat(F.lit("6100 sayılı Kanun madde "), n), F.concat(F.lit("4857. Kanunun "), n, F.lit(". maddesi")),
            F.concat(F.lit("madde "), n), F.concat(F.lit("Ceza Muhakemesi Kanunu "), n), F.concat(F.lit("Tebligat K. "), n))
    return _parsed(_order_rows(spark, sf), q)


@register("r06_range_refs", f"""
SELECT o_orderkey, CAST(i AS BIGINT) AS ord, law_no, CAST(lo + i AS VARCHAR) AS article_no, 'madde' AS article_type FROM (
 SELECT o_orderkey, (['6098','6100','2577','6098','6098','1136'])[k + 1] AS law_no, n AS lo, CASE k WHEN 4 THEN 50 ELSE k END AS w FROM ({_N})),
 LATERAL (SELECT unnest(range(0, w + 1)) AS i)""")
def _(spark, sf):
    n, up = _s("n"), lambda d: _s(F.col("n") + d)
    q = _by("k", F.concat(F.lit("TBK "), n, F.lit("-"), n), F.concat(F.lit("6100 sayılı Kanun "), n, F.lit(" ila "), up(1)),
            F.concat(F.lit("İYUK "), n, F.lit(" – "), up(2)), F.concat(F.lit("Türk Borçlar Kanunu "), n, F.lit("-"), up(3)),
            F.concat(F.lit("TBK "), n, F.lit(" ila "), up(50)), F.concat(F.lit("Avukatlık Kanunu m. "), n, F.lit(" ila "), up(5)))
    return _parsed(_order_rows(spark, sf), q)


@register("r06_reversed_and_wide_ranges", f"""
SELECT o_orderkey, CAST(i AS BIGINT) AS ord, '6098' AS law_no, CAST(n + i AS VARCHAR) AS article_no, 'madde' AS article_type
FROM ({_N}), LATERAL (SELECT unnest(range(0, 4)) AS i) WHERE k % 2 = 0
UNION ALL SELECT o_orderkey, 0, '6098', CAST(n AS VARCHAR), 'madde' FROM ({_N}) WHERE k % 2 = 1""")
def _(spark, sf):
    q = F.when(F.col("k") % 2 == 0, F.concat(F.lit("TBK "), _s(F.col("n") + 3), F.lit("-"), _s("n"))).otherwise(
        F.concat(F.lit("TBK "), _s("n"), F.lit(" ila "), _s(F.col("n") + 51)))
    return _parsed(_order_rows(spark, sf), q)


@register("r07_list_refs", f"""
SELECT o_orderkey, CAST(i - 1 AS BIGINT) AS ord, '6098' AS law_no, l[i] AS article_no, 'madde' AS article_type FROM (
 SELECT o_orderkey, CASE WHEN k % 2 = 0 THEN [CAST(n AS VARCHAR), CAST(n + 2 AS VARCHAR), CAST(n + 5 AS VARCHAR)]
   ELSE [CAST(n AS VARCHAR) || '/A', CAST(n + 1 AS VARCHAR), CAST(n AS VARCHAR)] END AS l FROM ({_N})), LATERAL (SELECT unnest(range(1, 4)) AS i)""")
def _(spark, sf):
    n, up = _s("n"), lambda d: _s(F.col("n") + d)
    q = F.when(F.col("k") % 2 == 0, F.concat(F.lit("TBK "), n, F.lit(", "), up(2), F.lit(" ve "), up(5))).otherwise(
        F.concat(F.lit("6098 sayılı Kanun "), n, F.lit("/a, "), up(1)))
    return _parsed(_order_rows(spark, sf), q)


@register("r08_following_refs", f"""
SELECT o_orderkey, CAST(i AS BIGINT) AS ord, (['6098','6100','2004','6098','6325','6698'])[k + 1] AS law_no, CAST(n + i AS VARCHAR) AS article_no, 'madde' AS article_type
FROM ({_N}), LATERAL (SELECT unnest(range(0, 5)) AS i)""")
def _(spark, sf):
    n = _s("n")
    tail = F.lit(" ve devamı")
    q = _by("k", *[F.concat(F.lit(p), n, tail) for p in ("TBK ", "6100 sayılı Kanun madde ", "İİK m. ", "Borçlar Kanunu ", "Arabuluculuk Kanunu ", "KVKK md ")])
    return _parsed(_order_rows(spark, sf), q)


@register("r09_special_refs", f"""
SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, (['1136','2004','1136','1136','2577','6183'])[k + 1] AS law_no,
 CASE WHEN k = 3 THEN CAST(n AS VARCHAR) || '/A' WHEN k = 5 THEN CAST(n AS VARCHAR) || '/A' ELSE CAST(n AS VARCHAR) END AS article_no,
 (['ek','gecici','ek_gecici','madde','gecici','madde'])[k + 1] AS article_type FROM ({_N})""")
def _(spark, sf):
    n = _s("n")
    q = _by("k", *[F.concat(F.lit(p), n) for p in ("Avukatlık Kanunu Ek Madde ", "2004 sayılı Kanun Geçici Madde ", "1136 sayılı Kanun Ek Geçici Madde ",
                                                    "Avukatlık Kanunu Mükerrer Madde ", "İYUK Geçici Madde ", "6183 sayılı Kanun Mükerrer Madde ")])
    return _parsed(_order_rows(spark, sf), q)


@register("r10_distinct_refs", f"""
SELECT o_orderkey, CAST(i AS BIGINT) AS ord, (['6098','6098','6100'])[i + 1] AS law_no, CAST(CASE i WHEN 0 THEN n WHEN 1 THEN n + 1 ELSE n END AS VARCHAR) AS article_no, 'madde' AS article_type
FROM ({_N}), LATERAL (SELECT unnest(range(0, 3)) AS i)""")
def _(spark, sf):
    q = F.concat(F.lit("TBK "), _s("n"), F.lit(", "), _s(F.col("n") + 1), F.lit(" ile HMK "), _s("n"), F.lit(" ve TBK "), _s("n"))
    return _parsed(_order_rows(spark, sf), q)


@register("r11_regulation_refs", f"""
SELECT o_orderkey, (['6698','6502','4857','6325','6102','7201'])[k + 1] AS law_no, CAST(n AS VARCHAR) AS article_no, 'madde' AS article_type FROM ({_N})""")
def _(spark, sf):
    n = _s("n")
    q = _by("k", *[F.concat(F.lit(p), n) for p in ("KVKK yönetmeliği ", "Mesafeli Sözleşmeler Yön. ", "Çalışma Süreleri Yönetmeliği madde ", "6325 Arabuluculuk Yönetmeliği md ",
                                                    "Ticaret Sicili Yön ", "Elektronik Tebligat Yönetmeliği m.")])
    asked = parsing.with_normalised(_order_rows(spark, sf).withColumn("_q", q), "_q")
    rows = explode_rows(asked, refs.parse_regulation_refs(canon(F.col("normalised"))), "ord", "r")
    return rows.select("o_orderkey", "r.law_no", "r.article_no", "r.article_type")


_INTRA_Q = ["HMK 114 {w} fıkra", "İş Kanunu 7/{d}-a", "TBK 49 önceki fıkra ve {d}. fıkra", "TBK 5 {d} numaralı bent", "TBK 5 (b) bendi", "TBK 49 {d} inci fıkra, yukarıdaki fıkralar"]


def _intra_question():
    """The six forms, with the paragraph number d = n % 4 + 1 in words or digits."""
    d = F.col("n") % 4 + 1
    w = F.get(F.array(*[F.lit(x) for x in ("birinci", "ikinci", "üçüncü", "dördüncü")]), (d - 1).cast("int"))
    return _by("k", *[F.replace(F.replace(F.lit(t), F.lit("{w}"), w), F.lit("{d}"), _s(d)) for t in _INTRA_Q])


def _intra(spark, sf):
    rows = _order_rows(spark, sf).withColumn("_q", _intra_question())
    return parsing.per_distinct(rows, "_q", lambda d: parsing.with_request(d, "_q"))


_INTRA = """(SELECT o_orderkey, k, CAST(n % 4 + 1 AS VARCHAR) AS d, CAST(n % 4 + 1 AS BIGINT) AS dn FROM (""" + _N + """))"""


@register("r12_intra_refs", f"""
SELECT o_orderkey, CASE k WHEN 0 THEN 'fikra:' || d WHEN 1 THEN 'fikra:' || d || ',bent:a' WHEN 2 THEN 'fikra:' || d || ',fikra:previous'
  WHEN 3 THEN 'numeric_bent:' || d WHEN 4 THEN 'bent:b' ELSE 'fikra:' || d || ',fikra:previous,fikra:previous_plural' END AS refs FROM {_INTRA}""")
def _(spark, sf):
    return _intra(spark, sf).select("o_orderkey", F.array_join(F.transform(
        "intra", lambda r: F.concat_ws(":", r["type"], r["value"])), ",").alias("refs"))


@register("r13_resolved_intra_refs", f"""
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN d || ';a' WHEN 2 THEN d || ';' || p WHEN 3 THEN d WHEN 4 THEN 'b'
  ELSE d || ';' || p || ';' || pl END AS resolved
FROM (SELECT *, CASE WHEN dn > 1 THEN CAST(dn - 1 AS VARCHAR) ELSE '' END AS p, array_to_string(range(1, dn), '+') AS pl FROM {_INTRA})""")
def _(spark, sf):
    return _intra(spark, sf).select("o_orderkey", F.array_join(F.transform(
        refs.resolve_intra_refs(F.col("intra")), lambda r: F.array_join(r["resolved"], "+")), ";").alias("resolved"))


def _history(spark, sf):
    return derived(spark, sf, "questions").select("conv_id", F.col("q_id").alias("turn"), F.col("question").alias("text"))


_LAST = cte("asked_refs") + """, last AS (
SELECT a.conv_id, r.law_no, r.article_no, r.article_type FROM (SELECT conv_id, max(q_id) AS q_id FROM asked GROUP BY conv_id) a
JOIN (SELECT * FROM asked_refs QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY ord DESC) = 1) r ON r.q_id = a.q_id)"""


@register("r14_last_law_in_history", _LAST + " SELECT * FROM last")
def _(spark, sf):
    return parsing.last_history_refs(_history(spark, sf)).select("conv_id", "last_ref.*")


@register("r15_contextual_question", _LAST + """
SELECT q.o_orderkey, CASE q.k WHEN 0 THEN concat(l.law_no, ' sayılı Kanun madde ', q.n, '-', q.n2)
  WHEN 1 THEN concat(l.law_no, ' sayılı Kanun madde ', q.n, ' ve devamı') WHEN 2 THEN concat(l.law_no, ' sayılı Kanun madde ', q.n, ', ', q.n2)
  WHEN 3 THEN concat(l.law_no, ' sayılı Kanun madde ', q.n)
  WHEN 4 THEN concat(l.law_no, ' sayılı Kanun madde ', CAST(greatest(1, CAST(l.article_no AS BIGINT) - 1) AS VARCHAR))
  ELSE concat(l.law_no, ' sayılı Kanun madde ', CAST(CAST(l.article_no AS BIGINT) + 1 AS VARCHAR)) END AS resolved
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k, CAST(o_custkey % 110 + 1 AS VARCHAR) AS n, CAST(o_custkey % 110 + 3 AS VARCHAR) AS n2 FROM orders) q
JOIN last l ON l.conv_id = q.o_custkey""")
def _(spark, sf):
    n, n2 = _s("n"), _s(F.col("n") + 2)
    q = _by("k", F.concat(F.lit("bu Kanunun "), n, F.lit(" ila "), n2), F.concat(F.lit("Bu kanunun "), n, F.lit(" ve devamı")),
            F.concat(F.lit("bu Kanunun "), n, F.lit(", "), n2, F.lit(". maddeleri")), F.concat(F.lit("bu Kanunun "), n, F.lit(" üncü maddesi")),
            "önceki madde ne diyor", "Sonraki madde")
    rows = _order_rows(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("conv_id")), "o_orderkey")
    joined = rows.join(parsing.last_history_refs(_history(spark, sf)), "conv_id")
    return joined.select("o_orderkey", refs.resolve_context(q, F.col("last_ref")).alias("resolved"))


def _asked_statutes(spark, sf):
    """Statutes with a structure and one of five requests each."""
    rows = corpus.with_structure(derived(spark, sf, "statutes"))
    form = F.col("id") % 5
    q = (F.when(form == 0, "TBK 1 2. fıkra").when(form == 1, "TBK 1/2-a").when(form == 2, "TBK 1 3. fıkra, önceki fıkralar")
         .when(form == 3, "TBK 1 b bendi").otherwise("TBK 1"))
    asked = parsing.per_distinct(rows.withColumn("_q", q), "_q", lambda d: parsing.with_request(d, "_q"))
    return asked.withColumn("found", refs.extract_requested(F.col("text"), F.col("ask"), F.col("paragraphs")))


_EXTRACT = cte("statutes") + """, x AS (SELECT *, id % 5 AS f, n % 4 AS b,
  concat(law_name, ' ', CASE article_type WHEN 'ek' THEN 'Ek Madde' WHEN 'gecici' THEN 'Geçici Madde' ELSE 'Madde' END, ' ', article_no, ': ') AS h,
  concat('(1) ', p_name, CASE n % 4 WHEN 1 THEN ' yukarıdaki maddede belirtilir.' ELSE ' faiz işletilir.' END) AS p1,
  CASE n % 4 WHEN 1 THEN concat('(2) ', p_type, ' için: a) ', p_brand, ' uygulanır. b) ', CAST(p_size AS VARCHAR), ' gün beklenir.')
             WHEN 2 THEN concat('(2) 6098 sayılı Kanunun ', CAST(p_size + 1 AS VARCHAR), ' inci maddesi saklıdır.')
             WHEN 3 THEN concat('a) ', p_name, ' b) ', p_brand, ' c) TBK ', CAST(p_size AS VARCHAR)) END AS p2,
  CASE n % 4 WHEN 1 THEN concat('a) ', p_brand, ' uygulanır.') WHEN 3 THEN concat('a) ', p_name) END AS ia,
  CASE n % 4 WHEN 1 THEN concat('b) ', CAST(p_size AS VARCHAR), ' gün beklenir.') WHEN 3 THEN concat('b) ', p_brand) END AS ib FROM statutes),
y AS (SELECT *, CASE f WHEN 0 THEN p2 WHEN 1 THEN coalesce(ia, p2)
   WHEN 2 THEN CASE b WHEN 0 THEN text WHEN 3 THEN concat(h, p_type, ' şunlardır:', chr(10), p2) ELSE concat(p1, chr(10), p2) END
   WHEN 3 THEN ib END AS found FROM x)"""


@register("r16_requested_part", _EXTRACT + " SELECT id, found FROM y")
def _(spark, sf):
    return _asked_statutes(spark, sf).select("id", "found")


@register("r17_context_text", _EXTRACT + " SELECT id, coalesce(found, text) AS context FROM y")
def _(spark, sf):
    return _asked_statutes(spark, sf).select("id", refs.context_text(F.col("text"), F.col("ask"), F.col("paragraphs")).alias("context"))


@register("r18_extraction_status", _EXTRACT + """
 SELECT id, CASE f WHEN 4 THEN 'not_requested' WHEN 0 THEN CASE WHEN b = 0 THEN 'not_structured' ELSE 'matched' END
   WHEN 1 THEN CASE b WHEN 0 THEN 'not_structured' WHEN 2 THEN 'partial_match' ELSE 'matched' END
   WHEN 2 THEN CASE b WHEN 0 THEN 'partial_match' ELSE 'matched' END
   ELSE CASE WHEN b IN (1, 3) THEN 'matched' ELSE 'not_structured' END END AS status FROM y""")
def _(spark, sf):
    return _asked_statutes(spark, sf).select("id", refs.extraction_status(F.col("ask"), F.col("paragraphs"), F.col("found")).alias("status"))


@register("r19_citations", cte("statutes") + """, s AS (SELECT * FROM statutes WHERE article_type = 'madde')
SELECT law_no, article_no, '6098' AS target_law_no, CAST(p_size + 1 AS VARCHAR) AS target_article_no, 'explicit_cross_law' AS ref_type,
       concat('6098 sayili kanunun ', CAST(p_size + 1 AS VARCHAR), ' inci madd') AS raw_match FROM s WHERE n % 4 = 2
UNION ALL SELECT law_no, article_no, law_no, CAST(n + 1 AS VARCHAR), 'explicit_same_law', concat('bu kanunun ', CAST(n + 1 AS VARCHAR), ' inci madd') FROM s WHERE n % 4 = 2
UNION ALL SELECT law_no, article_no, law_no, CAST(n + 1 AS VARCHAR), 'explicit_article', concat(CAST(n + 1 AS VARCHAR), ' inci maddesi') FROM s WHERE n % 4 = 2
UNION ALL SELECT law_no, article_no, '6098', CAST(p_size AS VARCHAR), 'explicit_cross_law', concat('tbk ', CAST(p_size AS VARCHAR)) FROM s WHERE n % 4 = 3""")
def _(spark, sf):
    return corpus.citation_edges(derived(spark, sf, "statutes")).select(
        F.col("source_law_no").alias("law_no"), F.col("source_article_no").alias("article_no"), "target_law_no", "target_article_no", "ref_type", "raw_match")


@register("r19_citation_forms", """
SELECT l_orderkey, l_linenumber, target_law_no, target_article_no, ref_type, count(*) AS edges FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN CAST(6000 + l_suppkey % 200 AS VARCHAR) WHEN l_partkey % 3 = 1 THEN '4721' ELSE 'own' END AS target_law_no,
   CAST(l_partkey AS VARCHAR) AS target_article_no, CASE WHEN l_partkey % 3 = 2 THEN 'explicit_article' ELSE 'explicit_cross_law' END AS ref_type FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'own', CAST(l_partkey + 1 AS VARCHAR), 'explicit_article' FROM lineitem WHERE l_partkey % 3 = 2
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'own', CAST(l_partkey + 1 AS VARCHAR), 'explicit_article' FROM lineitem WHERE l_partkey % 3 = 2) GROUP BY ALL""")
def _(spark, sf):
    no, up = _s("l_partkey"), _s(F.col("l_partkey") + 1)
    law = _s(F.lit(6000) + F.col("l_suppkey") % 200)
    form = F.col("l_partkey") % 3
    body = (F.when(form == 0, F.concat(law, F.lit(" sayılı Kanunun "), no, F.lit(" inci maddesi uyarınca")))
            .when(form == 1, F.concat(F.lit("Türk Medeni Kanununun "), no, F.lit(" üncü maddesine göre")))
            .otherwise(F.concat(no, F.lit(", "), up, F.lit(" nci maddeleri"))))
    rows = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    li = explode_rows(rows, refs.cited_articles(body, F.lit("own")), "ord", "e")
    return li.groupBy("l_orderkey", "l_linenumber", F.col("e.law_no").alias("target_law_no"), F.col("e.article_no").alias("target_article_no"),
                      F.col("e.ref_type").alias("ref_type")).agg(F.count("*").alias("edges"))


@register("r20_case_numbers", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(CAST(1990 + o_custkey % 35 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)) END AS numbers FROM orders""")
def _(spark, sf):
    year, no = _s(F.lit(1990) + F.col("o_custkey") % 35), _s("o_orderkey")
    q = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("1850/"), no)).otherwise(F.concat(year, F.lit(" / "), no, F.lit(" E. ve "), year, F.lit("/"), no))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(refs.case_numbers(q), ",").alias("numbers"))


@register("r21_previous_mention", cte("statutes") + "SELECT id, n % 4 = 1 AS mentions FROM statutes")
def _(spark, sf):
    return derived(spark, sf, "statutes").select("id", refs.mentions_previous_article(F.col("text")).alias("mentions"))


@register("r22_parse_inspection", cte("asked_refs", "questions") + """
SELECT q.q_id, q.question, replace(replace(replace(strip_accents(replace(lower(trim(q.question)), 'ı', 'i')), 'İ', 'i'), 'ı', 'i'), 'ş', 's') AS canonical,
  string_agg(concat(r.law_no, ' ', r.article_type, ' ', r.article_no), '; ' ORDER BY r.ord) AS refs FROM questions q JOIN asked_refs r ON r.q_id = q.q_id GROUP BY q.q_id, q.question""")
def _(spark, sf):
    q = F.col("question")
    show = F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", r["law_no"], r["article_type"], r["article_no"])), "; ")
    rows = parsing.with_refs(derived(spark, sf, "questions"), "question")
    return rows.select("q_id", "question", canon(q).alias("canonical"), show.alias("refs"))


