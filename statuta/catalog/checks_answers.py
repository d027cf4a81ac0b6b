"""Routing, text-only answers, answer audit and output formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import fixed_values as V
from ..functions import questions as P
from ..operators import audit, corpus, lookup, parsing
from ..plans import responses as R
from ..plans import retrieval
from ..session import cut_lineage
from .checks_joins import _ST, _links, _vectors, _COS, _decisions
from .inputs import VIEWS, cte, derived, table

Q: dict = {}


def register(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


_ORDER = "SELECT o_orderkey, CAST(o_custkey % 110 + 1 AS VARCHAR) AS n, o_orderkey % 10 AS k FROM orders"
_big = lambda c: F.col(c).cast("bigint").alias(c)


def _asked(spark, sf, *forms):
    """One of the given question forms per order; {n} is a number that follows the order."""
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("o_orderkey") % len(forms)).cast("int"))
    q = F.replace(form, F.lit("{n}"), (F.col("o_custkey") % 110 + 1).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", q.alias("q"))


def _flag(spark, sf, test, *forms):
    return _asked(spark, sf, *forms).select("o_orderkey", test(F.col("q")).alias("flag"))


def _flags_sql(*flags):
    return f"SELECT o_orderkey, ([{', '.join(str(f).lower() for f in flags)}])[o_orderkey % {len(flags)} + 1] AS flag FROM orders"


@register("p01_decision_intent", _flags_sql(True, True, False, False, True, False))
def _(spark, sf):
    return _flag(spark, sf, P.wants_decisions, "TBK {n} hakkında Yargıtay kararı", "TBK {n} hakkında karar var mı?", "TBK {n}", "karar ara {n}",
                 "2020 emsal {n}", "süre {n} gün")


@register("p02_case_number_query", _flags_sql(True, True, False, False, True, False))
def _(spark, sf):
    return _flag(spark, sf, P.is_case_number_query, "2022/{n}", "Yargıtay 2022 / {n} E. kararını bul", "TBK {n}", "2022/{n} sayılı kira davası",
                 "1999/{n} K. var mı", "1850/{n}")


@register("p03_generic_decision_query", _flags_sql(True, True, True, False, False, False, False))
def _(spark, sf):
    return _flag(spark, sf, P.is_generic_decision_query, "karar ara {n}", "Yargıtay kararı bul {n}", "AYM içtihat", "karar {n}", "2022/{n} kararını bul",
                 "kira kararı bul {n}", "TBK {n} karar ara")


@register("p04_text_contains_query", _flags_sql(True, True, False, False, True))
def _(spark, sf):
    return _flag(spark, sf, P.asks_text_contains, "TBK {n} içinde faiz geçiyor mu?", "TBK {n} metninde kusur var mı", "TBK {n} var mı", "TBK {n} içinde",
                 "TBK {n} lafzında yer alıyor mu")


@register("p04_contains_phrase", f"SELECT o_orderkey, ([concat('illiyet bağı ', n), 'kusurlu', '', 'faiz'])[o_orderkey % 4 + 1] AS phrase FROM ({_ORDER})")
def _(spark, sf):
    return _asked(spark, sf, "TBK 49 içinde illiyet bağı {n} geçiyor mu?", "TBK {n} metninde “kusurlu” var mı", "TBK {n} kusurlu mu", "TBK {n} LAFZINDA 'faiz' yer alıyor mu?"
                  ).select("o_orderkey", P.contains_phrase(F.col("q")).alias("phrase"))


# Every statute answers questions about itself; structure as built from the text.
def _docs(spark, sf, *forms):
    rows = corpus.with_structure(derived(spark, sf, "statutes"))
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("id") % len(forms)).cast("int"))
    return rows.withColumn("q", F.replace(form, F.lit("{n}"), F.col("article_no")))


_TITLE = "concat(law_name, ' Madde ', article_no)"
_NOTE = "'\n\n" + V.DISCLAIMER + "'"


def _esc(t):
    return t.replace("'", "''")


@register("p04_contains_answers", cte("statutes") + f""" SELECT id, CASE WHEN id % 2 = 1 THEN 'yedek'
  WHEN contains(lower(text), 'faiz') THEN concat('Evet. ', {_TITLE}, ' metninde “Faiz” ifadesi geçer.', '\n\n{V.BASIS}', {_TITLE}, '\n\n{V.LETTER_ONLY}', {_NOTE})
  ELSE concat('Hayır. ', {_TITLE}, ' metninde “Faiz” ifadesi açıkça geçmez.', '\n\n{V.BASIS}', {_TITLE}, '\n\n{V.LETTER_ONLY}', {_NOTE}) END AS answer FROM statutes""")
def _(spark, sf):
    return _docs(spark, sf, "TBK {n} içinde Faiz geçiyor mu?", "TBK {n}").select("id", A.text_contains_answer(
        F.col("q"), F.col("law_name"), F.col("article_no"), F.col("text"), F.lit("yedek")).alias("answer"))


@register("p05_technical_term", f"SELECT o_orderkey, (['illiyet bağı','faiz','zamanaşımı',NULL,'görevli mahkeme','arabuluculuk'])[o_orderkey % 6 + 1] AS term, o_orderkey % 6 IN (0, 1, 4) AS flag FROM ({_ORDER})")
def _(spark, sf):
    return _asked(spark, sf, "TBK {n}'da nedensellik bağı şart mı?", "TBK {n} temerrüt faizi istenebilir mi", "TBK {n} zamanaşımı süresi", "TBK {n} var mı",
                  "TBK {n} görevli mahkeme var mı", "TBK {n} arabuluculuk").select(
        "o_orderkey", P.technical_term(F.col("q")).alias("term"), P.asks_technical_term(F.col("q")).alias("flag"))


@register("p05_technical_answers", cte("statutes") + f""" SELECT id, CASE WHEN id % 2 = 1 THEN 'yedek' WHEN contains(lower(text), 'faiz') THEN
  concat('Kısa cevap:\n\nEvet. ', {_TITLE}, ' metninde “faiz” kavramı açıkça yer almaktadır.\n\n{V.LETTER_ONLY}\n\n{V.BASIS}', {_TITLE}, {_NOTE})
  ELSE concat('Kısa cevap:\n\n', {_TITLE}, ' metninde “faiz” kavramı açıkça yer almamaktadır.\n\nKaynakta bu kavram açıkça bulunmadığı için, “faiz” bakımından şart, sonuç, süre, talep veya uygulama değerlendirmesi yapamam.\n\n{V.LETTER_ONLY}\n\n{V.BASIS}', {_TITLE}, {_NOTE}) END AS answer FROM statutes""")
def _(spark, sf):
    return _docs(spark, sf, "TBK {n} faiz var mı?", "TBK {n}").select("id", A.technical_term_answer(
        F.col("q"), F.col("law_name"), F.col("article_no"), F.col("text"), F.lit("yedek")).alias("answer"))


@register("p06_full_text_request", _flags_sql(True, True, True, False))
def _(spark, sf):
    return _flag(spark, sf, P.asks_full_text, "TBK {n} metnini aynen ver", "TBK {n} lafzını göster", "TBK {n} tam metin", "TBK {n} metni nedir")


@register("p06_full_text_answers", cte("statutes") + f""" SELECT id, concat({_TITLE}, ' metni aşağıdadır:\n\n', text, '\n\n{V.BASIS}', {_TITLE},
 '\n\nBu cevap yalnızca ilgili madde metninin aktarımına ilişkindir; içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır.', {_NOTE}) AS answer FROM statutes""")
def _(spark, sf):
    return derived(spark, sf, "statutes").select("id", A.full_text_answer(F.col("law_name"), F.col("article_no"), F.col("text")).alias("answer"))


@register("p07_paragraph_count", cte("statutes") + f""" SELECT id, CASE WHEN id % 11 = 0 THEN concat({_TITLE}, ' için fıkra ayrıştırması mevcut değil.\n\n{V.BASIS}', {_TITLE}, '\n\n{V.STRUCTURE_ONLY}', {_NOTE})
 ELSE concat({_TITLE}, ' sistemde ', (['1','2','3','2'])[n % 4 + 1], ' fıkra olarak ayrıştırılmıştır.\n\n{V.BASIS}', {_TITLE},
  '\n\n{V.STRUCTURE_ONLY[:-1]}; içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır.', {_NOTE}) END AS answer, id % 3 <> 2 AS asked FROM statutes""")
def _(spark, sf):
    rows = _docs(spark, sf, "TBK {n} kaç fıkra?", "TBK {n} fıkra sayısı nedir", "TBK {n} birinci fıkra").withColumn(
        "paragraphs", F.when(F.col("id") % 11 != 0, F.col("paragraphs")))
    return rows.select("id", A.paragraph_count_answer(F.col("law_name"), F.col("article_no"), F.col("paragraphs")).alias("answer"),
                       P.asks_paragraph_count(F.col("q")).alias("asked"))


@register("p08_requested_paragraph", f"SELECT o_orderkey, (['1','2','10','1','12',NULL,n])[o_orderkey % 7 + 1] AS no FROM ({_ORDER})")
def _(spark, sf):
    return _asked(spark, sf, "TBK {n} birinci fıkra", "TBK {n} 2. fıkra", "TBK {n} onuncu fıkra", "TBK {n} ilk fıkrası", "TBK {n} 12 fıkra", "TBK {n} fıkralar", "TBK {n} fıkra"
                  ).select("o_orderkey", P.requested_paragraph(F.col("q")).alias("no"))


@register("p08_paragraph_answers", cte("statutes") + f""", x AS (SELECT *, CASE WHEN n % 4 = 1 THEN concat('(1) ', p_name, ' yukarıdaki maddede belirtilir.') WHEN n % 4 = 2 THEN concat('(1) ', p_name, ' faiz işletilir.')
  WHEN n % 4 = 0 THEN text ELSE concat(law_name, ' ', CASE article_type WHEN 'ek' THEN 'Ek Madde' WHEN 'gecici' THEN 'Geçici Madde' ELSE 'Madde' END, ' ', article_no, ': ', p_type, ' şunlardır:') END AS p1 FROM statutes)
 SELECT id, CASE id % 3 WHEN 0 THEN concat({_TITLE}, ' 1. fıkra metni aşağıdadır:\n\n', p1, '\n\n{V.BASIS}', {_TITLE}, '\n\nBu cevap yalnızca ilgili fıkra metninin aktarımına ilişkindir; içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır.', {_NOTE})
  WHEN 1 THEN concat({_TITLE}, ' içinde 9. fıkra sistemde ayrıştırılmış olarak bulunamadı.\n\n{V.BASIS}', {_TITLE}, '\n\n{V.STRUCTURE_ONLY}', {_NOTE})
  ELSE concat({_TITLE}, ' için istenen fıkra sistemde ayrıştırılmış olarak bulunamadı.\n\n{V.BASIS}', {_TITLE}, '\n\n{V.STRUCTURE_ONLY}', {_NOTE}) END AS answer FROM x""")
def _(spark, sf):
    return _docs(spark, sf, "TBK {n} birinci fıkra", "TBK {n} 9. fıkra", "TBK {n}").select("id", A.paragraph_answer(
        F.col("q"), F.col("law_name"), F.col("article_no"), F.col("paragraphs")).alias("answer"))


@register("p09_elements_request", _flags_sql(True, True, False, False))
def _(spark, sf):
    return _flag(spark, sf, P.asks_elements, "TBK {n} şartları nelerdir?", "TBK {n} hangi unsurlar", "TBK {n} şartları için ihtarname yaz", "TBK {n} koşulları hakkında karar")


@register("p09_elements_answers", cte("statutes") + f""" SELECT id, CASE WHEN strpos(text, ':') > 120 THEN 'uzun' ELSE concat('Kısa cevap:\n\n', {_TITLE}, ' bakımından, sistemdeki madde metnine göre değerlendirme yalnızca şu lafzi çerçeveyle sınırlıdır:\n\n', body,
 '\n\nBu nedenle bu cevap, sadece madde metninde açıkça yer alan ifadelerle sınırlıdır; kaynakta bulunmayan doktrin, içtihat veya uygulama unsuru eklenmemiştir.\n\n{V.BASIS}', {_TITLE}, {_NOTE}) END AS answer FROM statutes""")
def _(spark, sf):
    answer = A.elements_answer(F.col("law_name"), F.col("article_no"), F.col("text"), F.lit("yedek"))
    return derived(spark, sf, "statutes").select("id", F.when(F.instr("text", ":") > 120, "uzun").otherwise(answer).alias("answer"))


@register("p10_plain_lookup", _flags_sql(True, True, False, False, False, True))
def _(spark, sf):
    asked = parsing.with_refs(_asked(spark, sf, "TBK {n}", "6098 sayılı Kanun madde {n}", "TBK {n}, 250", "madde {n}", "TBK {n} açıkla", "TBK {n} hükmü"), "q")
    return asked.select("o_orderkey", P.is_plain_lookup(F.col("q"), F.col("refs")).alias("flag"))


@register("p11_explanation_request", _flags_sql(True, True, False, False))
def _(spark, sf):
    return _flag(spark, sf, P.asks_explanation, "TBK {n}'u iki cümleyle açıkla", "TBK {n} özetle", "TBK {n} için dilekçe açıkla", "TBK {n}")


@register("p11_explanation_answers", cte("statutes") + f""" SELECT id, CASE WHEN strpos(text, ':') > 120 THEN 'uzun' ELSE concat('Kısa cevap:\n\n', {_TITLE}, ', madde metnine göre şu hükmü içerir: ', body,
 '\n\nBu açıklama yalnızca ilgili madde metnine dayalıdır; içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır.\n\n{V.BASIS}', {_TITLE}, {_NOTE}) END AS answer FROM statutes""")
def _(spark, sf):
    answer = A.explanation_answer(F.col("law_name"), F.col("article_no"), F.col("text"), F.lit("yedek"))
    return derived(spark, sf, "statutes").select("id", F.when(F.instr("text", ":") > 120, "uzun").otherwise(answer).alias("answer"))


# --- routing --------------------------------------------------------------------------

_ROUTES = _ST + """, rt AS (SELECT q_id, CASE WHEN q_id NOT IN (SELECT q_id FROM explicit) THEN 'deterministic_no_source'
  WHEN form = 7 THEN 'deterministic_article_text_contains' WHEN form = 8 THEN 'deterministic_article_paragraph_count' WHEN form = 5 THEN 'deterministic_article_specific_paragraph'
  WHEN form IN (0, 3, 6) THEN 'deterministic_plain_article_lookup' WHEN form = 9 THEN 'deterministic_no_karar' ELSE 'llm_generation' END AS route FROM questions)"""


def _routed(spark, sf, questions=None):
    asked = derived(spark, sf, "questions").select("q_id", "question") if questions is None else questions
    resolved = cut_lineage(retrieval.resolve_questions(asked))
    links = cut_lineage(_links(spark, sf))
    explicit = cut_lineage(retrieval.explicit_candidates(resolved, links))
    return resolved, links, R.route_questions(resolved, explicit, explicit)


@register("p12_answer_routes", _ROUTES + " SELECT * FROM rt")
def _(spark, sf):
    return _routed(spark, sf)[2].select("q_id", "route")


@register("p12_route_counts", _ROUTES + " SELECT route, count(*) AS questions FROM rt GROUP BY route")
def _(spark, sf):
    return _routed(spark, sf)[2].groupBy("route").agg(F.count("*").alias("questions"))


@register("p12_gated_routes", f"SELECT o_orderkey, (['deterministic_pure_case_number','deterministic_generic_karar_search','deterministic_no_karar','deterministic_document_template','llm_generation','deterministic_source_strict_technical_article','deterministic_article_full_text','deterministic_article_elements'])[o_orderkey % 8 + 1] AS route FROM orders")
def _(spark, sf):
    asked = parsing.with_refs(_asked(spark, sf, "2022/{n} E.", "Yargıtay karar ara", "TBK {n} hakkında Yargıtay kararı", "TBK {n} kısa ihtarname hazırla", "TBK {n} nedir anlatır mısın",
                                     "TBK {n} faiz istenebilir mi", "TBK {n} aynen ver", "TBK {n} şartları nelerdir"), "q")
    yes = F.lit(True)
    return asked.select("o_orderkey", P.route(F.col("q"), F.col("q"), F.col("refs"), yes, yes, F.lit(False)).alias("route"))


@register("p13_document_request", f"SELECT o_orderkey, ([true,true,true,false,true])[o_orderkey % 5 + 1] AS document, ([true,true,false,false,false])[o_orderkey % 5 + 1] AS template FROM orders")
def _(spark, sf):
    return _asked(spark, sf, "TBK {n} dayalı kısa ihtarname hazırla", "ihtarname {n}", "ihtar çek, kira {n} tarihinde", "TBK {n}", "TBK {n} dilekçe").select(
        "o_orderkey", P.asks_document(F.col("q")).alias("document"), P.asks_template(F.col("q")).alias("template"))


@register("p14_notice_forms", f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace('{_esc(V.SHORT_NOTICE)}', '{{label}}', concat(p_name, ' Madde 1')) WHEN 1 THEN replace('{_esc(V.LONG_NOTICE)}', '{{label}}', 'ilgili mevzuat')
 ELSE 'yedek' END AS answer FROM part""")
def _(spark, sf):
    form = F.col("p_partkey") % 3
    q = F.when(form == 0, "TBK 49 kısa ihtarname").when(form == 1, "İhtarname örneği").otherwise("dilekçe")
    label = F.when(form == 0, F.concat("p_name", F.lit(" Madde 1")))
    return table(spark, sf, "part").select("p_partkey", A.notice_answer(q, label, F.lit("yedek")).alias("answer"))


# --- lists of sources -------------------------------------------------------------------

VIEWS["listed"] = ("""SELECT o_custkey AS q_id, o_orderkey AS id, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rank,
  'mevzuat' AS source_type, concat('Kanun ', o_orderstatus) AS law_name, CAST(NULL AS VARCHAR(9)) AS regulation_name, '6098' AS law_no, 'madde' AS article_type,
  CAST(o_orderkey AS VARCHAR(20)) AS article_no, concat('metin ', o_orderpriority) AS text, o_orderstatus AS chamber,
  concat('2020/', CAST(o_orderkey AS VARCHAR(20))) AS case_no, CAST(o_custkey AS VARCHAR(20)) AS decision_no FROM orders""", [])


def _listed(spark, sf):
    return derived(spark, sf, "listed")


def _lists(spark, sf):
    no = F.lit(None)
    ask = F.struct(no.cast("array<string>").alias("plural"), no.cast("string").alias("single"), no.cast("string").alias("item"),
                   no.cast("string").alias("numbered"), F.lit(False).alias("requested"))
    rows = _listed(spark, sf).withColumn("ask", ask).withColumn("paragraphs", no.cast("array<struct<no:string,text:string,items:map<string,string>>>"))
    arts = R.labelled_sources(rows.where(F.col("q_id") % 3 != 0))
    decs = R.labelled_decisions(rows.where(F.col("q_id") % 2 == 0))
    empty = F.array().cast("array<struct<label:string,text:string>>")
    both = table(spark, sf, "customer").select(F.col("c_custkey").alias("q_id")).join(arts, "q_id", "left").join(decs, "q_id", "left")
    return both.select("q_id", F.coalesce("articles", empty).alias("articles"), F.coalesce("decisions", empty).alias("decisions"))


def _agg(sep, fmt, table_name, lo, hi):
    return f"(SELECT string_agg({fmt}, '{sep}' ORDER BY rank) FROM {table_name} a WHERE a.q_id = c.q_id AND a.rank BETWEEN {lo} AND {hi})"


_AL, _DL = "concat('- [', law_name, ' Madde ', article_no, '] ', text)", "concat('- [', chamber, ' - ', case_no, ' / ', decision_no, '] ', text)"
_LISTS = cte("listed") + """, arts AS (SELECT * FROM listed WHERE q_id % 3 <> 0 AND rank <= 18), decs AS (SELECT * FROM listed WHERE q_id % 2 = 0 AND rank <= 5),
c AS (SELECT c_custkey AS q_id, (SELECT count(*) FROM arts a WHERE a.q_id = c_custkey) AS na, (SELECT count(*) FROM decs a WHERE a.q_id = c_custkey) AS nd FROM customer)"""


@register("p15_fallback_answers", _LISTS + f""" SELECT q_id, concat_ws('\n', '{V.FALLBACK_HEAD}', CASE WHEN na > 0 THEN concat('{V.FALLBACK_ARTICLES}\n', {_agg(chr(10), _AL, 'arts', 1, 10)}) END,
 CASE WHEN nd > 0 THEN concat('{V.FALLBACK_DECISIONS}\n', {_agg(chr(10), _DL, 'decs', 1, 3)}) END, CASE WHEN na + nd = 0 THEN '{V.FALLBACK_NONE}' END, '\n{V.DISCLAIMER}') AS answer FROM c""")
def _(spark, sf):
    return _lists(spark, sf).select("q_id", A.fallback_answer(F.col("articles"), F.col("decisions")).alias("answer"))


_FIRST = "(SELECT concat(law_name, ' Madde ', article_no) FROM arts a WHERE a.q_id = c.q_id AND a.rank = 1)"
_FTEXT = "(SELECT text FROM arts a WHERE a.q_id = c.q_id AND a.rank = 1)"


@register("p15_strict_answers", _LISTS + f""" SELECT q_id, CASE WHEN na > 0 THEN concat_ws('\n', 'Kısa Cevap', '', concat({_FIRST}, ' metnine göre:'), {_FTEXT}, '',
  CASE WHEN na > 1 THEN concat('İlgili Diğer Kaynaklar:\n', {_agg(chr(10), _AL, 'arts', 2, 5)}, '\n') END, concat('{V.BASIS}', {_FIRST}))
 WHEN nd > 0 THEN concat('{V.STRICT_DECISIONS}\n', {_agg(chr(10), _DL, 'decs', 1, 3)}) ELSE '{V.NO_SOURCE}' END AS answer FROM c""")
def _(spark, sf):
    return _lists(spark, sf).select("q_id", A.strict_answer(F.col("articles"), F.col("decisions")).alias("answer"))


@register("p15_no_decision_answers", _LISTS + f""" SELECT q_id, concat_ws('\n', '{V.NO_DECISION_HEAD}', CASE WHEN na > 0 THEN concat('\n{V.NO_DECISION_LIST}\n', {_agg(chr(10), _AL, 'arts', 1, 5)}) END, '', '{V.DISCLAIMER}') AS answer FROM c""")
def _(spark, sf):
    return _lists(spark, sf).select("q_id", A.no_decision_answer(F.col("articles")).alias("answer"))


@register("w13_source_limits", _LISTS + """ SELECT q_id, least(na, 10) AS fallback_articles, least(nd, 3) AS fallback_decisions, least(na, 5) AS listed FROM c""")
def _(spark, sf):
    count = lambda text, mark: F.regexp_count(text, F.lit(mark)).cast("bigint")
    rows = _lists(spark, sf)
    fb, nd = A.fallback_answer(F.col("articles"), F.col("decisions")), A.no_decision_answer(F.col("articles"))
    return rows.select("q_id", count(fb, r"- \[Kanun").alias("fallback_articles"), count(fb, r"- \[[A-Z] - 2020").alias("fallback_decisions"), count(nd, r"- \[Kanun").alias("listed"))


@register("p16_disclaimers", f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{V.DISCLAIMER}' WHEN 1 THEN concat(p_name, '\n\n{V.DISCLAIMER}')
 WHEN 2 THEN concat(p_name, ' BU BİLGİLER GENEL HUKUKİ BİLGİ NİTELİĞİNDEDİR, AVUKATTAN GÖRÜŞ ALINIZ. ', p_type) ELSE concat(p_name, ' {V.DISCLAIMER}') END AS answer FROM part""")
def _(spark, sf):
    form = F.col("p_partkey") % 4
    raw = (F.when(form == 0, "  \n").when(form == 1, F.concat(F.lit(" "), "p_name", F.lit(" ")))
           .when(form == 2, F.concat("p_name", F.lit(" BU BİLGİLER GENEL HUKUKİ BİLGİ NİTELİĞİNDEDİR, AVUKATTAN GÖRÜŞ ALINIZ. "), "p_type"))
           .otherwise(F.concat("p_name", F.lit(" " + V.DISCLAIMER))))
    return table(spark, sf, "part").select("p_partkey", A.with_disclaimer(raw).alias("answer"))


# --- audit -----------------------------------------------------------------------------

# Given answers over listed sources: seven ways to pass or fail.
_ANSWERS = """SELECT o_custkey AS q_id, MIN(o_orderkey) AS first_id FROM orders GROUP BY o_custkey"""
VIEWS["answer_keys"] = (_ANSWERS, [])


def _answers(spark, sf):
    k, no = F.col("q_id") % 8, F.col("first_id").cast("string")
    text = (F.when(k == 0, F.concat(F.lit("TBK m. "), no, F.lit(" uyarınca zarar giderilir.")))
            .when(k == 1, F.concat(F.lit("TBK m. "), no, F.lit(" uyarınca faiz ve zamanaşımı uygulanır.")))
            .when(k == 2, F.concat(F.lit("6098 sayılı Kanun Madde "), no, F.lit(" ve Yargıtay uygulaması.")))
            .when(k == 3, F.lit("Kaynaksız bir cevap.")).when(k == 4, F.lit("  "))
            .when(k == 5, F.concat(F.lit("Türk Borçlar Kanunu md."), no, F.lit(" açıktır.")))
            .when(k == 6, F.concat(F.lit("TBK "), no, F.lit(" için illiyet bağı gerekir.")))
            .otherwise(F.concat(F.lit("Borçlar Kanunu "), no)))
    return derived(spark, sf, "answer_keys").select("q_id", text.alias("answer"))


def _sources(spark, sf):
    return _listed(spark, sf).where(F.col("q_id") % 11 != 0).withColumn("kind", F.when(
        (F.col("q_id") % 5 == 0) & (F.col("rank") > 1), "decision").otherwise("article")).withColumn(
        "text", F.when(F.col("q_id") % 6 == 1, F.concat("text", F.lit(" Faiz"))).otherwise(F.col("text")))


_AUDIT = cte("answer_keys", "listed") + """, a AS (SELECT q_id, q_id % 8 AS k, (SELECT count(*) FROM listed l WHERE l.q_id = x.q_id) AS n FROM answer_keys x),
r AS (SELECT q_id, k, CASE WHEN k = 4 THEN 'empty_answer' WHEN q_id % 11 = 0 THEN 'no_sources'
  WHEN k = 1 THEN 'unsupported_legal_term:zamanaşımı' WHEN k = 6 THEN 'unsupported_legal_term:illiyet_bagi'
  WHEN k = 2 AND NOT (q_id % 5 = 0 AND n > 1) THEN 'forbidden_case_term:yargıtay' WHEN k = 3 THEN 'no_allowed_reference' ELSE 'ok' END AS reason FROM a)"""


@register("p17_unsupported_terms", cte("statutes") + """ SELECT id, CASE WHEN id % 3 = 0 THEN 'zamanaşımı'
  WHEN id % 3 = 1 THEN CASE WHEN contains(lower(text), 'faiz') THEN NULL ELSE 'faiz' END ELSE NULL END AS first_group FROM statutes""")
def _(spark, sf):
    said = F.when(F.col("id") % 3 == 0, "ZAMANAŞIMI ve yasal faiz").when(F.col("id") % 3 == 1, "Temerrüt faizi istenir").otherwise("zarar")
    rows = derived(spark, sf, "statutes").withColumn("g", A.term_groups(F.col("text")))
    source = [F.get("g", F.lit(i)) for i in range(len(V.UNSUPPORTED_TERMS))]
    return rows.select("id", A.first_unsupported(A.term_groups(said), source).alias("first_group"))


@register("p18_answer_audit", _AUDIT + " SELECT q_id, reason, reason = 'ok' AS valid FROM r")
def _(spark, sf):
    return audit.audit_answers(_answers(spark, sf), _sources(spark, sf)).select("q_id", "reason", "valid")


_AC, _DC = "concat('[', law_name, ' Madde ', article_no, ']\n', text)", "concat('[', chamber, ' - ', case_no, ' / ', decision_no, ']\n', text)"


@register("p19_context_blocks", _LISTS + f""" SELECT q_id, concat_ws('\n\n---\n\n', {_agg(chr(10) * 2 + '---' + chr(10) * 2, _AC, 'arts', 1, 18)}, {_agg(chr(10) * 2 + '---' + chr(10) * 2, _DC, 'decs', 1, 5)}) AS context FROM c WHERE na + nd > 0""")
def _(spark, sf):
    rows = _lists(spark, sf)
    arts = rows.where(F.size("articles") > 0).select("q_id", "articles")
    return R.context_blocks(arts, rows.where(F.size("decisions") > 0).select("q_id", "decisions"))


@register("p20_article_rows", cte("statutes") + """ SELECT id, id % 9 AS q_id, concat(law_name, ' ', CASE article_type WHEN 'ek' THEN 'Ek Madde' WHEN 'gecici' THEN 'Geçici Madde' ELSE 'Madde' END, ' ', article_no) AS title,
  CASE WHEN p_size % 2 = 0 THEN p_name ELSE left(text, 500) END AS snippet, round(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size / 64.0 END, 0) * 100, 2) AS match_percent FROM statutes""")
def _(spark, sf):
    rows = derived(spark, sf, "statutes").withColumn("q_id", F.col("id") % 9).withColumn("rank", F.col("id")).withColumn(
        "chunk_text", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")).withColumn(
        "similarity", F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 64.0))
    return R.format_articles(rows).select("id", "q_id", "title", "snippet", "match_percent")


@register("t05_all_sources", cte("listed") + """ SELECT q_id, id, rank, CAST(1 AS INTEGER) AS part, source_type, concat(law_name, ' Madde ', article_no) AS title, left(text, 500) AS snippet FROM listed
UNION ALL SELECT q_id, id, rank, 2, 'karar', concat(chamber, ' - ', case_no, ' / ', decision_no), left(text, 500) FROM listed""")
def _(spark, sf):
    rows = _listed(spark, sf).withColumn("similarity", F.lit(0.5)).withColumn("chunk_text", F.lit(""))
    return R.all_sources(rows, rows).select("q_id", "id", "rank", "part", "source_type", "title", "snippet")


@register("p21_search_routes", f"SELECT o_orderkey, (['generic','case_number','decision_only','mixed'])[o_orderkey % 4 + 1] AS route FROM orders")
def _(spark, sf):
    return _asked(spark, sf, "Yargıtay karar ara", "2022/{n} E.", "TBK {n} hakkında karar", "kira artışı {n}").select("o_orderkey", P.search_route(F.col("q")).alias("route"))


@register("p21_decision_search", _COS + """, rt AS (SELECT vec_id AS q_id, (['generic','case_number','decision_only','mixed'])[vec_id % 4 + 1] AS route FROM embeddings),
s AS (SELECT q_id, v_id AS id, rank, sim FROM t WHERE rank <= 8),
cs AS (SELECT q_id, o_orderkey AS id, row_number() OVER (PARTITION BY q_id ORDER BY o_orderkey) AS rank FROM rt JOIN orders ON contains(concat(CAST(1990 + o_custkey % 35 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)), concat('2005/', CAST(q_id AS VARCHAR))) WHERE route = 'case_number' QUALIFY rank <= 8)
SELECT q_id, route, 'decision' AS kind, CAST(rank AS BIGINT) AS rank, id, round(sim, 6) AS similarity FROM s JOIN rt USING (q_id) WHERE route IN ('decision_only', 'mixed')
UNION ALL SELECT q_id, route, 'article', rank, id, round(sim, 6) FROM s JOIN rt USING (q_id) WHERE route = 'mixed'
UNION ALL SELECT q_id, 'case_number', 'decision', rank, id, NULL FROM cs""")
def _(spark, sf):
    q, v = _vectors(spark, sf)
    forms = F.array(F.lit("Yargıtay karar ara"), F.concat(F.lit("2005/"), F.col("q_id").cast("string"), F.lit(" E.")), F.lit("TBK 49 hakkında karar"), F.lit("kira artışı"))
    asked = q.select("q_id", F.get(forms, (F.col("q_id") % 4).cast("int")).alias("question"))
    # routes without vectors take no part in the vector search; two kinds of rows come from its one result
    near = q.join(asked.where(P.search_route(F.col("question")).isin("decision_only", "mixed")).select("q_id").distinct(), "q_id", "left_semi")
    hits = cut_lineage(lookup.vector_top_k(near, v, 8).select("q_id", F.col("v_id").alias("id"), "rank", "similarity"))
    decisions = _decisions(spark, sf).withColumn("text", F.lit(""))
    cases = lookup.case_number_search(asked, decisions, 8).select("q_id", "id", "rank", F.lit(None).cast("double").alias("similarity"))
    out = R.decision_search(asked, cases, hits, hits)
    return out.select("q_id", "route", "kind", _big("rank"), "id", F.round("similarity", 6).alias("similarity"))


# Every fourth query of a kind; mixed ones ask for a product name, and every second of them has no vector.
_SEARCH = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nv AS (SELECT count(*) AS n FROM embeddings),
rt AS (SELECT vec_id AS q_id, (['generic','case_number','decision_only','mixed'])[vec_id % 4 + 1] AS route, vec_id % 8 <> 7 AS has FROM embeddings),
sm AS (SELECT a.vec_id AS q_id, b.vec_id AS own, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b)"""


def _search_inputs(spark, sf):
    q, v = _vectors(spark, sf)
    n = v.count()
    own = v.select(F.col("v_id").alias("own"), "vector")
    forms = F.array(F.lit("Yargıtay karar ara"), F.concat(F.lit("2005/"), F.col("q_id").cast("string"), F.lit(" E.")), F.lit("TBK 49 hakkında karar"), F.coalesce("p_name", F.lit("kira")))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("q_id"), "p_name")
    asked = q.select("q_id").join(names, "q_id", "left").select("q_id", F.get(forms, (F.col("q_id") % 4).cast("int")).alias("question"))
    vectors = q.select("q_id", F.when(F.col("q_id") % 8 != 7, F.col("vector")).alias("vector"))
    decisions, articles = _decisions(spark, sf), derived(spark, sf, "statutes")
    of = lambda rows: rows.select(F.col("id").alias("v_id"), (F.col("id") % n).alias("own")).join(own, "own").drop("own")
    chunks = of(articles).withColumns({"article_id": F.col("v_id"), "chunk_index": F.lit(0), "chunk_text": F.lit("")})
    return asked, vectors, decisions, of(decisions), articles, chunks


@register("p21_whole_search", cte("statutes") + ", " + _SEARCH.removeprefix("WITH ") + """,
ds AS (SELECT q_id, o_orderkey AS id, sim, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 12) DESC, o_orderkey) AS rank
  FROM (SELECT o_orderkey, o_orderkey % n AS own FROM orders, nv) JOIN sm USING (own) JOIN rt USING (q_id) WHERE has AND route IN ('decision_only', 'mixed') QUALIFY rank <= 8),
ar AS (SELECT q_id, id, sim, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 12) DESC, id) AS rank
  FROM (SELECT id, id % nv.n AS own FROM statutes, nv) JOIN sm USING (own) JOIN rt USING (q_id) WHERE has AND route = 'mixed' QUALIFY rank <= 8),
cs AS (SELECT q_id, o_orderkey AS id, row_number() OVER (PARTITION BY q_id ORDER BY o_orderkey) AS rank FROM rt JOIN orders
  ON contains(concat(CAST(1990 + o_custkey % 35 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)), concat('2005/', CAST(q_id AS VARCHAR)))
  OR contains(concat('bkz. 2001/', CAST(o_custkey AS VARCHAR), ' sayılı karar'), concat('2005/', CAST(q_id AS VARCHAR))) WHERE route = 'case_number' QUALIFY rank <= 8),
kw AS (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY law_no, article_type, article_no, id) AS rank FROM rt LEFT JOIN part ON part.p_partkey = q_id
  JOIN statutes ON contains(lower(text), lower(coalesce(part.p_name, 'kira'))) WHERE route = 'mixed' AND NOT has QUALIFY rank <= 8)
SELECT q_id, 'decision' AS kind, CAST(1 AS INTEGER) AS part, CAST(rank AS BIGINT) AS rank, id, round(sim, 6) AS similarity FROM ds
UNION ALL SELECT q_id, 'article', 2, rank, id, round(sim, 6) FROM ar UNION ALL SELECT q_id, 'decision', 1, rank, id, NULL FROM cs UNION ALL SELECT q_id, 'article', 3, rank, id, NULL FROM kw""")
def _(spark, sf):
    """All parts of the decision search: whole decision texts, keywords for queries without vectors only."""
    found = R.search_decisions(*_search_inputs(spark, sf))
    return found.select("q_id", "kind", "part", _big("rank"), "id", F.round("similarity", 6).alias("similarity"))


@register("p21_search_messages", _SEARCH + f""" SELECT q_id, route, route = 'mixed' AND NOT has AS fallback, CASE WHEN route = 'mixed' AND NOT has THEN '{V.SEARCH_FALLBACK}'
  WHEN route = 'generic' THEN '{V.SEARCH_MESSAGES["generic"]}' WHEN route = 'decision_only' THEN '{V.SEARCH_MESSAGES["decision_only"]}' END AS message FROM rt""")
def _(spark, sf):
    asked, vectors, *_rest = _search_inputs(spark, sf)
    return R.search_messages(asked, vectors)


@register("p23_validated_answers", _AUDIT + f""" SELECT q_id, reason = 'ok' AS valid, reason, CASE WHEN reason = 'empty_answer' THEN 'yedek'
 WHEN reason = 'ok' THEN concat(trim(CASE k WHEN 0 THEN concat('TBK m. ', f, ' uyarınca zarar giderilir.') WHEN 2 THEN concat('6098 sayılı Kanun Madde ', f, ' ve Yargıtay uygulaması.')
   WHEN 5 THEN concat('Türk Borçlar Kanunu md.', f, ' açıktır.') ELSE concat('Borçlar Kanunu ', f) END), {_NOTE})
 WHEN q_id % 2 = 0 THEN replace('{_esc(V.LONG_NOTICE)}', '{{label}}', 'ilgili mevzuat') ELSE concat('kesin', {_NOTE}) END AS answer
 FROM (SELECT r.*, CAST(first_id AS VARCHAR) AS f FROM r JOIN answer_keys USING (q_id))""")
def _(spark, sf):
    answers = _answers(spark, sf)
    empty = F.array().cast("array<struct<label:string,text:string>>")
    answered = answers.select("q_id", F.when(F.col("q_id") % 2 == 0, "ihtarname hazırla").otherwise("TBK 49").alias("resolved"),
                              F.lit("kesin").alias("strict"), F.lit("yedek").alias("fallback"), empty.alias("articles"))
    return R.validated_answers(answered, answers, _sources(spark, sf))


@register("p15_text_answers", None)
def _(spark, sf):
    """Answer texts of every route, over the whole question table; ids that ask the same are answered once."""
    articles = corpus.with_structure(derived(spark, sf, "statutes"))
    alike = parsing.asked_alike(derived(spark, sf, "questions"))
    resolved, links, routed = _routed(spark, sf, cut_lineage(parsing.one_of_each(alike)))
    ranked = retrieval.retrieve_resolved(resolved, links, articles)
    answers = R.text_answers(routed, ranked).select("asked", "route", "answer")
    return alike.join(answers, "asked").select("q_id", "route", "answer")


