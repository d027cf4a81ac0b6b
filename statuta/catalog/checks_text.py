"""Scans and normalising functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions import fixed_values as V
from ..operators import corpus, parsing
from ..sources import readers
from .inputs import WS, canon_sql, collapse_sql, cte, derived, spread, table

Q: dict = {}


def register(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


# --- sources -----------------------------------------------------------------

@register("s01_statute_lines", r"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line
FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\x{feff}', ''), '\r\n|\r|\n') AS lines FROM documents),
     LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)""")
def _(spark, sf):
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value"))
    return readers.cut_lines(raw).select(F.col("file").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@register("s02_article_records", """
SELECT c_custkey, trim(c_name) AS c_name, trim(c_mktsegment) AS c_mktsegment, body FROM (
  SELECT *, trim(CASE WHEN c_custkey % 7 = 0 THEN '   ' ELSE concat('  ', c_name, ' metni  ') END) AS body FROM customer)
WHERE body <> ''""")
def _(spark, sf):
    raw = table(spark, sf, "customer").withColumn("body", F.when(F.col("c_custkey") % 7 == 0, "   ").otherwise(
        F.concat(F.lit("  "), "c_name", F.lit(" metni  "))))
    return corpus.clean_records(raw, ["c_name", "c_mktsegment", "body"], "body").select(
        "c_custkey", "c_name", "c_mktsegment", "body")


@register("s03_regulation_meta", """
SELECT c.c_custkey, n.law_no, n.regulation_name, n.source_type
FROM customer c JOIN (
  SELECT n_nationkey AS folder, CAST(6000 + n_nationkey AS VARCHAR) AS law_no,
         CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat(n_name, ' Yönetmeliği') END AS regulation_name,
         'yonetmelik' AS source_type FROM nation) n ON c.c_nationkey = n.folder
WHERE n.regulation_name <> ''""")
def _(spark, sf):
    meta = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("folder"), (F.col("n_nationkey") + 6000).cast("string").alias("law_no"),
        F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat("n_name", F.lit(" Yönetmeliği"))).alias("regulation_name"),
        F.lit("yonetmelik").alias("source_type"))
    good, _rejected = readers.split_meta(meta)
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("folder"))
    return readers.attach_meta(rows, good).select("c_custkey", "law_no", "regulation_name", "source_type")


@register("s03_regulation_meta_rejected", """
SELECT CAST(c_custkey AS VARCHAR) AS folder,
       CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'law_no,regulation_name'
            WHEN c_mktsegment = 'BUILDING' THEN 'law_no' ELSE 'regulation_name' END AS missing
FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("folder"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("law_no"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("regulation_name"), F.lit("yonetmelik").alias("source_type"))
    return readers.split_meta(rows)[1].select("folder", F.array_join("missing_keys", ",").alias("missing"))


@register("s04_law_scan", "SELECT doc_id, text FROM documents WHERE source = 'src7'")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("source") == "src7").select("doc_id", "text")


_SNAPSHOT = """
WITH stored AS (SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0),
incoming AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, ' değişik') ELSE c_name END AS c_name,
             c_acctbal FROM customer WHERE c_custkey % 11 <> 0)"""


def _snapshots(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    edited = c.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" değişik"))).otherwise(F.col("c_name")))
    return c.where(F.col("c_custkey") % 5 != 0), edited.where(F.col("c_custkey") % 11 != 0)


@register("s05_article_upsert", _SNAPSHOT + """
SELECT * FROM incoming UNION ALL SELECT s.* FROM stored s WHERE NOT EXISTS (
  SELECT 1 FROM incoming i WHERE i.c_nationkey = s.c_nationkey AND i.c_custkey = s.c_custkey)""")
def _(spark, sf):
    stored, incoming = _snapshots(spark, sf)
    return corpus.upsert(stored, incoming, ["c_nationkey", "c_custkey"])


@register("s05_latest_version", """
SELECT l_partkey, l_suppkey, max(l_orderkey * 10 + l_linenumber) AS version,
       max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM (
  SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity
  FROM lineitem GROUP BY ALL) GROUP BY l_partkey, l_suppkey""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("l_quantity"))
    rows = rows.select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), "l_quantity")
    return corpus.latest_version(rows, ["l_partkey", "l_suppkey"], "version")


@register("s06_replace_derived", """
WITH rebuilt AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.09)
SELECT l_orderkey, l_linenumber, l_quantity, 'old' AS state FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM rebuilt)
UNION ALL
SELECT l_orderkey, l_linenumber, l_quantity * 2, 'new' FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM rebuilt) AND l_quantity > 10""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    parents = li.where(F.col("l_discount") > 0.09).select("l_orderkey").distinct()
    rebuilt = (li.drop("l_discount").join(parents, "l_orderkey", "left_semi").where(F.col("l_quantity") > 10)
               .withColumn("l_quantity", F.col("l_quantity") * 2).withColumn("state", F.lit("new")))
    return corpus.replace_derived(li.drop("l_discount").withColumn("state", F.lit("old")), rebuilt, "l_orderkey", parents)


@register("s07_preview_records", cte("statutes") + """
SELECT id, to_json({'law_no': law_no, 'law_name': law_name, 'article_no': article_no, 'article_type': article_type,
                    'text': text})::VARCHAR AS record FROM statutes""")
def _(spark, sf):
    return derived(spark, sf, "statutes").select("id", F.to_json(F.struct(
        "law_no", "law_name", "article_no", "article_type", "text")).alias("record"))


@register("s08_record_report", cte("statutes") + """
SELECT law_no, part, CAST(rank AS BIGINT) AS rank, article_type, article_no FROM (
  SELECT law_no, 'first' AS part, article_type, article_no,
         row_number() OVER (PARTITION BY law_no ORDER BY article_type, n) AS rank FROM statutes
  UNION ALL
  SELECT law_no, 'last', article_type, article_no,
         row_number() OVER (PARTITION BY law_no ORDER BY article_type DESC, n DESC) FROM statutes) WHERE rank <= 10""")
def _(spark, sf):
    return corpus.record_report(derived(spark, sf, "statutes")).select(
        "law_no", "part", F.col("rank").cast("bigint").alias("rank"), "article_type", "article_no")


@register("s09_page_links", r"""
WITH links AS (
  SELECT page_id, i AS nth, l[i] AS url FROM (
    SELECT page_id, regexp_extract_all(html, '<a[^>]*?href="([^"]*)"', 1) AS l FROM pages),
    LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))
SELECT url, min(page_id) AS page_id FROM links WHERE contains(url, '/') AND NOT contains(url, 'Dil=') GROUP BY url""")
def _(spark, sf):
    return readers.page_links(table(spark, sf, "pages"), "/", "Dil=").select("url", "page_id")


@register("s09_listed_decisions", """
SELECT o_orderkey AS page_id, concat('https://x/BB/', CAST(o_custkey AS VARCHAR)) AS url, concat('Karar ', o_orderpriority) AS title,
       concat(CAST(2000 + o_custkey % 25 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)) AS application_no,
       'Esas' AS kind, 'Birinci Bölüm' AS section, CAST(o_orderdate AS DATE) AS decision_date,
       left(repeat(concat(o_orderstatus, ' konu '), 120), 600) AS subject
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def _(spark, sf):
    o = spread(table(spark, sf, "orders"))
    html = F.concat(
        F.lit('<html><a href="/x?Dil=tr">d</a><div class="birkarar"><a href="/x?Dil=en">d</a><a href="/BB/'), F.col("o_custkey").cast("string"),
        F.lit('">git</a><titles>Karar '), "o_orderpriority", F.lit('</titles><div class="kararbilgileri">'),
        (F.col("o_custkey") % 25 + 2000).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"),
        F.lit(" | Esas | Birinci Bölüm | Karar Tarihi : "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit('</div><div class="basvurukonualani">'), F.repeat(F.concat("o_orderstatus", F.lit(" konu ")), 120), F.lit("</div></div></html>"))
    rows = readers.listed_decisions(o.select(F.col("o_orderkey").alias("page_id"), html.alias("html")), "https://x")
    return rows.select("page_id", "url", "title", "info.application_no", "info.kind", "info.section", "info.decision_date", "subject")


_PAGE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
  '(?is)<div[^>]*class="[^"]*\bad\b[^"]*"[^>]*>.*?</div>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"""


@register("s10_page_text", rf"""
SELECT page_id, t AS text, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace({_PAGE_SQL}, '(?s)<[^>]*>', chr(10), 'g'),
   '&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&'),
  '{WS}*\n{WS}*', chr(10), 'g'), '^{WS}+', ''), '{WS}+$', '') AS t FROM pages)""")
def _(spark, sf):
    body = readers.page_text(F.col("html"), ["script", "style"], ["ad"])
    return table(spark, sf, "pages").select("page_id", body.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


# Pages of blocks inside blocks: an item of a list with further blocks before, between and in its parts.
@register("s09_nested_listing", """
SELECT o_orderkey AS page_id, concat('https://x/BB/', CAST(o_orderkey AS VARCHAR), '/', CAST(i AS VARCHAR)) AS url, concat('Karar & ', o_orderpriority, CAST(i AS VARCHAR)) AS title,
  concat('2020/', CAST(o_custkey AS VARCHAR)) AS application_no, CAST(o_orderdate AS DATE) AS decision_date, concat('konu', o_orderstatus, 'sonu', CAST(i AS VARCHAR)) AS subject
FROM orders, (VALUES (1), (2)) AS t(i)""")
def _(spark, sf):
    o = spread(table(spark, sf, "orders"))
    key = F.col("o_orderkey").cast("string")
    item = lambda i: F.concat(
        F.lit('<div class="a"><DIV id=x class="kutu birkarar x"><div class="b"><div>iç</div></div><script>"</div>"</script><a href="/BB/1?Dil=en">d</a><a title="a>b" href=\'/BB/'),
        key, F.lit(f"/{i}'>git</a><titles>Karar &amp; "), "o_orderpriority", F.lit(f'{i}</titles><div class="kararbilgileri"><div>2020/'), F.col("o_custkey").cast("string"),
        F.lit('</div> | Esas | Birinci Bölüm | <div><span>Karar Tarihi : '), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit('</span></div></div><!-- <div> --><div class="basvurukonualani">konu<div class="basvurukonualani">'), "o_orderstatus", F.lit(f"</div>sonu{i}</div></DIV></div>"))
    html = F.concat(F.lit('</div><div class="birkararlar"><a href="/BB/0">x</a></div>'), item(1), item(2), F.lit('<div class="birkarar">ohne'))
    rows = readers.listed_decisions(o.select(F.col("o_orderkey").alias("page_id"), html.alias("html")), "https://x")
    return rows.select("page_id", "url", "title", "info.application_no", "info.decision_date", "subject")


@register("s10_decision_page", """
SELECT o_orderkey AS page_id, CASE o_orderkey % 4
  WHEN 0 THEN concat('TÜRKİYE CUMHURİYETİ', chr(10), 'Karar ', CAST(o_custkey AS VARCHAR), chr(10), 'son')
  WHEN 1 THEN concat('orta ', o_orderpriority, chr(10), 'içerik', chr(10), 'kuyruk')
  WHEN 2 THEN concat('TÜRKİYE CUMHURİYETİ', chr(10), 'menü sonu ', o_orderstatus)
  ELSE concat('açık kalan ', o_orderstatus, chr(10), 'sayfa sonu') END AS text FROM orders""")
def _(spark, sf):
    o = spread(table(spark, sf, "orders"))
    side = '<div class="filtreler"><div>iç<div class="filtreler">daha iç</div></div>kenar</div>'
    forms = [
        F.concat(F.lit(f'<div>menü</div><div class="ortaalan">{side}<div class="x kararsonucalani"><p>giriş</p>{side}<div>TÜRKİYE CUMHURİYETİ</div><p>Karar '),
                 F.col("o_custkey").cast("string"), F.lit('</p><div class="aravetemizle"><div>x</div>y</div><div><div>son</div></div></div><div>alt</div></div>')),
        F.concat(F.lit(f'<div>menü</div>{side}<div class="ortaalan"><div>orta '), "o_orderpriority", F.lit(f'</div>{side}<p>içerik</p><div><div>kuyruk</div></div></div><div>alt</div>')),
        F.concat(F.lit(f'menü{side}<style>div{{}}</style><p>TÜRKİYE CUMHURİYETİ</p><div class="ortaalanlar">menü sonu '), "o_orderstatus", F.lit("</div>")),
        F.concat(F.lit('<div>menü</div><div class="kararsonucalani">açık kalan '), "o_orderstatus", F.lit('<div>sayfa sonu</div><div class="filtreler">kenar<div>')),
    ]
    html = F.get(F.array(*forms), (F.col("o_orderkey") % 4).cast("int"))
    return o.select(F.col("o_orderkey").alias("page_id"), readers.decision_text(html).alias("text"))


# --- scalar normalisers ---------------------------------------------------------

@register("n01_canonical_text", f"SELECT doc_id, sha256({canon_sql('text')}) AS canon FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.canon(F.col("text")), 256).alias("canon"))


# Mathematical letters, enclosed numbers, full-width digits and Korean syllables by the number of a part.
_WIDE = {0: (119808, 26, 1), 1: (9312, 20, 1), 2: (65296, 10, 1), 3: (44032, 399, 28)}


@register("n01_whole_unicode", """
SELECT p_partkey, concat('oe ss ', CASE p_partkey % 4 WHEN 0 THEN chr(CAST(65 + k % 26 AS INTEGER)) WHEN 1 THEN CAST(k % 20 + 1 AS VARCHAR) WHEN 2 THEN CAST(k % 10 AS VARCHAR)
  ELSE concat(chr(CAST(4352 + (k % 399) * 28 // 588 AS INTEGER)), chr(CAST(4449 + (k % 399) * 28 % 588 // 28 AS INTEGER))) END, ' ', lower(p_name)) AS canon
FROM (SELECT *, p_partkey // 4 AS k FROM part)""")
def _(spark, sf):
    k = F.floor(F.col("p_partkey") / 4)
    code = None
    for form, (first, count, step) in _WIDE.items():
        own = F.lit(first) + k % count * step
        code = F.when(F.col("p_partkey") % 4 == form, own) if code is None else code.when(F.col("p_partkey") % 4 == form, own)
    wide = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
    return table(spark, sf, "part").select("p_partkey", text.canon(F.concat(F.lit(" Öe ẞ "), wide, F.lit(" "), F.upper("p_name"))).alias("canon"))


@register("n02_statute_line", rf"SELECT doc_id, sha256({collapse_sql('line')}) AS line FROM (SELECT doc_id, concat(chr(65279), '  ', text, chr(160)) AS raw, replace(concat('  ', text, chr(160)), chr(65279), '') AS line FROM documents)")
def _(spark, sf):
    raw = F.concat(F.lit("\ufeff  "), "text", F.lit("\u00a0"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.normalise_line(raw), 256).alias("line"))


@register("n03_regulation_line", rf"SELECT doc_id, sha256({collapse_sql('line')}) AS line FROM (SELECT doc_id, replace(replace(concat(' a-b-', chr(160), text), chr(65279), ''), chr(8203), '') AS line FROM documents)")
def _(spark, sf):
    raw = F.concat(F.lit("\ufeff \u200ba\u2010b\u2012\u00a0"), "text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.normalise_regulation_line(raw), 256).alias("line"))


@register("n04_content_hash", f"SELECT doc_id, sha256({collapse_sql('text')}) AS content_hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


_TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
_UNITS = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
_ORD_UNITS = ["", "birinci", "ikinci", "üçüncü", "dördüncü", "beşinci", "altıncı", "yedinci", "sekizinci", "dokuzuncu"]


def _pick(words, index):
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _spelled(n, units=_UNITS):
    """n (1..9999) in Turkish words."""
    th, hu, te, un = F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10
    lead = lambda d: F.when(d > 1, _pick(_UNITS, d))
    return F.concat_ws(" ", lead(th), F.when(th > 0, "bin"), lead(hu), F.when(hu > 0, "yüz"),
                       F.nullif(_pick(_TENS, te), F.lit("")), F.nullif(_pick(units, un), F.lit("")))


def _numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 9998 + 1).alias("n"))


def _unit_numbers(spark, sf):
    """Round numbers moved up by one, so that every number ends in a unit word."""
    return _numbers(spark, sf).withColumn("n", F.col("n") + F.when(F.col("n") % 10 == 0, 1).otherwise(0))


@register("n05_cardinal_words", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 9998 + 1 END AS value FROM orders")
def _(spark, sf):
    words = _spelled(F.col("n"))
    words = F.when(F.col("o_orderkey") % 13 == 0, F.concat(words, F.lit(" tane"))).otherwise(words)
    return _numbers(spark, sf).select("o_orderkey", numbers.cardinal_value(words).alias("value"))


@register("n06_ordinal_words", "SELECT o_orderkey, o_orderkey % 9998 + 1 + CASE WHEN (o_orderkey % 9998 + 1) % 10 = 0 THEN 1 ELSE 0 END AS value FROM orders")
def _(spark, sf):
    return _unit_numbers(spark, sf).select(
        "o_orderkey", numbers.ordinal_value(_spelled(F.col("n"), _ORD_UNITS)).alias("value"))


@register("n07_number_spelling", "SELECT o_orderkey, concat('Süre ', replace(replace(replace(replace(replace(w, 'ı','i'),'ü','u'),'ç','c'),'ö','o'),'ş','s'), ' Gün') AS q FROM (SELECT o_orderkey, (['kırk','dört','üç','beş','altı','üçüncü'])[o_orderkey % 6 + 1] AS w FROM orders)")
def _(spark, sf):
    w = _pick(["kırk", "DÖRT", "üç", "Beş", "altı", "üçüncü"], F.col("o_orderkey") % 6)
    return table(spark, sf, "orders").select("o_orderkey", numbers.fold_number_words(F.concat(F.lit("Süre "), w, F.lit(" Gün"))).alias("q"))


@register("n08_compact_words", "SELECT o_orderkey, concat('Madde ', (['seksen iki','kirk dokuz','yuz on dort','on dorduncu','dokuz'])[o_orderkey % 5 + 1], ' sekiziki') AS q FROM orders")
def _(spark, sf):
    w = _pick(["Sekseniki", "kırkdokuz", "yüzondört", "ondördüncü", "dokuz"], F.col("o_orderkey") % 5)
    return table(spark, sf, "orders").select("o_orderkey", numbers.split_compact_words(F.concat(F.lit("Madde "), w, F.lit(" sekiziki"))).alias("q"))


@register("n09_ordinal_phrases", "SELECT o_orderkey, concat('HMK ', CAST(o_orderkey % 9998 + 1 + CASE WHEN (o_orderkey % 9998 + 1) % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR), '. madde ve sonrası') AS q FROM orders")
def _(spark, sf):
    words = numbers.fold_number_words(_spelled(F.col("n"), _ORD_UNITS))
    return _unit_numbers(spark, sf).select("o_orderkey", numbers.digits_for_ordinals(
        F.concat(F.lit("HMK "), words, F.lit(" madde ve sonrası"))).alias("q"))


@register("n10_cardinal_phrases", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('TBK ', n) WHEN 1 THEN concat('madde ', n, ' nedir')
  ELSE concat('süre ', (['on','yirmi','otuz'])[o_orderkey % 3 + 1], ' gün') END AS q FROM (SELECT o_orderkey, CAST(o_orderkey % 9998 + 1 AS VARCHAR) AS n FROM orders)""")
def _(spark, sf):
    words, form = numbers.fold_number_words(_spelled(F.col("n"))), F.col("o_orderkey") % 3
    q = (F.when(form == 0, F.concat(F.lit("TBK "), words)).when(form == 1, F.concat(F.lit("madde "), words, F.lit(" nedir")))
         .otherwise(F.concat(F.lit("süre "), _pick(["on", "yirmi", "otuz"], form), F.lit(" gün"))))
    return _numbers(spark, sf).select("o_orderkey", numbers.digits_for_cardinals(q).alias("q"))


@register("n11_question_normaliser", cte("questions") + r"""
SELECT q_id, CASE WHEN form = 5 THEN concat(alias, ' ', CAST(n AS VARCHAR), ' 2. fıkra')
  WHEN form = 4 THEN concat(alias, ' m. ', CAST(n AS VARCHAR), ' ve devamı') ELSE question END AS normalised FROM questions""")
def _(spark, sf):
    asked = derived(spark, sf, "questions").select("q_id", "question")
    return parsing.with_normalised(asked, "question").select("q_id", "normalised")


@register("n11_spelled_questions", "SELECT o_orderkey, concat('HMK ', CAST(o_orderkey % 9998 + 1 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN ' 7 2. fıkra a bendi' ELSE ' kanunu 5' END) AS q FROM orders")
def _(spark, sf):
    tail = F.when(F.col("o_orderkey") % 2 == 0, "  7 / 2 - a ").otherwise(" K. 5")
    return _numbers(spark, sf).select("o_orderkey", numbers.normalise_question(F.concat(F.lit("HMK "), _spelled(F.col("n")), tail)).alias("q"))


@register("n12_footnote_numbers", r"""SELECT p_partkey, concat(p_name, ' dayanarak; ', p_type, '. [', p_brand, '] ', 'Madde ', CAST(p_size AS VARCHAR)) AS t FROM part""")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    raw = F.concat("p_name", size, F.lit(" dayanarak;1 "), "p_type", F.lit(".23 ["), "p_brand", F.lit("]"), size, F.lit(" Madde "), size)
    return table(spark, sf, "part").select("p_partkey", text.drop_footnote_numbers(raw).alias("t"))


@register("n13_cut_at_appendix", f"SELECT doc_id, sha256({collapse_sql('text')}) AS t FROM documents")
def _(spark, sf):
    raw = F.concat("text", F.lit(f"\n {V.APPENDIX_MARKER} LİSTE\n"), "text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.cut_at_appendix(raw), 256).alias("t"))


@register("n13_clean_preview", "SELECT p_partkey, concat(p_name, ' ', p_type) AS t FROM part")
def _(spark, sf):
    raw = F.concat("p_name", F.lit("12\n 3 14/5/2011 tarihli not\n\n"), "p_type", F.lit(f"\n4857 SAYILI {V.APPENDIX_MARKER}\n"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", text.clean_preview_text(raw).alias("t"))


@register("n14_strip_title", cte("statutes") + "SELECT id, CASE WHEN p_size % 2 = 0 AND strpos(text, ':') <= 120 THEN body WHEN p_size % 2 = 0 THEN text ELSE concat(p_name, ': ', body) END AS t FROM statutes")
def _(spark, sf):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "text")).otherwise(F.concat("p_name", F.lit(": "), "body"))
    return derived(spark, sf, "statutes").select("id", text.strip_title(raw).alias("t"))


@register("n15_number_key", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE l_partkey END AS base,
  CASE WHEN l_linenumber = 7 THEN concat('X', CAST(l_partkey AS VARCHAR)) WHEN l_linenumber = 1 THEN 'B' ELSE '' END AS suffix FROM lineitem""")
def _(spark, sf):
    no = F.col("l_partkey").cast("string")
    value = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), no)).when(F.col("l_linenumber") == 1, F.concat(no, F.lit(" / b"))).otherwise(no)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.article_number_key(value).alias("k")).select(
        "l_orderkey", "l_linenumber", F.col("k.base").alias("base"), F.col("k.suffix").alias("suffix"))


@register("n16_typed_number_key", cte("statutes") + """SELECT id, CAST(CASE article_type WHEN 'madde' THEN 0 WHEN 'ek' THEN 1 WHEN 'gecici' THEN 2 ELSE 99 END AS INTEGER) AS type_rank,
  n AS base, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END AS suffix FROM statutes""")
def _(spark, sf):
    no = F.when(F.col("p_size") % 2 == 0, F.concat("article_no", F.lit("/A"))).otherwise(F.col("article_no"))
    return derived(spark, sf, "statutes").select("id", text.typed_number_key(F.col("article_type"), no).alias("k")).select("id", "k.*")


@register("n17_decision_info", """SELECT o_orderkey, concat(CAST(o_custkey AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)) AS application_no, o_orderstatus AS kind,
  o_orderpriority AS section, CAST(o_orderdate AS DATE) AS application_date, CAST(o_orderdate AS DATE) + 30 AS decision_date FROM orders""")
def _(spark, sf):
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    info = F.concat_ws(" | ", F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")), "o_orderstatus", "o_orderpriority",
                       F.concat(F.lit("Başvuru Tarihi : "), day("o_orderdate")), F.concat(F.lit("Karar Tarihi : "), day(F.date_add("o_orderdate", 30))))
    return table(spark, sf, "orders").select("o_orderkey", text.decision_info(info).alias("i")).select("o_orderkey", "i.*")


@register("n18_titles", cte("typed") + "SELECT p_partkey, concat(law_name, ' ', label, ' ', article_no) AS title, concat(law_name, ' ', label, ' ', article_no, ': ') AS prefix, concat(law_name, ' ', CASE article_type WHEN 'madde' THEN 'Madde' ELSE article_type END, ' ', article_no) AS label FROM typed")
def _(spark, sf):
    c = [F.col(x) for x in ("law_name", "article_type", "article_no")]
    return derived(spark, sf, "typed").select("p_partkey", text.article_title(*c).alias("title"), text.article_prefix(*c).alias("prefix"), text.article_label(*c).alias("label"))


@register("n19_snippets", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE left(text, 500) END AS snippet,
  CASE WHEN doc_id % 4 = 0 THEN left(concat(lang, text), 300) ELSE left(text, 300) END AS preview, left(text, 2000) AS embedding_text FROM documents""")
def _(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.snippet(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), c).alias("snippet"),
        text.preview(F.when(F.col("doc_id") % 4 == 0, F.concat("lang", "text")), c).alias("preview"), text.embedding_text(c).alias("embedding_text"))


_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


@register("n20_history", f"""
SELECT conv_id, turn, role, text FROM (
  SELECT conv_id, turn, CASE WHEN role IN ('user','assistant','model') THEN role ELSE 'assistant' END AS role,
         left({_TRIM('text')}, 4000) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 20 AND text <> ''""")
def _(spark, sf):
    from ..operators.history import clean_history
    return clean_history(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


@register("n21_input_errors", f"""
SELECT doc_id, CASE WHEN t = '' THEN 'Soru boş olamaz.' WHEN length(t) > 5000 THEN 'Soru en fazla 5000 karakter olabilir.' END AS question_error,
  CASE WHEN length(t) > 1000 THEN 'Not en fazla 1000 karakter olabilir.' END AS note_error
FROM (SELECT doc_id, {_TRIM("CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END")} AS t FROM documents)""")
def _(spark, sf):
    value = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.text_error(value, V.MAX_QUESTION_LENGTH, "Soru").alias("question_error"),
                                                text.text_error(value, V.MAX_QUERY_LENGTH, "Not", False).alias("note_error"))


