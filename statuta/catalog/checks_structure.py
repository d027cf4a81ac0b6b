"""Segmentation, structure and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import structure
from ..operators import corpus, segment
from .inputs import VIEWS, WS, collapse_sql, cte, derived, table

Q: dict = {}


def register(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


# Raw lines of a statute file per law: header, body line, blank line, second body line;
# a preamble in front and spellings that vary.
_NUMBERED = """
SELECT *, CASE n % 10 WHEN 0 THEN 'ek' WHEN 5 THEN 'gecici' WHEN 7 THEN 'mukerrer_madde' ELSE 'madde' END AS kind,
  CASE n % 10 WHEN 0 THEN 'Ek Madde' WHEN 5 THEN 'GEÇİCİ MADDE' WHEN 7 THEN 'Mükerrer Madde' WHEN 3 THEN 'MADDE' ELSE 'Madde' END AS head,
  CASE n % 10 WHEN 0 THEN 'Ek Madde' WHEN 5 THEN 'Geçici Madde' WHEN 7 THEN 'Mükerrer Madde' ELSE 'Madde' END AS label,
  CASE n % 3 WHEN 0 THEN '- ' WHEN 1 THEN ' – ' ELSE ' ' END AS dash
FROM numbered"""
_LINES = """
SELECT law_no AS file, law_name, n * 4 + d AS line_no,
  CASE d WHEN 0 THEN concat('   ', head, '  ', CAST(n AS VARCHAR(20)), dash, CASE WHEN n % 6 = 0 THEN '' ELSE concat('(1) ', p_name) END)
         WHEN 1 THEN concat('  ', p_type, '   hükmü  ') WHEN 2 THEN '  ' ELSE concat('(2) ', p_brand) END AS line
FROM headed CROSS JOIN (VALUES (0),(1),(2),(3)) AS s(d)
WHERE d = 0 OR n % 12 <> 0
UNION ALL SELECT law_no, law_name, 0, concat('Kanun No: ', law_no) FROM headed WHERE n = 1"""
VIEWS["headed"] = (_NUMBERED, ["numbered"])
VIEWS["lines"] = (_LINES, ["numbered", "headed"])


def _lines(spark, sf):
    return derived(spark, sf, "lines")


@register("g01_segment_articles", cte("headed") + """
SELECT law_no, kind AS article_type, CAST(n AS VARCHAR) AS article_no,
  concat(law_name, ' ', label, ' ', CAST(n AS VARCHAR), ': ', CASE WHEN n % 6 = 0 THEN '' ELSE concat('(1) ', p_name, ' ') END,
         p_type, ' hükmü (2) ', p_brand) AS text FROM headed WHERE n % 12 <> 0""")
def _(spark, sf):
    lines = _lines(spark, sf)
    names = lines.select("file", F.col("file").alias("law_no"), "law_name").distinct()
    return segment.segment_articles(lines, names).select("law_no", "article_type", "article_no", "text")


@register("g01_segment_regulations", cte("headed") + """
SELECT law_no, kind AS article_type, CAST(n AS VARCHAR) AS article_no,
  concat('Yönetmelik ', label, ' ', CAST(n AS VARCHAR), ': ', CASE WHEN n % 6 = 0 THEN '' ELSE concat('(1) ', p_name, ' ') END,
         p_type, ' hükmü (2) ', p_brand) AS text FROM headed WHERE n % 12 <> 0""")
def _(spark, sf):
    lines = _lines(spark, sf)
    names = lines.select("file", F.col("file").alias("law_no"), F.lit("Yönetmelik").alias("law_name")).distinct()
    return segment.segment_articles(lines, names, regulation=True).select("law_no", "article_type", "article_no", "text")


_NOISE = """
SELECT p_partkey AS line_no, law_no AS file, kind, line FROM (
  SELECT p_partkey, law_no, p_partkey % 12 AS kind, CASE p_partkey % 12
    WHEN 0 THEN concat('Bu maddede geçen “', p_name, '” ibaresi “', p_type, '” şeklinde değiştirilmiştir.')
    WHEN 1 THEN concat(CAST(p_size AS VARCHAR(20)), ' sayılı dipnot ', p_name)
    WHEN 2 THEN 'BİRİNCİ BÖLÜM'
    WHEN 3 THEN 'A'
    WHEN 4 THEN concat('GENEL ', p_type)
    WHEN 5 THEN concat('Mülga ', p_name)
    WHEN 6 THEN concat('Madde ', CAST(p_size AS VARCHAR(20)), ' - ', p_name)
    WHEN 7 THEN concat(p_name, ' hakkında karar verilir.')
    WHEN 8 THEN concat('Anayasa Mahkemesinin ', p_name, ' Kararı ile sınırlıdır')
    WHEN 9 THEN concat('İkinci Kısım ', p_name)
    WHEN 10 THEN 'Üçüncü Kısım'
    ELSE concat('(', CAST(p_size AS VARCHAR(20)), ') ', p_name, ' uygulanır.') END AS line FROM numbered) AS x"""
VIEWS["noise"] = (_NOISE, ["numbered"])


@register("g02_noise_lines", cte("noise") + "SELECT line_no, line FROM noise WHERE kind IN (6, 7, 9, 11)")
def _(spark, sf):
    return segment.drop_noise_lines(derived(spark, sf, "noise")).select("line_no", "line")


@register("g03_title_lines", cte("noise") + """
SELECT line_no, line FROM (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY line_no) AS nxt FROM noise)
WHERE NOT (coalesce(regexp_matches(nxt, '(?i)^((ek|geçici)\\s+)?madde\\s+\\d+\\s*[-–—]'), false) AND NOT regexp_matches(line, '(?i)^((ek|geçici)\\s+)?madde\\s+\\d+\\s*[-–—]'))""".replace("\\\\", "\\"))
def _(spark, sf):
    return segment.drop_title_lines(derived(spark, sf, "noise")).select("line_no", "line")


_APPENDIX = f"""
SELECT file, line_no, CASE WHEN line_no >= 1200 AND line_no < 1230 THEN concat(file, ' SAYILI {V.APPENDIX_MARKER} LİSTESİ') ELSE line END AS line FROM noise"""
VIEWS["appendix"] = (_APPENDIX, ["numbered", "noise"])


@register("g04_stop_at_appendix", cte("appendix") + """
SELECT file, line_no, line FROM (SELECT *, count(CASE WHEN contains(line, 'MEVZUATIN') THEN 1 END) OVER (PARTITION BY file ORDER BY line_no) AS seen FROM appendix) WHERE seen = 0""")
def _(spark, sf):
    return segment.stop_at_appendix(derived(spark, sf, "appendix")).select("file", "line_no", "line")


@register("g05_inline_headers", """
SELECT p_partkey, concat('Madde ', n, ' - (1) ', p_name, ' uygulanır.', chr(10), 'Madde ', n1, ' - ', p_type, ' saklıdır.', chr(10), 'Ek Madde 1 - ', p_brand) AS t
FROM (SELECT *, CAST(p_size AS VARCHAR) AS n, CAST(p_size + 1 AS VARCHAR) AS n1 FROM part)""")
def _(spark, sf):
    n, n1 = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    raw = F.concat(F.lit("Kanun başlığı\nAmaç Madde "), n, F.lit(" - (1) "), "p_name", F.lit(" uygulanır. Kapsam Madde "), n1, F.lit(" - "),
                   "p_type", F.lit(" saklıdır. Ek Madde 1 - "), "p_brand")
    lines = segment.reline_inline_headers(table(spark, sf, "part").select("p_partkey", raw.alias("t")), "p_partkey", "t")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(F.col("file").alias("p_partkey")).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("t"))


@register("g06_longest_article", """
SELECT lang AS law_no, source AS article_no, doc_id AS pos, text FROM documents
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) = 1""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("law_no"), F.lit("madde").alias("article_type"),
                                                F.col("source").alias("article_no"), F.col("doc_id").alias("pos"), "text")
    return segment.longest_per_article(rows).select("law_no", "article_no", "pos", "text")


@register("g07_cut_glued_article", f"""
SELECT doc_id, sha256({collapse_sql("CASE WHEN length(text) > 30 THEN text ELSE concat(text, ' Madde 5 - sonraki ', text) END")}) AS t FROM documents""")
def _(spark, sf):
    raw = F.concat("text", F.lit(" Madde 5 - sonraki "), "text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(segment.cut_glued_article(raw), 256).alias("t"))




@register("g08_layout_blocks", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax * 10000 >= 40 AND l_tax * 10000 + l_quantity <= 760
  AND (l_discount * 1000 + l_quantity * 10) - l_discount * 1000 >= 600.0 * 0.28""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    x0, y0 = F.col("l_discount") * 1000, F.col("l_tax") * 10000
    blocks = li.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("page"), x0.alias("x0"), y0.alias("y0"),
                       (x0 + F.col("l_quantity") * 10).alias("x1"), (y0 + F.col("l_quantity")).alias("y1"),
                       F.concat("l_returnflag", F.lit(" metin")).alias("text"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return segment.keep_layout_blocks(blocks).select("l_orderkey", "l_linenumber")


def _paragraph_rows(df, paragraphs):
    return df.select("id", F.posexplode(paragraphs).alias("pos", "p")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.col("p.no").alias("no"), F.col("p.text").alias("text"),
        F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("p.items")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"), F.lit("")).alias("items"))


@register("g09_numbered_paragraphs", r"""
WITH s AS (SELECT doc_id AS id, trim(text) AS t FROM documents),
m AS (SELECT doc_id AS id, concat('giriş (1) ', source, ' (2) ', lang, ' (3) son (2) tekrar ', source) AS t FROM documents)
SELECT id, CAST(i - 1 AS BIGINT) AS pos, CAST(i AS VARCHAR) AS no, CASE i WHEN 1 THEN concat('(1) ', a) WHEN 2 THEN concat('(2) tekrar ', a) ELSE '(3) son' END AS text, '' AS items
FROM (SELECT doc_id AS id, source AS a FROM documents), (VALUES (1),(2),(3)) v(i)""")
def _(spark, sf):
    raw = F.concat(F.lit("giriş (1) "), "source", F.lit(" (2) "), "lang", F.lit(" (3) son (2) tekrar "), "source")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), raw.alias("t"))
    return _paragraph_rows(rows, structure.numbered_paragraphs(F.col("t")))


@register("g10_blank_line_paragraphs", r"""
SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS VARCHAR) AS no, t AS text
FROM (SELECT doc_id, i, regexp_replace(regexp_replace(l[i], '^\s+', ''), '\s+$', '') AS t FROM (
  SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10)||chr(10)), '\n{2,}') AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))
WHERE t <> ''""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return _paragraph_rows(rows, structure.blank_line_paragraphs(F.col("t"))).drop("items")


@register("g11_intro_and_items", """
SELECT p_partkey AS id, CAST(i - 1 AS BIGINT) AS pos, CAST(i AS VARCHAR) AS no,
  CASE i WHEN 1 THEN concat(p_type, ' şunlardır:') ELSE concat('a) ', p_name, ' b) ', p_brand) END AS text,
  CASE i WHEN 1 THEN '' ELSE concat('a=a) ', p_name, '|b=b) ', p_brand) END AS items FROM part, (VALUES (1),(2)) v(i)""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(
        "p_type", F.lit(" şunlardır: a) "), "p_name", F.lit(" b) "), "p_brand").alias("t"))
    return _paragraph_rows(rows, structure.intro_and_items(F.col("t")))


_STRUCTURE = cte("statutes") + """, head AS (SELECT *, concat(law_name, ' ', CASE article_type WHEN 'ek' THEN 'Ek Madde' WHEN 'gecici' THEN 'Geçici Madde' ELSE 'Madde' END, ' ', article_no, ': ') AS h FROM statutes),
par AS (
 SELECT id, law_no, n, 1 AS no, text, '' AS items FROM head WHERE n % 4 = 0
 UNION ALL SELECT id, law_no, n, 1, concat('(1) ', p_name, ' yukarıdaki maddede belirtilir.'), '' FROM head WHERE n % 4 = 1
 UNION ALL SELECT id, law_no, n, 2, concat('(2) ', p_type, ' için: a) ', p_brand, ' uygulanır. b) ', CAST(p_size AS VARCHAR), ' gün beklenir.'),
   concat('a=a) ', p_brand, ' uygulanır.|b=b) ', CAST(p_size AS VARCHAR), ' gün beklenir.') FROM head WHERE n % 4 = 1
 UNION ALL SELECT id, law_no, n, 1, concat('(1) ', p_name, ' faiz işletilir.'), '' FROM head WHERE n % 4 = 2
 UNION ALL SELECT id, law_no, n, 2, concat('(2) 6098 sayılı Kanunun ', CAST(p_size + 1 AS VARCHAR), ' inci maddesi saklıdır.'), '' FROM head WHERE n % 4 = 2
 UNION ALL SELECT id, law_no, n, 3, concat('(3) Bu Kanunun ', CAST(n + 1 AS VARCHAR), ' inci maddesi uygulanır.'), '' FROM head WHERE n % 4 = 2
 UNION ALL SELECT id, law_no, n, 1, concat(h, p_type, ' şunlardır:'), '' FROM head WHERE n % 4 = 3
 UNION ALL SELECT id, law_no, n, 2, concat('a) ', p_name, ' b) ', p_brand, ' c) TBK ', CAST(p_size AS VARCHAR)),
   concat('a=a) ', p_name, '|b=b) ', p_brand, '|c=c) TBK ', CAST(p_size AS VARCHAR)) FROM head WHERE n % 4 = 3) """


@register("g12_structure", _STRUCTURE + "SELECT id, CAST(no - 1 AS BIGINT) AS pos, CAST(no AS VARCHAR) AS no, text, items FROM par")
def _(spark, sf):
    return _paragraph_rows(derived(spark, sf, "statutes"), structure.build_structure(F.col("text")))


@register("g13_lettered_items", """
SELECT p_partkey, key, CASE key WHEN 'a' THEN concat('A) ', p_type) WHEN 'ç' THEN concat('ç) ', p_brand) ELSE concat('b) ', p_name, ' (x) y') END AS value
FROM part, (VALUES ('a'),('b'),('ç')) v(key)""")
def _(spark, sf):
    raw = F.concat(F.lit("giriş a) ilk b) "), "p_name", F.lit(" (x) y ç) "), "p_brand", F.lit(" A) "), "p_type")
    return table(spark, sf, "part").select("p_partkey", F.explode(structure.split_items(raw)).alias("key", "value"))


@register("g14_structure_backfill", _STRUCTURE + """
SELECT law_no, count(*) AS paragraphs, CAST(sum(CASE WHEN items = '' THEN 0 ELSE length(items) - length(replace(items, '|', '')) + 1 END) AS BIGINT) AS items FROM par GROUP BY law_no""")
def _(spark, sf):
    filled = corpus.with_structure(derived(spark, sf, "statutes"))
    items = F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.size(p["items"]))
    return filled.groupBy("law_no").agg(F.sum(F.size("paragraphs")).alias("paragraphs"), F.sum(items).alias("items"))


_TRIMMED = f"regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')"
_CHUNKS = f"""
WITH d AS (SELECT doc_id, source, lang, {_TRIMMED} AS t FROM documents),
c AS (SELECT doc_id, source, lang, i, regexp_replace(regexp_replace(substring(t, i * 800 + 1, 1000), '^{WS}+', ''), '{WS}+$', '') AS chunk
      FROM d, LATERAL (SELECT unnest(range(0, CASE WHEN length(t) <= 1000 THEN 1 ELSE CAST(ceil((length(t) - 200) / 800.0) AS BIGINT) END)) AS i) WHERE t <> '')
"""


@register("g15_overlapping_chunks", _CHUNKS + "SELECT doc_id, chunk FROM c WHERE chunk <> ''")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(structure.chunks(F.col("text"))).alias("chunk"))


@register("g16_chunk_rows", _CHUNKS + f"""
SELECT doc_id AS article_id, source AS law_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index,
  sha256({collapse_sql('chunk')}) AS chunk_hash, 'external' AS embedding_model, CAST(64 AS INTEGER) AS embedding_dim FROM c WHERE chunk <> ''""")
def _(spark, sf):
    return corpus.chunk_rows(derived(spark, sf, "doc_articles")).select(
        "article_id", "law_no", "chunk_index", "chunk_hash", "embedding_model", "embedding_dim")


@register("g17_structure_class", cte("statutes") + """
SELECT id, CASE WHEN id % 11 = 0 THEN 'missing' ELSE (['single_fikra_only','multi_fikra_with_bents','multi_fikra','multi_fikra_with_bents'])[n % 4 + 1] END AS class FROM statutes""")
def _(spark, sf):
    rows = corpus.with_structure(derived(spark, sf, "statutes")).withColumn(
        "paragraphs", F.when(F.col("id") % 11 != 0, F.col("paragraphs")))
    return rows.select("id", structure.classify_structure(F.col("paragraphs")).alias("class"))


@register("g12_stored_structure", """
SELECT p_partkey AS id, CAST(i - 1 AS BIGINT) AS pos, CAST(i AS VARCHAR) AS no, CASE i WHEN 1 THEN p_name ELSE p_type END AS text,
  CASE i WHEN 1 THEN '' ELSE concat('a=', p_brand) END AS items FROM part, (VALUES (1),(2)) v(i)""")
def _(spark, sf):
    stored = F.concat(F.lit('{"fikralar":{"1":"'), "p_name", F.lit('","2":{"text":"'), "p_type", F.lit('","bentler":{"a":"'), "p_brand", F.lit('"}}}}'))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), stored.alias("s"))
    return _paragraph_rows(rows, structure.read_stored_structure(F.col("s")))
