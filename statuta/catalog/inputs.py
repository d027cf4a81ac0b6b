"""Inputs of the registered queries, derived from the given tables.

The tables hold no statutes, so statutes, questions and citations are derived from them by
SQL that both engines read.  ``cte(...)`` gives the same text as a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as V

LAWS = list(V.LAW_NAMES.items())
_case = lambda expr, values: "CASE " + expr + " " + " ".join(
    f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

# Statutes: 18 laws; number = partkey / 18 + 1; every 10th additional, every 10th provisional.
_NUMBERED = f"""
SELECT p_partkey, p_name, p_brand, p_type, p_size,
       {_case('p_partkey % 18', [n for n, _ in LAWS])} AS law_no,
       {_case('p_partkey % 18', [n for _, n in LAWS])} AS law_name,
       CAST(FLOOR(p_partkey / 18) AS BIGINT) + 1 AS n
FROM part"""

_TYPED = """
SELECT *, CASE n % 10 WHEN 0 THEN 'ek' WHEN 5 THEN 'gecici' ELSE 'madde' END AS article_type,
       CASE n % 10 WHEN 0 THEN 'Ek Madde' WHEN 5 THEN 'Geçici Madde' ELSE 'Madde' END AS label,
       CAST(n AS VARCHAR(20)) AS article_no
FROM numbered"""

# Four body forms: plain, numbered with items, numbered, items without numbers.
_BODY = """
SELECT p_partkey AS id, p_partkey, n, law_no, law_name, article_type, article_no, label,
       p_name, p_type, p_brand, p_size,
       CASE n % 4
         WHEN 0 THEN concat(p_name, ' hükmü ', p_type, ' hakkında uygulanır.')
         WHEN 1 THEN concat('(1) ', p_name, ' yukarıdaki maddede belirtilir. (2) ', p_type,
                            ' için: a) ', p_brand, ' uygulanır. b) ', CAST(p_size AS VARCHAR(20)), ' gün beklenir.')
         WHEN 2 THEN concat('(1) ', p_name, ' faiz işletilir. (2) 6098 sayılı Kanunun ', CAST(p_size + 1 AS VARCHAR(20)),
                            ' inci maddesi saklıdır. (3) Bu Kanunun ', CAST(n + 1 AS VARCHAR(20)), ' inci maddesi uygulanır.')
         ELSE concat(p_type, ' şunlardır: a) ', p_name, ' b) ', p_brand, ' c) TBK ', CAST(p_size AS VARCHAR(20)))
       END AS body
FROM typed"""

_STATUTES = """
SELECT id, 'mevzuat' AS source_type, law_no, law_name, CAST(NULL AS VARCHAR(9)) AS regulation_name,
       article_type, article_no, n, concat(law_name, ' ', label, ' ', article_no, ': ', body) AS text, body,
       p_partkey, p_name, p_type, p_brand, p_size
FROM bodies"""

_DOC_ARTICLES = """
SELECT doc_id AS id, 'mevzuat' AS source_type, source AS law_no, source AS law_name,
       CAST(NULL AS VARCHAR(9)) AS regulation_name, lang AS article_type, CAST(doc_id AS VARCHAR(20)) AS article_no,
       doc_id AS pos, text
FROM documents"""

# Question numbers and laws follow the order; ten forms.
_ASKED = """
SELECT o_orderkey AS q_id, o_custkey AS conv_id, o_orderkey % 10 AS form, o_custkey % 110 + 1 AS n,
       CASE o_custkey % 4 WHEN 0 THEN 'TBK' WHEN 1 THEN 'HMK' WHEN 2 THEN 'İİK' ELSE 'KVKK' END AS alias,
       CASE o_custkey % 4 WHEN 0 THEN '6098' WHEN 1 THEN '6100' WHEN 2 THEN '2004' ELSE '6698' END AS law_no
FROM orders"""

_QUESTIONS = """
SELECT q_id, conv_id, form, n, alias, law_no,
       CASE form
         WHEN 0 THEN concat(alias, ' ', CAST(n AS VARCHAR(20)))
         WHEN 1 THEN concat(alias, ' ', CAST(n AS VARCHAR(20)), ' ila ', CAST(n + 3 AS VARCHAR(20)))
         WHEN 2 THEN concat(alias, ' ', CAST(n AS VARCHAR(20)), ', ', CAST(n + 2 AS VARCHAR(20)), ' ve ', CAST(n + 5 AS VARCHAR(20)))
         WHEN 3 THEN concat(law_no, ' sayılı Kanun madde ', CAST(n AS VARCHAR(20)))
         WHEN 4 THEN concat(alias, ' m.', CAST(n AS VARCHAR(20)), ' ve devamı')
         WHEN 5 THEN concat(alias, ' ', CAST(n AS VARCHAR(20)), '/2')
         WHEN 6 THEN concat(alias, ' Ek Madde ', CAST(n AS VARCHAR(20)))
         WHEN 7 THEN concat(alias, ' ', CAST(n AS VARCHAR(20)), ' içinde faiz geçiyor mu?')
         WHEN 8 THEN concat(alias, ' ', CAST(n AS VARCHAR(20)), ' kaç fıkra?')
         ELSE concat(alias, ' ', CAST(n AS VARCHAR(20)), ' hakkında Yargıtay kararı var mı?')
       END AS question
FROM asked"""

VIEWS = {
    "numbered": (_NUMBERED, []),
    "typed": (_TYPED, ["numbered"]),
    "bodies": (_BODY, ["numbered", "typed"]),
    "statutes": (_STATUTES, ["numbered", "typed", "bodies"]),
    "doc_articles": (_DOC_ARTICLES, []),
    "asked": (_ASKED, []),
    "questions": (_QUESTIONS, ["asked"]),
}
# References each question form stands for, in order.
VIEWS["asked_refs"] = ("""
SELECT q_id, law_no, CAST(n + d AS VARCHAR(20)) AS article_no, CASE WHEN form = 6 THEN 'ek' ELSE 'madde' END AS article_type,
       ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY d) AS ord
FROM asked CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS s(d)
WHERE d = 0 OR (form = 1 AND d <= 3) OR (form = 2 AND d IN (2, 5)) OR (form = 4 AND d <= 4)""", ["asked"])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table dealt out to the tasks where they come in fewer files than there are cores.

    The given tables are single files of one row group, which one task would read and work on alone.  There are as
    many parts as a shuffle has, so that parts do not grow with the table alone.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts) if len(rows.inputFiles()) < cores else rows


def _spark_form(sql: str) -> str:
    """A fixed list of values per row is a generator in Spark, not a join."""
    return re.sub(r"CROSS JOIN \(VALUES ([^A]*)\) AS (\w+)\((\w+)\)", lambda m: (
        f"LATERAL VIEW explode(array({m[1].replace('(', '').replace(')', '')})) {m[2]} AS {m[3]}"), sql)


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; the tables are dealt out, what is joined or grouped from them stays as it is."""
    sql, needs = VIEWS[name]
    ctes = _spark_form(", ".join(f"{n} AS ({VIEWS[n][0]})" for n in needs))
    sql = _spark_form(sql)
    for base in ("part", "orders", "documents"):
        sql_all = ctes + sql
        if f"FROM {base}" in sql_all:
            spread(table(spark, sf, base)).createOrReplaceTempView(base)
    return spark.sql((f"WITH {ctes} " if ctes else "") + sql)


def cte(*names: str) -> str:
    """WITH clause holding the derived inputs and what they need."""
    order: list[str] = []
    for name in names:
        for n in [*VIEWS[name][1], name]:
            if n not in order:
                order.append(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in order)


# DuckDB forms of the canonical text and of the collapsed text.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}]"


def canon_sql(c: str) -> str:
    return f"replace(strip_accents(replace(lower(trim({c})), 'ı', 'i')), 'ß', 'ss')"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
