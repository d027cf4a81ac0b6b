"""Completeness and quality checks over articles, and the reports built from them.

Article frames have ``law_no, law_name, article_type, article_no, text`` and, where
file order matters, ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.structure import STRUCTURE_CLASSES, classify_structure
from ..functions.text import article_number_key, article_prefix, collapse, let, strip, typed_number_key
from .ordered import neighbour, top_per_key


# --- expected numbers ----------------------------------------------------------

def expected_numbers(spark: SparkSession, spec: list[tuple] = V.EXPECTED_NUMBERS) -> DataFrame:
    """Expected article numbers, from rows of law, type, first and last number and lettered numbers."""
    rows = []
    for law, kind, first, last, extras in spec:
        rows.append((law, kind, None, first, last))
        rows += [(law, kind, extra, None, None) for extra in extras]
    raw = spark.createDataFrame(rows, "law_no string, article_type string, single string, lo int, hi int")
    return expand_numbers(raw)


def expand_numbers(raw: DataFrame) -> DataFrame:
    """``single`` numbers and ``lo``..``hi`` ranges to one row per number."""
    numbers = F.when(F.col("single").isNotNull(), F.array("single")).otherwise(
        F.transform(F.sequence("lo", "hi"), lambda n: n.cast("string")))
    return raw.select("law_no", "article_type", F.explode(numbers).alias("article_no")).distinct()


_KEY = ["law_no", "article_type", "article_no"]


def missing_numbers(expected: DataFrame, articles: DataFrame) -> DataFrame:
    """Expected but absent; only laws that occur in the articles are checked."""
    laws = articles.select("law_no").distinct()
    return expected.join(laws, "law_no", "left_semi").join(
        articles.select(*_KEY), _KEY, "left_anti").select(*_KEY).distinct()


def unexpected_numbers(expected: DataFrame, articles: DataFrame) -> DataFrame:
    """Present but not expected; a type without any expectation lists all its numbers."""
    return articles.select(*_KEY).distinct().join(expected, _KEY, "left_anti")


def number_gaps(articles: DataFrame, article_type: str = "madde") -> DataFrame:
    """Integers absent between the smallest and the largest number of each law.

    Each number makes the gap up to the next one of its law, so that only numbers that are there are shuffled, never
    absent ones.  Without a law nothing counts as there, and all numbers of the span are listed.
    """
    numbers = (articles.where(F.col("article_type") == article_type)
               .select("law_no", F.col("article_no").try_cast("bigint").alias("n"))
               .where(F.col("n").isNotNull()).distinct())
    ahead = neighbour(numbers, ["law_no"], "n", F.col("n"), "_next", 1)
    own = F.col("law_no").isNull()
    gaps = ahead.select("law_no", F.when(own, F.col("n")).otherwise(F.col("n") + 1).alias("lo"),
                        F.coalesce(F.col("_next") - 1, F.when(own, F.col("n"))).alias("hi")).where(F.col("hi") >= F.col("lo"))
    # Two levels, so that a wide gap never becomes one long array.
    starts = gaps.select("law_no", "hi", F.explode(F.sequence("lo", "hi", F.lit(10_000))).alias("start"))
    return starts.select("law_no", F.explode(F.sequence("start", F.least("hi", F.col("start") + 9_999))).alias("n"))


# --- checks of one article -------------------------------------------------------

def with_body(articles: DataFrame) -> DataFrame:
    """Text collapsed, expected prefix and the body behind it."""
    prefix = article_prefix(F.col("law_name"), F.col("article_type"), F.col("article_no"))
    clean = articles.withColumn("text", collapse(F.col("text"))).withColumn("prefix", prefix)
    starts = F.coalesce(F.startswith("text", "prefix"), F.lit(False))
    return clean.withColumn("prefix_ok", F.when(F.col("prefix").isNull(), True).otherwise(starts)).withColumn(
        "body", F.when(starts, strip(F.substr("text", F.length("prefix") + 1))).otherwise(F.col("text")))


def has_embedded_header(body: Column) -> Column:
    """An article header with a dash inside a body, a word directly behind the dash."""
    return body.rlike(r"(?iU)\bMadde\s+\d+\s*-\b")


def heading_leaks(text: Column) -> Column:
    """Headings that leaked into a body: phrases anywhere, one-word headings on own lines."""
    phrases = [F.when(text.rlike(rf"(?iU)\b{p}\b"), F.lit(p)) for p in V.HEADING_PHRASES]
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda t: F.lower(collapse(t)))
    words = F.transform(F.filter(lines, lambda t: t.isin(V.HEADING_LINES)),
                        lambda t: F.concat(F.lit("LINE_HEADING::"), t))
    return F.array_distinct(F.concat(F.filter(F.array(*phrases), lambda p: p.isNotNull()), words))


def suspicion_reasons(text: Column, article_type: Column) -> Column:
    """Why an article text looks wrong."""
    plain_only = {"ek madde sızıntısı", "geçici madde sızıntısı"}
    name, size = V.TOO_SHORT_REASON
    reasons = [F.when(F.length(text) < size, F.lit(name))]
    for reason, pattern in V.SUSPICION_RULES:
        hit = text.rlike("(?iU)" + pattern)
        reasons.append(F.when(hit & (article_type == "madde") if reason in plain_only else hit, F.lit(reason)))
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


REGULATION_FIELDS = ["law_no", "regulation_name", "article_no", "article_type", "text", "source_type"]


def regulation_errors(df: DataFrame) -> DataFrame:
    """Failed field checks per regulation row."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c))
                                 for c in REGULATION_FIELDS]), lambda x: x.isNotNull())
    checks = F.array(
        F.when(F.size("missing_fields") > 0, F.lit("missing_field")),
        F.when(~F.coalesce("article_type", F.lit("")).isin(V.ARTICLE_TYPES), F.lit("invalid_type")),
        F.when(F.coalesce("source_type", F.lit("")) != "yonetmelik", F.lit("invalid_source_type")),
        F.when(strip(F.coalesce("text", F.lit(""))) == "", F.lit("empty_content")))
    return df.withColumn("missing_fields", missing).withColumn(
        "errors", F.filter(checks, lambda c: c.isNotNull()))


def decision_text_class(text: Column, short: int = V.DECISION_SHORT_TEXT) -> Column:
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, "missing").when(size < short, "short").otherwise("ok")


# --- checks across rows ------------------------------------------------------------

def duplicate_keys(articles: DataFrame, keys: list[str] = _KEY) -> DataFrame:
    return articles.groupBy(*keys).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") > 1)


def later_duplicates(articles: DataFrame, keys: list[str] = _KEY) -> DataFrame:
    """Every occurrence behind the first in file order."""
    first = articles.groupBy(*keys).agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    repeated = first.where(F.col("_n") > 1).drop("_n")
    return articles.join(repeated, keys).where(F.col("pos") > F.col("_first")).drop("_first")


def mixed_values(articles: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows whose value differs from that of the group's first row."""
    first = articles.groupBy(group).agg(*[F.min_by(F.coalesce(F.col(c), F.lit("")), "pos").alias(f"first_{c}")
                                          for c in columns])
    differs = [F.when(F.coalesce(F.col(c), F.lit("")) != F.col(f"first_{c}"), F.lit(c)) for c in columns]
    return articles.join(first, group).withColumn(
        "mixed", F.filter(F.array(*differs), lambda c: c.isNotNull())).where(F.size("mixed") > 0)


def order_errors(articles: DataFrame, keys: list[str] = ["law_no", "article_type"]) -> DataFrame:
    """Rows whose number sorts before the one in front of it; none means sorted."""
    key = article_number_key(F.col("article_no"))
    seen = neighbour(articles.withColumn("_key", key), keys, "pos", F.col("_key"), "_before", -1)
    return seen.where(F.col("_before") > F.col("_key")).withColumn(
        "previous_base", F.col("_before.base")).drop("_before", "_key")


# --- reports ---------------------------------------------------------------------------

def loaded_laws(articles: DataFrame) -> DataFrame:
    """Rows per law with the first name given; the row without a law is the grand total."""
    law = strip(F.coalesce("law_no", F.lit("")))
    name = F.nullif(strip(F.coalesce("law_name", F.lit(""))), F.lit(""))
    rows = articles.withColumn("law_no", law).where(F.col("law_no") != "")
    return rows.rollup("law_no").agg(
        F.count("*").alias("articles"), F.countDistinct(F.col("law_no")).alias("laws"),
        F.min_by(name, F.when(name.isNotNull(), F.col("pos"))).alias("law_name"))


def type_distribution(articles: DataFrame, keys: list[str] = ["law_no"]) -> DataFrame:
    return articles.groupBy(*keys, "article_type").agg(F.count("*").alias("articles"))


def structure_quality(articles: DataFrame) -> DataFrame:
    """Per law: total and one column per structure class."""
    classed = articles.select("law_no", classify_structure(F.col("paragraphs")).alias("class"))
    return classed.groupBy("law_no").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("class") == c).alias(c) for c in STRUCTURE_CLASSES])


def structure_samples(articles: DataFrame, limit: int = 3) -> DataFrame:
    classed = articles.withColumn("class", classify_structure(F.col("paragraphs")))
    return top_per_key(classed, ["law_no", "class"], [F.col("pos")], limit, "sample")


def number_preview(articles: DataFrame, limit: int = 20) -> DataFrame:
    key = typed_number_key(F.col("article_type"), F.col("article_no"))
    return articles.orderBy(key, *[F.col(c) for c in ("law_no", "pos") if c in articles.columns]).limit(limit)


def special_articles(articles: DataFrame, limit: int = 50) -> DataFrame:
    """Additional and provisional articles per type, and repeated ones by suffix."""
    order = [F.col("law_no"), F.col("article_no"), F.col("article_type")]
    typed = articles.where(F.col("article_type").isin("ek", "gecici", "ek_gecici")).withColumn(
        "listing", F.col("article_type"))
    repeated = articles.where(F.col("article_no").endswith("/A")).withColumn("listing", F.lit("repeated"))
    return top_per_key(typed.unionByName(repeated), ["listing"], order, limit)


def parser_assertions(articles: DataFrame, opening: str = "Bu Kanunun amacı", min_rows: int = 100,
                      min_last: int = 110) -> DataFrame:
    """Range assertions of a parsed law: first number, row count, opening phrase, last number."""
    number = F.col("article_no").try_cast("bigint")
    per_law = articles.groupBy("law_no").agg(
        F.min(number).alias("first_no"), F.max(number).alias("last_no"), F.count("*").alias("articles"),
        F.min_by("text", number).alias("_text"))
    failed = F.array(
        F.when(F.col("first_no") != 1, F.lit("first_number")),
        F.when(F.col("articles") < min_rows, F.lit("too_few")),
        F.when(~F.contains("_text", F.lit(opening)), F.lit("opening_phrase")),
        F.when(F.col("last_no") < min_last, F.lit("last_number")))
    return per_law.withColumn("failed", F.filter(failed, lambda x: x.isNotNull())).drop("_text")


ERROR_CHECKS = ["duplicate", "prefix", "missing", "ordering", "embedded_header"]
WARNING_CHECKS = ["short", "heading_leak"]


def quality_report(articles: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per finding: law, check, article and detail.

    Empty bodies are listed but do not count in the status.
    """
    rows = with_body(articles)
    leaks = heading_leaks(F.col("body"))
    checks = F.array(
        F.when(~F.col("prefix_ok"), F.struct(F.lit("prefix").alias("check"), F.substring("text", 1, 180).alias("detail"))),
        F.when(F.col("body") == "", F.struct(F.lit("empty").alias("check"), F.lit("").alias("detail"))),
        F.when(F.length("body") < V.SHORT_BODY, F.struct(F.lit("short").alias("check"), F.substring("body", 1, 180).alias("detail"))),
        let(leaks, lambda x: F.when(F.size(x) > 0, F.struct(
            F.lit("heading_leak").alias("check"), F.array_join(x, "; ").alias("detail")))),
        F.when(has_embedded_header(F.col("body")), F.struct(
            F.lit("embedded_header").alias("check"), F.substring("body", 1, 220).alias("detail"))))
    per_row = rows.select(*_KEY, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select(
        *_KEY, "c.check", "c.detail")
    plain = lambda df, name: df.select(*_KEY, F.lit(name).alias("check"), F.lit("").alias("detail"))
    # A type counts once in ordering, however many rows are out of place.
    ordering = order_errors(articles).groupBy("law_no", "article_type").agg(
        F.min("article_no").alias("article_no")).select(*_KEY)
    return (per_row.unionByName(plain(later_duplicates(articles), "duplicate"))
            .unionByName(plain(missing_numbers(expected, articles), "missing"))
            .unionByName(plain(ordering, "ordering")))


def quality_status(report: DataFrame, laws: DataFrame) -> DataFrame:
    """PASS, PASS_WITH_WARNINGS or FAIL per law; laws without findings pass."""
    counts = report.groupBy("law_no").agg(
        F.count_if(F.col("check").isin(ERROR_CHECKS)).alias("errors"),
        F.count_if(F.col("check").isin(WARNING_CHECKS)).alias("warnings"))
    filled = laws.select("law_no").distinct().join(counts, "law_no", "left").na.fill(0)
    return filled.withColumn("status", F.when(F.col("errors") > 0, "FAIL")
                             .when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def decision_statistics(decisions: DataFrame, required: list[str]) -> DataFrame:
    """Corpus counts in one pass: texts, short texts, repeated links, missing fields."""
    size = F.length(F.coalesce("text", F.lit("")))
    return decisions.agg(
        F.count("*").alias("total"), F.count_if(size > 0).alias("with_text"),
        F.count_if(size == 0).alias("without_text"),
        F.count_if((size > 0) & (size < V.DECISION_SHORT_TEXT)).alias("short_text"),
        (F.count("*") - F.countDistinct("url")).alias("duplicate_urls"),
        *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}") for c in required])


def random_sample(df: DataFrame, n: int = 5, seed: int = 7, key: str = "id") -> DataFrame:
    """n rows in the order of a hash of seed and key: the same ones in every run and on every layout."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(n)


