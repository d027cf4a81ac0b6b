"""Readers: statute text, article JSON, regulation folders, stored tables, web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed_values as V
from ..functions import listing, markup
from ..functions.text import decision_info, let, literal_map
from ..operators.ordered import explode_rows

_META = ["law_no", "regulation_name", "source_type"]


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def cut_lines(raw: DataFrame) -> DataFrame:
    """Whole texts (``file, value``) to ``file, line_no, line``; the byte-order mark is dropped."""
    text = F.regexp_replace("value", "^\ufeff", "")
    return raw.select("file", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))


def with_folder(lines: DataFrame) -> DataFrame:
    """Folder of the file and the law number it starts with."""
    folder = _folder(F.col("file"))
    return lines.select("file", folder.alias("folder"), F.split_part(folder, F.lit("_"), F.lit(1)).alias("law_no"),
                        "line_no", "line")


def read_statute_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, folder, law_no, line_no, line`` of raw statute files.

    A file is read split by split, each by a task of its own.  Rows of a split follow each other, so their place in
    it is the distance of their running numbers from the first one; the lines of the splits before, one row per
    split, make it the place in the file.  A line end closes a line: behind the last one there is no empty line.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    ahead = splits.select("file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id") - F.col("_first")
    placed = rows.join(ahead, ["file", "_start"]).withColumn("line_no", place.cast("int"))
    mark = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return with_folder(placed.withColumn("line", mark))


def law_names(lines: DataFrame) -> DataFrame:
    """``file, law_no, law_name``; an unknown law takes its name from the folder."""
    known = literal_map(V.LAW_NAMES)
    rest = F.array_join(F.slice(F.split("folder", "_"), F.lit(2), F.size(F.split("folder", "_"))), " ")
    return lines.select("file", "folder", "law_no").distinct().select(
        "file", "law_no", F.coalesce(known[F.col("law_no")], rest).alias("law_name"))


def read_article_json(spark: SparkSession, path: str) -> DataFrame:
    """Article files holding one JSON array each, with the file name as source."""
    return (spark.read.schema(schemas.ARTICLE_JSON).option("multiLine", True).json(path)
            .withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def read_regulation_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sidecar rows that hold all required keys, and the rejected ones."""
    rows = (spark.read.schema("bagli_kanun_no string, yonetmelik_adi string, source_type string")
            .option("multiLine", True).json(path)
            .select(_folder(F.col("_metadata.file_path")).alias("folder"), F.col("bagli_kanun_no").alias("law_no"),
                    F.col("yonetmelik_adi").alias("regulation_name"), "source_type"))
    return split_meta(rows)


def split_meta(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in _META]),
                       lambda c: c.isNotNull())
    checked = rows.withColumn("missing_keys", missing)
    return (checked.where(F.size("missing_keys") == 0).drop("missing_keys"),
            checked.where(F.size("missing_keys") > 0))


def attach_meta(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata of the folder on every row; Spark broadcasts it while it is small."""
    return rows.join(meta, "folder")


def read_by_law(spark: SparkSession, path: str, law: str = "law_no") -> DataFrame:
    """A table partitioned by law, its numbers as they were written: as numbers they would lose leading zeros."""
    found = spark.read.parquet(path).schema
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == law else f.dataType.simpleString()}" for f in found.fields)
    return spark.read.schema(kinds).parquet(path)


def read_law(spark: SparkSession, path: str, law_no: str | None = None) -> DataFrame:
    """Stored table; one law reads only its partition."""
    table = read_by_law(spark, path)
    return table if law_no is None else table.where(F.col("law_no") == law_no)


# --- web pages -------------------------------------------------------------------

def listed_decisions(pages: DataFrame, base_url: str = "", page: dict = V.DECISION_PAGE) -> DataFrame:
    """One row per listed decision: link, title, info line, clipped subject; links once.

    An item is a whole block with all blocks inside, and so are its info line and its subject.  Items are read in
    Python, page by page, as built-in functions would try each pattern on each token again.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    items = pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(listing.listed_items(page), f"page_id {kind}, {listing.ITEM}")

    def links(item: Column) -> Column:
        hrefs = F.transform(F.filter(item, lambda t: t.rlike(r"(?is)^<a(?=[\s/>])")), lambda t: markup.attribute(t, "href"))
        return F.filter(hrefs, lambda h: F.contains(h, F.lit(page["link_contains"])) & ~F.contains(h, F.lit(page["link_excludes"])))

    # as rows, so that a test of the link does not find it a second time; items without one are not read further
    linked = explode_rows(items, F.slice(links(F.col("anchors")), 1, 1), "_n", "href")
    rows = linked.select("page_id", "nth", "href", "title", decision_info(F.col("info")).alias("info"), "subject")
    full = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base_url), F.col("href")))
    return first_links(rows.where(F.col("href") != "").withColumn("url", full).drop("href"))


def first_links(rows: DataFrame) -> DataFrame:
    """Repeated links kept once, at their first place."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), F.struct("page_id", "nth"))
    return rows.groupBy("url").agg(first.alias("_r")).select("url", "_r.*")


def page_links(pages: DataFrame, contains: str, excludes: str | None = None) -> DataFrame:
    """Links of a page that hold one mark and not another; each link once."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all(
        "html", F.lit(r'<a[^>]*?href="([^"]*)"'), F.lit(1))).alias("nth", "url"))
    kept = links.where(F.contains("url", F.lit(contains)))
    if excludes:
        kept = kept.where(~F.contains("url", F.lit(excludes)))
    return first_links(kept)


def page_text(html: Column, drop_tags: list[str] = ["script", "style"], drop_classes: list[str] = [],
              start_marker: str | None = None, body_classes: list[str] = []) -> Column:
    """Text of a page: dropped tags and side blocks out, of the rest the first block of the first body class
    that there is (else all), other tags as line breaks, blank lines out, everything before the marker phrase out."""
    def body(parts: Column) -> Column:
        kept = markup.outside(parts, markup.spans(parts, "div", drop_classes)) if drop_classes else parts
        return let(kept, lambda k: markup.lines(markup.container(k, "div", body_classes)))

    out = let(markup.tokens(markup.without(html, drop_tags)), body)
    if start_marker is None:
        return out
    return let(out, lambda t: F.when(F.instr(t, start_marker) > 1, F.substr(
        t, F.instr(t, start_marker))).otherwise(t))


def decision_text(html: Column, page: dict = V.DECISION_PAGE) -> Column:
    """Text of a decision page under its settings."""
    return page_text(html, page["drop_tags"], page["side_classes"], page["start_marker"], page["body_classes"])
