"""Paragraphs, lettered items and chunks of an article text.

A structure is ``array<struct<no:string, text:string, items:map<string,string>>>``
in paragraph order.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import let, strip

STRUCTURE_TYPE = "array<struct<no:string,text:string,items:map<string,string>>>"
# A letter and a closing bracket, at the start or behind whitespace.
_ITEM = r"(?iu)(?<=\s|^)(?=[a-zçğıöşü]\))"
_ITEM_START = r"(?iu)^[a-zçğıöşü]\)"
_MARKER = r"(?=\(\d+\))"


def _empty() -> Column:
    return F.array().cast(STRUCTURE_TYPE)


def _last_per_key(entries: Column) -> Column:
    """Entries of struct(key, value): first position of a key, its last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))


def item_pieces(text: Column) -> Column:
    pieces = F.filter(F.split(text, _ITEM), lambda p: p.rlike(_ITEM_START))
    return F.transform(pieces, lambda p: F.struct(
        F.lower(F.substring(p, 1, 1)).alias("key"), strip(p).alias("value")))


def split_items(text: Column) -> Column:
    """Lettered items: letter to text, marker kept, a later repeat wins."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return let(strip(text), lambda t: F.when(t.contains(")"), let(
        item_pieces(t), lambda e: F.map_from_entries(_last_per_key(e)))).otherwise(none))


def _paragraph(no: Column, text: Column) -> Column:
    return F.struct(no.alias("no"), text.alias("text"), split_items(text).alias("items"))


def numbered_paragraphs(text: Column) -> Column:
    """Split on ``(n)`` markers; text before the first marker is dropped."""
    pieces = F.filter(F.split(text, _MARKER), lambda p: p.rlike(r"^\(\d+\)"))
    entries = F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, r"^\((\d+)\)", 1).alias("key"),
        strip(F.concat(F.regexp_extract(p, r"^\(\d+\)", 0), F.lit(" "),
                       strip(F.regexp_replace(p, r"^\(\d+\)", "")))).alias("value")))
    return let(entries, lambda e: F.transform(
        _last_per_key(e), lambda x: _paragraph(x["key"], x["value"])))


def blank_line_paragraphs(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")
    return F.transform(parts, lambda p, i: _paragraph((i + 1).cast("string"), p))


def intro_and_items(text: Column) -> Column:
    """One block with at least two items: the intro is paragraph 1, the items paragraph 2."""
    def build(pieces: Column) -> Column:
        intro = strip(F.get(pieces, F.lit(0)))
        block = strip(F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), ""))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        both = F.array(
            F.struct(F.lit("1").alias("no"), intro.alias("text"), none.alias("items")),
            F.struct(F.lit("2").alias("no"), block.alias("text"), split_items(block).alias("items")))
        usable = (F.size(pieces) >= 3) & ~intro.rlike(_ITEM_START) & (intro != "")
        return F.when(usable, F.filter(
            let(both, lambda b: F.when(F.size(F.get(b, F.lit(1))["items"]) >= 2, b)),
            lambda p: p.isNotNull()))

    return let(F.split(text, _ITEM), build)


def build_structure(text: Column) -> Column:
    """Numbered paragraphs, else blank-line paragraphs, else intro and items, else one."""
    def build(t: Column) -> Column:
        lines = let(blank_line_paragraphs(t), lambda p: F.when(F.size(p) > 1, p))
        return (F.when(t == "", _empty())
                .when(t.rlike(r"\(\d+\)"), numbered_paragraphs(t))
                .otherwise(F.coalesce(
                    F.when(t.contains("\n\n"), lines), intro_and_items(t),
                    F.array(_paragraph(F.lit("1"), t)))))

    return let(strip(F.coalesce(text, F.lit(""))), build)


def read_stored_structure(stored: Column) -> Column:
    """Structure from stored JSON; a paragraph may be a bare string or an object."""
    paragraphs = F.map_entries(F.from_json(stored, "fikralar map<string,string>")["fikralar"])

    def one(e: Column) -> Column:
        full = F.from_json(e["value"], "text string, bentler map<string,string>")
        is_object = e["value"].startswith("{")
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return F.struct(
            e["key"].alias("no"),
            F.when(is_object, F.coalesce(full["text"], F.lit(""))).otherwise(e["value"]).alias("text"),
            F.when(is_object, F.coalesce(full["bentler"], none)).otherwise(none).alias("items"))

    return F.coalesce(F.transform(paragraphs, one), _empty())


def classify_structure(paragraphs: Column) -> Column:
    count = F.coalesce(F.size(paragraphs), F.lit(0))
    items = F.aggregate(paragraphs, F.lit(0), lambda n, p: n + F.coalesce(F.size(p["items"]), F.lit(0)))
    return (F.when(count <= 0, "missing")
            .when((count == 1) & (items == 0), "single_fikra_only")
            .when(count == 1, "single_fikra_with_bents")
            .when(items == 0, "multi_fikra").otherwise("multi_fikra_with_bents"))


STRUCTURE_CLASSES = ["missing", "single_fikra_only", "single_fikra_with_bents", "multi_fikra",
                     "multi_fikra_with_bents"]


def chunks(text: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """Overlapping pieces, trimmed, blank ones left out: ``array<string>``."""
    step = size - overlap

    def cut(t: Column) -> Column:
        count = F.when(F.length(t) <= size, 1).otherwise(
            F.ceil((F.length(t) - overlap) / step)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), count - 1),
                             lambda i: strip(F.substring(t, i * step + 1, F.lit(size))))
        return F.filter(pieces, lambda p: p != "")

    return let(strip(F.coalesce(text, F.lit(""))), cut)


