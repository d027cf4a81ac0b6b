"""Normalising scalar functions.  Every function takes and returns a Column."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

# What a full-Unicode strip removes.
WHITESPACE = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def _fold(ch: str) -> str:
    """Case fold, compatibility decompose, drop combining marks; dotless i becomes i."""
    decomposed = unicodedata.normalize("NFKD", ch.casefold().replace("ı", "i"))
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _fold_tables() -> tuple[str, str, str, list[int], list[str]]:
    """Folds of all code points beyond ASCII, in three forms.

    Characters that fold to one character, with those that fold to nothing behind them; and for those that fold to
    several a table in two levels: the place of each block of 256 code points (-1: none fold), and the folds.
    """
    single_from, single_to, gone, several = [], [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        ch = chr(code)
        if ch.isascii() or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        folded = _fold(ch)
        # Upper-case letters are lowered before the tables are applied.
        if folded == ch or ch.lower() != ch:
            continue
        if not folded:
            gone.append(ch)
        elif len(folded) == 1:
            single_from.append(ch)
            single_to.append(folded)
        else:
            several[code] = folded
    blocks = sorted({code >> 8 for code in several})
    places = [blocks.index(b) * 256 if b in set(blocks) else -1 for b in range((sys.maxunicode >> 8) + 1)]
    folds = [several.get((b << 8) + k, chr((b << 8) + k)) for b in blocks for k in range(256)]
    ranges: list[list[int]] = []
    for code in sorted(several):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    pattern = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"
    return "".join(single_from + gone), "".join(single_to), pattern, places, folds


@functools.cache
def _tables() -> tuple[str, str, str, list[int], list[str]]:
    return _fold_tables()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sql(value: str | int | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict) -> Column:
    """A constant map, sent to the JVM as one expression."""
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in values.items()) + ")")


def literal_array(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(_sql(v) for v in values) + ")")


_BUILT: dict = {}


def built_once(name: str, build: Callable[[], Column]) -> Column:
    """Reuse a big column expression: building one takes thousands of calls to the JVM.

    Expressions are immutable and refer to columns by name, so one can serve many plans of
    the same JVM.
    """
    jvm = SparkContext._jvm
    if _BUILT.get("") is not jvm:  # expressions of an ended JVM are of no use
        _BUILT.clear()
        _BUILT[""] = jvm
    if name not in _BUILT:
        _BUILT[name] = build()
    return _BUILT[name]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


# A character for private use: no fold has it.
_BREAK = "\ue000"


def _looked_up(t: Column, places: list[int], folds: list[str]) -> Column:
    """Each character by its block and its place in the block; the tables travel as two strings that Spark splits once."""
    place = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    table = F.split(F.lit(_BREAK.join(folds)), _BREAK)

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        at = F.get(place, F.shiftright(code, 8))
        return F.when(at < 0, ch).otherwise(F.get(table, at + code.bitwiseAND(F.lit(255))))

    return F.array_join(F.transform(F.split(t, ""), one), "")


def canon(c: Column) -> Column:
    """Trimmed, case-folded text with all letters in their compatible form without combining marks."""
    single_from, single_to, several, places, folds = _tables()

    def fold(t: Column) -> Column:
        folded = F.translate(t, single_from, single_to)
        return let(folded, lambda f: F.when(~is_ascii(f) & f.rlike(several), _looked_up(f, places, folds)).otherwise(f))

    lowered = F.lower(strip(F.coalesce(c, F.lit(""))))
    return let(lowered, lambda t: F.when(is_ascii(t), t).otherwise(fold(t)))


def collapse(c: Column) -> Column:
    """Runs of any whitespace become one blank; ends trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_line(c: Column) -> Column:
    """Statute line: byte-order mark dropped, whitespace collapsed."""
    return collapse(F.translate(F.coalesce(c, F.lit("")), "\u00a0\ufeff", " "))


def normalise_regulation_line(c: Column) -> Column:
    """Regulation line: also zero-width blanks dropped and hyphen variants unified."""
    return collapse(F.translate(
        F.coalesce(c, F.lit("")), "\u00a0\u2010\u2012\ufeff\u200b", " --"))


def normalise_for_hash(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def content_hash(c: Column) -> Column:
    return F.sha2(normalise_for_hash(c), 256)


def drop_footnote_numbers(c: Column) -> Column:
    """Footnote numbers glued to a letter, to . ; , ) or to ]."""
    out = F.regexp_replace(c, r"(?U)(?<=[^\W\d_])\d{1,4}(?=\s|$)", "")
    out = F.regexp_replace(out, r"(?U)(?<=[.;,)])\d{1,4}(?=\s|$)", "")
    return F.regexp_replace(out, r"(?U)(?<=\])\d{1,4}(?=\s|$)", "")


def cut_at_appendix(c: Column, marker: str = V.APPENDIX_MARKER) -> Column:
    """Text before the amendment appendix, whitespace collapsed."""
    return strip(F.substring_index(collapse(c), marker, 1))


def clean_preview_text(c: Column, marker: str = V.APPENDIX_MARKER) -> Column:
    """Line-based variant: dated footnote lines dropped, stop at the appendix line,
    footnote numbers removed, then one line."""
    body = F.regexp_replace(c, r"(?is)(^|\n)[ \t]*\d{0,5} SAYILI " + marker + r".*$", "")
    body = F.regexp_replace(body, r"(?m)^[ \t]*\d+\s+\d{1,2}/\d{1,2}/\d{4}\b[^\n]*$", "")
    return collapse(drop_footnote_numbers(body))


def strip_title(c: Column) -> Column:
    """Drop the heading before the first colon when it names an article and is short."""
    def cut(text: Column) -> Column:
        before = F.substring_index(text, ":", 1)
        size = F.length(before)
        heading = text.contains(":") & (size < 120) & canon(before).contains("madde")
        return F.when(heading, strip(F.substr(text, size + 2))).otherwise(text)

    return let(strip(F.coalesce(c, F.lit(""))), cut)


def article_number_key(c: Column) -> Column:
    """Sortable (base, suffix); what does not parse sorts last."""
    form = r"^(\d+)(?:\s*/\s*([A-Z]))?$"

    def key(value: Column) -> Column:
        base = F.regexp_extract(value, form, 1).try_cast("bigint")
        return F.struct(
            F.coalesce(base, F.lit(10**9)).alias("base"),
            F.when(value.rlike(form), F.regexp_extract(value, form, 2)).otherwise(value).alias("suffix"))

    return let(F.upper(strip(c.cast("string"))), key)


def type_order(c: Column) -> Column:
    order = literal_map({t: i for i, t in enumerate(V.ARTICLE_TYPES)})
    return F.coalesce(order[c], F.lit(99))


def typed_number_key(article_type: Column, number: Column) -> Column:
    """(type order, base, suffix) with the suffix cut at the first slash."""
    value = F.coalesce(number.cast("string"), F.lit(""))
    base = F.split_part(value, F.lit("/"), F.lit(1))
    suffix = F.when(value.contains("/"), F.regexp_replace(value, r"^[^/]*/", "")).otherwise("")
    return F.struct(
        type_order(article_type).alias("type_rank"),
        F.coalesce(strip(base).try_cast("bigint"), F.lit(10**9)).alias("base"),
        suffix.alias("suffix"),
    )


def decision_info(c: Column) -> Column:
    """Info line of a decision: number | kind | section | labelled dates."""
    def read(parts: Column) -> Column:
        def at(i: int) -> Column:
            return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

        def dated(label: str) -> Column:
            part = F.get(F.filter(parts, lambda p: p.contains(label)), F.lit(0))
            return F.try_to_date(strip(F.substring_index(part, ":", -1)), "dd/MM/yyyy")

        return F.struct(
            at(0).alias("application_no"), at(1).alias("kind"), at(2).alias("section"),
            dated("Başvuru Tarihi").alias("application_date"),
            dated("Karar Tarihi").alias("decision_date"))

    return let(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), read)


def source_name(source_type: Column, law_name: Column, regulation_name: Column) -> Column:
    return F.when(
        source_type == "yonetmelik",
        F.coalesce(F.nullif(regulation_name, F.lit("")), law_name, F.lit("Yönetmelik")),
    ).otherwise(F.coalesce(law_name, F.lit("Kanun")))


def article_title(name: Column, article_type: Column, number: Column) -> Column:
    """Display title: the four plain types spelled out, others by their type code."""
    kind = F.coalesce(article_type, F.lit("madde"))
    word = (F.when(kind == "madde", "Madde").when(kind == "ek", "Ek Madde")
            .when(kind == "gecici", "Geçici Madde").when(kind == "ek_gecici", "Ek Geçici Madde")
            .otherwise(kind))
    return F.concat_ws(" ", name, word, F.coalesce(number, F.lit("?")))


def article_label(name: Column, article_type: Column, number: Column) -> Column:
    """Citation label used inside answers: only the plain type is spelled out."""
    kind = F.coalesce(article_type, F.lit("madde"))
    return F.concat_ws(" ", name, F.when(kind == "madde", "Madde").otherwise(kind),
                       F.coalesce(number, F.lit("?")))


def article_prefix(name: Column, article_type: Column, number: Column) -> Column:
    """Heading every article text starts with; null for an unknown type."""
    labels = literal_map(V.TYPE_LABELS)
    return F.concat(name, F.lit(" "), labels[article_type], F.lit(" "), number, F.lit(": "))


def snippet(chunk_text: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(chunk_text, F.lit("")),
                      F.substring(F.coalesce(text, F.lit("")), 1, V.SNIPPET_LENGTH))


def preview(found: Column, text: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(found, F.lit("")), text, F.lit("")), 1, V.PREVIEW_LENGTH)


def embedding_text(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, V.EMBED_TEXT_LENGTH)


def text_error(c: Column, max_length: int, field: str, required: bool = True) -> Column:
    """Null when the value is accepted, else the message shown to the caller."""
    value = strip(F.coalesce(c, F.lit("")))
    error = F.when(F.length(value) > max_length,
                   F.lit(f"{field} en fazla {max_length} karakter olabilir."))
    if not required:
        return error
    return F.when(value == "", F.lit(f"{field} boş olamaz.")).otherwise(error)


def has_any(c: Column, terms: list[str]) -> Column:
    """Does the text contain one of the terms (plain substrings)?"""
    return c.rlike("|".join(quote(t) for t in terms))


def has_word(c: Column, words: list[str]) -> Column:
    return c.rlike(r"\b(?:" + "|".join(quote(w) for w in words) + r")\b")


def quote(term: str) -> str:
    """Escape a literal for a Java regular expression."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/" else ch for ch in term)
