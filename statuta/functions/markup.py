"""Blocks of web pages: a page as an array of tags and texts, and the spans of its balanced blocks.

A block runs from its opening tag to the closing tag that belongs to it, with all blocks inside.  The spans come
from one pass over the tokens that keeps the depth and the wanted blocks that are still open; nothing is
copied on the way, so that the work grows with the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# A tag may hold ">" inside quotes; a quote that never ends does not swallow the page; a lone "<" is text.
_TOKEN = r"""(?s)<[/!a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[/!a-zA-Z][^>]*>|[^<]+|<"""
_IS_TAG = r"(?s)^<[/!a-zA-Z].*>$"
_SPANS = "array<struct<first:int,last:int>>"
# Entities that pages use, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def without(html: Column, tags: list[str]) -> Column:
    """The page without comments and without these tags and their raw content."""
    out = html
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


def tokens(html: Column) -> Column:
    """Tags and the texts between them, in order."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def is_tag(token: Column) -> Column:
    return token.rlike(_IS_TAG)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; empty where it is missing."""
    found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])


def spans(parts: Column, tag: str, classes: list[str] | None = None) -> Column:
    """(first, last) token numbers from 1 of all blocks of a tag with one of the classes, by their place.

    Blocks inside blocks have spans of their own.  A closing tag without an opening one is passed over, and a block
    that is never closed reaches to the end of the page.
    """
    opening, closing = rf"(?is)^<{tag}(?=[\s/>])", rf"(?is)^</{tag}(?=[\s>])"
    either = f" (?:{'|'.join(map(re.escape, classes or []))}) "

    def wanted(t: Column) -> Column:
        own = F.concat(F.lit(" "), F.regexp_replace(attribute(t, "class"), r"\s+", " "), F.lit(" "))
        return F.lit(True) if classes is None else own.rlike(either)

    # 0: no tag of this name, 1: opens another block, 2: opens a wanted one, -1: closes one
    codes = F.transform(parts, lambda t, i: F.struct((i + 1).alias("at"), F.when(t.rlike(closing), -1).when(
        t.rlike(opening) & ~t.rlike(r"/\s*>$"), F.when(wanted(t), 2).otherwise(1)).otherwise(0).alias("code")))
    begin = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<depth:int,first:int>>").alias("open"),
                     F.array().cast(_SPANS).alias("done"))

    def step(s: Column, tag: Column) -> Column:
        at, code, depth = tag["at"], tag["code"], s["depth"]
        top = F.get(s["open"], F.size(s["open"]) - 1)
        ends = (code == -1) & (F.size(s["open"]) > 0) & F.coalesce(top["depth"] == depth, F.lit(False))
        return F.struct(
            F.when(code > 0, depth + 1).when((code == -1) & (depth > 0), depth - 1).otherwise(depth).alias("depth"),
            F.when(code == 2, F.concat(s["open"], F.array(F.struct((depth + 1).alias("depth"), at.alias("first"))))).when(
                ends, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
            F.when(ends, F.concat(s["done"], F.array(F.struct(top["first"].alias("first"), at.alias("last"))))).otherwise(s["done"]).alias("done"))

    def finish(s: Column) -> Column:
        left = F.transform(s["open"], lambda o: F.struct(o["first"].alias("first"), F.size(parts).alias("last")))
        return F.array_sort(F.concat(s["done"], left))

    # only tags of this name are gone through
    return F.aggregate(F.filter(codes, lambda c: c["code"] != 0), begin, step, finish)


def cut(parts: Column, span: Column) -> Column:
    """The tokens of a span."""
    return F.slice(parts, span["first"], span["last"] - span["first"] + 1)


def outside(parts: Column, blocks: Column) -> Column:
    """The tokens in none of the blocks: what lies between the outermost ones, in whole slices."""
    begin = F.struct(F.lit(0).alias("upto"), F.array().cast(_SPANS).alias("kept"))
    gap = lambda first, last: F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))
    kept = F.aggregate(blocks, begin, lambda s, b: F.when(b["first"] > s["upto"], F.struct(
        b["last"].alias("upto"), F.concat(s["kept"], gap(s["upto"] + 1, b["first"] - 1)).alias("kept"))).otherwise(s),
        lambda s: F.concat(s["kept"], gap(s["upto"] + 1, F.size(parts))))
    return F.flatten(F.transform(F.filter(kept, lambda g: g["last"] >= g["first"]), lambda g: cut(parts, g)))


def inner_text(parts: Column) -> Column:
    """Stripped texts, one behind the other."""
    return F.array_join(F.transform(F.filter(parts, lambda t: ~is_tag(t)), lambda t: strip(decoded(t))), "")


def first_text(parts: Column, tag: str, classes: list[str] | None = None) -> Column:
    """Text of the first such block; empty where there is none."""
    return let(F.get(spans(parts, tag, classes), F.lit(0)), lambda s: F.when(s.isNull(), "").otherwise(inner_text(cut(parts, s))))


def container(parts: Column, tag: str, classes: list[str]) -> Column:
    """The tokens of the first block of the first class that the page has; without any, the whole page."""
    found = [F.get(spans(parts, tag, [c]), F.lit(0)) for c in classes]
    return let(F.coalesce(*found), lambda s: F.when(s.isNull(), parts).otherwise(cut(parts, s))) if found else parts


def lines(parts: Column) -> Column:
    """Texts in lines, each tag a break, without blank lines."""
    joined = F.array_join(F.transform(parts, lambda t: F.when(is_tag(t), "\n").otherwise(t)), "")
    return strip(F.regexp_replace(decoded(joined), r"(?U)\s*\n\s*", "\n"))
