"""Balanced blocks of pages against a small stack machine."""

import random
import re

from pyspark.sql import functions as F

from statuta.functions import markup
from statuta.sources import readers

TOKEN = re.compile(r"""<[/!a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|<[/!a-zA-Z][^>]*>|[^<]+|<""", re.S)


def plain_spans(html, names):
    """(first, last) of all divs with one of the names, by a stack."""
    stack, out, parts = [], [], TOKEN.findall(html)
    for at, token in enumerate(parts, 1):
        if re.match(r"(?i)</div[\s>]", token):
            if stack:
                first, wanted = stack.pop()
                if wanted:
                    out.append((first, at))
        elif re.match(r"(?i)<div[\s/>]", token) and not re.search(r"/\s*>$", token):
            own = re.search(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", token)
            stack.append((at, bool(own) and bool(set("".join(g or "" for g in own.groups()).split()) & set(names))))
    return sorted(out + [(first, len(parts)) for first, wanted in stack if wanted])


def test_spans_of_random_pages(spark):
    rng = random.Random(7)
    bits = ["<div>", "<div class='a'>", '<DIV class="x a  b">', "<div class=b>", '<div class="ab a-b">', "</div>", "</div >", "</DIV>", "text", " < ", "<br/>", "<div/>",
            "<p>", "</p>", '<i t="a>b">', "<divider>", '<div data-class="a">', "\n"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "<div class='a'>" * 400 + "x" + "</div>" * 400]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    for names in (["a"], ["a", "b"], ["missing"]):
        got = rows.select("id", markup.spans(markup.tokens(F.col("html")), "div", names).alias("s")).collect()
        for r in got:
            assert [tuple(s) for s in r.s] == plain_spans(pages[r.id], names), pages[r.id]


def test_tokens_lose_nothing(spark):
    pages = ["a < b <c", "<p title='x>y'>t</p>", '<p title="open>t</p>', "<", "<>", "</", "x<!DOCTYPE html>y", "<div" + " a='b'" * 20_000 + ">long</div>"]
    rows = spark.createDataFrame([(p,) for p in pages], "html string")
    for r in rows.select("html", F.array_join(markup.tokens(F.col("html")), "").alias("again")).collect():
        assert r.again == r.html


def test_page_text_settings(spark):
    page = ('<div class="nav">Menü</div><div class="ortaalan">a<div class="filtreler">weg<div>auch</div></div><script>"<div>"</script>'
            '<div>TÜRKİYE CUMHURİYETİ</div>&lt;b&gt;</div>Ende')
    rows = spark.createDataFrame([(page,), (None,), ("",), ("kein Block",)], "html string")
    got = [r[0] for r in rows.select(readers.decision_text(F.col("html"))).collect()]
    assert got == ["TÜRKİYE CUMHURİYETİ\n<b>", None, "", "kein Block"]
    assert rows.select(readers.page_text(F.col("html"))).first()[0].startswith("Menü\na\nweg\nauch\nTÜRKİYE")


def test_listing_of_pages_without_items(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, '<div class="birkarar"><a href="/x">kein</a></div>')], "page_id long, html string")
    assert readers.listed_decisions(rows).count() == 0
