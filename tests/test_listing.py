"""Items of listing pages, read in one pass: the same as by the blocks of ``markup``, no pattern per token in the plan."""

import random

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions import listing, markup
from statuta.operators.ordered import explode_rows
from statuta.sources import readers

BITS = ["<div>", '<div class="birkarar">', "<DIV class='x birkarar  y'>", "<div class=kararbilgileri>", '<div class="kararbilgileri birkarar">', '<div class="basvurukonualani">',
        '<div class="birkararlar">', "</div>", "</div >", "</DIV>", "</div/>", "<div/>", "<divider>", "<titles>", "</titles>", "<TITLES x='>'>", "<titles/>", "Karar &amp;lt; ", " a < b ", "<", "  ıİ ",
        '<a href="/BB/1">', "<A title='a>b' href='/BB/2?Dil=en'>", "<a href=/BB/3>", "<abbr href='/BB/4'>", "</a>", "<script>\"</div>\"</script>", "<SCRIPT x", "<sty<script></script>le></style>", "<!-- <div> -->",
        "<!--", '<i t="', "> ", "2020/1 | Esas | Bölüm | Karar Tarihi : 01/02/2020", "\n"]


def _pages():
    rng = random.Random(11)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["", "<div class='birkarar'>" * 60 + "x" + "</div>" * 40, None]


def test_items_are_those_of_the_blocks(spark):
    pages, page = _pages(), V.DECISION_PAGE
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    parts = rows.select("page_id", markup.tokens(markup.without(F.col("html"), page["drop_tags"])).alias("parts"))
    items = explode_rows(parts, markup.spans(F.col("parts"), "div", [page["item_class"]]), "nth", "block").select(
        "page_id", "nth", markup.cut(F.col("parts"), F.col("block")).alias("item"))
    div = lambda c: markup.first_text(F.col("item"), "div", [page[c]])
    want = items.select("page_id", "nth", markup.first_text(F.col("item"), page["title_tag"]), div("info_class"), F.substring(div("subject_class"), 1, page["subject_length"]),
                        F.filter("item", lambda t: t.rlike("^<[aA]"))).collect()
    read = listing.reader(page)
    got = [(at, nth, title, info, subject, anchors) for at, html in enumerate(pages) if html is not None for nth, (anchors, title, info, subject) in enumerate(read(html))]
    assert len(got) > 300 and sorted(got) == sorted(map(tuple, want))


def test_no_pattern_is_tried_on_every_token(spark):
    """The work on a page is one pass over its tags, not one pattern after the other on each of them."""
    html = '<div class="birkarar"><a href="/BB/1">x</a><titles>T</titles><div class="kararbilgileri">2020/1 | E</div></div>'
    rows = readers.listed_decisions(spark.createDataFrame([("p", html)], "page_id string, html string"), "https://x")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "(?is)^<div" not in plan and "(?is)^</div" not in plan
    assert [(r.page_id, r.nth, r.url, r.title, r.info.application_no, r.subject) for r in rows.collect()] == [("p", 0, "https://x/BB/1", "T", "2020/1", "")]


def test_kept_tags_are_bounded(monkeypatch):
    monkeypatch.setattr(listing, "KEPT_TAGS", 3)
    read, page = listing.reader(V.DECISION_PAGE), "".join(f'<div class="birkarar n{i}">{i}</div>' for i in range(20))
    assert [len(read(page)), len(read(page + f'<div title="{"x" * 500}" class="birkarar">'))] == [20, 21]
