"""Quality rules, page text, toxicity and fingerprints against brute force and small cases."""

import base64
import collections
import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import by_key

from statuta.llm import fertility, fingerprints, html_text, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    n = len(w)
    windows = collections.Counter(tuple(w[k:k + 5]) for k in range(n - 4))
    inside = {k + i for k in range(n - 4) if windows[tuple(w[k:k + 5])] > 1 for i in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_quality_measures(odd, odd_rows, documents, paths):
    for frame, rows in ((odd, odd_rows), (documents, [tuple(r) for r in documents.collect()])):
        got = fertility.measure(frame, paths["piece_bpe_32k.model"]).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(
            repr((k, *base(t))) for k, t, *_ in rows)
        assert not any(r.kept and r.base_failed for r in got)


def test_symbols_are_rejected_and_prose_stays(spark, paths):
    prose = "The committee met on Monday to read the report, and it agreed to publish a shorter version next week."
    junk = " ".join(w + c for w, c in zip(prose.split() * 3, "%%% $$$ &&& ***".split() * 20)) + " ".join(f" {w}{i} |" for i, w in enumerate(prose.split()))
    frame = spark.createDataFrame([(1, prose, 5), (2, junk, 6), (3, None, 7)], "doc_id long, text string, kept long")
    assert [tuple(r) for r in fertility.keep(frame, paths["piece_bpe_32k.model"]).collect()] == [(1, prose, 5)]


def test_junk_without_symbols_is_rejected(spark, paths):
    """Random letters, consonants, base64 and mojibake go by bands learned from the table; hardly any other text does."""
    draw = random.Random(5)
    words = lambda letters: " ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(300))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    french = docs.filter("lang = 'fr' and length(text) > 2000").orderBy("doc_id").first().text[:2000]
    junk = [words(string.ascii_lowercase), words("bcdfghjklmnpqrstvwxz"), " ".join(base64.b64encode(draw.randbytes(24)).decode() for _ in range(60)),
            french.encode().decode("cp1252", "replace").encode().decode("cp1252", "replace")]
    frame = docs.union(spark.createDataFrame([(-1 - k, t, "en" if k < 3 else "fr") for k, t in enumerate(junk)], docs.schema))
    got = {r.doc_id: r for r in fertility.measure(frame, paths["piece_bpe_32k.model"]).collect()}
    assert all(not got[-1 - k].kept and set(got[-1 - k].outside.split(",")) - {"symbol_share"} for k in range(4))
    assert got[-4].part_share > 0.1  # whole characters are rare in it by the byte-level vocabulary
    rest = [r for k, r in got.items() if k >= 0 and not r.base_failed and r.symbol_share <= 0.05]
    assert sum(r.kept for r in rest) >= 0.99 * len(rest)
    kept = {r.doc_id for r in fertility.keep(frame, paths["piece_bpe_32k.model"]).collect()}
    assert kept == {k for k, r in got.items() if r.kept}


def test_page_text():
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head &amp; line</h1><p>one<p>two  <b>bold</b> <span hidden>no</span>
      <ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><div style="display: none">no</div><script>var x = "</p>";</script>
      <table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td rowspan=2>日本<td>5<tr><td>x<br>yy</table>
      <pre>k\n  l</pre><blockquote>said</blockquote>end"""
    assert html_text.text_of(page) == "\n".join([
        "Head & line", "", "one", "", "two bold", "", "- a", "- b", "  3. c", "  4. d", "", "Cap", "Name  | Qty", "Apple | 10", "日本  | 5", "      | x",
        "      | yy", "", "k", "  l", "", "> said", "", "end"])


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<table><td>", "<li>" * 3000 + "x", "<div>" * 3000 + "x", "a & b &bogus; &#x110000;", "<!-- x"])
def test_broken_pages_have_text(page):
    assert isinstance(html_text.text_of(page), str)


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tr><form><td>text</td></form></tr></table>", "text"), ("<table><tr><td>a<td>b</tr><form><tr><td>c</form><td>d</table>", "a | b\nc | d"),
    ("<table><tr><div>text</div></tr></table>", "text"), ("<table><tr>some <b>words</b><td>a</td></tr></table>end", "some words\na\n\nend"),
    ("<table><caption>Cap</caption><tr><div>x<td>a<td>b</div></table>", "x\nCap\na | b"), ("<table><div>x<tr><td>a</table>", "x\na"),
    ("<table><tr><td><div>in</div><table><tr>far<td>deep</table></table>", "in\n\nfar\ndeep")])
def test_all_text_of_rows_is_shown(page, text):
    assert html_text.text_of(page) == text


def test_pages_table(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (2, "<p>a<p>b"), (None, "<p hidden>x")], "page_id long, html string")
    assert sorted(map(repr, map(tuple, html_text.extract(frame).collect()))) == sorted(map(repr, [(1, None, 0, 0), (2, "", 0, 0), (2, "a\n\nb", 4, 3), (None, "", 0, 0)]))


def test_grammar_weighs_clauses_not_words():
    terms = {}
    one = lambda t: dict(zip(toxicity.OUTPUTS, toxicity.features([t], terms)[0]))
    assert one("he is scum.")["insult+dir"] > 0
    assert one("scum. he came")["insult"] > 0 and one("scum. he came")["insult+dir"] == 0
    assert one("not an idiot")["insult+neg"] > 0
    assert one("Anna wrote: idiot")["insult"] > 0  # the colon ends the clause
    assert one("Anna wrote idiot")["insult+rep"] > 0
    assert one("I will kill you")["threat+dir"] > 0
    assert sum(one("").values()) == 0
    weights = dict(zip(toxicity.OUTPUTS, toxicity.prior_weights()))
    assert weights["insult+dir"] > weights["insult"] > weights["insult+rep"] > weights["insult+neg"]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.learned_and_scored(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    auc = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert auc > 0.93


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 0, 1), (8, 1, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.learned_and_scored(odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.learned_and_scored(empty, labels).collect() == []
    assert len(toxicity.learned_and_scored(odd, labels.limit(0)).collect()) == len(odd_rows)


def expected_prints(rows):
    digests = lambda t: set(re.findall(r"[^\n]{1,128}", t))
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    keys = sorted({k if k is not None else -(1 << 63) for k, *_ in rows})
    by = {}
    for k, t, *_ in rows:
        by.setdefault(k if k is not None else -(1 << 63), []).append(t or "")
    out = []
    for k, t, *_ in rows:
        own = k if k is not None else -(1 << 63)
        x, y = t or "", min(by[keys[(keys.index(own) + 1) % len(keys)]], key=lambda s: s.encode())
        half = len(x) // 2
        e = x[:len(x) - half] + y[:half]
        out.append((k, len(x), hashlib.sha256(e.encode()).hexdigest(), round(likeness(digests(x), digests(e)), 9), round(likeness(digests(x), digests(y)), 9)))
    return sorted(map(repr, out))


def test_fingerprints(odd, odd_rows, documents, empty):
    for frame, rows in ((odd, odd_rows), (documents.filter("doc_id < 60"), [tuple(r) for r in documents.filter("doc_id < 60").collect()])):
        got = fingerprints.compared(frame).collect()
        assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got) == expected_prints(rows)
    assert fingerprints.compared(empty).collect() == []


def test_equal_texts_have_equal_fingerprints(spark):
    frame = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (5, "a\nb"), (9, "")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in by_key(fingerprints.compared(frame))}
    assert prints[1] == prints[5] and len(set(prints.values())) == 3


def test_peeling_recovers_digests_and_larger_tables_help(spark):
    frame = spark.range(1).select(*[F.expr(f"transform(sequence({a}, {b}), x -> xxhash64(x))").alias(n) for n, a, b in (("a", 1, 6), ("b", 4, 9), ("many", 1, 40))])
    found = fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a"), 12), fingerprints.sketch(F.col("b"), 12)), 12)
    row = frame.select("a", "b", found.alias("found"), fingerprints.recovered(F.col("many"), F.col("b")).alias("n"),
                       fingerprints.peel(fingerprints.sketch(F.col("many"), 4), 4).alias("small")).first()
    assert {(f.n, f.key) for f in row.found} == {(1, k) for k in row.a[:3]} | {(-1, k) for k in row.b[3:]}
    assert row.small is None and row.n == 34


def test_successors_of_scattered_ids(spark):
    ids = [-(1 << 63), -5, 0, 1, 2, 65_535, 65_536, 1 << 40, (1 << 40) + 1, (1 << 63) - 1]
    got = dict(map(tuple, fingerprints.successors(spark.createDataFrame([(i,) for i in ids], "k long")).collect()))
    assert got == dict(zip(ids, [*ids[1:], ids[0]]))
