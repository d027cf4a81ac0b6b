"""Reference parsing: text in, array of structs out.

All parsers read canonical text.  Patterns of one kind are merged into a single
alternation over the aliases, so the cost does not grow with the dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .aliases import (NAMED_ALIAS_PATTERN, REGULATION_PATTERN, SHORT_ALIAS_PATTERN, detect_law,
                      law_of, names_a_law, rank_of, regulation_of)
from .text import canon, has_any, let

NUMBER = r"\d+(?:/[A-Za-z])?"
RANGE = rf"{NUMBER}\s*(?:-|–|—|ila)\s*{NUMBER}"
NUMBER_LIST = rf"(?:{NUMBER}\s*,\s*)*{NUMBER}\s*(?:ve\s*{NUMBER})?"
FOLLOWING = r"\s+ve\s+devami"
ORDINAL_ENDING = r"(?:inci|nci|uncu|ncu)"

REF_TYPE = "array<struct<law_no:string,article_no:string,article_type:string>>"


def no_refs() -> Column:
    return F.array().cast(REF_TYPE)


def _ref(law: Column, number: Column, kind: str = "madde") -> Column:
    return F.struct(law.alias("law_no"), number.alias("article_no"), F.lit(kind).alias("article_type"))


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


# How the text captured behind a law becomes references.
def _single(law: Column, body: Column) -> Column:
    return F.array(_ref(law, body))


def _special(kind: str) -> Callable[[Column, Column], Column]:
    return lambda law, body: F.array(_ref(law, body, kind))


def _repeated(law: Column, body: Column) -> Column:
    return F.array(_ref(law, F.concat(body, F.lit("/A"))))


def _list(law: Column, body: Column) -> Column:
    numbers = _numbers(F.upper(body))
    return F.when(F.size(numbers) <= V.MAX_LIST_NUMBERS,
                  F.transform(numbers, lambda n: _ref(law, n))).otherwise(no_refs())


def _sequence(law: Column, first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda n: _ref(law, n.cast("string")))


def _range(law: Column, body: Column) -> Column:
    ends = F.transform(_numbers(body), lambda n: n.try_cast("bigint"))
    a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    # A lettered end does not parse, which leaves the range out.
    return F.when(F.abs(a - b) <= V.MAX_RANGE_WIDTH,
                  _sequence(law, F.least(a, b), F.greatest(a, b))).otherwise(no_refs())


def _following(law: Column, body: Column) -> Column:
    first = body.try_cast("bigint")
    return F.when(first.isNotNull(),
                  _sequence(law, first, first + (V.FOLLOWING_LENGTH - 1))).otherwise(no_refs())


def _pairs(text: Column, pattern: str, build: Callable[[Column, Column], Column]) -> Column:
    """Apply ``build(group 1, group 2)`` to every match, in text order."""
    return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
                      F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), build)


def _named(build: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda alias, body: build(law_of(alias), body)


def _where(flag: Column, refs: Column) -> Column:
    return F.when(flag, refs).otherwise(no_refs())


_NUMBERED_LAW = r"\b(\d{3,4})\s+sayili\s+kanun"
# (pattern behind the law, reader) for additional, provisional, both, repeated.
_SPECIALS = {
    "ek": (r"\s+ek\s+madde\s+(\d+)\b", _special("ek")),
    "gecici": (r"\s+gecici\s+madde\s+(\d+)\b", _special("gecici")),
    "ek_gecici": (r"\s+ek\s+gecici\s+madde\s+(\d+)\b", _special("ek_gecici")),
    "mukerrer": (r"\s+mukerrer\s+madde\s+(\d+)\b", _repeated),
}
_PLAINS = {
    "range": (rf"({RANGE})\b", _range),
    "list": (rf"({NUMBER_LIST})\b", _list),
    "following": (rf"(\d+){FOLLOWING}\b", _following),
    "single": (r"(\d+)\b", _single),
}


def _guard(text: Column, kind: str) -> Column:
    """A cheap test that must hold for a kind of reference to occur at all."""
    needle = {"ek": "madde", "gecici": "gecici", "ek_gecici": "gecici", "mukerrer": "mukerrer",
              "following": "devami"}.get(kind)
    if needle:
        return text.contains(needle)
    if kind == "range":
        return text.rlike("[-–—]|ila")
    return F.lit(True)


def _by_law_number(text: Column, kinds: list[str]) -> list[Column]:
    out = []
    for kind in kinds:
        behind, build = {**_SPECIALS, **_PLAINS}[kind]
        glue = "" if kind in _SPECIALS else r"\s*(?:m\.|madde)?\s*"
        refs = F.flatten(_pairs(text, _NUMBERED_LAW + glue + behind, build))
        out.append(_where(text.contains("sayili") & _guard(text, kind), refs))
    return out


def _by_short_alias(text: Column) -> list[Column]:
    out = []
    for kind, (behind, build) in _PLAINS.items():
        pattern = rf"\b({SHORT_ALIAS_PATTERN})\s*(?:m\.|md\.|madde)?\s*{behind}"
        refs = F.flatten(_pairs(text, pattern, _named(build)))
        out.append(_where(_guard(text, kind), refs))
    return out


def _ranked(build: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.struct(rank_of(a).alias("rank"), build(law_of(a), b).alias("refs"))


def _placed(position: int) -> Callable[[Column, Column], Column]:
    return lambda m, i: F.struct(m["rank"].alias("rank"), F.lit(position).alias("kind"),
                                 i.alias("pos"), m["refs"].alias("refs"))


def _by_any_alias(text: Column) -> Column:
    """Every named alias; ordered by dictionary rank, then kind, then position."""
    item = ("array<struct<rank:int,kind:int,pos:int,"
            "refs:array<struct<law_no:string,article_no:string,article_type:string>>>>")
    groups = []
    order = ["mukerrer", "ek_gecici", "gecici", "ek", "range", "list", "following", "single"]
    for position, kind in enumerate(order):
        behind, build = {**_SPECIALS, **_PLAINS}[kind]
        glue = "" if kind in _SPECIALS else r"\s*(?:m\.?|md\.?|madde|maddesi)?\s*"
        pattern = rf"\b({NAMED_ALIAS_PATTERN}){glue}{behind}"
        found = _pairs(text, pattern, _ranked(build))
        placed = F.transform(found, _placed(position))
        groups.append(F.when(_guard(text, kind), placed.cast(item)).otherwise(F.array().cast(item)))
    return F.flatten(F.transform(F.array_sort(F.concat(*groups)), lambda m: m["refs"]))


def _without_law(text: Column, law: Column) -> list[Column]:
    """Article words and numbers; used only where no law is named outright."""
    word = r"(?:m\.|m|md|madde)\s*(?:no\s*)?(\d+)"
    numbers = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    follow = F.flatten(F.transform(numbers(word + FOLLOWING + r"\b"), lambda n: _following(law, n)))
    patterns = [word + r"\b", r"\b(\d+)\.\s*madde\b", rf"\b(\d+)\s*(?:inci|nci|uncu)\s*madde\b",
                r"\b(\d+)\.\s*maddesi\b", r"\b(\d+)\s*maddesi\b"]
    singles = [F.transform(numbers(p), lambda n: _ref(law, n)) for p in patterns]
    return [F.when(law.isNotNull(), follow).otherwise(no_refs()), *singles]


def parse_refs(canonical: Column) -> Column:
    """Article references of a question, first occurrence kept, parser order kept."""
    def parse(text: Column) -> Column:
        loose = let(detect_law(text), lambda law: F.concat(*_without_law(text, law)))
        parts = [
            _where(~names_a_law(text), loose),
            *_by_law_number(text, ["ek", "gecici", "ek_gecici", "mukerrer"]),
            *_by_law_number(text, ["range", "list", "following", "single"]),
            *_by_short_alias(text),
            _by_any_alias(text),
        ]
        return F.array_distinct(F.concat(*parts))

    # A reference always carries a digit.
    return let(canonical, lambda t: F.when(t.rlike(r"\d"), parse(t)).otherwise(no_refs()))


def parse_regulation_refs(canonical: Column) -> Column:
    """Regulation alias followed by an article number."""
    pattern = rf"\b({REGULATION_PATTERN})\s*(?:m\.?|md\.?|madde|maddesi)?\s*({NUMBER})\b"

    def build(alias: Column, number: Column) -> Column:
        return let(regulation_of(alias), lambda r: F.struct(
            r["law_no"].alias("law_no"), r["regulation_name"].alias("regulation_name"),
            number.alias("article_no"), F.lit("madde").alias("article_type")))

    empty = F.array().cast("array<struct<law_no:string,regulation_name:string,"
                           "article_no:string,article_type:string>>")
    return F.when(canonical.contains("yon"),
                  F.array_distinct(_pairs(canonical, pattern, build))).otherwise(empty)


def last_law_ref(refs: Column) -> Column:
    """Last reference of a turn that carries a law; null if there is none."""
    return F.try_element_at(F.filter(refs, lambda r: r["law_no"].isNotNull()), F.lit(-1))


_THIS_LAW = r"\bbu\s+kanun(?:un|unun|nun|na|nda|daki)?\s+"


def resolve_context(question: Column, last: Column) -> Column:
    """Rewrite a question that leans on the conversation; the first rule that fires wins.

    ``last`` is the last reference carrying a law (null leaves the question alone).
    """
    def rules(q: Column) -> Column:
        law, number = last["law_no"], last["article_no"]
        group = lambda p, i=1: F.regexp_extract(q, p, i)
        ask = lambda *tail: F.concat(law, F.lit(" sayılı Kanun madde "), *tail)
        follow = _THIS_LAW + r"(\d+)\s+ve\s+devami\b"
        span = (_THIS_LAW + rf"({NUMBER})\s*(?:-|–|—|ila)\s*({NUMBER})"
                r"(?:\.?\s*madd(?:e|esi|eleri)?)?\b")
        several = _THIS_LAW + r"((?:\d+\s*,\s*)+\d+\s*(?:ve\s*\d+)?)\.?\s*madd(?:e|eleri|esi)?"
        ordinal = _THIS_LAW + r"(\d+)\s*(?:inci|nci|uncu)\s*madd"
        plain = _THIS_LAW + r"(\d+)\.?\s*madd(?:e|esi)?\b"
        numeric = number.rlike(r"^\d+$")
        step = number.try_cast("bigint")
        return (
            F.when(q.rlike(follow), ask(group(follow), F.lit(" ve devamı")))
            .when(q.rlike(span), ask(group(span), F.lit("-"), group(span, 2)))
            .when(q.rlike(several), ask(F.trim(group(several))))
            .when(q.rlike(ordinal), ask(group(ordinal)))
            .when(q.rlike(plain), ask(group(plain)))
            .when(q.rlike(r"\bbu\s+madde(?:yi|ye|de|den)?\b") & (number != ""), ask(number))
            .when(q.rlike(r"\b(onceki|yukaridaki)\s+madde\b") & numeric,
                  ask(F.greatest(F.lit(1), step - 1).cast("string")))
            .when(q.rlike(r"\b(sonraki|asagidaki)\s+madde\b") & numeric,
                  ask((step + 1).cast("string")))
        )

    return F.when(last["law_no"].isNull(), question).otherwise(
        F.coalesce(let(canon(question), rules), question))


# --- paragraph and item references inside an article -------------------------

INTRA_TYPE = "array<struct<type:string,value:string>>"
_FOUR = ["1", "2", "3", "4"]
_FOUR_WORDS = ["birinci", "ikinci", "ucuncu", "dorduncu"]


def _intra(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def parse_intra_refs(canonical: Column) -> Column:
    """Paragraph, lettered-item and numbered-item references, from the canonical form of a
    normalised question."""
    tail = r"fikra(?:[a-z]*)?\b"
    flags = [("fikra", rf"\b{w}\s*{tail}", n) for w, n in zip(_FOUR_WORDS, _FOUR)]
    flags += [("fikra", rf"\b{n}\.\s*fikra\b", n) for n in _FOUR]
    flags += [("fikra", rf"\b{n}\s*(?:inci|nci|uncu)\s*fikra\b", n) for n in _FOUR]
    flags += [("fikra", rf"\b{w}\s*{tail}", v) for w, v in
              (("yukaridaki", "previous"), ("onceki", "previous"), ("bu", "current"))]
    flags += [("fikra", rf"\b{w}\s*fikralar(?:[a-z]*)?\b", "previous_plural")
              for w in ("yukaridaki", "onceki")]
    letters = [r"\b([a-z])\s*bendi\b", r"\b([a-z])\s*bent\b",
               r"\(([a-z])\)\s*bendi\b", r"\(([a-z])\)\s*bent\b"]
    numbered = [(rf"\b{n}\.\s*bent\b", n) for n in _FOUR]
    numbered += [(rf"\b{n}\s*numarali\s*bent\b", n) for n in _FOUR]
    numbered += [(rf"\b{w}\s*bent\b", n) for w, n in zip(_FOUR_WORDS, _FOUR)]

    def parse(q: Column) -> Column:
        paragraphs = F.array(*[F.when(q.rlike(p), _intra(k, F.lit(v))) for k, p, v in flags])
        items = [F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(1)), lambda x: _intra("bent", x))
                 for p in letters]
        counted = F.array(*[F.when(q.rlike(p), _intra("numeric_bent", F.lit(v))) for p, v in numbered])
        found = F.concat(paragraphs, *items, counted).cast(INTRA_TYPE)
        return F.filter(found, lambda r: r.isNotNull())

    return let(canonical, lambda q: F.when(
        has_any(q, ["fikra", "bent", "bend"]), parse(q)).otherwise(F.array().cast(INTRA_TYPE)))


def resolve_intra_refs(refs: Column) -> Column:
    """Resolve relative paragraphs against the last explicit number.

    Each result carries the list of paragraph numbers (or item letter) it stands for.
    """
    explicit = F.filter(refs, lambda r: r["value"].isin(_FOUR))
    last = F.try_element_at(explicit, F.lit(-1))["value"].try_cast("int")
    none = F.array().cast("array<string>")

    def resolve(n: Column) -> Column:
        def one(r: Column) -> Column:
            value = r["value"]
            before = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: i.cast("string")))
            resolved = (
                F.when(value.isin(_FOUR), F.array(value))
                .when(value == "current", F.when(n.isNotNull(), F.array(n.cast("string"))))
                .when(value == "previous", F.when(n > 1, F.array((n - 1).cast("string"))))
                .when(r["type"] == "bent", F.array(value))
                .when(value == "previous_plural", before))
            kind = F.when(r["type"] == "bent", "bent").otherwise("fikra")
            return F.struct(kind.alias("type"), value.alias("value"),
                            F.coalesce(resolved, none).alias("resolved"))
        return F.transform(refs, one)

    return let(last, resolve)


def intra_request(refs: Column) -> Column:
    """What the question asks of an article: paragraph list, one paragraph, item, numbered item."""
    def last_of(kind: str) -> Column:
        return F.try_element_at(F.filter(refs, lambda r: r["type"] == kind), F.lit(-1))["value"]

    def request(resolved: Column) -> Column:
        plural = F.try_element_at(F.filter(resolved, lambda r: (r["value"] == "previous_plural")
                                           & (F.size(r["resolved"]) > 0)), F.lit(1))["resolved"]
        single = F.try_element_at(F.filter(resolved, lambda r: (r["value"] != "previous_plural")
                                           & F.get(r["resolved"], F.lit(0)).isin(_FOUR)), F.lit(-1))
        return F.struct(plural.alias("plural"),
                        F.get(single["resolved"], F.lit(0)).alias("single"),
                        last_of("bent").alias("item"), last_of("numeric_bent").alias("numbered"),
                        (F.size(refs) > 0).alias("requested"))

    return let(resolve_intra_refs(refs), request)


def _numbered_item(text: Column, number: Column) -> Column:
    """Text of ``N. ...`` up to the next number at a word start; null if absent."""
    out = None
    for n in _FOUR:
        pattern = rf"(?siU)(?:(?<=\s)|^){n}\.\s*(.+?)(?=(?:(?<=\s)|^)\d+\.\s|$)"
        found = F.when(text.rlike(pattern),
                       F.concat(F.lit(f"{n}. "), F.trim(F.regexp_extract(text, pattern, 1))))
        out = F.when(number == n, found) if out is None else out.when(number == n, found)
    return out


def _paragraph(paragraphs: Column, number: Column) -> Column:
    return F.get(F.filter(paragraphs, lambda p: p["no"] == number), F.lit(0))


def _paragraph_text(paragraph: Column, ask: Column) -> Column:
    """The item asked for inside a paragraph, else the paragraph; null when empty."""
    whole = F.nullif(F.trim(paragraph["text"]), F.lit(""))
    item = F.nullif(paragraph["items"][ask["item"]], F.lit(""))
    return F.when(paragraph.isNotNull(), F.coalesce(
        F.when(ask["item"].isNotNull(), item),
        F.when(ask["numbered"].isNotNull(), _numbered_item(whole, ask["numbered"])), whole))


def _raw_paragraph(text: Column, number: Column) -> Column:
    """Marker and text of a numbered paragraph in the raw text, last repeat wins."""
    parts = F.filter(F.split(text, r"(?=\(\d+\))"), lambda p: p.rlike(r"^\(\d+\)"))
    return F.try_element_at(F.filter(parts, lambda p: F.regexp_extract(
        p, r"^\((\d+)\)", 1) == number), F.lit(-1))


def extract_requested(text: Column, ask: Column, paragraphs: Column) -> Column:
    """Text of the requested paragraph or item: structure first, raw text as fallback."""
    def joined(pick: Callable[[Column], Column]) -> Column:
        parts = F.filter(F.transform(ask["plural"], pick), lambda p: p.isNotNull())
        return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))

    item_anywhere = F.get(F.filter(
        F.transform(paragraphs, lambda p: F.nullif(p["items"][ask["item"]], F.lit(""))),
        lambda t: t.isNotNull()), F.lit(0))
    body = F.trim(F.coalesce(text, F.lit("")))
    structured = F.coalesce(
        F.when(ask["plural"].isNotNull(),
               joined(lambda n: _paragraph_text(_paragraph(paragraphs, n), ask))),
        F.when(ask["plural"].isNull() & ask["single"].isNotNull(), let(
            _paragraph(paragraphs, ask["single"]), lambda p: _paragraph_text(p, ask))),
        F.when(ask["item"].isNotNull() & ask["plural"].isNull(), item_anywhere))
    raw = F.coalesce(
        F.when(ask["numbered"].isNotNull(), _numbered_item(body, ask["numbered"])),
        F.when(ask["plural"].isNotNull(), joined(lambda n: _raw_paragraph(body, n))),
        F.when(ask["plural"].isNull() & ask["single"].isNotNull(), _raw_paragraph(body, ask["single"])))
    return F.when(ask["requested"], F.coalesce(structured, raw))


def context_text(text: Column, ask: Column, paragraphs: Column) -> Column:
    """The requested part, else the whole article."""
    return F.coalesce(F.nullif(extract_requested(text, ask, paragraphs), F.lit("")),
                      text, F.lit(""))


def extraction_status(ask: Column, paragraphs: Column, found: Column) -> Column:
    """not_requested, matched, partial_match or not_structured."""
    held = F.coalesce(F.transform(paragraphs, lambda p: p["no"]), F.array().cast("array<string>"))
    has_item = lambda p: F.coalesce(p["items"][ask["item"]], F.lit("")) != ""
    with_item = F.coalesce(F.transform(F.filter(paragraphs, has_item), lambda p: p["no"]),
                           F.array().cast("array<string>"))
    wanted = ask["plural"]
    hit = lambda have: F.size(F.array_intersect(wanted, have))
    plural = (
        F.when(hit(held) == 0, "not_structured").when(hit(held) < F.size(wanted), "partial_match")
        .when(ask["item"].isNull(), "matched")
        .when(hit(with_item) == 0, "not_structured")
        .when(hit(with_item) < F.size(wanted), "partial_match").otherwise("matched"))
    loose = F.when(F.coalesce(found, F.lit("")) != "", "partial_match").otherwise("not_structured")
    single = (
        F.when(~F.array_contains(held, ask["single"]), loose)
        .when(ask["item"].isNotNull() & ~F.array_contains(with_item, ask["single"]), loose)
        .otherwise("matched"))
    return (
        F.when(~ask["requested"], "not_requested")
        .when(F.coalesce(F.size(wanted), F.lit(0)) > 0, plural)
        .when(ask["single"].isNotNull(), single)
        .when(ask["numbered"].isNotNull(), loose)
        .when(ask["item"].isNotNull(),
              F.when(F.size(with_item) > 0, "matched").otherwise("not_structured"))
        .otherwise(F.when(F.coalesce(found, F.lit("")) != "", "matched").otherwise("not_structured")))


# --- citations in article bodies ---------------------------------------------

def cited_articles(text: Column, law_no: Column, compatible: bool = False) -> Column:
    """Citations of an article body: target, kind of citation, matched text.

    A citation that names another law is not repeated as one of the same law;
    ``compatible=True`` keeps that repetition.
    """
    ending = rf"\s*{ORDINAL_ENDING}\s*madd"
    genitive = r"(?:nunun|unun|nun|un|nin|in|na|ne|nda|nde|daki|deki)?"
    empty = F.array().cast(
        "array<struct<law_no:string,article_no:string,ref_type:string,raw_match:string>>")

    def edge(law: Column, number: Column, kind: str, raw: Column) -> Column:
        return F.struct(law.alias("law_no"), F.upper(number).alias("article_no"),
                        F.lit(kind).alias("ref_type"), raw.alias("raw_match"))

    def found(t: Column, pattern: str, build: Callable[[Column], Column]) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), build)

    short = rf"\b(tbk|tck|hmk|cmk)\s*(?:m\.|md\.|madde)?\s*({NUMBER})\b"
    numbered = rf"\b(\d{{4}})\s+sayili\s+kanun{genitive}\s+({NUMBER}){ending}"
    named = rf"\b({NAMED_ALIAS_PATTERN}){genitive}\s+({NUMBER}){ending}"
    same = rf"\bbu\s+kanun{genitive}\s+({NUMBER}){ending}"
    several = rf"((?:{NUMBER}\s*,\s*)+(?:{NUMBER}\s*ve\s*)?{NUMBER}){ending}"
    single = rf"\b({NUMBER})\s*{ORDINAL_ENDING}\s*madd(?:esi|enin|elerine|eleri|e)?\b"

    def read(t: Column) -> Column:
        crossing = F.concat(
            found(t, short, lambda m: edge(law_of(F.regexp_extract(m, short, 1)),
                                           F.regexp_extract(m, short, 2), "explicit_cross_law", m)),
            found(t, numbered, lambda m: edge(F.regexp_extract(m, numbered, 1),
                                              F.regexp_extract(m, numbered, 2), "explicit_cross_law", m)),
            found(t, named, lambda m: edge(law_of(F.regexp_extract(m, named, 1)),
                                           F.regexp_extract(m, named, 2), "explicit_cross_law", m)))
        own = found(t, same, lambda m: edge(law_no, F.regexp_extract(m, same, 1),
                                            "explicit_same_law", m))
        rest = t if compatible else F.regexp_replace(F.regexp_replace(t, numbered, " "), named, " ")
        lists = F.flatten(found(rest, several, lambda m: F.transform(
            _numbers(F.regexp_extract(m, several, 1)), lambda n: edge(law_no, n, "explicit_article", m))))
        singles = found(rest, single, lambda m: edge(law_no, F.regexp_extract(m, single, 1),
                                                     "explicit_article", m))
        edges = F.concat(crossing, own, lists, singles)
        return F.array_distinct(F.filter(edges, lambda e: e["law_no"].isNotNull()))

    return let(canon(text), lambda t: F.when(
        t.rlike(r"\d"), read(t)).otherwise(empty))


def case_numbers(question: Column) -> Column:
    """Case or decision numbers (year/number), inner blanks removed, distinct."""
    raw = F.regexp_extract_all(canon(question), F.lit(r"\b(?:19|20)\d{2}\s*/\s*\d+\b"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda n: F.regexp_replace(n, r"\s+", "")))


def mentions_previous_article(text: Column) -> Column:
    phrases = "|".join(V.PREVIOUS_ARTICLE_PHRASES)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(rf"(?U)\b(?:{phrases})(?:de)?\b")
