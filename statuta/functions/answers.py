"""Text-only answers and the per-row parts of the answer audit, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .aliases import ALIASES
from .questions import contains_phrase, requested_paragraph, technical_term
from .text import canon, has_any, let, literal_map, strip, strip_title


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def with_disclaimer(answer: Column) -> Column:
    """Append the standard notice unless its canonical form is already there.

    A text that has the notice itself need not be folded to see that.
    """
    plain = _fixed_canon(V.DISCLAIMER)
    return let(strip(F.coalesce(answer, F.lit(""))), lambda a: (
        F.when(a == "", V.DISCLAIMER).when(a.contains(V.DISCLAIMER) | canon(a).contains(plain), a)
        .otherwise(_lines(a, "\n\n" + V.DISCLAIMER))))


def _fixed_canon(text: str) -> str:
    from .text import _fold
    return "".join(_fold(ch) for ch in text.strip())


def _answer_title(law_name: Column, number: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(law_name, F.lit("Kanun")), F.lit("Madde"),
                       F.coalesce(number, F.lit("?")))


def text_contains_answer(question: Column, law_name: Column, number: Column, text: Column,
                         strict: Column) -> Column:
    """Does the phrase occur in the article?  ``strict`` is used when no phrase was given."""
    title = _answer_title(law_name, number)

    def build(phrase: Column) -> Column:
        wanted = canon(phrase)
        found = (wanted != "") & F.contains(canon(text), wanted)
        head = F.when(found, _lines("Evet. ", title, " metninde “", phrase, "” ifadesi geçer."))
        head = head.otherwise(_lines("Hayır. ", title, " metninde “", phrase, "” ifadesi açıkça geçmez."))
        return F.when(phrase == "", strict).otherwise(
            with_disclaimer(_lines(head, "\n\n" + V.BASIS, title, "\n\n" + V.LETTER_ONLY)))

    return let(contains_phrase(question), build)


def names_term(text: Column, term: Column) -> Column:
    """Does the text name the technical term group?"""
    out = None
    for name, words in V.TECHNICAL_TERMS.items():
        test = has_any(text, words)
        out = F.when(term == name, test) if out is None else out.when(term == name, test)
    return F.coalesce(out, F.lit(False))


def technical_term_answer(question: Column, law_name: Column, number: Column, text: Column,
                          strict: Column) -> Column:
    title = _answer_title(law_name, number)

    def build(term: Column) -> Column:
        found = let(canon(text), lambda t: names_term(t, term))
        yes = _lines("Evet. ", title, " metninde “", term, "” kavramı açıkça yer almaktadır.\n\n")
        no = _lines(title, " metninde “", term, "” kavramı açıkça yer almamaktadır.\n\n",
                    "Kaynakta bu kavram açıkça bulunmadığı için, “", term, "” bakımından ",
                    "şart, sonuç, süre, talep veya uygulama değerlendirmesi yapamam.\n\n")
        return F.when(term.isNull(), strict).otherwise(with_disclaimer(_lines(
            "Kısa cevap:\n\n", F.when(found, yes).otherwise(no), V.LETTER_ONLY + "\n\n" + V.BASIS, title)))

    return let(technical_term(question), build)


def full_text_answer(law_name: Column, number: Column, text: Column) -> Column:
    title = _answer_title(law_name, number)
    return with_disclaimer(_lines(
        title, " metni aşağıdadır:\n\n", F.coalesce(text, F.lit("")), "\n\n" + V.BASIS, title,
        "\n\nBu cevap yalnızca ilgili madde metninin aktarımına ilişkindir; "
        "içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır."))


def paragraph_count_answer(law_name: Column, number: Column, paragraphs: Column) -> Column:
    title = _answer_title(law_name, number)
    count = F.coalesce(F.size(paragraphs), F.lit(0))
    missing = _lines(title, " için fıkra ayrıştırması mevcut değil.\n\n" + V.BASIS, title,
                     "\n\n" + V.STRUCTURE_ONLY)
    counted = _lines(title, " sistemde ", count.cast("string"), " fıkra olarak ayrıştırılmıştır.\n\n"
                     + V.BASIS, title, "\n\n" + V.STRUCTURE_ONLY[:-1]
                     + "; içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır.")
    return with_disclaimer(F.when(count <= 0, missing).otherwise(counted))


def paragraph_answer(question: Column, law_name: Column, number: Column, paragraphs: Column) -> Column:
    title = _answer_title(law_name, number)

    def build(no: Column) -> Column:
        body = F.coalesce(strip(F.get(F.filter(paragraphs, lambda p: p["no"] == no), F.lit(0))["text"]),
                          F.lit(""))
        basis = _lines("\n\n" + V.BASIS, title, "\n\n")
        unknown = _lines(title, " için istenen fıkra sistemde ayrıştırılmış olarak bulunamadı.",
                         basis, V.STRUCTURE_ONLY)
        absent = _lines(title, " içinde ", no, ". fıkra sistemde ayrıştırılmış olarak bulunamadı.",
                        basis, V.STRUCTURE_ONLY)
        found = _lines(title, " ", no, ". fıkra metni aşağıdadır:\n\n", body, basis,
                       "Bu cevap yalnızca ilgili fıkra metninin aktarımına ilişkindir; "
                       "içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır.")
        empty = no.isNull() | (F.coalesce(F.size(paragraphs), F.lit(0)) <= 0)
        return with_disclaimer(F.when(empty, unknown).when(body == "", absent).otherwise(found))

    return let(requested_paragraph(question), build)


def elements_answer(law_name: Column, number: Column, text: Column, strict: Column) -> Column:
    title = _answer_title(law_name, number)
    return let(strip_title(text), lambda body: F.when(body == "", strict).otherwise(with_disclaimer(_lines(
        "Kısa cevap:\n\n", title, " bakımından, sistemdeki madde metnine göre değerlendirme "
        "yalnızca şu lafzi çerçeveyle sınırlıdır:\n\n", body,
        "\n\nBu nedenle bu cevap, sadece madde metninde açıkça yer alan ifadelerle "
        "sınırlıdır; kaynakta bulunmayan doktrin, içtihat veya uygulama unsuru eklenmemiştir.\n\n"
        + V.BASIS, title))))


def explanation_answer(law_name: Column, number: Column, text: Column, strict: Column) -> Column:
    title = _answer_title(law_name, number)
    return let(strip_title(text), lambda body: F.when(body == "", strict).otherwise(with_disclaimer(_lines(
        "Kısa cevap:\n\n", title, ", madde metnine göre şu hükmü içerir: ", body,
        "\n\nBu açıklama yalnızca ilgili madde metnine dayalıdır; içtihat, doktrin "
        "veya uygulama değerlendirmesi yapılmamıştır.\n\n" + V.BASIS, title))))


def notice_answer(question: Column, label: Column, fallback: Column) -> Column:
    """Notice form with the source label filled in; other documents get the fallback."""
    source = F.coalesce(label, F.lit("ilgili mevzuat"))
    fill = lambda form: F.replace(F.lit(form), F.lit("{label}"), source)
    return let(canon(question), lambda q: F.when(
        q.contains("ihtar"),
        F.when(has_any(q, V.SHORT_NOTICE_WORDS), fill(V.SHORT_NOTICE)).otherwise(fill(V.LONG_NOTICE)),
    ).otherwise(fallback))


# --- answers over lists of sources: array<struct<label,text>> -----------------

def _bullets(items: Column, limit: int, start: int = 1) -> Column:
    return F.array_join(F.transform(
        F.slice(items, start, limit),
        lambda s: F.concat(F.lit("- ["), s["label"], F.lit("] "), s["text"])), "\n")


def _count(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def _sections(*parts: Column) -> Column:
    """Join the parts that are present, one per line."""
    return F.concat_ws("\n", *parts)


def fallback_answer(articles: Column, decisions: Column) -> Column:
    return _sections(
        F.lit(V.FALLBACK_HEAD),
        F.when(_count(articles) > 0, _sections(F.lit(V.FALLBACK_ARTICLES), _bullets(articles, 10))),
        F.when(_count(decisions) > 0, _sections(F.lit(V.FALLBACK_DECISIONS), _bullets(decisions, 3))),
        F.when((_count(articles) <= 0) & (_count(decisions) <= 0), F.lit(V.FALLBACK_NONE)),
        F.lit("\n" + V.DISCLAIMER))


def strict_answer(articles: Column, decisions: Column) -> Column:
    first = F.get(articles, F.lit(0))
    others = F.when(_count(articles) > 1, _sections(
        F.lit("İlgili Diğer Kaynaklar:"), _bullets(articles, 4, 2), F.lit("")))
    from_articles = _sections(
        F.lit("Kısa Cevap\n"), F.concat(first["label"], F.lit(" metnine göre:")), first["text"],
        F.lit(""), others, F.concat(F.lit(V.BASIS), first["label"]))
    from_decisions = _sections(F.lit(V.STRICT_DECISIONS), _bullets(decisions, 3))
    return (F.when(_count(articles) > 0, from_articles)
            .when(_count(decisions) > 0, from_decisions).otherwise(V.NO_SOURCE))


def no_decision_answer(articles: Column) -> Column:
    return _sections(
        F.lit(V.NO_DECISION_HEAD),
        F.when(_count(articles) > 0, _sections(
            F.lit(""), F.lit(V.NO_DECISION_LIST), _bullets(articles, 5))),
        F.lit(""), F.lit(V.DISCLAIMER))


def context_block(articles: Column, decisions: Column) -> Column:
    """Labelled source texts, articles then decisions."""
    blocks = F.transform(F.concat(articles, decisions), lambda s: F.concat(
        F.lit("["), s["label"], F.lit("]\n"), s["text"]))
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n---\n\n")).otherwise(V.EMPTY_CONTEXT)


# --- answer audit -------------------------------------------------------------

def term_groups(text: Column) -> Column:
    """Which groups of risky terms a text names: ``array<boolean>`` in group order."""
    return let(canon(text), lambda t: F.array(*[has_any(t, w) for w in V.UNSUPPORTED_TERMS.values()]))


def first_unsupported(answer_groups: Column, source_groups: list[Column]) -> Column:
    """First group named in the answer but in no source; null if there is none."""
    tests = [F.when(F.get(answer_groups, F.lit(i)) & ~F.coalesce(source, F.lit(False)), F.lit(name))
             for i, (name, source) in enumerate(zip(V.UNSUPPORTED_TERMS, source_groups))]
    return F.coalesce(*tests)


def forbidden_case_term(answer: Column) -> Column:
    return let(F.lower(answer), lambda a: F.coalesce(
        *[F.when(a.contains(t), F.lit(t)) for t in V.FORBIDDEN_CASE_TERMS]))


def law_alias_list(law_no: Column) -> Column:
    by_law: dict[str, list[str]] = {}
    for alias, (_, law) in ALIASES.items():
        by_law.setdefault(law, []).append(alias)
    joined = literal_map({law: "|".join(names) for law, names in by_law.items()})[law_no]
    return F.coalesce(F.split(joined, r"\|"), F.array().cast("array<string>"))


def cites_article(answer: Column, name: Column, law_no: Column, article_type: Column,
                  number: Column) -> Column:
    """Does the canonical answer hold a permitted citation of this article?"""
    law = F.coalesce(law_no, F.lit(""))
    numbers = F.when(law == "", F.array().cast("array<string>")).otherwise(
        F.array(law, F.concat(law, F.lit(" sayili kanun"))))
    names = F.concat(F.array(canon(name)), numbers, law_alias_list(law))
    plain = lambda alias, no: reduce(
        lambda x, y: x | y,
        [F.contains(answer, F.concat(alias, F.lit(form), no)) for form in V.CITATION_FORMS])
    typed = lambda alias, no: F.contains(answer, F.concat_ws(
        " ", alias, article_type, no)) | F.contains(answer, F.concat_ws(
            " ", alias, article_type, F.lit("madde"), no))
    kept = F.filter(names, lambda a: a != "")
    no = canon(F.coalesce(number, F.lit("?")))
    return F.exists(kept, lambda a: F.when(article_type == "madde", plain(a, no))
                    .otherwise(typed(a, no)))


def decision_label(chamber: Column, case_no: Column, decision_no: Column) -> Column:
    return F.concat(F.coalesce(chamber, F.lit("Mahkeme")), F.lit(" - "),
                    F.coalesce(case_no, F.lit("?")), F.lit(" / "), F.coalesce(decision_no, F.lit("?")))


