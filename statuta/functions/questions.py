"""Question classes.  Raw-question flags read the raw column; the others the resolved one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import canon, has_any, has_word, let, literal_array, strip

_CASE = r"\b(?:19|20)\d{2}\s*/\s*\d+\b"


def _tokens(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit("[a-z]+"), F.lit(0))


def _words(words: list[str]) -> Column:
    return literal_array(words)


def wants_decisions(question: Column) -> Column:
    """Court words, or a decision word together with a legal-context word."""
    return let(canon(question), lambda q: has_word(q, V.STRONG_DECISION_WORDS)
               | (has_any(q, V.DECISION_WORDS) & has_any(q, V.ARTICLE_TERMS)))


def is_case_number_query(question: Column) -> Column:
    """Nothing but a case number and words of asking for it."""
    return let(canon(question), lambda q: q.rlike(_CASE) & ~has_any(q, V.ARTICLE_TERMS)
               & (F.size(F.array_except(_tokens(q), _words(V.CASE_QUERY_WORDS))) == 0))


def is_generic_decision_query(question: Column) -> Column:
    """Asks for decisions without any topic, article or number."""
    allowed = V.DECISION_WORDS + V.SEARCH_WORDS + V.COURT_WORDS + V.GENERIC_EXTRA_WORDS

    def test(q: Column) -> Column:
        return let(_tokens(q), lambda t: F.arrays_overlap(t, _words(V.DECISION_WORDS))
                   & F.arrays_overlap(t, _words(V.SEARCH_WORDS + V.COURT_WORDS))
                   & (F.size(F.array_except(t, _words(allowed))) == 0))

    return let(canon(question), lambda q: ~q.rlike(_CASE) & ~has_any(q, V.ARTICLE_TERMS) & test(q))


def asks_text_contains(question: Column) -> Column:
    return let(canon(question), lambda q: has_any(q, V.CONTAINS_PLACE_WORDS)
               & has_any(q, V.CONTAINS_ASK_WORDS))


def contains_phrase(question: Column) -> Column:
    """The phrase asked for in a text-contains question; empty if it has no such form."""
    pattern = (r"(?iu)(?:içinde|icinde|içerisinde|icerisinde|metninde|lafzında|lafzinda)\s+(.+?)\s+"
               r"(?:geçiyor\s+mu|geciyor\s+mu|geçer\s+mi|gecer\s+mi|var\s+mı|var\s+mi|"
               r"yer\s+alıyor\s+mu|yer\s+aliyor\s+mu)\??$")
    return let(strip(question), lambda q: F.btrim(
        F.trim(F.regexp_extract(q, pattern, 1)), F.lit("“”\"'`.,;:!? ")))


def technical_term(question: Column) -> Column:
    """First technical term group named in the question; null if none."""
    def pick(q: Column) -> Column:
        return F.coalesce(*[F.when(has_any(q, words), F.lit(name))
                            for name, words in V.TECHNICAL_TERMS.items()])
    return let(canon(question), pick)


def asks_technical_term(question: Column) -> Column:
    return let(canon(question), lambda q: has_any(q, V.TECHNICAL_ASK_WORDS)) \
        & technical_term(question).isNotNull()


def asks_full_text(question: Column) -> Column:
    return has_any(canon(question), V.FULL_TEXT_WORDS)


def asks_paragraph_count(question: Column) -> Column:
    return has_any(canon(question), V.PARAGRAPH_COUNT_WORDS)


def requested_paragraph(question: Column) -> Column:
    """Number of the paragraph asked for (words up to ten, or digits); null if none."""
    def pick(q: Column) -> Column:
        words = [F.when(q.contains(f"{w} fikra"), F.lit(n)) for w, n in V.PARAGRAPH_ORDINALS.items()]
        digits = F.nullif(F.regexp_extract(q, r"\b(\d+)\s*\.?\s*fikra\b", 1), F.lit(""))
        return F.when(q.contains("fikra"), F.coalesce(*words, digits))
    return let(canon(question), pick)


def asks_elements(question: Column) -> Column:
    return let(canon(question), lambda q: has_any(q, V.ELEMENT_WORDS)
               & ~has_any(q, V.DRAFT_WORDS + V.ELEMENT_DECISION_WORDS))


def asks_explanation(question: Column) -> Column:
    return let(canon(question), lambda q: has_any(q, V.EXPLAIN_WORDS) & ~has_any(q, V.DRAFT_WORDS))


def is_plain_lookup(question: Column, refs: Column) -> Column:
    """One reference with a law and at most five tokens, nothing special asked."""
    one = F.get(refs, F.lit(0))
    return let(canon(question), lambda q: (F.size(refs) == 1) & one["law_no"].isNotNull()
               & ~has_any(q, V.PLAIN_LOOKUP_EXCLUDED)
               & (F.regexp_count(q, F.lit("[a-z0-9]+")) <= 5))


def asks_document(question: Column) -> Column:
    return has_any(canon(question), V.DOCUMENT_WORDS)


def asks_template(question: Column) -> Column:
    """A document request for a standard form, or a notice without stated facts."""
    return let(canon(question), lambda q: has_any(q, V.DOCUMENT_WORDS)
               & (has_any(q, V.TEMPLATE_WORDS)
                  | (q.contains("ihtar") & ~has_any(q, V.FACT_WORDS))))


ROUTES = [
    ("deterministic_article_text_contains", asks_text_contains),
    ("deterministic_source_strict_technical_article", asks_technical_term),
    ("deterministic_article_full_text", asks_full_text),
    ("deterministic_article_paragraph_count", asks_paragraph_count),
    ("deterministic_article_specific_paragraph", lambda q: requested_paragraph(q).isNotNull()),
    ("deterministic_article_elements", asks_elements),
]


def route(raw: Column, resolved: Column, refs: Column, has_direct: Column, has_articles: Column,
          has_decisions: Column) -> Column:
    """Answer path of a question; the first test that holds decides."""
    out = (F.when(is_case_number_query(raw), "deterministic_pure_case_number")
           .when(is_generic_decision_query(raw), "deterministic_generic_karar_search"))
    for name, test in ROUTES:
        out = out.when(has_direct & test(resolved), name)
    return (
        out.when(has_direct & is_plain_lookup(resolved, refs), "deterministic_plain_article_lookup")
        .when(~has_articles & ~has_decisions, "deterministic_no_source")
        .when(wants_decisions(resolved) & ~has_decisions, "deterministic_no_karar")
        .when(asks_template(resolved), "deterministic_document_template")
        .otherwise("llm_generation"))


def search_route(query: Column) -> Column:
    """Path of a decision search: generic, case number, decisions only, or mixed."""
    return (F.when(is_generic_decision_query(query), "generic")
            .when(is_case_number_query(query), "case_number")
            .when(wants_decisions(query), "decision_only").otherwise("mixed"))
