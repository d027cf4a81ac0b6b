"""Turkish number words and the question normaliser.

A replacement with a computed value is done without Python: matches are fenced
with control characters, the text is split at the fences, the fenced pieces are
rewritten with array functions and everything is joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import canon, let, literal_map, strip
from .aliases import SHORT_ALIAS_PATTERN, detect_law

FENCE, GAP = "\u0001", "\u0002"


def rewrite_matches(c: Column, pattern: str, template: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace each match; ``rewrite`` gets the match laid out by ``template``."""
    # Splitting puts the matches at the odd positions.
    pieces = F.split(F.regexp_replace(c, pattern, FENCE + template + FENCE), FENCE)
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, rewrite(p)).otherwise(p)), "")


def cardinal_value(c: Column) -> Column:
    """Sum of the words; hundred and thousand multiply; null on any unknown word."""
    return _cardinal_of(F.split(canon(c), r"(?U)\s+"))


def _cardinal_of(words: Column) -> Column:
    values = literal_map(V.CARDINALS)
    state = lambda total, current, known: F.struct(
        total.cast("bigint").alias("total"), current.cast("bigint").alias("current"),
        known.alias("known"))

    def step(acc: Column, word: Column) -> Column:
        return let(values[word].cast("bigint"), lambda value: add(acc, value))

    def add(acc: Column, value: Column) -> Column:
        scaled = F.greatest(F.lit(1), acc["current"]) * value
        thousand = value == 1000
        return state(
            F.when(thousand, acc["total"] + scaled).otherwise(acc["total"]),
            F.when(thousand, F.lit(0)).when(value == 100, scaled)
            .otherwise(acc["current"] + F.coalesce(value, F.lit(0))),
            acc["known"] & value.isNotNull(),
        )

    return F.aggregate(
        words, state(F.lit(0), F.lit(0), F.lit(True)), step,
        lambda acc: F.when(acc["known"], acc["total"] + acc["current"]))


def ordinal_value(c: Column) -> Column:
    """Last word is an ordinal; words before it are a cardinal.

    Round ordinals add to the cardinal, unit ordinals replace its last digit.
    """
    def join(base: Column, lead: Column) -> Column:
        return F.when(base.isin(V.ROUND_ORDINALS), lead + base).otherwise(lead - lead % 10 + base)

    def value(words: Column) -> Column:
        lead = _cardinal_of(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
        base = literal_map(V.ORDINALS)[F.element_at(words, -1)].cast("bigint")
        return let(base, lambda b: F.when(F.size(words) == 1, b).otherwise(
            let(lead, lambda n: join(b, n))))

    return let(F.split(canon(c), r"(?U)\s+"), value)


_WORD = r"(?U)\b[^\W\d_]+\b"


def fold_number_words(c: Column) -> Column:
    """Number words in ASCII spelling; other words untouched."""
    vocabulary = literal_map({w: w for w in (*V.CARDINALS, *V.ORDINALS)})
    return rewrite_matches(c, _WORD, "$0", lambda p: F.coalesce(vocabulary[canon(p)], p))


def split_compact_words(c: Column) -> Column:
    """Run-together number words are split at the word joints."""
    compact = literal_map(V.COMPACT_WORDS)
    return rewrite_matches(c, _WORD, "$0", lambda p: F.coalesce(compact[canon(p)], p))


def _fold_and_split(c: Column) -> Column:
    # One pass for the two functions above: a compact form wins over its own fold.
    both = literal_map({**{w: w for w in (*V.CARDINALS, *V.ORDINALS)}, **V.COMPACT_WORDS})
    return rewrite_matches(c, _WORD, "$0", lambda p: F.coalesce(both[canon(p)], p))


_CARDINAL_WORDS = "|".join(w for w in V.CARDINALS if w != "sifir")
_CARDINAL_RUN = rf"(?:{_CARDINAL_WORDS})(?:\s+(?:{_CARDINAL_WORDS}))*"
_ORDINAL_RUN = rf"(?:(?:{_CARDINAL_WORDS})\s+)*(?:{'|'.join(V.ORDINALS)})"
_UNIT_WORD = r"(?:maddesi|madde|fikrasi|fikra|fıkrası|fıkra|bendi|bent)"
_ARTICLE_WORD = r"(?:m\.?|md\.?|madd?e(?:si)?)"


def digits_for_ordinals(c: Column) -> Column:
    """``yuz on dorduncu madde`` becomes ``114. madde``."""
    return rewrite_matches(
        c, rf"(?iU)\b({_ORDINAL_RUN})\s+({_UNIT_WORD})\b", "$1" + GAP + "$2",
        lambda p: F.concat(
            ordinal_value(F.split_part(p, F.lit(GAP), F.lit(1))).cast("string"), F.lit(". "),
            F.split_part(p, F.lit(GAP), F.lit(2))))


def digits_for_cardinals(c: Column) -> Column:
    """Cardinal words after an article word or a short law alias become digits; elsewhere
    only when the text names a law or an article."""
    def after(prefix: str, text: Column) -> Column:
        return rewrite_matches(
            text, rf"(?iU)\b({prefix})\s+({_CARDINAL_RUN})\b", "$1" + GAP + "$2",
            lambda p: F.concat_ws(
                " ", F.split_part(p, F.lit(GAP), F.lit(1)),
                cardinal_value(F.split_part(p, F.lit(GAP), F.lit(2))).cast("string")))

    def rest(out: Column) -> Column:
        spelled = out.rlike(rf"(?iU)\b(?:{_CARDINAL_WORDS})\b")
        legal = let(canon(out), lambda t: detect_law(t).isNotNull()
                    | t.rlike(r"\b(?:m\.|md\.|madde|maddesi)\b"))
        general = rewrite_matches(
            out, rf"(?iU)\b{_CARDINAL_RUN}\b", "$0", lambda p: cardinal_value(p).cast("string"))
        return F.when(spelled & legal, general).otherwise(out)

    return let(after(SHORT_ALIAS_PATTERN, after(_ARTICLE_WORD, c)), rest)


def normalise_question(c: Column) -> Column:
    """The whole question normaliser, in a fixed order of rewrites."""
    q = F.coalesce(c, F.lit(""))
    # abbreviations
    q = F.regexp_replace(q, r"(?iU)\byon\.\s*", "yonetmeligi ")
    q = F.regexp_replace(q, r"(?iU)\byon\s+(?=\d)", "yonetmeligi ")
    q = F.regexp_replace(q, r"(?iU)\bk\.\s*(?=\d)", "kanunu ")
    q = _fold_and_split(q)
    # 7/2-a and 114/1
    q = F.regexp_replace(q, r"(?U)\b(\d+)\s*/\s*(\d+)\s*-\s*([a-zA-Z])\b", "$1 $2. fıkra $3 bendi")
    q = F.regexp_replace(q, r"(?U)\b(\d+)\s*/\s*(\d+)\b", "$1 $2. fıkra")
    q = digits_for_cardinals(digits_for_ordinals(q))
    # spacing
    q = F.regexp_replace(q, r"(?iU)\bm\s*\.\s*(\d+)\b", "m. $1")
    q = F.regexp_replace(q, r"(?iU)\bmd\s*\.\s*(\d+)\b", "md. $1")
    return strip(F.regexp_replace(q, r"(?U)\s{2,}", " "))


