"""Alias tables derived once from the dictionaries, and the lookups built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _fold, literal_map, quote


def _canonical(text: str) -> str:
    return "".join(_fold(ch) for ch in text.strip())


# canonical alias -> (rank, law)
ALIASES: dict[str, tuple[int, str]] = {}
for _alias, _law in V.LAW_ALIASES.items():
    ALIASES.setdefault(_canonical(_alias), (len(ALIASES), _law))

_named = [a for a in ALIASES if not a.isdigit()]
SHORT_ALIASES = [a for a in _named
                 if len(a.split()) <= V.SHORT_ALIAS_MAX_WORDS and len(a) <= V.SHORT_ALIAS_MAX_CHARS]
EXPLICIT_ALIASES = [a for a in _named if a not in V.AMBIGUOUS_ALIASES]


def alternation(names: list[str]) -> str:
    """Longest name first, so that the longest one wins at a position."""
    return "(?:" + "|".join(quote(n) for n in sorted(names, key=len, reverse=True)) + ")"


SHORT_ALIAS_PATTERN = alternation(SHORT_ALIASES)
NAMED_ALIAS_PATTERN = alternation(_named)
EXPLICIT_ALIAS_PATTERN = alternation(EXPLICIT_ALIASES)
ANY_ALIAS_PATTERN = alternation(list(ALIASES))
REGULATION_PATTERN = alternation(list(V.REGULATION_ALIASES))


def law_of(alias: Column) -> Column:
    return literal_map({a: law for a, (_, law) in ALIASES.items()})[alias]


def rank_of(alias: Column) -> Column:
    return literal_map({a: rank for a, (rank, _) in ALIASES.items()})[alias]


def _longest(text: Column, pattern: str, rank: Column | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\w)({pattern})(?!\w)"), F.lit(1))
    scored = F.transform(found, lambda a: F.struct(
        F.length(a).alias("size"), (-rank(a) if rank else F.lit(0)).alias("rank"), a.alias("alias")))
    return F.array_max(scored)["alias"]


def detect_law(text: Column) -> Column:
    """Law of the longest alias in canonical text; earlier dictionary rank breaks ties."""
    return law_of(_longest(text, ANY_ALIAS_PATTERN, rank_of))


def detect_regulation(text: Column) -> Column:
    """struct(law_no, regulation_name) of the longest regulation alias; null if none."""
    return regulation_of(_longest(text, REGULATION_PATTERN))


def regulation_of(alias: Column) -> Column:
    code = literal_map(V.REGULATION_ALIASES)[alias]
    law = literal_map({c: law for c, (law, _) in V.REGULATIONS.items()})
    name = literal_map({c: name for c, (_, name) in V.REGULATIONS.items()})
    return F.when(code.isNotNull(), F.struct(law[code].alias("law_no"), name[code].alias("regulation_name")))


def names_a_law(text: Column) -> Column:
    """Does canonical text name a law outright (number form or a safe alias)?"""
    return text.rlike(r"\b\d{3,4}\s+sayili\s+kanun\b") | text.rlike(rf"(?U)\b{EXPLICIT_ALIAS_PATTERN}\b")


def alias_frame(spark: SparkSession) -> DataFrame:
    """The law aliases as a table with the subset flags."""
    rows = [(a, law, a in SHORT_ALIASES, a in EXPLICIT_ALIASES) for a, (_, law) in ALIASES.items()]
    return spark.createDataFrame(rows, "alias string, law_no string, is_short boolean, is_explicit boolean")
