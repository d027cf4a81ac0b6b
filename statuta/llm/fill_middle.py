"""Fill-in-the-middle rewriting of texts with one counted regular expression per row.

``regexp_count`` gives the number n of units of a text; two hashed cuts a <= b of n become the pattern
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z``.  Its possessive counts never give a unit back, so a single
match holds prefix, middle and suffix, and a single ``regexp_replace`` writes them down in their new order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A unit is a word with the white space before it, or white space at the end of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# A mark that repeats its own beginning at its end could be found a character too early behind a text.
_RESTORE = {"psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
            "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")}


def units(text: Column) -> Column:
    """Number of units of a text, null for a null one."""
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def cut_pattern(a: Column, b: Column) -> Column:
    """The row's own pattern: a units, b - a units, the rest."""
    counted = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"(?s)\A"), counted(a), counted(b - a), F.lit(r"(.*)\z"))


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50,
              spm_rate: int = 80) -> DataFrame:
    """(key, text, n, form, prefix_chars, middle_chars, output) of every row.

    Of the texts, ``rate`` percent are rewritten, of those ``spm_rate`` percent as ``spm``
    (``<S>suffix<P>prefix<M>middle``), the others as ``psm`` (``<P>prefix<S>suffix<M>middle``).  An empty or
    null text and one that holds a mark stay ``plain``, with null lengths.  The draws hang on the key alone:
    equal rows get equal results, reruns agree, rows with a null key draw as an empty key.  Other columns
    are not read; an empty table gives no rows.  Lengths count code points.
    """
    h1, h2, h3, h4 = (F.col(f"h{i}") for i in range(1, 5))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    drawn = rows.select("*", units(F.col("text")).alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("key"), seed), 1)])
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    cuts = [h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)]
    formed = drawn.select("key", "text", "n", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
                          F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    order = F.when(F.col("form") == "psm", F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")).otherwise(F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.regexp_replace(F.col("text"), cut_pattern(F.col("a"), F.col("b")), order))
    written = formed.select("key", "text", "n", "form", output.alias("output"))
    p, s, m = (F.instr(F.col("output"), mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    prefix = F.when(F.col("form") == "psm", s - p - len(PREFIX)).when(F.col("form") == "spm", m - p - len(PREFIX))
    middle = F.when(F.col("form") != "plain", F.length("output") - m - len(MIDDLE) + 1)
    out = written.select("key", "text", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")
    return out.toDF(key, *[c if c != key else f"{c}_" for c in out.columns[1:]])


def restored(output: Column, form: Column) -> Column:
    """The text before the rewriting, from output and form alone."""
    out = F.when(form == "plain", output)
    for name, (pattern, parts) in _RESTORE.items():
        out = out.when(form == name, F.regexp_replace(output, pattern, parts))
    return out


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    done = transform(docs, key, text)
    output, form = F.col("output"), F.col("form")
    return done.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"),
                       F.sha2(restored(output, form), 256).alias("restored_sha256"))


#: The same rows by lists of units instead of counted patterns.
SQL = """
with units as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u,
         sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
drawn as (
  select doc_id, text, u, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
         cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix
  from cut)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
