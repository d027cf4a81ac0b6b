"""Removal of line passages that repeat across documents, by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where a chunk of lines ends, so that the
same passage is cut alike wherever it stands.  A chunk counts alone (from two lines on) and together with
the line before it and the line after it, which keeps the edges of a passage; independent cuttings
(seeds) make up for passages that one of them cuts badly.  Blocks found twice or more are compared byte
by byte; all but the first, in key order, lose their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import numbered

#: Lines under the rolling hash, cuttings, and in how many of CUT_OF cases a line does not end a chunk.
ROLL_LINES, SEEDS, CUT_OF = 2, (11, 23, 47), 4


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _rolled(hashes: Column, seed: int) -> Column:
    """For every line whether the hash rolled over it and the lines before ends a chunk there."""
    return F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(F.lit(seed), h, *[F.get(hashes, i - k) for k in range(1, ROLL_LINES)]), F.lit(CUT_OF)) != 0)


def _ends(cut: Column) -> Column:
    """Ends of the chunks of one cutting, ascending; the last is the number of lines."""
    return F.filter(F.sequence(F.lit(1), F.size(cut)), lambda e: (e == F.size(cut)) | F.get(cut, e - 1))


def _blocks(ends: Column, n: Column) -> Column:
    """[b, e) line ranges of a cutting's chunks, alone and with the line before or after."""
    chunks = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("b"), ends.alias("e"))
    around = F.flatten(F.transform(chunks, lambda c: F.array(
        F.struct(c["b"].alias("b"), c["e"].alias("e")), F.struct((c["b"] - 1).alias("b"), c["e"].alias("e")), F.struct(c["b"].alias("b"), (c["e"] + 1).alias("e")))))
    return F.filter(around, lambda s: (s.b >= 0) & (s.e <= n) & (s.e - s.b >= 2))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Row identity: the key as text and the hash of the content; equal rows are one document."""
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("\u0000")).alias("_k"), F.xxhash64(F.col(text).cast("string")).alias("_c"),
                       F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, _c, _key, b, e, hash): blocks of lines b to e-1 of every document; texts of one line have none."""
    rows = _named(docs, key, text).filter(F.instr("_text", "\n") > 0)
    hashed = rows.select("_k", "_c", "_key", F.transform(lines_of(F.col("_text")), lambda x: F.xxhash64(x)).alias("h"))
    # each step is a column of its own, as an array used inside a lambda is made anew for every element
    rolls = hashed.select("*", *[_rolled(F.col("h"), s).alias(f"_r{s}") for s in SEEDS])
    ends = rolls.select("_k", "_c", "_key", "h", *[_ends(F.col(f"_r{s}")).alias(f"_e{s}") for s in SEEDS])
    spans = ends.select("_k", "_c", "_key", "h", F.explode(F.array_distinct(F.concat(*[_blocks(F.col(f"_e{s}"), F.size("h")) for s in SEEDS]))).alias("s"))
    return spans.select("_k", "_c", "_key", F.col("s.b").alias("b"), F.col("s.e").alias("e"),
                        F.xxhash64(F.slice("h", F.col("s.b") + 1, F.col("s.e") - F.col("s.b"))).alias("hash"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))).withColumn("_c", F.xxhash64(F.col(text).cast("string")))


def _block(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span.getField("b") + 1, span.getField("e") - span.getField("b")), "\n")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, _c, _kept, _n_lines, _n_removed) beside the columns of ``docs``; see ``dedup`` and ``report``.

    Texts are dealt out once, by document; both uses of them read the same exchange.
    """
    found = blocks(docs, key, text)
    place = F.struct("_key", "_c", "b")
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    own = cut_lineage(found.join(often, "hash").groupBy(F.col("_k").alias("_mk"), F.col("_c").alias("_mc")).agg(
        F.collect_set(F.struct("b", "e", "hash", (~place.eqNullSafe(F.col("first"))).alias("later"))).alias("_cand")))
    joined = _rows(docs, key, text).join(own, (F.col("_k") == F.col("_mk")) & (F.col("_c") == F.col("_mc")), "left")
    lines = lines_of(F.coalesce(F.col(text).cast("string"), F.lit("")))
    # the other columns ride along, so that this side asks the exchange for the same columns as the result does
    others = F.struct(*[c for c in docs.columns if c != text], "_k", "_c")
    texts = joined.select("_k", "_c", lines.alias("lines"), others.alias("o"), F.explode("_cand").alias("s")).select(
        F.col("s.hash").alias("hash"), F.struct(_block(F.col("lines"), F.col("s")).alias("block"), "o").alias("v"))
    # unequal least and greatest bytes: the blocks of the hash are not all the same, and stay
    unlike = texts.groupBy("hash").agg(F.min("v").alias("least"), F.max("v").alias("most")).filter(
        "least.block != most.block").select("hash")
    spared = own.select("_mk", "_mc", F.explode("_cand").alias("s")).filter("s.later").join(
        unlike, F.col("s.hash") == F.col("hash"), "left_semi").groupBy(F.col("_mk").alias("_sk"), F.col("_mc").alias("_sc")).agg(
        F.collect_set("s.hash").alias("_spared"))
    marked = joined.join(spared, (F.col("_k") == F.col("_sk")) & (F.col("_c") == F.col("_sc")), "left")
    later = F.filter("_cand", lambda s: s.later & ~F.coalesce(F.array_contains("_spared", s.hash), F.lit(False)))
    with_gone = marked.withColumn("_gone", F.array_distinct(F.flatten(F.transform(later, lambda s: F.sequence(s.b, s.e - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    some = F.coalesce(F.size("_gone"), F.lit(0)) > 0
    split = with_gone.withColumn("_all", F.when(some, lines)).withColumn("_left", F.when(some, left))
    return (split.withColumn("_kept", F.when(some, F.array_join(F.transform("_left", lambda i: F.get("_all", i)), "\n")).otherwise(F.col(text)))
            .withColumn("_n_lines", F.when(F.coalesce(F.col(text).cast("string"), F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long"))
            .withColumn("_n_removed", F.when(some, F.size("_gone")).otherwise(0).cast("long")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns; texts lose the lines of passages that stood before.

    Order is by key (null first), then content hash, then line.  Null and empty texts stay as they are, as
    do texts of one line; a text all of whose lines go becomes empty; rows alike in key and text are one
    document and lose the same lines.
    """
    inner, (own_key, own_text) = numbered(docs, key, text)
    kept = remove_repeated(inner, own_key, own_text)
    return kept.select(*[F.col("_kept") if c == own_text else F.col(c) for c in inner.columns]).toDF(*docs.columns)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_removed, kept_text) of every row."""
    rows = docs.select(F.col(key).alias("c0"), F.col(text).alias("c1"))
    return remove_repeated(rows, "c0", "c1").select(
        F.col("c0").alias(key), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_text"))
