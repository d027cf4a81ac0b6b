"""Mixing sources to target weights.

Rows get hash-random keys.  A source is cut into equal ranges of the key, each range is sorted, and
running word counts are put together from the ranges' sums, so that a source of any size is spread.
Each source is cut at its exact budget: whole epochs first, then the head of the random order, the
last row in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import numbered

#: Ranges of the random key per source: 2**RANGE_BITS.
RANGE_BITS = 10
WEIGHTS = (3.0, 1.0, 2.0)
_BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs without blanks and the controls 9 to 13; null counts 0."""
    bare = F.ltrim(text, F.lit(_BLANKS))
    return F.coalesce(F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn and share ``share`` times all sizes
    by weight; a target stops at ``most`` times its source's size, and the rest is shared anew.  That
    level is where the sources, in the order of size per weight, no longer fill up: with everything
    before a source filled, its share by weight of what is left still reaches its own bound.
    """
    nulls_last = [F.col("source").isNull(), F.col("source")]
    # one row per source; the windows without a key see the sources only
    ranked = sources.withColumn("nth", F.row_number().over(Window.orderBy(*nulls_last)) - 1)
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fill", "nth").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measured = (ranked.withColumn("weight", choice).withColumn("bound", most * F.col("source_size"))
                .withColumn("fill", F.col("bound") / F.col("weight"))
                .withColumn("total", share * F.sum("source_size").over(everyone)).withColumn("weights", F.sum("weight").over(everyone))
                .withColumn("left", F.col("total") - F.coalesce(F.sum("bound").over(by_fill), F.lit(0.0)))
                .withColumn("rest", F.col("weights") - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0))))
    # the first source in that order whose share stays below its bound sets the level
    level = F.min(F.when(F.col("left") / F.col("rest") < F.col("fill"), F.struct("fill", "nth", (F.col("left") / F.col("rest")).alias("level"))))
    open_level = measured.withColumn("level", level.over(everyone).getField("level"))
    return open_level.select("source", "source_size", F.least(F.col("bound"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))


def _plan(sizes: DataFrame, seed: int, weights, share, most) -> DataFrame:
    """Sizes with key, source_size, target and the words before each row in its source's random order."""
    keyed = (sizes.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "content"))
             .withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS)))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    whole = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    ahead = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    base = (ranges.withColumn("ahead", ahead).join(whole.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead", "source_size", "target"))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "content", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return (inside.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
            .withColumn("before", F.col("inside") + F.col("ahead")))


def budgets(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
            key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, epochs, tail): what the mix takes of each row.

    taken counts words: ``epochs`` times all of them, and the first ``tail`` once more.  A null or empty
    text has size 0 and is never taken; null sources are one source, the last; rows with equal keys are
    ordered by content, and equal rows share what they get in any order.  Reruns give the same rows.
    An empty table gives no rows.
    """
    sizes = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"),
                        F.xxhash64(F.col(text).cast("string")).alias("content"))
    # the whole words of the target; a target is at most ``most`` times the source's size
    goal = F.floor("target")
    epochs = F.when(F.col("size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    out = _plan(sizes, seed, weights, share, most).withColumn("epochs", epochs).withColumn(
        "tail", F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("epochs") * F.col("source_size") - F.col("before"))).cast("long"))
    return out.select(F.col("doc_id").alias(key), "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + F.col("tail")).alias("taken"), "epochs", "tail", "content")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows, with the columns of ``docs``: each row once per epoch taken, the last one cut after ``tail`` words.

    Rows of equal key and content are told apart by their number only: those with most words to give come
    first.  Every column but the cut text stays as it is.
    """
    names = docs.columns
    docs, (key, text, source) = numbered(docs, key, text, source)
    plan = budgets(docs, seed, weights, share, most, key, text, source)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    alike = plan.groupBy(name(key).alias("_key"), F.col("content").alias("_content"), F.col("epochs").alias("_epochs"), F.col("tail").alias("_tail")).agg(
        F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy("_key", "_content").orderBy(F.desc("_epochs"), F.desc("_tail")))
    alike = alike.withColumn("_upto", upto).filter("_epochs > 0 or _tail > 0")
    rows = docs.withColumn("_k", name(key)).withColumn("_c", F.xxhash64(F.col(text).cast("string")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_c").orderBy(F.col(source))))
    joined = rows.join(alike, (F.col("_k") == F.col("_key")) & (F.col("_c") == F.col("_content")) & (F.col("_n") <= F.col("_upto"))
                       & (F.col("_n") > F.col("_upto") - F.col("_rows")))
    # one entry per copy: null for the whole text, a word count for a cut one
    whole = F.array_repeat(F.lit(None).cast("long"), F.col("_epochs").cast("int"))
    own_tail = F.when(F.col("_tail") < word_count(F.col(text)), F.col("_tail"))
    copies = F.when(F.col("_tail") > 0, F.concat(whole, F.array(own_tail))).otherwise(whole)
    cut = joined.withColumn("_cut", F.explode(copies))
    return cut.select(*[F.when(F.col("_cut").isNull(), F.col(c)).otherwise(first_words(F.col(c), F.col("_cut"))).alias(c) if c == text else F.col(c)
                        for c in docs.columns]).toDF(*names)
