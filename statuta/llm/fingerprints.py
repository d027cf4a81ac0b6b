"""Document fingerprints from invertible Bloom lookup sketches of paragraph digests.

A text is a set of digests of short paragraphs (lines, cut every PIECE code points).  The set is dealt
by hash into groups, and every group is a small table of cells; a cell holds the count, the XOR of the
digests and the XOR of their check hashes.  Tables of two versions are subtracted cell by cell, and peeling
reads the differing digests from cells that hold a single one.  A group that cannot be peeled is tried
again in a larger table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 128
#: Digests a group is made for, tables per group, cells of each table in the attempts, rounds of peeling.
GROUP_LOAD, TABLES, CELLS, ROUNDS = 12, 4, (12, 24, 48), 8
_NULL_ID = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs, ascending."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x))))


def group_count(n: Column) -> Column:
    """Power of two of groups for n digests."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), n / GROUP_LOAD)))).cast("int")


def _group(digest: Column, groups: Column) -> Column:
    return F.pmod(digest, groups).cast("int")


def by_group(digests: Column, groups: Column) -> Column:
    """Digests in the order of their groups."""
    return F.array_sort(F.transform(digests, lambda d: F.struct(_group(d, groups).alias("g"), d.alias("d"))))


def members(numbers: Column, ordered: Column, g: Column) -> Column:
    """Digests of one group: a slice of the ordered ones; numbers are their groups."""
    first = F.array_position(numbers, g)
    size = F.array_position(F.reverse(numbers), g)
    return F.when(first == 0, F.array().cast("array<bigint>")).otherwise(
        F.slice(ordered, first.cast("int"), (F.size(numbers) - size - first + 2).cast("int")))


def _cell(digest: Column, table: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(cells), table, digest), F.lit(cells)).cast("int")


def check(digest: Column) -> Column:
    return F.xxhash64(F.lit(977), digest)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a name for the value, which is then computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(digests: Column, cells: int) -> Column:
    """Cells of the tables of one group: TABLES * cells of (n, key, chk)."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("chk"))

    def filled(own: Column) -> Column:
        return F.struct(F.size(own).alias("n"), _xor(own).alias("key"), _xor(F.transform(own, check)).alias("chk"))

    def table(t: int) -> Column:
        return _let(F.transform(digests, lambda d: _cell(d, F.lit(t), cells)), lambda at: F.transform(
            F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.when(~F.array_contains(at, i), empty).otherwise(
                _let(F.filter(digests, lambda d, k: F.get(at, k) == i), filled))))

    return F.concat(*[table(t) for t in range(TABLES)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x.n - y.n).alias("n"), x.key.bitwiseXOR(y.key).alias("key"), x.chk.bitwiseXOR(y.chk).alias("chk")))


def peel(difference: Column, cells: int) -> Column:
    """(n, key, at) of the differing digests, n = 1 on the left side and -1 on the right; null if cells are left over."""
    def places(d: Column) -> Column:
        return F.array(*[_cell(d, F.lit(t), cells) + t * cells for t in range(TABLES)])

    def pure(now: Column) -> Column:
        single = F.filter(now, lambda c: (F.abs(c.n) == 1) & (check(c.key) == c.chk))
        return F.array_distinct(F.transform(single, lambda c: F.struct(c.n.alias("n"), c.key.alias("key"), places(c.key).alias("at"))))

    def less(c: Column, p: Column) -> Column:
        return F.struct((c.n - p.n).alias("n"), c.key.bitwiseXOR(p.key).alias("key"), c.chk.bitwiseXOR(check(p.key)).alias("chk"))

    def removed(now: Column, keys: Column) -> Column:
        return _let(F.flatten(F.transform(keys, lambda p: p.at)), lambda touched: F.transform(now, lambda c, i: F.when(
            ~F.array_contains(touched, i), c).otherwise(F.aggregate(keys, c, lambda x, p: F.when(F.array_contains(p.at, i), less(x, p)).otherwise(x)))))

    def step(state: Column, _: Column) -> Column:
        return _let(pure(state.cells), lambda keys: F.when(F.size(keys) == 0, state).otherwise(
            F.struct(removed(state.cells, keys).alias("cells"), F.concat(state.found, keys).alias("found"))))

    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<n:int,key:bigint,at:array<int>>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(
        ~F.exists(s.cells, lambda c: (c.n != 0) | (c.key != 0) | (c.chk != 0)), s.found))


def recovered(a: Column, b: Column) -> Column:
    """Number of differing digests of one group, by the smallest table that can be peeled; sets that defeat all sizes are compared themselves."""
    attempts = [_let(peel(subtract(sketch(a, c), sketch(b, c)), c), lambda found: F.when(found.isNotNull(), F.size(found))) for c in CELLS]
    return F.coalesce(*attempts, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def differing(frame: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the number of digests that two digest columns do not share; both are built at the size of the larger."""
    groups = group_count(F.greatest(F.size(a), F.size(b)))
    cut = frame.withColumn("_g", groups).withColumn("_oa", by_group(F.col(a), F.col("_g"))).withColumn("_ob", by_group(F.col(b), F.col("_g")))
    parts = cut.withColumn("_na", F.col("_oa.g")).withColumn("_da", F.col("_oa.d")).withColumn("_nb", F.col("_ob.g")).withColumn("_db", F.col("_ob.d"))
    listed = parts.withColumn("_groups", F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda g: F.struct(
        members(F.col("_na"), F.col("_da"), g).alias("a"), members(F.col("_nb"), F.col("_db"), g).alias("b"))))
    counts = F.transform("_groups", lambda p: F.when(p.a == p.b, 0).otherwise(recovered(p.a, p.b)))
    return listed.withColumn(out, F.aggregate(counts, F.lit(0), lambda x, y: x + y)).drop("_g", "_oa", "_ob", "_na", "_da", "_nb", "_db", "_groups")


def likeness(a: Column, b: Column, d: Column) -> Column:
    """Jaccard similarity from two set sizes and the number of differing members; two empty sets are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def fingerprint(digests: Column) -> Column:
    """Name of the sketch of a set: its size and groups, and the XOR, sum and count sketch of all groups hashed."""
    groups = group_count(F.size(digests))
    cells = F.transform(digests, lambda d: F.struct(_group(d, groups).alias("g"), *[_cell(d, F.lit(t), CELLS[0]).alias(f"c{t}") for t in range(TABLES)],
                                                    check(d).alias("chk"), d.alias("d")))
    return F.concat_ws(":", F.size(digests).cast("string"), groups.cast("string"), F.sha2(F.to_json(F.array_sort(cells)), 256))


def successors(ids: DataFrame) -> DataFrame:
    """(k, next) of distinct 64-bit ids: the next larger one, the least one after the last.

    Ids are dealt by their upper bits; the last of each bucket looks to the next bucket, level by level, so
    that no window sees more than 65,536 rows.
    """
    level = ids.select(F.col("k").alias("p0"), F.col("k").alias("m0"))
    levels = []
    for n in range(4):
        up = F.shiftright(f"p{n}", 16)
        window = Window.partitionBy(f"p{n + 1}").orderBy(f"p{n}") if n < 3 else Window.orderBy(f"p{n}")
        if n < 3:
            level = level.withColumn(f"p{n + 1}", up)
        else:
            level = level.withColumn("least", F.min(f"m{n}").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        levels.append(level.withColumn(f"n{n}", F.lead(f"m{n}").over(window)))
        if n < 3:
            level = level.groupBy(f"p{n + 1}").agg(F.min(f"m{n}").alias(f"m{n + 1}"))
    joined = reduce(lambda low, n: low.join(levels[n].drop(f"m{n}"), f"p{n}"), range(1, 4), levels[0])
    return joined.select(F.col("p0").alias("k"), F.coalesce("n0", "n1", "n2", "n3", "least").alias("next"))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: Callable[[Column], Column] = paragraphs) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text keeps the first half and ends in the start of the next document's text, by ascending
    integer key; the last one is followed by the first.  A null key comes before all others; rows of equal
    keys share their next document, whose text is the least one where several have its key.  A null
    text is empty; texts without paragraphs are alike.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("k"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("k").agg(F.max(F.floor(F.length("text") / 2)).alias("half"))
    after = successors(ids.select("k"))
    needs = after.join(ids, "k").select(F.col("next").alias("nk"), F.col("k").alias("asker"), "half")
    first = Window.partitionBy("k").orderBy("text")
    # told by the row before it: a rank would be cut before the exchange, which the result could then not share
    givers = rows.withColumn("above", F.lag("k").over(first)).filter("above is null").join(needs, F.col("k") == F.col("nk"))
    # the key rides along, so that both uses of the texts ask the exchange for the same columns
    given = givers.select("asker", F.substring("text", F.lit(1), F.col("half").cast("int")).alias("head"), digests(F.col("text")).alias("dn"),
                          F.col("key").alias("next_key"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    whole = rows.join(given, F.col("k") == F.col("asker"), "left").select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", "dn", "next_key")
    digested = whole.select("key", "n_chars", "next_key", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("da"),
                            digests(F.col("edited")).alias("de"), F.coalesce("dn", F.array().cast("array<bigint>")).alias("dn"))
    counted = differing(differing(digested, "da", "de", "d_edited"), "da", "dn", "d_next")
    return counted.select(F.col("key").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("da")).alias("fingerprint"),
                          fingerprint(F.col("de")).alias("edited_fingerprint"), likeness(F.col("da"), F.col("de"), F.col("d_edited")).alias("near_edited"),
                          likeness(F.col("da"), F.col("dn"), F.col("d_next")).alias("near_next"), F.col("next_key").alias("next_doc_id"))
