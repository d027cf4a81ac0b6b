"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Every one of the 64 bits gets a nonzero label of ``radius + 1`` bits.  A mask keeps the bits whose label has
an odd overlap with the mask's own number; whatever ``radius`` bits differ, some number is even with all their
labels, so that mask hides them all and the two fingerprints meet in its table.  ``2^(radius+1) - 1`` masks
cover every pair within the radius, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import components

BITS, SEED = 64, 42
#: Fingerprints of a bucket that are compared with each other; larger buckets meet over shared halfway points.
COMPARED = 16


# --- fingerprints -------------------------------------------------------------------

def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words of the text in ASCII lower case, as an unsigned number."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    hashes = np.fromiter((digest(line[b:e], SEED) for b, e in zip(begins.tolist(), last.tolist(), strict=False)), np.uint64, len(last))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; bits are counted in strips of bounded size."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        strip = hashes[k:k + (1 << 16)].astype("<u8")
        counts += np.unpackbits(strip.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp) of every row: the fingerprint's 64 bits as a long.  Null and wordless texts have 0."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py() or "", width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


# --- the tables -----------------------------------------------------------------------

def masks(radius: int) -> list[int]:
    """The covering masks of 64 bits for a radius; labels are dealt evenly, so that a mask hides about half of the bits."""
    numbers = 1 << (radius + 1)
    labels = [1 + i % (numbers - 1) for i in range(BITS)]
    return [sum(1 << i for i, own in enumerate(labels) if (own & v).bit_count() % 2) for v in range(1, numbers)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _shared_points(fp: Column, hidden: Column, radius: int) -> Column:
    """Points that a fingerprint shares with exactly those that differ from it in at most two hidden bits:
    itself and all points one hidden bit away.  A larger radius adds the points of its further halves."""
    points = F.array(fp)
    for _ in range((radius + 1) // 2):
        flipped = F.flatten(F.transform(points, lambda p: F.transform(
            F.filter(F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)]), lambda bit: bit.bitwiseAND(hidden) != 0),
            lambda bit: p.bitwiseXOR(bit))))
        points = F.array_distinct(F.concat(points, flipped))
    return points


def links(prints: DataFrame, radius: int = 2, compared: int = COMPARED) -> DataFrame:
    """(u, v) of distinct fingerprints ``fp`` that differ in 1 to ``radius`` bits: enough to connect all that do.

    Buckets of up to ``compared`` fingerprints give their linked pairs.  In a larger bucket every fingerprint is
    dealt to the points at most half the radius away inside the bits that the mask hides: two meet exactly
    when they are within the radius (within one more, where it is odd: those are compared), a point holds few
    fingerprints, and the members of a point are tied to its least.
    """
    hides = [_signed(~m & ((1 << BITS) - 1)) for m in masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(h).alias("hidden")) for t, h in enumerate(hides)]))
    dealt = prints.select("fp", tables.alias("m")).select(
        "fp", F.col("m.t").alias("t"), F.col("m.hidden").alias("hidden"), F.col("fp").bitwiseAND(F.bitwise_not(F.col("m.hidden"))).alias("bucket"))
    sizes = dealt.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut_lineage(dealt.join(sizes, ["t", "bucket"]))
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    small = held.where(F.col("n") <= compared).groupBy("t", "bucket").agg(F.collect_list("fp").alias("own"))
    close = F.flatten(F.transform("own", lambda a, i: F.transform(
        F.filter(F.slice("own", F.lit(1), i), lambda b: _far(a, b) <= radius), lambda b: pair(a, b))))
    near = small.select(F.explode(close).alias("p")).select("p.*")
    points = held.where(F.col("n") > compared).select(
        "t", "fp", F.explode(_shared_points(F.col("fp"), F.col("hidden"), radius)).alias("point"))
    met = points.groupBy("t", "point").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1)
    least = F.array_min("own")
    tied = close if radius % 2 else F.transform(F.filter("own", lambda a: a != least), lambda a: pair(a, least))
    return near.unionByName(met.select(F.explode(tied).alias("p")).select("p.*")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(key, fp, component_id) of every row: the least key that links reach, its own included.

    Fingerprints link at ``radius`` or fewer differing bits; equal ones always do, and so do the zeros of null
    and wordless texts.  Rows with equal keys stay rows of their own, a null key is never a component's least
    unless there is no other, other columns are not read, an empty table gives no rows.
    """
    held = cut_lineage(fingerprints(docs, key, text, width))
    prints = held.groupBy("fp").agg(F.min("key").alias("least"))
    tied = components(links(prints, radius))
    labelled = prints.join(tied.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = labelled.join(least, "label").select("fp", "component_id")
    out = held.join(whole, "fp").select("key", "fp", "component_id")
    return out.toDF(key, *(c if c != key else f"{c}_" for c in out.columns[1:]))


def hexed(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
