"""Similarity join on sets of word n-grams with Bayesian pruning of candidates.

Texts with the same n-gram set are one node.  Nodes that agree on a band of MinHash values are
candidates; candidates are dealt out in pairs of blocks, where MinHash values are compared a few at a
time and a pair is dropped once the posterior probability that its Jaccard similarity reaches the
threshold falls below a tolerance.  What remains is verified on the whole sets.  No pair becomes a row:
a block pair returns, for each node, its number of links and its place in a spanning forest.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import pretokens as P
from .columns import keyed, numbered
from .components import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: A pair at the threshold shares no band with probability (1 - 0.8 ** 4) ** 24, about 3e-6.
BANDS, BAND_ROWS, HASHES, STEP = 24, 4, 128, 16
#: Nodes and n-grams of a block.
BLOCK_NODES, BLOCK_GRAMS = 256, 400_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of the MinHash functions."""
    n = np.arange(1, HASHES + 1, dtype=np.uint64)
    return _mixed(n * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), _mixed(n * np.uint64(0xD1B54A32D192ED03))


@functools.cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n MinHash values at which the posterior for the threshold is not below the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); that it reaches t
    has the probability that at most m of n + 1 draws succeed at rate t.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


class _Words:
    """Stable 64-bit hashes of distinct words, once per Python worker."""

    def __init__(self):
        self.table = P.WordTable(self.encode, {}, self._forget)

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)

    def encode(self, words):
        import xxhash

        new = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        self.hashes = np.concatenate([self.hashes, new])
        return np.ones(len(words), np.int64), np.zeros(len(words), np.int32)


@functools.cache
def _words() -> _Words:
    return _Words()


def gram_sets(texts: list[str], n_words: int):
    """Per range of texts: (begin, end, distinct n-gram hashes, number per text).  Texts of fewer words have their whole word row as one."""
    words = _words()
    words.table.renew()
    codes, n = P.pieces(words.table, texts, P.white_words)
    words.table.fill()
    done = 0
    for b, e in P.chunks(texts):
        size = n[b:e]
        own = words.hashes[codes[done:done + int(size.sum())]] if size.sum() else np.zeros(0, np.uint64)
        done += len(own)
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(e - b), size)
        left = ends[owner] - np.arange(len(own)) if len(own) else np.zeros(0, np.int64)  # words from here to the text's end
        first = left == size[owner] if len(own) else np.zeros(0, bool)
        at = np.flatnonzero((left >= n_words) | (first & (left < n_words)))
        grams = np.zeros(len(at), np.uint64)
        for k in range(n_words):
            inside = left[at] > k
            grams = np.where(inside, _mixed(grams * np.uint64(3) + own[np.minimum(at + k, len(own) - 1)] + np.uint64(k + 1)), grams)
        fresh = ~pd.Series(_mixed(owner[at].astype(np.uint64) + np.uint64(1)) ^ grams).duplicated().to_numpy() if len(at) else np.zeros(0, bool)
        yield b, e, grams[fresh], np.bincount(owner[at][fresh], minlength=e - b)


def signatures(grams: np.ndarray, per: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values (texts, hashes); texts without n-grams have zeros."""
    out = np.zeros((len(per), hashes), np.uint32)
    full = np.flatnonzero(per)
    if len(full):
        at = (np.cumsum(per) - per)[full]
        mul, add = _family()
        for k in range(hashes):
            out[full, k] = np.minimum.reduceat(((grams * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _identities(grams: np.ndarray, per: np.ndarray) -> list[bytes]:
    """Sixteen bytes that name each text's n-gram set."""
    ends = np.cumsum(per)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(grams + np.uint64(s)), dtype=np.uint64)]) for s in (0x51ED27, 0xA0761D)]
    both = np.stack([s[ends] - s[ends - per] for s in sums], axis=1).astype(">u8")
    return [row.tobytes() for row in both]


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.tile(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), 1))
    for r in range(BAND_ROWS):
        key = _mixed(key * np.uint64(3) + sig[:, r:BANDS * BAND_ROWS:BAND_ROWS].astype(np.uint64))
    return key.view(np.int64)


def _texts(pdf: pd.DataFrame):
    return ["" if t is None else t for t in pdf["text"].tolist()]


def _described(docs: DataFrame, key: str, text: str, n_words: int) -> DataFrame:
    """(key, content, sid, n_grams, keys) of every row; without words sid is null."""
    def run(batches):
        for whole in batches:
            texts = _texts(whole)
            for lo, hi in P.chunks(texts, P.SLAB_CHARS):
                pdf = whole.iloc[lo:hi]
                for b, e, grams, per in gram_sets(texts[lo:hi], n_words):
                    sig = signatures(grams, per, BANDS * BAND_ROWS)
                    keys = band_keys(sig)
                    yield pd.DataFrame({"key": pdf["key"].iloc[b:e].tolist(), "content": pdf["content"].iloc[b:e].tolist(),
                                        "sid": [s if n else None for s, n in zip(_identities(grams, per), per, strict=True)],
                                        "n_grams": per, "keys": [k if n else [] for k, n in zip(keys, per, strict=True)]})

    rows = keyed(docs, key, text).withColumn("content", F.xxhash64("text"))
    described = rows.mapInPandas(run, "key string, content long, sid binary, n_grams long, keys array<long>")
    return described.withColumn("key", F.col("key").cast(docs.schema[key].dataType))


def _with_sets(nodes: DataFrame, n_words: int) -> DataFrame:
    """(sid, text, rest) rows with the MinHash values and n-grams of the text as binary columns."""
    def run(batches):
        for whole in batches:
            texts = _texts(whole)
            for lo, hi in P.chunks(texts, P.SLAB_CHARS):
                pdf = whole.iloc[lo:hi]
                for b, e, grams, per in gram_sets(texts[lo:hi], n_words):
                    sig, ends = signatures(grams, per), np.cumsum(per)
                    own = pdf.iloc[b:e][["sid", "bid", "copies"]].reset_index(drop=True)
                    own["sig"] = [s.tobytes() for s in sig]
                    own["grams"] = [grams[t - n:t].tobytes() for t, n in zip(ends, per, strict=True)]
                    yield own

    return nodes.select("sid", "bid", "copies", "text").mapInPandas(run, "sid binary, bid long, copies long, sig binary, grams binary")


def linked(sig_a, sig_b, sets_a, sets_b, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks (or above the diagonal of one) whose sets reach the threshold."""
    match = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for k in range(STEP):
        match += sig_a[:, k, None] == sig_b[None, :, k]
    i, j = np.nonzero(match >= least_matches(STEP, threshold, tolerance))
    if same:
        i, j = i[i < j], j[i < j]
    count = match[i, j].astype(np.int64)
    for n in range(2 * STEP, HASHES + 1, STEP):
        if not len(i):
            break
        count += (sig_a[i, n - STEP:n] == sig_b[j, n - STEP:n]).sum(axis=1)
        good = count >= least_matches(n, threshold, tolerance)
        i, j, count = i[good], j[good], count[good]
    if not len(i):
        return i, j
    return _verified(i, j, sets_a, sets_b, threshold)


def _verified(i, j, sets_a, sets_b, threshold):
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    distinct, number = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
    at_b = size_a.sum() + np.cumsum(size_b) - size_b
    at_a = np.cumsum(size_a) - size_a
    flag, good = np.zeros(len(distinct), np.int32), np.zeros(len(i), bool)
    begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for s, e in zip(begin, np.append(begin[1:], len(i)), strict=True):
        a = i[s]
        own = number[at_a[a]:at_a[a] + size_a[a]]
        flag[own] = 1
        for lo in range(s, e, 512):
            hi = min(e, lo + 512)
            n = size_b[j[lo:hi]]
            run = np.repeat(at_b[j[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.add.reduceat(flag[number[run]], np.cumsum(n) - n)
            good[lo:hi] = shared >= threshold * (n + size_a[a] - shared) - 1e-9
        flag[own] = 0
    return i[good], j[good]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Root of each of n nodes under the links."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _compare(pdf: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """(sid, links, root) of the nodes of one pair of blocks that have links there."""
    pdf = pdf.drop_duplicates("sid").sort_values(["bid", "sid"], ignore_index=True)
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf["sig"]])
    sets = [np.frombuffer(s, np.uint64) for s in pdf["grams"]]
    side = (pdf["bid"] == low).to_numpy()
    a, b = np.flatnonzero(side), np.flatnonzero(~side)
    if low == high:
        b = a
    if not len(a) or not len(b):
        return pd.DataFrame({"sid": [], "links": [], "root": []})
    i, j = linked(sig[a], sig[b], [sets[x] for x in a], [sets[x] for x in b], low == high, threshold, tolerance)
    i, j = a[i], b[j]
    copies = pdf["copies"].to_numpy()
    links = np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
    root = _forest(len(pdf), i, j)
    has = np.flatnonzero(links)
    return pd.DataFrame({"sid": pdf["sid"].iloc[has].tolist(), "links": links[has].astype(np.int64), "root": [pdf["sid"].iloc[root[x]] for x in has]})


def _labels(docs: DataFrame, key: str, text: str, n_words: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, content, sid) and nodes (sid, copies, links, label)."""
    rows = cut_lineage(_described(docs, key, text, n_words))
    sets = rows.filter("sid is not null").groupBy("sid").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "content")).alias("place"), F.max("n_grams").alias("n_grams"))
    bands = rows.filter("sid is not null").select("sid", "n_grams", F.explode("keys").alias("band")).distinct()
    buckets = bands.groupBy("band").agg(F.min("sid").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "lead")
    members = bands.join(buckets, "band")
    homes = members.groupBy("sid", "n_grams").agg(F.min("lead").alias("home"))
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).alias("parts"))
    placed = cut_lineage(homes.join(sizes, "home").select("sid", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("parts"))).alias("bid")))
    # the blocks that meet in a bucket, as many as its nodes need; pairs are of blocks, not of nodes
    met = members.select("band", "sid").join(placed, "sid").groupBy("band").agg(F.array_sort(F.collect_set("bid")).alias("bids"))
    pairs = met.select(F.explode(F.flatten(F.transform("bids", lambda x, k: F.transform(
        F.slice("bids", k + 1, F.size("bids")), lambda y: F.struct(x.alias("low"), y.alias("high")))))).alias("p")).select("p.*").distinct()
    ids = placed.join(sets, "sid").select("sid", "bid", "copies", F.coalesce(F.col("place.key").cast("string"), F.lit("\u0000")).alias("_k"),
                                          F.col("place.content").alias("_c"))
    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("\u0000")).alias("_k"), F.xxhash64(F.col(text).cast("string")).alias("_c"),
                         F.col(text).cast("string").alias("text"))
    nodes = _with_sets(source.join(ids, ["_k", "_c"]), n_words)
    sides = pairs.select(F.col("low").alias("bid"), "low", "high").unionByName(pairs.filter("low != high").select(F.col("high").alias("bid"), "low", "high"))
    found = cut_lineage(nodes.join(sides, "bid").groupBy("low", "high").applyInPandas(
        lambda pdf: _compare(pdf, threshold, tolerance), "sid binary, links long, root binary"))
    label = components(found.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    graph = sets.select("sid", "copies").join(links, "sid", "left").join(label.withColumnRenamed("node", "sid"), "sid", "left")
    return rows.select("key", "content", "sid"), graph.select(
        "sid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("label", "sid").alias("label"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = WORDS, threshold: float = THRESHOLD,
            tolerance: float = TOLERANCE) -> DataFrame:
    """(key, class_id, n_links) of every row: its class's least key and the number of rows it is linked with.

    Rows are linked when the Jaccard similarity of their n-gram sets reaches the threshold; a class is all
    that links join.  Words are runs without blanks and the controls 9 to 13.  Rows of fewer words than an
    n-gram have their whole row of words as the only one; rows without words (or null) have no links and
    are classes of their own.  Equal rows are linked like any copies; null keys count as least.
    """
    rows, nodes = _labels(docs, key, text, n_words, threshold, tolerance)
    joined = cut_lineage(rows.join(nodes, "sid", "left"))
    least = joined.filter("label is not null").groupBy("label").agg(F.min(F.struct("key")).alias("least"))
    return joined.join(least, "label", "left").select(
        F.col("key").alias(key), F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("least.key")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = WORDS, threshold: float = THRESHOLD,
                tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs``, with their columns, that come first in their class by key, then by content hash;
    rows without words all stay."""
    names = docs.columns
    docs, (key, text) = numbered(docs, key, text)
    rows, nodes = _labels(docs, key, text, n_words, threshold, tolerance)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\u0000"))
    first = rows.join(nodes, "sid").groupBy("label").agg(F.min(F.struct("key", "content")).alias("first")).select(
        name(F.col("first.key")).alias("_fk"), F.col("first.content").alias("_fc"), F.lit(False).alias("_bare"))
    bare = rows.filter("sid is null").select(name(F.col("key")).alias("_fk"), F.col("content").alias("_fc"), F.lit(True).alias("_bare")).distinct()
    marked = docs.withColumn("_k", name(F.col(key))).withColumn("_c", F.xxhash64(F.col(text).cast("string")))
    marked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_c").orderBy(F.lit(0))))
    kept = marked.join(first.unionByName(bare), (F.col("_k") == F.col("_fk")) & (F.col("_c") == F.col("_fc"))).filter("_bare or _n = 1")
    return kept.select(*docs.columns).toDF(*names)
