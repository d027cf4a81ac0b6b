"""Equality lookups, case-number search and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions.refs import case_numbers
from .keywords import maybe_among
from .ordered import explode_rows, top_per_key


#: Keys of a lookup, in the order in which stored tables are bucketed: another order would not match their buckets.
STATUTE_KEY = ["law_no", "article_no", "article_type"]
REGULATION_LOOKUP_KEY = ["law_no", "regulation_name", "article_no", "article_type"]


def located(asked: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Asked rows with the stored rows of their keys.

    Each key meets the corpus once, however many ask for it, so that a popular article is no hot key there.
    """
    return asked.join(asked.select(*keys).distinct().join(stored, keys), keys)


def direct_articles(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles named by (law, number, type); one row per reference, its order kept.

    ``refs`` has ``q_id, ord, law_no, article_no, article_type``.
    """
    statutes = articles.where(F.col("source_type") == "mevzuat")
    named = refs.where(F.col("law_no").isNotNull() & F.col("article_no").isNotNull())
    return (located(named, statutes, STATUTE_KEY)
            .withColumn("retrieval_source", F.lit("direct_article_lookup")))


def direct_regulation_articles(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """Regulation articles named by (parent law, regulation, number, type)."""
    regulations = articles.where(F.col("source_type") == "yonetmelik")
    return (located(refs, regulations, REGULATION_LOOKUP_KEY)
            .withColumn("retrieval_source", F.lit("direct_yonetmelik_lookup"))
            .withColumn("law_name", F.col("regulation_name")))


def by_ids(ids: DataFrame, articles: DataFrame) -> DataFrame:
    return ids.join(articles, "id")


# --- decisions by case number ---------------------------------------------------

def case_number_search(questions: DataFrame, decisions: DataFrame, count: int,
                       question: str = "question") -> DataFrame:
    """Decisions whose case number, decision number or text contains a number asked for.

    Every year/number in a decision gives one key per prefix of its number: a number asked
    for is a substring exactly when one of these keys equals it.
    """
    asked = explode_rows(questions.select("q_id", question), case_numbers(F.col(question)), "nth", "number").drop(question)
    numbers = F.flatten(F.array(*[F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit(r"(?=((?:19|20)\d{2}/\d+))"), F.lit(1))
                                  for c in ("case_no", "decision_no", "text")]))

    # four digits of the year and the stroke are in front of the first digit of the number
    prefixes = lambda n: F.transform(F.sequence(F.lit(6), F.length(n)), lambda i: F.substring(n, F.lit(1), i))
    keys = F.array_distinct(F.flatten(F.transform(F.array_distinct(numbers), prefixes)))
    held = explode_rows(decisions.select("id", "case_no", "decision_no", "text"), keys, "_n", "number").select("id", "number")
    # a number's first decisions are found once; a question needs no more than that of each of its numbers
    wanted = asked.select("number").distinct()
    near = maybe_among(held, F.xxhash64("number"), wanted.select(F.xxhash64("number").alias("_key")))
    first = top_per_key(near.join(wanted, "number"), ["number"], [F.col("id")], count, "_nth").drop("_nth")
    hits = asked.join(first, "number").groupBy("q_id", "id").agg(F.min("nth").alias("nth"))
    best = top_per_key(hits, ["q_id"], [F.col("nth"), F.col("id")], count)
    return best.drop("nth").join(decisions, "id")


# --- vector search -----------------------------------------------------------------

#: Vectors that one Python task holds at a time, as bytes of doubles.
BLOCK_BYTES = 64 << 20
#: What the results of all parts of the vectors may add to a shuffle, and the bytes of one row of them.
FOUND_BYTES, FOUND_ROW = 2 << 30, 24
#: Queries that one task holds, as bytes of doubles; vectors that are packed into one row, and all that are being packed, as bytes.
QUERY_BYTES, PACK_BYTES, PACKING_BYTES = 16 << 20, 2 << 20, 64 << 20
#: Pairs of a query and a vector below which further tasks cost more than they take off others.
TASK_PAIRS = 1 << 24
#: Scores that are held at a time: queries by vectors; the first vectors of a block only set the borders.
TILE, FIRST, SLICE = 512, 1_024, 8_192
#: Place of a similarity that is no number: behind all others.
NO_NUMBER = -2.0


def _unit_rows(x: np.ndarray) -> np.ndarray:
    v = x.astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return v


def unit(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(np.stack(vectors.to_numpy()))


def _copies(x: np.ndarray) -> np.ndarray:
    """The number of each row's value: equal rows have equal numbers."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    return np.unique(whole, return_inverse=True)[1].ravel()


def _first_of_each(groups: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of every group, ascending."""
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    return np.sort(order[np.arange(len(own)) - np.searchsorted(own, own) < k])


def _pair_scores(q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 12):   # the gathered rows stay in the cache
        own = slice(at, at + (1 << 12))
        out[own] = np.einsum("ij,ij->i", q[rows[own]], v[cols[own]])
    return np.where(np.isnan(out), NO_NUMBER, out)


def _tile_top_k(q: np.ndarray, v: np.ndarray, v_single: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best columns of each row, in order; of equal scores the one further left.

    Scores in single precision drop what lies below the k-th best so far by more than their error; what
    is left is scored in double precision, pair by pair.
    """
    single, slack = q.astype(np.float32), (q.shape[1] + 8) * 2.0 ** -23
    rows, cols, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    least, plain = np.full(len(q), -np.inf), bool(np.isfinite(single.sum() + v_single.sum()))
    for at in [0, *range(FIRST, len(v), SLICE)]:
        near = single @ v_single[at:at + (SLICE if at else FIRST)].T
        if not plain:
            near = np.nan_to_num(near, nan=NO_NUMBER)
        if not at and near.shape[1] > k:
            least = np.partition(near, -k, axis=1)[:, -k] - slack
        r, c = np.nonzero(near >= (least - slack).astype(np.float32)[:, None])
        if not len(r):
            continue
        rows, cols, scores = np.concatenate([rows, r]), np.concatenate([cols, c + at]), np.concatenate([scores, _pair_scores(q, v, r, c + at)])
        order = np.lexsort((cols, -scores, rows))
        order = order[_first_of_each(rows[order], k)]
        rows, cols, scores = rows[order], cols[order], scores[order]
        counts = np.bincount(rows, minlength=len(q))
        full = np.flatnonzero(counts == k)
        least[full] = scores[np.cumsum(counts)[full] - 1]
    return rows, cols, scores


def block_top_k(k: int):
    """Top-k of streamed queries against the block of vectors that comes before them.

    Of vectors with equal values a block needs the first k only, and queries with equal values are scored once, so
    that copies cost no more than others.
    """
    def run(batches):
        block, held, ids = None, [], None
        for pdf in batches:
            for (b, is_query), part in pdf.groupby(["block", "is_query"], sort=False):
                if b != block:
                    block, held, ids = b, [], None
                if not is_query:
                    held.append(part)
                    continue
                if not held and ids is None:
                    continue
                if ids is None:
                    ids = np.concatenate([p["id"].to_numpy() for p in held])
                    order = np.argsort(ids, kind="stable")
                    matrix = np.concatenate([unit(p["vector"]) for p in held])[order]
                    first = _first_of_each(_copies(matrix), k)
                    ids, matrix, held = ids[order][first], matrix[first], []
                    single = matrix.astype(np.float32)
                asked, q_ids = unit(part["vector"]), part["id"].to_numpy()
                same = _copies(asked)
                by_value = np.argsort(same, kind="stable")
                starts = np.searchsorted(same[by_value], np.arange(same.max() + 2))
                for at in range(0, same.max() + 1, TILE):
                    rows, cols, scores = _tile_top_k(asked[by_value[starts[at:min(at + TILE, len(starts) - 1)]]], matrix, single, k)
                    times = np.diff(starts)[rows + at]
                    own = by_value[np.repeat(starts[rows + at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    yield pd.DataFrame({"q_id": q_ids[own], "v_id": np.repeat(ids[cols], times),
                                        "similarity": np.repeat(np.where(scores == NO_NUMBER, np.nan, scores), times)})
    return run


def best_found(partial: DataFrame, k: int) -> DataFrame:
    """The k best of what the blocks found per query; a similarity that is no number comes last."""
    return top_per_key(partial, ["q_id"], [F.desc(F.nanvl("similarity", F.lit(NO_NUMBER))), F.asc("v_id")], k)


def _grid(n: int, width: int, tasks: int, vector_blocks: int | None, block_bytes: int, asked: int | None = None, k: int = 1) -> tuple[int, int]:
    """Parts of the vectors and groups of queries: as many pairs as there are tasks.

    A part is ``block_bytes`` of vectors, more where the results of so many parts would outgrow what may be
    shuffled; a group is at most ``QUERY_BYTES`` of the queries.
    """
    row = 8 * max(width, 1)
    parts = max(vector_blocks or 1, -(-n * row // block_bytes))
    if asked is None:
        return parts, max(1, -(-tasks // parts))
    parts = min(parts, max(vector_blocks or 1, FOUND_BYTES // (max(asked, 1) * k * FOUND_ROW)))
    return parts, max(1, min(asked, max(-(-tasks // parts), -(-asked * row // QUERY_BYTES))))


_PACK = "part int, ids binary, unnamed binary, dim int, single boolean, vectors binary"


def _without_copies(ids: np.ndarray, unnamed: np.ndarray, x: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal values the first k by id, which are all that can be among the best."""
    if k is None or not x.shape[1]:
        return ids, unnamed, x
    words = np.ascontiguousarray(x).view(np.uint32)
    wide = words.astype(np.uint64)
    odd = np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    _, first, same = np.unique((wide ^ wide >> np.uint64(15)) @ odd, return_index=True, return_inverse=True)
    if len(first) == len(x):
        return ids, unnamed, x
    if (words != words[first[same]]).any():   # another vector has the same hash
        same = _copies(x)
    order = np.lexsort((ids, ~unnamed))
    kept = order[_first_of_each(same[order], k)]
    return ids[kept], unnamed[kept], x[kept]


def packed(pack_bytes: int, k: int | None = None):
    """Rows of ``part, id, vector`` to rows that hold many vectors of a part, at most ``pack_bytes`` of them.

    With ``k`` a pack has a vector's first k copies only.  All packs that are being filled are bounded, too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def packs(part: int, last: bool):
            ids, unnamed, x = (np.concatenate(c) for c in zip(*held.pop(part)))
            del sizes[part]
            ids, unnamed, x = _without_copies(ids, unnamed, x, k)
            rows = max(1, pack_bytes // max(1, x.itemsize * x.shape[1]))
            if not last and len(x) <= rows // 2:
                held[part], sizes[part] = [(ids, unnamed, x)], x.nbytes
                return
            for at in range(0, len(x), rows):
                own = slice(at, at + rows)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "ids": pa.array([ids[own].tobytes()], pa.binary()), "unnamed": pa.array([unnamed[own].tobytes()], pa.binary()),
                    "dim": pa.array([x.shape[1]], pa.int32()), "single": pa.array([x.dtype == np.float32]), "vectors": pa.array([np.ascontiguousarray(x[own]).tobytes()], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            part, named, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            widths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
            if len(widths) > 1:
                raise ValueError(f"vectors of different lengths: {widths.tolist()}")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, widths[0])
            ids, unnamed = named.fill_null(0).to_numpy(zero_copy_only=False), named.is_null().to_numpy(zero_copy_only=False)
            order = np.argsort(part, kind="stable")
            found, starts = np.unique(part[order], return_index=True)
            for p, own in zip(found.tolist(), np.split(order, starts[1:])):
                held.setdefault(p, []).append((ids[own], unnamed[own], x[own]))
                sizes[p] = sizes.get(p, 0) + x[own].nbytes
                if sizes[p] >= pack_bytes:
                    yield from packs(p, False)
            if sum(sizes.values()) >= PACKING_BYTES:
                for p in list(held):
                    yield from packs(p, True)
        for p in list(held):
            yield from packs(p, True)
    return run


def _unpacked(pack: dict, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(pack[f"{of}vectors"], np.float32 if pack[f"{of}single"] else np.float64)
    ids = np.frombuffer(pack[f"{of}ids"], np.int64)
    return ids, np.frombuffer(pack[f"{of}unnamed"], bool), _unit_rows(x.reshape(len(ids), pack[f"{of}dim"]))


class RunningTopK:
    """The k best of every query among the vectors that came past so far.

    Scores in single precision, a tile at a time, drop what lies below the k-th best so far by more than their error;
    what is left is scored in double precision, pair by pair.  Equal queries are scored once.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.same = _copies(queries)
        self.q = queries[np.unique(self.same, return_index=True)[1]]
        self.single, self.k, self.slack = self.q.astype(np.float32), k, (queries.shape[1] + 8) * 2.0 ** -23
        self.finite = bool(np.isfinite(self.single).all())
        n = len(self.q)
        self.ids, self.unnamed = np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.scores, self.counts, self.bound = np.full((n, k), -np.inf), np.zeros(n, np.int64), np.full(n, -np.inf, np.float32)
        self.tile = np.empty(TILE * FIRST, np.float32)

    def see(self, ids: np.ndarray, unnamed: np.ndarray, v: np.ndarray) -> None:
        single = v.astype(np.float32)
        plain = self.finite and bool(np.isfinite(single).all())
        for at in range(0, len(self.q), TILE):
            own, rows, cols, held = slice(at, at + TILE), [], [], 0
            for left in range(0, len(v), FIRST):
                q, part = self.single[own], single[left:left + FIRST]
                near = np.matmul(q, part.T, out=self.tile[:len(q) * len(part)].reshape(len(q), len(part)))
                if not plain:
                    near = np.nan_to_num(near, nan=NO_NUMBER)
                bound = self.bound[own]
                if near.shape[1] > self.k and (self.counts[own] < self.k).any():
                    bound = np.maximum(bound, np.partition(near, -self.k, axis=1)[:, -self.k] - np.float32(2 * self.slack))
                hit = np.flatnonzero(near.max(axis=1) >= bound)
                if len(hit):
                    r, c = np.divmod(np.flatnonzero(near[hit] >= bound[hit][:, None]), near.shape[1])
                    rows.append(hit[r] + at)
                    cols.append(c + left)
                    held += len(r)
                # the first vectors set the bounds; later ones are gathered until there are many
                if held and (held >= 2 * self.k * len(q) or (self.counts[own] < self.k).any()):
                    self._take(np.concatenate(rows), np.concatenate(cols), ids, unnamed, v)
                    rows, cols, held = [], [], 0
            if held:
                self._take(np.concatenate(rows), np.concatenate(cols), ids, unnamed, v)

    def _take(self, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, v: np.ndarray) -> None:
        scores = _pair_scores(self.q, v, rows, cols)
        good = (self.counts[rows] < self.k) | (scores >= self.scores[rows, -1])
        rows, cols, scores = rows[good], cols[good], scores[good]
        own = np.unique(rows)
        there, slot = np.nonzero(np.arange(self.k) < self.counts[own][:, None])
        there = own[there]
        rows = np.concatenate([there, rows])
        scores = np.concatenate([self.scores[there, slot], scores])
        names, none = np.concatenate([self.ids[there, slot], ids[cols]]), np.concatenate([self.unnamed[there, slot], unnamed[cols]])
        order = np.lexsort((names, ~none, -scores, rows))
        order = order[_first_of_each(rows[order], self.k)]
        rows = rows[order]
        slot = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.ids[rows, slot], self.unnamed[rows, slot], self.scores[rows, slot] = names[order], none[order], scores[order]
        self.counts[own] = np.searchsorted(rows, own, "right") - np.searchsorted(rows, own)
        full = own[self.counts[own] == self.k]
        self.bound[full] = (self.scores[full, -1] - self.slack).astype(np.float32)

    def best(self, ids: np.ndarray, unnamed: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(q_id, v_id, similarity) for the named queries, those with equal values included."""
        for at in range(0, len(ids), SLICE):
            own = self.same[at:at + SLICE]
            row, slot = np.nonzero(np.arange(self.k) < self.counts[own][:, None])
            own, scores = own[row], self.scores[own[row], slot]
            yield pa.RecordBatch.from_pydict({
                "q_id": pa.array(ids[at + row], mask=unnamed[at + row]), "v_id": pa.array(self.ids[own, slot], mask=self.unnamed[own, slot]),
                "similarity": pa.array(np.where(scores == NO_NUMBER, np.nan, scores))})


def streamed_top_k(k: int):
    """Top-k of packs of queries among all packs of vectors that meet them in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, tuple] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                pair = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns) if name != "q_vectors"}
                of = (pair["q_part"], pair["q_ids"])
                if of not in groups:
                    ids, unnamed, queries = _unpacked(pair | {"q_vectors": batch.column("q_vectors")[at].as_py()}, "q_")
                    groups[of] = (ids, unnamed, RunningTopK(queries, k))
                groups[of][2].see(*_unpacked(pair, ""))
        for ids, unnamed, found in groups.values():
            yield from found.best(ids, unnamed)
    return run


def _dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``part, id, vector``: the part by a hash of id and vector, so that no id and no vector makes a large one."""
    single = isinstance(rows.schema["vector"].dataType.elementType, FloatType)
    vector = F.col("vector") if single else F.col("vector").cast("array<double>")
    own = rows.where(F.col("vector").isNotNull()).select(F.col(key).cast("bigint").alias("id"), vector.alias("vector"))
    return own.select(F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int").alias("part"), "id", "vector")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, vector_blocks: int | None = None,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact cosine top-k.  ``queries(q_id, vector)``, ``vectors(v_id, vector)``.

    Vectors are packed and dealt into ``vector_blocks`` parts (more, where a part would be above ``block_bytes``),
    queries into groups.  Each is shuffled once: a task holds a group and streams a part past it, reading both
    from where the shuffle has put them, and k rows per query leave it.  Counts of vectors and queries set the numbers.
    """
    has = F.col("vector").isNotNull()
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    asked = queries.where(has).count()
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(tasks, -(-size["n"] * asked // TASK_PAIRS))
    parts, groups = _grid(size["n"], size["dim"] or 1, tasks, vector_blocks, block_bytes, asked, k)
    v = _dealt(vectors, "v_id", parts).mapInArrow(packed(PACK_BYTES, k), _PACK).repartitionById(parts, F.col("part"))
    q = _dealt(queries, "q_id", groups).repartitionById(groups, F.col("part")).mapInArrow(packed(QUERY_BYTES), _PACK)
    # the product of the parts of both sides: of what a shuffle has written nothing is written a second time
    pairs = v.join(q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]).hint("shuffle_replicate_nl"))
    return best_found(pairs.mapInArrow(streamed_top_k(k), "q_id bigint, v_id bigint, similarity double"), k)


def best_chunk_articles(hits: DataFrame, chunk_rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunk hits to articles: best chunk per article, missing articles dropped.

    ``hits(q_id, v_id, similarity)``; ``chunk_rows`` carries the chunk id as ``v_id``.
    """
    placed = hits.join(chunk_rows.select("v_id", "article_id", "chunk_index", "chunk_text"), "v_id")
    best = placed.groupBy("q_id", "article_id").agg(F.min_by(
        F.struct("similarity", "chunk_index", "chunk_text"),
        F.struct(-F.col("similarity"), F.col("v_id"))).alias("c"))
    found = best.withColumnRenamed("article_id", "id").join(articles, "id").select("*", "c.*").drop("c")
    order = Window.partitionBy("q_id").orderBy(F.desc("similarity"), F.asc("id"))
    return (found.withColumn("ord", F.row_number().over(order).cast("bigint"))
            .withColumn("retrieval_source", F.lit("semantic")))
