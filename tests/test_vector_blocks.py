"""Exact vector search by tiles: brute force, copies, zero vectors, blocks and groups of queries."""

import numpy as np
import pandas as pd
import pytest

from statuta.operators import lookup


def _rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2:n // 2 + n // 4] = x[3]          # a large group of copies
    x[n - 5:] = 0
    return x


def _frame(block, is_query, ids, x):
    return pd.DataFrame({"block": block, "is_query": is_query, "id": ids, "vector": list(x)})


def _brute(q, v, k):
    a, b = lookup.unit(pd.Series(list(q))), lookup.unit(pd.Series(list(v)))
    scores = np.round(np.einsum("id,jd->ij", a, b), 12)
    return [sorted(range(len(v)), key=lambda j: (-s[j], j))[:k] for s in scores]


@pytest.mark.parametrize("n", [5, 700, 11_000])
def test_a_block_gives_the_exact_best_of_every_query(n):
    v = _rows(n, 6, 1)
    q = np.concatenate([v[:30], v[-3:], v[3:4]])
    found = pd.concat(lookup.block_top_k(8)(iter([_frame(7, False, range(n), v), _frame(7, True, range(len(q)), q)])))
    for i, want in enumerate(_brute(q, v, 8)):
        own = found[found["q_id"] == i].sort_values(["similarity", "v_id"], ascending=[False, True])
        assert own["v_id"].tolist() == want


def test_scores_of_a_large_block_are_held_tile_by_tile(monkeypatch):
    """The largest array of scores is a tile, however many vectors a block has."""
    sizes, real = [], np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda a: sizes.append(a.size) or real(a))
    v = np.random.default_rng(2).normal(size=(40_000, 4))
    list(lookup.block_top_k(3)(iter([_frame(0, False, range(len(v)), v), _frame(0, True, range(2_000), v[:2_000])])))
    assert max(sizes) <= lookup.TILE * lookup.SLICE


def test_few_wanted_blocks_still_make_work_for_all_tasks_and_stay_bounded():
    blocks, groups = lookup._grid(150_000, 64, 24, 3, lookup.BLOCK_BYTES)
    assert blocks == 3 and blocks * groups >= 24
    blocks, groups = lookup._grid(9_000_000, 64, 24, 3, lookup.BLOCK_BYTES)
    assert 9_000_000 * 512 <= blocks * lookup.BLOCK_BYTES


def test_queries_in_groups_meet_every_block(spark):
    x = _rows(400, 5, 4)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    found = lookup.vector_top_k(rows.withColumnRenamed("id", "q_id"), rows.withColumnRenamed("id", "v_id"), 4, vector_blocks=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.q_id, r["rank"])):
        got.setdefault(r.q_id, []).append(r.v_id)
    assert [got[i] for i in range(400)] == _brute(x, x, 4)


def test_a_similarity_that_is_no_number_comes_last(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.0, 1.0]), (0, [0.0, float("inf")])], "v_id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.5])], "q_id long, vector array<double>")
    assert [r.v_id for r in lookup.vector_top_k(q, v, 4).orderBy("rank").collect()] == [1, 3, 0, 2]
