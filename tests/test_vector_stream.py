"""Exact vector search past which the vectors stream: what is shuffled, ids that are missing or come twice, parts and groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import lookup

SCHEMA = "id long, vector array<{}>"


def _brute(q, v, k):
    """Ranked (id, similarity) of every query id; rows of one id are one list, a missing id comes first among equals."""
    unit = lambda x: np.asarray(x, np.float64) / max(np.linalg.norm(np.asarray(x, np.float64)), 1e-300)
    out = {}
    for q_id, a in q:
        if a is not None:
            out.setdefault(q_id, []).extend((-round(float(unit(a) @ unit(b)), 9) + 0.0, v_id is not None, v_id or 0) for v_id, b in v if b is not None)
    return {q_id: [(i if named else None, -s + 0.0) for s, named, i in sorted(rows)[:k]] for q_id, rows in out.items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_missing_and_repeated_ids_and_vectors(spark, kind):
    rng = np.random.default_rng(5)
    x = [[float(c) for c in np.float32(r)] for r in rng.normal(size=(120, 5))]
    v = [*enumerate(x), *list(enumerate(x))[:40], (None, x[7]), (None, x[7]), (500, None), (501, [0.0] * 5)]
    q = [*enumerate(x[:30]), (3, x[3]), (3, [0.125, 0.25, 0.375, -0.5, 0.625]), (None, x[4]), (None, [0.5, 0.125, -0.25, 0.375, 0.25]), (77, None)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA.format(kind))
    found = lookup.vector_top_k(frame(q).withColumnRenamed("id", "q_id"), frame(v).withColumnRenamed("id", "v_id"), 6, vector_blocks=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.q_id or -1, r["rank"])):
        got.setdefault(r.q_id, []).append((r.v_id, round(r.similarity, 9) + 0.0))
    assert got == _brute(q, v, 6)


def test_neither_side_is_copied_before_a_shuffle(spark):
    """Queries go to every part and vectors to every group without rows that are written more than once."""
    rows = spark.range(3_000).select(F.col("id"), F.array(*[F.rand(i) for i in range(4)]).alias("vector"))
    found = lookup.vector_top_k(rows.withColumnRenamed("id", "q_id"), rows.withColumnRenamed("id", "v_id"), 3, vector_blocks=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert found.count() == 9_000


def test_results_of_the_parts_stay_bounded_and_groups_fit_a_task():
    parts, groups = lookup._grid(54_000_000, 64, 600, 3, lookup.BLOCK_BYTES, 600_000, 5)
    assert parts * 600_000 * 5 * lookup.FOUND_ROW <= lookup.FOUND_BYTES and parts * groups >= 600
    assert 600_000 * 64 * 8 <= groups * lookup.QUERY_BYTES
    assert lookup._grid(10, 64, 600, None, lookup.BLOCK_BYTES, 0, 5) == (1, 1)


def test_a_pack_is_bounded_and_has_the_first_copies_only():
    import pyarrow as pa
    ids, same = list(range(5_000, 0, -1)), [1.0, 2.0, 3.0]
    batch = pa.RecordBatch.from_pydict({"part": pa.array([0] * 5_000, pa.int32()), "id": pa.array(ids), "vector": pa.array([same] * 5_000, pa.list_(pa.float32()))})
    packs = [p.to_pylist()[0] for p in lookup.packed(1 << 14, 4)(iter([batch]))]
    assert [np.frombuffer(p["ids"], np.int64).tolist() for p in packs] == [[1, 2, 3, 4]]
    apart = pa.RecordBatch.from_pydict({"part": pa.array([i % 3 for i in range(5_000)], pa.int32()), "id": pa.array(ids), "vector": pa.array([[float(i), 1.0] for i in ids], pa.list_(pa.float32()))})
    packs = [p.to_pylist()[0] for p in lookup.packed(1 << 12, 4)(iter([apart]))]
    assert max(len(p["vectors"]) for p in packs) <= 1 << 12
    assert sorted((p["part"], i) for p in packs for i in np.frombuffer(p["ids"], np.int64).tolist()) == sorted((n % 3, i) for n, i in enumerate(ids))


def test_the_running_best_is_that_of_all_vectors():
    rng = np.random.default_rng(3)
    v = lookup._unit_rows(np.concatenate([rng.normal(size=(9_000, 6)), np.tile(rng.normal(size=(1, 6)), (300, 1)), np.zeros((5, 6))]))
    q = np.concatenate([v[:20], v[9_000:9_003], v[-2:], lookup._unit_rows(rng.normal(size=(600, 6)))])
    ids, found = rng.permutation(len(v)), lookup.RunningTopK(q, 7)
    for own in np.array_split(np.arange(len(v)), 5):
        found.see(ids[own], np.zeros(len(own), bool), v[own])
    got = {}
    for batch in found.best(np.arange(len(q)), np.zeros(len(q), bool)):
        for row in batch.to_pylist():
            got.setdefault(row["q_id"], []).append(row["v_id"])
    scores = np.round(np.einsum("id,jd->ij", q, v), 12)
    assert [got[i] for i in range(len(q))] == [ids[np.lexsort((ids, -s))[:7]].tolist() for s in scores]


def test_vectors_of_different_lengths_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], SCHEMA.format("double"))
    with pytest.raises(Exception, match="different lengths"):
        lookup.vector_top_k(rows.withColumnRenamed("id", "q_id"), rows.withColumnRenamed("id", "v_id"), 1).collect()


def test_keys_of_decisions_pass_a_filter_before_they_are_shuffled(spark):
    held = [(i, f"{1990 + i % 35}/{i}", f"K {i}", f"bkz. 2001/{i * 7} ve 2005/{i}5/9") for i in range(400)]
    decisions = spark.createDataFrame(held, "id long, case_no string, decision_no string, text string")
    asked = [(i, f"2001/{i} E. ve 20{i % 20:02d}/{i % 7} K.") for i in range(60)] + [(99, "hiç")]
    found = lookup.case_number_search(spark.createDataFrame(asked, "q_id long, question string"), decisions, 3)
    assert "_bits" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.q_id, r["rank"])):
        got.setdefault(r.q_id, []).append(r.id)
    want = {}
    for q_id, _question in asked[:-1]:
        numbers = [f"2001/{q_id}", f"20{q_id % 20:02d}/{q_id % 7}"]
        hits = sorted((min(n for n, x in enumerate(numbers) if any(x in c for c in row[1:])), row[0]) for row in held if any(x in c for x in numbers for c in row[1:]))
        if hits:
            want[q_id] = [i for _n, i in hits[:3]]
    assert got == want
