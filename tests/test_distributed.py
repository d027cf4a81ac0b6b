"""Blocked windows, searches and joins against brute force on small data."""

import random

import numpy as np
from pyspark.sql import functions as F

from statuta.operators import keywords, lookup, ordered
from statuta.operators.candidates import article_links, expand_cited, expand_previous, merge_candidates
from statuta.plans.retrieval import resolve_questions


def _sequence(spark, n=200):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", i, rng.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, pos bigint, v int")


def test_running_count_matches_plain_order(spark):
    rows, df = _sequence(spark)
    got = {(r.g, r.pos): r.c for r in ordered.running_count(df, ["g"], "pos", F.col("v") > 5, "c", block=7).collect()}
    seen = {"a": 0, "b": 0}
    for g, pos, v in rows:
        seen[g] += v > 5
        assert got[(g, pos)] == seen[g]


def test_neighbours_cross_block_edges(spark):
    rows, df = _sequence(spark)
    for offset in (-1, 1):
        got = {(r.g, r.pos): r.x for r in ordered.neighbour(df, ["g"], "pos", F.col("v"), "x", offset, block=5).collect()}
        for g in "ab":
            members = [(p, v) for k, p, v in rows if k == g]
            for i, (p, _) in enumerate(members):
                j = i + offset
                assert got[(g, p)] == (members[j][1] if 0 <= j < len(members) else None)


def test_vector_grid_equals_full_product(spark):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(23, 5)), rng.normal(size=(71, 5))
    qdf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "q_id bigint, vector array<double>")
    vdf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "v_id bigint, vector array<double>")
    got = lookup.vector_top_k(qdf, vdf, 4, vector_blocks=5).collect()
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    best = {(i, int(j)) for i in range(len(q)) for j in np.argsort(-sims[i])[:4]}
    assert {(r.q_id, r.v_id) for r in got} == best


def test_substring_search_equals_nested_loop(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "ca", "x1", "Öz", "d-e", "f.g"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pats = sorted({t[i:i + rng.randint(1, 14)] for t in texts[:25] for i in range(0, len(t), 4)} | {"-", ".", "AB", "zz", " "})
    pdf = spark.createDataFrame(list(enumerate(pats)), "pid int, p string")
    tdf = spark.createDataFrame(list(enumerate(texts)), "tid int, t string")
    got = {(r.pid, r.tid) for r in keywords.substring_matches(pdf, tdf, "p", "t", "pid", "tid").collect()}
    assert got == {(i, j) for i, p in enumerate(pats) for j, t in enumerate(texts) if p.lower() in t.lower()}


def test_case_number_search_is_a_substring_search(spark):
    decisions = spark.createDataFrame([(1, "2020/12", "5", "x"), (2, "2020/123", "6", "y"), (3, "E", "12020/12 K", "z"), (4, "2019/2020/12", "", "q"),
                                       (5, "2021/12", "", "2020/1")], "id bigint, case_no string, decision_no string, text string")
    asked = spark.createDataFrame([(7, "2020 / 12 E.")], "q_id bigint, question string")
    got = {r.id for r in lookup.case_number_search(asked, decisions, 10).collect()}
    assert got == {1, 2, 3, 4}


def test_expansion_adds_new_documents_only(spark):
    rows = [(n, "mevzuat", "6098", "TBK", None, "madde", str(n), "önceki maddede" if n == 3 else "metin") for n in range(1, 9)]
    articles = spark.createDataFrame(rows, "id bigint, source_type string, law_no string, law_name string, regulation_name string, "
                                           "article_type string, article_no string, text string")
    edges = spark.createDataFrame([("6098", "madde", "3", "6098", "madde", str(t), i) for i, t in enumerate((2, 5, 5, 3, 6, 99))],
                                  "source_law_no string, source_article_type string, source_article_no string, target_law_no string, "
                                  "target_article_type string, target_article_no string, ord int")
    links = article_links(articles, edges)
    start = links.where(F.col("id").isin(3, 5)).select(
        F.lit(1).alias("q_id"), "*", F.lit("direct_article_lookup").alias("retrieval_source"), F.lit(None).cast("double").alias("similarity"),
        F.col("id").alias("ord"))
    merged = merge_candidates(start, 10, "id")
    before = merge_candidates(expand_previous(merged), 12, "id")
    after = merge_candidates(expand_cited(before), 18, "id").orderBy("ord").collect()
    assert [(r.id, r.retrieval_source) for r in after] == [
        (3, "direct_article_lookup"), (5, "direct_article_lookup"), (6, "reference_graph"), (2, "previous_article_ref")]


def test_rows_without_law_keep_their_place(spark):
    rows = spark.createDataFrame([(None, 1, True), (None, 2, False), ("a", 1, False), ("a", None, True)], "law string, pos int, flag boolean")
    counted = ordered.running_count(rows, ["law"], "pos", F.col("flag"), "n")
    assert sorted((str(r.law), str(r.pos), r.n) for r in counted.collect()) == [("None", "1", 1), ("None", "2", 1), ("a", "1", 1), ("a", "None", 1)]
    near = ordered.neighbour(rows, ["law"], "pos", F.col("flag"), "before", -1)
    assert near.count() == 4


def test_a_null_question_has_flags(spark):
    rows = spark.createDataFrame([(1, None), (2, "TBK 5")], "q_id long, question string")
    got = {r.q_id: r for r in resolve_questions(rows).select("q_id", "gated", "decision_intent").collect()}
    assert (got[1].gated, got[1].decision_intent) == (False, False) and got[2].gated is False


def test_keyword_search_with_a_very_long_token(spark):
    long = "ab" * 50_000
    texts = spark.createDataFrame([(1, "karar " + long), (2, long), (3, "bir karar daha")], "id long, text string")
    asked = spark.createDataFrame([(1, "karar"), (2, "k"), (3, "ba" * 100), (4, "a karar"), (5, "KARAR")], "q_id long, question string")
    got = sorted(map(tuple, keywords.keyword_search(asked, texts, 2, [F.col("id")]).select("q_id", "id", "ord").collect()))
    assert got == [(1, 1, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2), (5, 1, 1), (5, 3, 2)]


def test_equal_similarities_keep_the_smaller_id(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "v_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, vector array<double>")
    got = lookup.vector_top_k(asked, vectors, 3, vector_blocks=4).orderBy("rank").collect()
    assert [r.v_id for r in got] == [0, 2, 4]
