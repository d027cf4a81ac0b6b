"""Text answers: ids that ask the same are answered once, and their documents are read once."""

from collections import Counter

from pyspark.sql import functions as F

from statuta.catalog import checks_answers as C
from statuta.operators import corpus, parsing
from statuta.plans import responses, retrieval

# Keys that repeat with equal and with other rows, null keys, null customers, and many ids that ask the same.
ORDERS = [(k, c) for k in range(100, 140) for c in (k % 3 * 220,)] + [
    (10, 4), (10, 4), (20, 4), (20, 5), (30, 4), (30, 5), (40, None), (41, None), (50, None), (50, None), (None, 4), (None, 4), (None, 8)]
PARTS = [(k, f"mal {k}", f"Brand#{k % 5}", f"tip {k % 7}", k % 50) for k in [*range(18 * 12), 9, 9, 27]] + [(None, "mal", "Brand#1", "tip", 1), (9, None, None, "tip", None)]


def _tables(spark, folder):
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_brand string, p_type string, p_size long").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_answers_of_what_is_asked_alike_are_those_by_row(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path)
    resolved, links, routed = C._routed(spark, sf)
    ranked = retrieval.retrieve_resolved(resolved, links, corpus.with_structure(C.derived(spark, sf, "statutes")))
    plain = responses.text_answers(routed, ranked).select("q_id", "route", "answer")
    retrieved, whole = [], retrieval.retrieve_resolved

    def seen(resolved, *more, **named):
        retrieved.append(resolved.count())
        return whole(resolved, *more, **named)
    monkeypatch.setattr(retrieval, "retrieve_resolved", seen)
    got = C.Q["p15_text_answers"][0](spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, plain.collect()))
    assert len(got) >= len(ORDERS) and retrieved[0] < len(ORDERS)


def test_one_id_stands_for_those_that_ask_the_same(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, "b"), (4, "a"), (5, "a"), (5, "b"), (6, None), (7, None), (None, "a"), (None, "a"), (None, "b")]
    alike = parsing.asked_alike(spark.createDataFrame(rows, "q_id long, question string"))
    one = Counter((r.q_id, r.question) for r in parsing.one_of_each(alike).collect())
    assert one == Counter([(1, "a"), (3, "a"), (3, "a"), (4, "a"), (4, "b"), (6, None), (None, "a"), (None, "a"), (None, "b")])
    firsts = alike.join(parsing.one_of_each(alike).drop("q_id"), "asked").select("q_id", "question")
    assert Counter(map(tuple, firsts.collect())) == Counter(rows)


def test_ranked_documents_are_read_once(spark):
    text = "Kanun Madde 1: metin"
    ranked = spark.createDataFrame([(1, 1, text), (1, 1, text + " iki"), (1, 2, text), (2, 2, text), (None, 1, text)], "q_id long, rank int, text string").select(
        "*", *[F.lit(v).alias(n) for n, v in (("source_type", "mevzuat"), ("law_name", "Kanun"), ("article_no", "1"), ("article_type", "madde"))],
        F.lit(None).cast("string").alias("regulation_name"), F.expr("CAST(NULL AS array<struct<no:string,text:string,items:map<string,string>>>) AS paragraphs"),
        F.expr("CAST(NULL AS struct<plural:array<string>,single:string,item:string,numbered:string,requested:boolean>) AS ask")).localCheckpoint()
    routed = spark.createDataFrame([(1,), (2,), (3,), (None,)], "q_id long").select("q_id", F.lit("TBK 1").alias("resolved"), F.lit("deterministic_article_full_text").alias("route"))
    answers = responses.text_answers(routed, ranked).select("q_id", "answer")
    got = sorted(((r.q_id or 0), "iki" in r.answer) for r in answers.collect())
    assert got == [(0, False), (1, False), (1, True), (2, False), (3, False)]
    whole = responses.text_answers(routed, ranked)._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("Join") == 1
