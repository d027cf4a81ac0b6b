"""Properties that hold for any input."""

import random

from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.structure import build_structure, chunks
from statuta.functions.text import canon
from statuta.operators import audit, corpus, quality
from statuta.operators.candidates import keep_first


def test_chunks_cover_the_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcçş ") for _ in range(n)).strip() for n in (0, 1, 999, 1000, 1001, 1800, 1801, 5003)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        expected, start = [], 0
        while start < len(r.t):
            piece = r.t[start:start + V.CHUNK_SIZE].strip()
            expected += [piece] if piece else []
            if start + V.CHUNK_SIZE >= len(r.t):
                break
            start += V.CHUNK_SIZE - V.CHUNK_OVERLAP
        assert r.c == expected


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("1", "madde", "1", "a"), ("1", "madde", "2", "b")], "law_no string, article_type string, article_no string, text string")
    new = spark.createDataFrame([("1", "madde", "2", "c"), ("1", "ek", "1", "d")], old.schema)
    once = corpus.upsert(old, new)
    assert sorted(once.collect()) == sorted(corpus.upsert(once, new).collect())
    assert once.count() == 3


def test_missing_and_present_make_up_expected(spark):
    expected = quality.expected_numbers(spark)
    present = expected.where(F.xxhash64("law_no", "article_type", "article_no") % 3 != 0)
    missing = quality.missing_numbers(expected, present)
    assert missing.unionByName(present).distinct().count() == expected.count()
    assert quality.unexpected_numbers(expected, present).count() == 0


def test_expected_numbers_of_one_law(spark):
    rows = quality.expected_numbers(spark).where("law_no = '5237' and article_type = 'madde'").collect()
    assert len(rows) == 344 + 3 and "245" not in {r.article_no for r in rows}


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 6, 3)], "q_id int, id int, ord int")
    once = keep_first(df, ["q_id", "id"])
    assert sorted(once.collect()) == sorted(keep_first(once, ["q_id", "id"]).collect()) and once.count() == 2


def test_audit_accepts_an_answer_quoting_its_source(spark):
    kinds = [("6098", "madde", "49"), ("1136", "gecici", "3"), ("6100", "ek_gecici", "1"), (None, "madde", "7")]
    sources = spark.createDataFrame([(i, 1, "article", "mevzuat", law, "Örnek Kanunu", None, t, no, "metin faiz", None, None, None)
                                     for i, (law, t, no) in enumerate(kinds)],
                                    "q_id int, rank int, kind string, source_type string, law_no string, law_name string, regulation_name string, "
                                    "article_type string, article_no string, text string, chamber string, case_no string, decision_no string")
    answers = spark.createDataFrame([(i, f"Örnek Kanunu {'Madde' if t == 'madde' else t} {no} uyarınca faiz istenir.") for i, (_, t, no) in enumerate(kinds)],
                                    "q_id int, answer string")
    assert all(r.valid for r in audit.audit_answers(answers, sources).collect())


def test_structure_keeps_every_numbered_paragraph(spark):
    texts = [" ".join(f"({n}) metin {n}" for n in range(1, k + 1)) for k in range(1, 6)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", build_structure(F.col("t")).alias("p")).collect()
    for r in rows:
        assert " ".join(p.text for p in r.p) == r.t


def test_canonical_text_is_ascii_for_turkish_and_idempotent(spark):
    df = spark.createDataFrame([("İĞÜŞÖÇığüşöç Âîû",)], "t string").select(canon(F.col("t")).alias("c"))
    assert df.first().c == "igusocigusoc aiu"
    assert df.select(canon(F.col("c")).alias("d")).first().d == "igusocigusoc aiu"
