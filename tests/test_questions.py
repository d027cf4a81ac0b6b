"""Golden pairs: question forms to normalised text, references and flags."""

from pyspark.sql import functions as F

from statuta.functions import numbers, questions, refs
from statuta.functions.text import canon
from statuta.operators import parsing
from statuta.plans.retrieval import resolve_questions

FORMS = [
    ("TBK 52", [("6098", "52", "madde")]),
    ("TBK 7 ila 9", [("6098", "7", "madde"), ("6098", "8", "madde"), ("6098", "9", "madde")]),
    ("HMK 31 ve devamı", [("6100", str(n), "madde") for n in range(31, 36)]),
    ("İİK seksen dört", [("2004", "84", "madde")]),
    ("HMK yüz yirminci madde", [("6100", "120", "madde")]),
    ("TTK 12/3", [("6102", "12", "madde")]),
    ("Avukatlık Kanunu Geçici Madde 4", [("1136", "4", "gecici")]),
    ("Avukatlık Kanunu Mükerrer Madde 35", [("1136", "35/A", "madde")]),
    ("5271 sayılı Kanun 100, 101 ve 104", [("5271", "100", "madde"), ("5271", "101", "madde"), ("5271", "104", "madde")]),
    ("madde 18", [(None, "18", "madde")]),
    ("TBK 10 ila 100", [("6098", "10", "madde")]),
    ("Tebligat K. 11", [("7201", "11", "madde")]),
    ("kira sözleşmesi nedir", []),
]


def test_question_forms(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(FORMS)], "i int, q string")
    rows = parsing.with_refs(parsing.with_normalised(df, "q"), "normalised").collect()
    for row in rows:
        assert [tuple(r) for r in row.refs] == FORMS[row.i][1], row.q


def test_regulation_forms(spark):
    df = spark.createDataFrame([("Mesafeli Sözleşmeler Yön. 6",), ("VERBİS Yönetmeliği md 3",), ("Ticaret Sicili Yön 40",)], "q string")
    q = canon(numbers.normalise_question(F.col("q")))
    got = [(r.r[0].law_no, r.r[0].article_no) for r in df.select(refs.parse_regulation_refs(q).alias("r")).collect()]
    assert got == [("6502", "6"), ("6698", "3"), ("6102", "40")]


def test_context_from_history(spark):
    turns = spark.createDataFrame([(1, 1, "TBK 60"), (1, 2, "teşekkürler"), (2, 1, "HMK 5"), (2, 2, "CMK 90")],
                                  "conv_id int, turn int, text string")
    asked = spark.createDataFrame([(1, 1, "bu Kanunun 61 ila 63"), (2, 1, "önceki madde"), (3, 2, "sonraki madde"), (4, 3, "önceki madde"),
                                   (5, 2, "bu Kanunun 12 nci maddesi")], "q_id int, conv_id int, question string")
    got = {r.q_id: r.resolved for r in resolve_questions(asked, turns).collect()}
    assert got == {1: "6098 sayılı Kanun madde 61-63", 2: "6098 sayılı Kanun madde 59", 3: "5271 sayılı Kanun madde 91",
                   4: "önceki madde", 5: "5271 sayılı Kanun madde 12"}


def test_gates_read_the_raw_question(spark):
    df = spark.createDataFrame([("2021/410 E.",), ("TBK 49",), ("Danıştay kararı bul",), ("TBK 49 emsal",)], "q string")
    rows = df.select(questions.is_case_number_query(F.col("q")), questions.is_generic_decision_query(F.col("q")),
                     questions.wants_decisions(F.col("q"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (False, False, False), (False, True, True), (False, False, True)]
