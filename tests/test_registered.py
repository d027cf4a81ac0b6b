"""Registered queries against their SQL on the smallest tables.

By default a spread of them; ``ALL_QUERIES=1`` checks every one.
"""

import math
import os

import duckdb
import pytest

from statuta.catalog import registry

SF = "/root/testdata/sf0.001"
SPREAD = ["s09_listed_decisions", "n01_canonical_text", "n11_spelled_questions", "g01_segment_articles", "g12_structure", "g16_chunk_rows", "r05_question_refs",
          "r15_contextual_question", "r18_extraction_status", "r19_citations", "j04_short_keywords", "j05_chunk_vectors", "j08_case_number_search",
          "j11_change_detection", "w08_ranked_candidates", "q09_quality_report", "a01_loaded_laws", "a07_retrieval_accuracy", "p12_gated_routes", "p18_answer_audit",
          "p22_retrieval", "p23_validated_answers"]
QUERIES = registry()
NAMES = [n for n, (_, sql) in QUERIES.items() if sql] if os.environ.get("ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield con
    con.close()


def _plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    fn, sql = QUERIES[name]
    df = fn(spark, SF)
    cols = sorted(df.columns)
    cur = tables.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert got == want
