"""Loads by touched laws, and lookups that leave the corpus where it is."""

import pathlib
import re

from pyspark.sql import functions as F

from statuta.functions.text import content_hash
from statuta.operators import corpus, lookup
from statuta.sources import corpus_store as S
from statuta.sources.readers import read_by_law


def _articles(spark, rows):
    frame = spark.createDataFrame(rows, "law_no string, article_no string, text string")
    return frame.select(F.lit("mevzuat").alias("source_type"), "law_no", F.lit("Kanun").alias("law_name"), F.lit("madde").alias("article_type"), "article_no", "text",
                        content_hash(F.col("text")).alias("content_hash")).withColumn("id", corpus.article_id())


def _store(spark, path):
    rows = [("0061", "1", "TBK 5 uygulanır."), ("0061", "2", "metin"), ("6100", "1", "TBK 7 uygulanır."), ("2004", "1", "son")]
    articles = _articles(spark, rows)
    S.create_store(path, articles, corpus.chunk_rows(articles), corpus.citation_edges(articles))
    return articles


def test_a_load_neither_reads_nor_writes_other_laws(spark, tmp_path):
    path = str(tmp_path / "store")
    _store(spark, path)
    # files of the other laws are spoiled: a job that opened one of them would fail
    others = [p for p in pathlib.Path(path).rglob("*.parquet") if "law_no=0061" not in str(p)]
    assert others
    for p in others:
        p.write_bytes(b"no parquet file")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    batch = _articles(spark, [("0061", "1", "yeni metin"), ("0061", "2", "metin"), ("0061", "3", "ek metin")]).drop("content_hash")
    result = S.load_batch(spark, path, batch)
    assert {(r.article_no, r.reason) for r in result["changes"].collect()} == {("1", "content_changed"), ("2", "same"), ("3", "new")}
    assert all(p.read_bytes() == b"no parquet file" for p in others)
    stored = read_by_law(spark, path + "/articles").where("law_no = '0061'").collect()
    assert sorted((r.law_no, r.article_no, r.text) for r in stored) == [("0061", "1", "yeni metin"), ("0061", "2", "metin"), ("0061", "3", "ek metin")]
    # the only citation of the law is gone, and with it the partition
    assert not list(pathlib.Path(path, "edges").glob("source_law_no=0061/*.parquet"))


def test_wanted_laws_prune_at_run_time(spark, tmp_path):
    _store(spark, str(tmp_path / "s"))
    wanted = spark.createDataFrame([("6100",), ("6100",), (None,), ("none",)], "law_no string")
    rows = S.read_laws(spark, str(tmp_path / "s" / "articles"), wanted)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.law_no for r in rows.collect()] == ["6100"]


def _above(plan, table):
    """Names of the nodes between the scan of a table and the join above it."""
    lines = re.sub(r"\*\(\d+\) ", "", plan).split("\n")
    at = next(i for i, line in enumerate(lines) if table in line and "FileScan" in line)
    names, depth = [], lines[at].index("FileScan")
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            names.append(line.lstrip(" :+-").split(" ")[0])
            if "Join" in names[-1]:
                break
    return names


def test_the_corpus_is_not_shuffled_for_a_lookup(spark, tmp_path):
    articles = _store(spark, str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = S.store_lookups(articles, articles.select("id", "source_type", *corpus.ARTICLE_KEY), "t_corpus", str(tmp_path / "b"), 8)
        refs = spark.createDataFrame([(1, 1, "6100", "1", "madde"), (2, 1, "6100", "1", "madde"), (3, 1, "9", "1", "madde")],
                                     "q_id long, ord long, law_no string, article_no string, article_type string")
        found = lookup.direct_articles(refs, stored["links"])
        by_id = found.select("q_id", "id").join(stored["articles"], "id")
        assert sorted((r.q_id, r.text) for r in by_id.collect()) == [(1, "TBK 7 uygulanır."), (2, "TBK 7 uygulanır.")]
        key_path = _above(found._jdf.queryExecution().executedPlan().toString(), "links_by_key")
        id_path = _above(by_id._jdf.queryExecution().executedPlan().toString(), "articles_by_id")
        for names in (key_path, id_path):
            assert names[-1].endswith("Join") and not any("Exchange" in n for n in names), names
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in ("links_by_key", "links_by_id", "articles_by_id"):
            spark.sql(f"DROP TABLE IF EXISTS t_corpus_{table}")
