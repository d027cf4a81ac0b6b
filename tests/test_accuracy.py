"""Counts of a retrieval taken on the way; the golden questions have a registered query with SQL."""

from pyspark.sql import functions as F

from statuta.operators import corpus
from statuta.plans.accuracy import watched
from statuta.plans.retrieval import retrieve


def _corpus(spark):
    rows = [("mevzuat", "6098", "Türk Borçlar Kanunu", None, "madde", str(n), f"Türk Borçlar Kanunu Madde {n}: (1) Birinci fıkra {n}. (2) TBK {n + 2} uygulanır.") for n in range(1, 9)]
    frame = spark.createDataFrame(rows, "source_type string, law_no string, law_name string, regulation_name string, article_type string, article_no string, text string")
    return corpus.with_structure(frame.withColumn("id", corpus.article_id()))


def test_counts_are_taken_while_the_result_is_written(spark, tmp_path):
    articles = _corpus(spark)
    asked = spark.createDataFrame([(1, "TBK 2"), (2, "TBK 3 2. fıkra"), (3, "selam")], "q_id long, question string")
    ranked, seen = watched(retrieve(asked, articles, corpus.citation_edges(articles)))
    ranked.select("q_id", "id", "rank", "retrieval_source", "extraction_status").write.parquet(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    counts = seen.get
    assert counts["rows"] == stored.count() and counts["answered"] == 2
    assert counts["source_direct_article_lookup"] == stored.where(F.col("retrieval_source") == "direct_article_lookup").count() == 2
    assert counts["status_matched"] == stored.where("extraction_status = 'matched'").count()
