"""Readers, writers and incremental loading on files."""

import json

from pyspark.sql import functions as F

from statuta.operators import corpus
from statuta.operators.segment import segment_articles
from statuta.plans.ingest import incremental_load, parse_laws
from statuta.sources import readers, writers
from statuta.streaming.arrivals import load_arrivals

STATUTE = "﻿GİRİŞ\n  Madde 1- (1) Birinci cümle.\n\n   (2) İkinci cümle.\nEk Madde 1 – (1) Ek hüküm.\nGEÇİCİ MADDE 1- (1) Geçici hüküm.\nMükerrer Madde 35 - Tek blok: a) bir b) iki\nMadde 2-\n"
PARSED = {("madde", "1"): "İş Kanunu Madde 1: (1) Birinci cümle. (2) İkinci cümle.", ("ek", "1"): "İş Kanunu Ek Madde 1: (1) Ek hüküm.",
          ("gecici", "1"): "İş Kanunu Geçici Madde 1: (1) Geçici hüküm.",
          ("mukerrer_madde", "35"): "İş Kanunu Mükerrer Madde 35: Tek blok: a) bir b) iki"}


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_statute_files(spark, tmp_path):
    _write(tmp_path / "4857_is", "4857_raw.txt", STATUTE)
    lines = readers.read_statute_lines(spark, f"{tmp_path}/*/*_raw.txt")
    rows = segment_articles(lines, readers.law_names(lines)).collect()
    assert {(r.article_type, r.article_no): r.text for r in rows} == PARSED
    stored = parse_laws(lines, readers.law_names(lines)).where("original_type = 'mukerrer_madde'").first()
    assert (stored.article_type, stored.article_no) == ("madde", "35/A")
    assert [p.no for p in stored.paragraphs] == ["1", "2"] and set(stored.paragraphs[1]["items"]) == {"a", "b"}


def test_article_json_and_regulation_meta(spark, tmp_path):
    _write(tmp_path / "a", "a_preview.json", json.dumps([{"kanun_no": " 1 ", "kanun_adi": "K", "madde_no": "1", "madde_tipi": "madde", "icerik": " x "},
                                                        {"kanun_no": "1", "icerik": "  "}], ensure_ascii=False))
    raw = readers.read_article_json(spark, f"{tmp_path}/a/*_preview.json")
    kept = corpus.clean_records(raw, ["kanun_no", "icerik"], "icerik").collect()
    assert [(r.kanun_no, r.icerik, r.source_file) for r in kept] == [("1", "x", "a_preview.json")]
    _write(tmp_path / "good", "meta.json", '{"bagli_kanun_no": "6698", "yonetmelik_adi": "Y", "source_type": "yonetmelik"}')
    _write(tmp_path / "bad", "meta.json", '{"bagli_kanun_no": "6698", "yonetmelik_adi": ""}')
    good, bad = readers.read_regulation_meta(spark, f"{tmp_path}/*/meta.json")
    assert [r.folder for r in good.collect()] == ["good"]
    assert [(r.folder, r.missing_keys) for r in bad.collect()] == [("bad", ["regulation_name", "source_type"])]


def test_replacing_one_law_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "law_no string, text string")
    writers.replace_laws(rows, path)
    writers.replace_laws(spark.createDataFrame([("2", "c")], rows.schema), path)
    assert sorted((str(r.law_no), r.text) for r in spark.read.parquet(path).collect()) == [("1", "a"), ("2", "c")]
    many = spark.createDataFrame([("3", f"t{i}") for i in range(500)], rows.schema).repartition(7)
    writers.replace_laws(many, path, salts=2)
    assert len(list((tmp_path / "articles" / "law_no=3").glob("*.parquet"))) <= 2
    plan = readers.read_law(spark, path, "1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(law_no" in plan


def test_preview_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "ğ")], "law_no string, text string")
    writers.write_preview(df, str(tmp_path / "p"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "p")).collect() == df.collect()


def test_incremental_load_rechunks_only_changes(spark, tmp_path):
    _write(tmp_path / "4857_is", "4857_raw.txt", STATUTE)
    lines = readers.read_statute_lines(spark, f"{tmp_path}/*/*_raw.txt")
    first = parse_laws(lines, readers.law_names(lines)).withColumn("source_type", F.lit("mevzuat"))
    empty = first.limit(0).withColumn("content_hash", F.lit(""))
    chunks0 = corpus.chunk_rows(first).limit(0)
    one = incremental_load(first, empty, chunks0)
    assert {r.reason for r in one["changes"].collect()} == {"new"}
    edited = first.withColumn("text", F.when(F.col("article_type") == "ek", F.concat("text", F.lit(" Değişik."))).otherwise(F.col("text")))
    two = incremental_load(edited, one["articles"], one["chunks"])
    assert {(r.article_type, r.reason) for r in two["changes"].collect()} == {
        ("madde", "same"), ("gecici", "same"), ("ek", "content_changed")}
    assert two["chunks"].count() == one["chunks"].count() == 4
    # edges of unchanged articles are taken over as they are stored, those of changed ones are read anew
    old = spark.createDataFrame([("4857", "madde", "1", "x"), ("4857", "ek", "1", "y")], "source_law_no string, source_article_type string, source_article_no string, raw_match string")
    old = old.select(*[F.col(c) if c in old.columns else F.lit(None).cast(t).alias(c) for c, t in one["edges"].dtypes])
    three = incremental_load(edited.where("article_type != 'gecici'"), one["articles"], one["chunks"], old)
    assert [r.raw_match for r in three["edges"].where("raw_match in ('x', 'y')").collect()] == ["x"]
    assert [r.article_type for r in three["removed"].collect()] == ["gecici"]


def test_arriving_files(spark, tmp_path):
    seen = {}
    _write(tmp_path / "in" / "4857_is", "4857_raw.txt", STATUTE)

    def snapshot():
        lines = readers.read_statute_lines(spark, f"{tmp_path}/in/*/*_raw.txt")
        rows = parse_laws(lines, readers.law_names(lines)).withColumn("source_type", F.lit("mevzuat")).limit(0)
        return rows.withColumn("content_hash", F.lit("")), corpus.chunk_rows(rows)

    def publish(result, epoch):
        seen[epoch] = result["articles"].count()

    query = load_arrivals(spark, f"{tmp_path}/in/*", str(tmp_path / "cp"), snapshot, publish).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen == {0: 4}
