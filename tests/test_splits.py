"""Files read in many splits: line numbers, line ends, and articles over the size of one row."""

import random

from pyspark.sql import functions as F

from statuta.operators.segment import oversized_segments, segment_articles
from statuta.sources import readers


def _write(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)


def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    files = {}
    for law, ends in (("6098_tbk", ["\n"]), ("6100_hmk", ["\r\n"]), ("2004_iik", ["\n", "\r\n", "\r"])):
        lines = [f"{i} " + "ş" * rng.randint(0, 120) for i in range(4000)]
        raw = "﻿" + "".join(x + rng.choice(ends) for x in lines)
        _write(tmp_path / law, f"{law}_raw.txt", raw.encode())
        files[law.split("_")[0]] = lines
    _write(tmp_path / "1_bos", "1_bos_raw.txt", b"")
    _write(tmp_path / "2_tek", "2_tek_raw.txt", b"tek")
    files["2"] = ["tek"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = readers.read_statute_lines(spark, f"{tmp_path}/*/*_raw.txt")
        scan = spark.read.text(f"{tmp_path}/6098_tbk/*_raw.txt")
        assert scan.select(F.spark_partition_id().alias("p")).distinct().count() > 4  # one file, many tasks
        got = {}
        for r in rows.collect():
            got.setdefault(r.law_no, []).append((r.line_no, r.line))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: [line for _, line in sorted(v)] for k, v in got.items()} == files
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in got.values())


def test_long_articles_go_to_their_own_table(spark):
    lines = [("f", 0, "başlık"), ("f", 1, "Madde 1- kısa"), ("f", 2, "devam"), ("f", 3, "Madde 2- " + "uzun " * 10), *[("f", 4 + i, "satır " * 20) for i in range(30)],
             ("f", 99, "Madde 3- son")]
    frame = spark.createDataFrame(lines, "file string, line_no int, line string")
    names = spark.createDataFrame([("f", "1", "Kanun")], "file string, law_no string, law_name string")
    kept = segment_articles(frame, names, limit=500).orderBy("pos").collect()
    assert [(r.article_no, r.text) for r in kept] == [("1", "Kanun Madde 1: kısa devam"), ("3", "Kanun Madde 3: son")]
    long = oversized_segments(frame, limit=500).collect()
    assert len(long) == 31 and {r.segment for r in long} == {2} and min(r.chars for r in long) > 500
    assert len(segment_articles(frame, names).collect()) == 3 and oversized_segments(frame).count() == 0
