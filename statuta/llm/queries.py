"""Registered queries of the operators: name -> (query function, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fertility, fill_middle, fingerprints, html_text, line_chunks, mixing, ngram_join, simhash, token_counts, token_files, toxicity, whitening

Q: dict = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn
    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op5_bpe_round_trip")
def _(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op6_token_counts")
def _(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@register("op9_token_files")
def _(spark, sf):
    return token_files.written_and_read(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@register("op7_quality_fertility")
def _(spark, sf):
    return fertility.measure(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op1_mix_sources")
def _(spark, sf):
    return mixing.budgets(table(spark, sf, "documents")).drop("content", "epochs", "tail")


@register("op10_line_chunks")
def _(spark, sf):
    return line_chunks.report(table(spark, sf, "documents"))


@register("op8_ngram_classes")
def _(spark, sf):
    return ngram_join.classes(table(spark, sf, "documents"))


@register("op2_toxicity")
def _(spark, sf):
    return toxicity.learned_and_scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op3_html_text")
def _(spark, sf):
    return html_text.extract(table(spark, sf, "pages"))


@register("op4_fingerprints")
def _(spark, sf):
    return fingerprints.compared(table(spark, sf, "documents"))


@register("op11_fill_middle", fill_middle.SQL)
def _(spark, sf):
    return fill_middle.digests(table(spark, sf, "documents"))


@register("op12_embedding_whitening")
def _(spark, sf):
    out = whitening.whitened(table(spark, sf, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@register("op13_simhash_components")
def _(spark, sf):
    out = simhash.near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")
