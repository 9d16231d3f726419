"""The registered queries of this subpackage, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm.common import table
from storyloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


@query("op2_quality")
def op2_quality(spark, sf_dir):
    from storyloom.llm import quality

    return quality.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_secrets")
def op10_secrets(spark, sf_dir):
    from storyloom.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark, sf_dir):
    import public_tokenizers

    from storyloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    from storyloom.llm import toxicity

    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_decontamination")
def op5_decontamination(spark, sf_dir):
    from storyloom.llm import decontamination

    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_warc")
def op3_warc(spark, sf_dir):
    from storyloom.llm import warc

    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query("op9_line_dedup")
def op9_line_dedup(spark, sf_dir):
    from storyloom.llm import lines

    return lines.report(table(spark, sf_dir, "documents"))


@query("op8_order_minhash")
def op8_order_minhash(spark, sf_dir):
    from storyloom.llm import fingerprints

    return fingerprints.report(table(spark, sf_dir, "documents"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, sf_dir):
    from storyloom.llm import jaccard

    return jaccard.grouped(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    from storyloom.llm import suffixes

    return suffixes.report(table(spark, sf_dir, "documents"))


@query("op11_maxent")
def op11_maxent(spark, sf_dir):
    from storyloom.llm import maxent

    return maxent.report(table(spark, sf_dir, "documents"))


@query("op12_centroids")
def op12_centroids(spark, sf_dir):
    from storyloom.llm import centroids

    return centroids.report(table(spark, sf_dir, "embeddings"))


@query("op13_codes")
def op13_codes(spark, sf_dir):
    from storyloom.llm import codes

    return codes.report(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
