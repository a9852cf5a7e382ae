"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import audit, bpe, centroids, decontaminate, fingerprints, jaccard, lines, pii, quality, shards, substrings, suffixes, toxicity
from lectern.llm.common import table
from lectern.llm.oracles import SQL

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_json(path: str | None = None) -> str:
    """Content of the tokenizer file at `path`; the default is the installed public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.dedup(table(spark, sf_dir, "documents")))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.dedup(table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup(table(spark, sf_dir, "documents")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, docs, table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_json()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digests(shards.shuffled(table(spark, sf_dir, "documents")))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(*centroids.clusters(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substrings, op2_suffixes, op3_pii, op4_lines, op5_jaccard, op6_fingerprints, op7_decontaminate, op8_quality, op9_bpe, op10_toxicity, op11_shards, op12_audit, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
