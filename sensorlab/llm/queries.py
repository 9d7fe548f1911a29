"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorlab.llm import (
    extraction,
    importance,
    lines,
    minhash,
    mixing,
    neighbours,
    oracles,
    packing,
    periodic,
    personal,
    rule_ensemble,
    secret_scan,
    token_files,
    toxicity,
)
from sensorlab.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.SQL)


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, "word_bpe_49k.json", end=1, capacity=4096).drop("row_id")


@query
def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line rules on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.clean_lines(docs).drop("text", "cleaned")


@query
def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return rule_ensemble.classify(docs, labels)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.classify(docs, labels)


@query
def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract_text(table(spark, sf_dir, "pages"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to files of directly addressable codes and read back."""
    path = scratch(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, "byte_bpe_50k.json", end=0)
    return token_files.read_documents(spark, path)


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).drop("text")


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal.scan_personal(docs).drop("text")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document with planted repeats, and digests of runs and of what is left."""
    return periodic.run_report(table(spark, sf_dir, "documents"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and draw of all documents towards the benchmark's words."""
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return importance.resample(docs, target)
