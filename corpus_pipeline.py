"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
rows its predecessor kept, and its result is written and read again as the next
one's docs. All but the last return the columns of documents.

Null texts fail the quality rules; further columns go along unchanged; an empty
table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.llm import lines, minhash, mixing, packing, secret_scan
from sensorlab.llm.common import table, written

SECRET_MARK = "[secret]"
SEQUENCE_IDS, VOCABULARY, END_ID = 4096, "word_bpe_49k.json", 1


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that the rules reject.

    Null and empty texts are rejected; repeated rows are judged alike.
    """
    return _recounted(lines.keep_clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with a similarity of 0.80 or more stays, whatever the ids.

    The row with the smallest id stays, a null id last; rows without words all stay.
    """
    return minhash.drop_near_duplicates(docs, per_cent=80, n_bands=24)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; null texts stay null, no row goes."""
    return _recounted(secret_scan.redact_secrets(docs, SECRET_MARK))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it.

    Documents of which it takes none go, as those without words do; repeated rows are
    documents of their own, and a null source is a source.
    """
    return _recounted(mixing.mix_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a null text is an empty one."""
    return packing.pack(docs, VOCABULARY, END_ID, SEQUENCE_IDS).drop("row_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Hash draws, tokens and similarity components are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
