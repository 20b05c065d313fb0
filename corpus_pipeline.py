"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``documents``; where a stage changes a text, ``n_chars`` follows. Stages are written to the shared
folder and read again, so a lost executor costs one stage at most; what a stage wrote is deleted when the next is done.

Defined cases, of all stages: an empty table gives no rows; repeated rows are documents of their own; very long texts
are worked on whole; other columns, whatever their names, are kept by all stages but the last, which ignores them.
Nulls in other columns stay; for those in ``doc_id`` and ``text`` see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, packing, quality, secrets, simhash, suffix_dedup


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return common.reads(docs.withColumn("n_chars", F.length("text").cast("long")), *getattr(docs, "_tessera_reads", ()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go. A null text has no words, so it is rejected; a null doc_id is kept."""
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    A null doc_id comes after all others, and of equal ones the first row stays. Null and empty texts, and those of white
    space, are one group, of which rows with a null doc_id stay too."""
    return simhash.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start twice go from all texts; documents stay, if with an empty text. A null text stays null."""
    return _counted(suffix_dedup.deduplicate(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay. A null text stays null."""
    return _counted(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences. A null text is empty; a null doc_id is kept."""
    # workers have served four stages by now: fewer cached chunks leave them room
    return packing.pack_documents(docs, common.tokenizer_path("byte_bpe_50k.json"), cached=common.cached_chunks(spark) // 2)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = common.materialised(docs, name)
        if hasattr(before, "_tessera_path"):
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
