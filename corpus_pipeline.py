"""The corpus pipeline: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wideleaf.llm import bpe, decontaminate, quality, secrets, similar
from wideleaf.llm.common import delete, read, spool_path, sweeping, write
from wideleaf.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist mostly of them go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those in encoded layers, are replaced by a mask."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, their number, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, columns=docs.columns)


STAGES = [("quality rules", quality_rules), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_redaction), ("byte-level bpe", encoding)]

#: Near-duplicate classes, suffix automata and BPE aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    What a stage spooled goes when its rows are written, and these go when the next stage's are."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = spool_path(spark, name.replace(" ", "-"))
        with sweeping(spark):
            write(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
