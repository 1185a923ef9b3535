"""The corpus pipeline: five stages over ``documents``.

Each stage works on all that the one before it kept, and its result is written
as Parquet in the cluster's shared folder and read again as the next one's input,
so a lost executor costs a stage at most.  All but the last return the columns of
``documents``; the last returns the packed sequences' pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import configure, drop_table, keep, table
from ticklake.llm.decontaminate import decontaminated
from ticklake.llm.exact_dedup import deduplicated
from ticklake.llm.near_dedup import near_duplicates
from ticklake.llm.packing import packed_documents
from ticklake.llm.quality import good

QUALITY = 0.5  # score from which a document stays


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good(docs, table(spark, sf_dir, "labels"), threshold=QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays: the one with the smallest doc_id."""
    gone = keep(near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# The stages use trained weights, MinHash and tokenizer files, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    configure(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
