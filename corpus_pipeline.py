"""The text pipeline: which documents stay, and how they are packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its
predecessor kept.  All but the last return the columns of ``documents``.  A
decision names documents by id, so rows with a null id pass the stages that drop
by id; the first stage judges every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import quality
from flowloom.llm.common import broadcast_if_small, stored, table
from flowloom.llm.decontaminate import contamination
from flowloom.llm.exact_dedup import exact_duplicates
from flowloom.llm.near_dedup import near_duplicates
from flowloom.llm.queries import THRESHOLD, packed_pieces


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id is not listed, with their columns as they are."""
    ids = stored(dropped.select(F.col("doc_id").alias("dropped_id")), "dropped")
    ids = broadcast_if_small(ids)
    return docs.join(ids, docs["doc_id"] == ids["dropped_id"], "left_anti")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: the documents it does not reject."""
    stats = stored(quality.statistics_rows(docs), "quality-stats")
    labels = quality.quality_labels(table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.fit(stats, labels), THRESHOLD)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the document with the least id."""
    return _without(docs, exact_duplicates(docs).where(~F.col("kept")))


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document with the least id."""
    return _without(docs, near_duplicates(docs).where(~F.col("kept")))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: the documents without any benchmark phrase."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
    return _without(docs, found.where(F.col("n_hit") > 0))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all remaining documents."""
    return packed_pieces(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("decontamination", clean_documents),
    ("packing", packed_documents),
]

#: A classifier decides what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
