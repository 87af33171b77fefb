"""The corpus pipeline: quality, near-duplicates, shared passages, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, all but the last with the columns of
``docs``; its input is written as Parquet before it and reread, so no stage is worked out twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.jaccard import keep_one_of_each
from tracemill.llm.packing import pack_documents
from tracemill.llm.pii import redact_pii
from tracemill.llm.quality import keep_quality
from tracemill.llm.substrings import dedup_substrings
from tracemill.session import stored

# No SQL for stages that hash, classify and tokenise; tests hold them against brute force.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: SimHash balls and MinHash bands find them, exact similarity decides."""
    return keep_one_of_each(docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words in windows that a document with a smaller id has too; documents with nothing left go.

    Texts without a cut stay as they are, a NULL one becomes empty; others are their words joined by blanks.
    Columns of the documents that have a name of the operator's result are carried under another.
    """
    others = {name: f"column_{k}" for k, name in enumerate(docs.columns) if name not in ("doc_id", "text")}
    named = docs.select("doc_id", "text", *[F.col(name).alias(new) for name, new in others.items()])
    cut = dedup_substrings(named, extra=list(others.values()), as_is=True)
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    back = {"doc_id": "doc_id", "text": "kept", **others}
    return _with_length(left.select(*[F.col(back[name]).alias(name) for name in docs.columns]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return _with_length(redact_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", shared_passages),
    ("PII", personal_data),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
