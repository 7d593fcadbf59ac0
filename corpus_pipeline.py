"""The corpus pipeline: documents through five stages, each the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents.  Between stages the rows are written as Parquet to the
folder that the cluster shares and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm import jaccard, lines, packing, quality, secrets
from rastrum.llm.common import shared_dir, table
from rastrum.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or are outliers of their language and source go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that five documents hold stay in the one with the largest id; n_chars follows."""
    kept = lines.dedup_lines(docs, min_chars=40, min_docs=5)
    return with_length(kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 on five-word shingles connect, the one with the least id stays."""
    return jaccard.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder; every document stays; n_chars follows."""
    return with_length(secrets.redact(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, TOKENIZER, 2048), 2048)


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with these columns, n_chars (if among them) being the length of text."""
    return docs.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but line dedup can be put in SQL: robust estimates, links' components, the battery and packing are iterative.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
