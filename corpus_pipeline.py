"""The corpus pipeline: stages over the documents, each one operator of ``driftgauge.llm``.

Every stage takes the rows that its predecessor kept and, but for the last, returns rows with the columns of the
documents: junk goes (quality classifier), lines spread over many sites go but for their first occurrence, one document
of each group of near duplicates stays (five-word shingles, similarity 0.8), documents that hold a benchmark item go,
and what is left is packed into sequences of at most 2048 ids. SQL cannot express the classifier, the fingerprints, edit
distances or tokens, so there is no SQL twin; the tests compare each stage with a brute-force version.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftgauge.llm.common import load, written
from driftgauge.llm.decontamination import clean_documents
from driftgauge.llm.line_dedup import without_boilerplate
from driftgauge.llm.packing import pack
from driftgauge.llm.quality_classifier import good_documents
from driftgauge.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return good_documents(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of any length that spread over ten sites or more, but for each line's first occurrence."""
    return without_boilerplate(docs, least_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 2048 ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
