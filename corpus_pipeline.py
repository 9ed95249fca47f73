"""Corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps; the result
is written as Parquet and read again as the next one's input.  All but the last
keep the columns of documents.

Defined cases, of all stages: empty tables give empty tables; extra columns stay, whatever
their names; texts of any length are read whole; null texts count as empty.  Null and
empty texts are scored by quality's intercept, are near copies of one another, contain no
benchmark item and no secret, and take nothing from a mix.  Rows without an id are
documents of their own, kept after those with one; rows equal in id and text become one in
the near-dedup stage, and rows equal in all columns one with all their copies in the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, mixing, quality, secrets, simhash
from concord.llm.store import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of this stage's input, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Groups are first those of op8, fingerprints within three bits; of what is left,
    documents that are linked by sharing 0.8 of their shingles of five words.
    """
    return simhash.keep_dissimilar(materialize(simhash.keep_one(docs), "distinct"))


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def documents_without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars as it is then."""
    clean = docs.withColumn("text", secrets.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the column ``copies``."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", uncontaminated_documents),
    ("secret scans", documents_without_secrets),
    ("mixing sources to target weights", mixed_documents),
]

#: No stage but the last could be put in SQL; tests compare every stage with a plain version, and run() with the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
