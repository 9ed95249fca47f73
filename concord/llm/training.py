"""What the classifiers share: a bounded labelled sample, and hashed features of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample on which a classifier is fitted.
TRAIN_ROWS = 10_000


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text (null: empty text) modulo ``divisor``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of ``limit`` labelled rows at most, in one partition and a fixed order.

    Only rows whose id remainder modulo 3 isn't 1 are taken.  Labels are cut
    first, by a hash of their id, so that what is broadcast and what one task
    sorts are both within ``limit``.  Rows without an id or a label are not used.
    """
    usable = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "label").limit(limit).select("text", "label")
