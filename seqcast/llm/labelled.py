"""Labelled documents, and which of them a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept back from training: its id's checksum is divisible by the number of folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of the rows to learn from; of repeated ids the largest label counts, null ids and labels none."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
