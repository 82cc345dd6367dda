"""From raw documents to training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.llm.exact_dedup import drop_exact_duplicates
from seqcast.llm.jaccard_join import MOST_BROADCAST_IDS, Similarity, near_duplicates
from seqcast.llm.mixing import mix_sources
from seqcast.llm.packing import pack
from seqcast.llm.toxicity import reject_toxic, train_toxicity
from seqcast.sources.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier, trained on the labels, calls toxic.

    Null and empty texts score as the bias does, which keeps them. Rows that repeat one another go or stay together. Very long texts are scored whole.
    """
    return reject_toxic(docs.select(*COLUMNS), train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the smallest id.

    Null and empty texts are one text, of which the row that stays keeps its null. A row without an id stays only where no other has its text; of rows
    that repeat one another one stays.
    """
    return drop_exact_duplicates(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the smallest id.

    A document without an id is in no group. Rows that share an id stay or go together.
    """
    gone = written(near_duplicates(docs, Similarity(words=5, percent=80)).filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    # Few ids are sent to the texts; many meet them by shuffle.
    side = F.broadcast(gone) if gone.count() <= MOST_BROADCAST_IDS else gone
    return docs.select(*COLUMNS).join(side, "doc_id", "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. One without words adds nothing to a mix and is not in it.

    Rows that repeat an id are documents of their own; a null source is a source.
    """
    mixed = mix_sources(docs, carry=[c for c in COLUMNS if c not in ("doc_id", "source")]).filter("taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their ids. A null text is its end id alone; repeated rows are packed each, and very long texts whole."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

# Neither a trained classifier nor a fitted subset sum nor a tokenizer can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
