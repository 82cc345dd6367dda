"""Exact duplicates by sorting content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.sources.shared import written

HEAD = 32


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     keep: str = "smallest", normalise=None) -> DataFrame:
    """Group documents of equal normalised text; one row per input row.

    Columns: the id, ``keep_id`` (id of the row of the group that stays), ``group_size``,
    ``kept`` and ``text_sha256`` of the normalised text.

    Texts are range-partitioned by splitters that Spark samples, sorted within each range
    on disk where memory does not do, and a window compares each text in full with its
    neighbour. The range sort already has equal texts side by side, so the window adds no
    exchange. The range key is a text's first ``HEAD`` characters and then its hash, so that the sample which
    Spark brings to the driver holds no whole texts and texts with one beginning still spread. A text with more rows than an average partition would fill a range by itself:
    its rows get a salt as a second sort key, from their place in the table, and so spread over several ranges whatever their ids; the few runs
    that result, one per salt, are then compared in full and merged. Such texts are found by
    a count over all rows; there are fewer of them than partitions, which bounds what is
    broadcast.

    Null text counts as empty. ``keep`` is "smallest" or "largest"; a null id comes last
    either way. Of repeated rows (same id and text) exactly one is kept. An empty table
    gives no rows; other columns of the input are ignored. ``normalise`` maps a column to a
    column and defaults to no change.
    """
    runs = written(_runs(docs, id_column, text_column, keep, normalise, ())
                   .select("id", "hot", F.when(F.col("hot") & F.col("leads"), F.col("text")).alias("text"),
                           F.sha2("text", 256).alias("text_sha256"), "run_keep", "run_size", "leads", "salt"), "runs")
    # Rows that share the best id may lie in runs of several salts: one of these has the row that stays.
    smallest = keep == "smallest"
    rank = F.struct(F.col("run_keep").isNull() if smallest else F.col("run_keep").isNotNull(), "run_keep", "salt")
    best = F.min_by if smallest else F.max_by
    merged = (runs.filter("hot and leads").groupBy("text", "text_sha256")
              .agg(best(F.struct("run_keep", "salt"), rank).alias("best"), F.sum("run_size").alias("all_size"))
              .select(F.lit(True).alias("hot"), "text_sha256", F.col("best.run_keep").alias("all_keep"), F.col("best.salt").alias("all_salt"), "all_size"))
    whole = runs.drop("text").join(F.broadcast(merged), ["hot", "text_sha256"], "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep"))
    return whole.select(
        F.col("id").alias(id_column), keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("leads") & F.coalesce(F.col("salt") == F.col("all_salt"), F.lit(True))).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all columns. Text and id columns are ``text`` and ``doc_id``."""
    leads = written(_runs(docs, "doc_id", "text", keep, None, docs.columns).filter("leads"), "leads")
    among = Window.partitionBy("text").orderBy(_first("run_keep", keep))
    # A row per salt of the few texts that were spread.
    chosen = leads.filter("hot").withColumn("place", F.row_number().over(among)).filter("place = 1").drop("place")
    return leads.filter("not hot").unionByName(chosen).select(
        *((F.when(F.col("had_text"), F.col("text")) if c == "text" else F.col(f"_kept_{i}")).alias(c) for i, c in enumerate(docs.columns)))


def _first(column: str, keep: str) -> Column:
    return F.col(column).asc_nulls_last() if keep == "smallest" else F.col(column).desc_nulls_last()


def _runs(docs: DataFrame, id_column: str, text_column: str, keep: str, normalise, carry: Sequence[str]) -> DataFrame:
    """Every row in its place of the content sort, with the best id and the size of its run of equal texts and salts."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    change = normalise or (lambda c: c)
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(change(F.col(text_column)), F.lit("")).alias("text"),
                       F.col(text_column).isNotNull().alias("had_text"), F.monotonically_increasing_id().alias("place"),
                       *(F.col(c).alias(f"_kept_{i}") for i, c in enumerate(carry) if c != text_column))
    hot = _hot_texts(base, docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = (base.withColumn("h", F.xxhash64("text")).join(F.broadcast(hot), "h", "left")
              .withColumn("head", F.substring("text", 1, HEAD)).withColumn("hot", F.col("parts").isNotNull())
              .withColumn("salt", F.coalesce(F.pmod("place", "parts"), F.lit(0).cast("long"))).drop("parts", "place"))
    run = Window.partitionBy("head", "h", "salt", "text")
    ordered = run.orderBy(_first("id", keep))
    return (salted.repartitionByRange("head", "h", "salt")
            .withColumn("run_keep", F.first("id").over(ordered)).withColumn("run_size", F.count(F.lit(1)).over(run))
            .withColumn("leads", F.row_number().over(ordered) == 1).drop("head", "h"))


def _hot_texts(base: DataFrame, rows: int, partitions: int) -> DataFrame:
    """Hashes of the texts with more rows than an average partition, and over how many salts to spread each.

    Fewer than ``partitions`` rows, as the counts sum to ``rows``.
    """
    fair = max(1.0, rows / partitions)
    return (base.groupBy(F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fair)
            .select("h", F.ceil(F.col("n") / fair).cast("long").alias("parts")))
