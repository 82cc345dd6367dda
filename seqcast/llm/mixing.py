"""Mix sources to target weights by fitting a subset sum to each budget."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.sources.shared import written
from seqcast.sources.ship import ship_package

WORD = r"[^\x20\x09-\x0D]+"
# Top bits of a document's seeded hash: documents of one source and length are counted by these first.
SLICE_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Target words of each source: ``source, source_size, target``.

    Sources in code point order, null last, weigh ``weights``, repeating. They share
    ``share`` times all words by weight; no target exceeds ``most`` times its source, and the
    excess is shared again by weight. The common level at which this ends is found by taking
    the sources in order of the level at which each is full. The windows here are over one row
    per source.
    """
    in_order, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", "rank")
    so_far = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    per_source = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                  .withColumn("rank", F.row_number().over(in_order) - 1)
                  .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
                  .withColumn("cap", F.col("source_size") * most)
                  .withColumn("full_at", F.col("cap") / F.col("weight")))
    levels = (per_source
              .withColumn("left", F.sum("source_size").over(everything) * share - (F.sum("cap").over(so_far) - F.col("cap")))
              .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - (F.sum("weight").over(so_far) - F.col("weight"))))
              # The first source that is not full at the level of those from it on.
              .withColumn("common", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("common.level"), F.col("full_at")) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for ``budget`` words, as near below it as can be found.

    An equal share of every length comes first, so that the mix looks like its source. Long
    documents then bring the rest down to a few of the longest lengths, and that rest is
    fitted exactly by a bounded-knapsack table: one bit per reachable sum, counts split into
    powers of two, and for each sum the item that reached it first.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    # budget * counts can pass 64 bits.
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((take * lengths).sum())
    longest = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= 2 * longest:
            break
        more = min(int(counts[i] - take[i]), (rest - longest) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, rest)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    reach, mask = 1, (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        left, piece = min(int(counts[i]), budget // length), 1
        while left > 0 and not reach >> budget & 1:
            n = min(piece, left)
            new = (reach << n * length) & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = len(items)
                items.append((i, n))
                reach |= new
            left, piece = left - n, piece * 2
    take, at = np.zeros(len(lengths), np.int64), reach.bit_length() - 1
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(rows["target"].iloc[0])
    whole = int(target // total) if total else 0
    rows["whole"] = whole
    rows["take"] = fit_budget(lengths, counts, round(target) - whole * total)
    return rows[["source", "size", "whole", "take"]]


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2,
                seed: int = 7, carry: Iterable[str] = ()) -> DataFrame:
    """How often each document goes into a mix of its sources.

    Returns a row per input row: ``doc_id, source, size, source_size, target, taken`` and the
    columns named in ``carry``. ``taken`` is the words the mix takes from the row, a whole
    multiple of ``size`` up to ``most``.

    A source is taken whole as often as its target allows. For the rest, its documents are
    counted by exact length, ``fit_budget`` finds how many of each length to take, and a hash
    of seed, id, text and carried columns draws that many. The fit of a source sees one row per distinct length, not
    its documents. To draw without bringing all documents of one length together, they are
    first counted by slices of the hash; whole slices are in or out, and only the slice at the
    edge is ranked.

    Null or empty text has size 0 and is never taken. A null source is a source of its own.
    Rows that repeat an id are documents of their own; those that are the same in all that comes out are interchangeable. Which of the rows without an id
    are taken depends on the table's files. Very long texts are counted whole. An empty table gives no
    rows. Columns not named in ``carry`` do not matter.
    """
    ship_package(docs.sparkSession.sparkContext)
    carry = list(carry)
    # Rows without an id may be many and alike: their place in the table tells them apart.
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()), F.col("text"), *carry)
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed.alias("_draw"),
                       F.shiftrightunsigned(hashed, 64 - SLICE_BITS).alias("_slice"),
                       *(F.col(c).alias(f"_kept_{i}") for i, c in enumerate(carry)))
    sizes = written(base.select("doc_id", "source", "size", "_draw", "_slice"), "sizes")
    targets = source_targets(sizes, weights, share, most)
    slices = sizes.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("n"))
    lengths = slices.filter("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    t = targets.withColumnRenamed("source", "t_source")
    fitted = (lengths.join(t, F.col("source").eqNullSafe(F.col("t_source")))
              .select("source", "size", "n", "target").groupBy("source")
              .applyInPandas(_fit_source, lengths.select("source").schema.add("size", "long").add("whole", "long").add("take", "long")))
    fitted = written(fitted, "fitted").select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "whole", "take")
    before = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .join(fitted, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")), "left")
              .join(t, F.col("source").eqNullSafe(F.col("t_source")), "left")
              .select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("_slice").alias("q_slice"),
                      "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"),
                      F.greatest(F.lit(0), F.coalesce("take", F.lit(0)) - F.col("before")).alias("quota")))
    drawn = Window.partitionBy("source", "size", "_slice").orderBy("_draw", "doc_id")
    return ((base if carry else sizes)
            .withColumn("_rank", F.row_number().over(drawn))
            .join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))
                  & (F.col("_slice") == F.col("q_slice")))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * (F.col("whole") + (F.col("_rank") <= F.col("quota")).cast("long"))).alias("taken"),
                    *(F.col(f"_kept_{i}").alias(c) for i, c in enumerate(carry))))
