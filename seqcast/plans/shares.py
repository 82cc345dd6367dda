"""The bars of a panel dealt to tasks, and the windows that a task cuts from its share.

Windows are numbered in symbol and position order, so a block of a series knows the numbers of its windows from that of its first. An
epoch's permutation is a function of a number, so a task finds by itself which of its windows go into which step of which rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from seqcast.config import Settings
from seqcast.operators.shards import permuted
from seqcast.operators.split import TRAIN, VALIDATION
from seqcast.operators.windows import gathered_blocks
from seqcast.plans.panel import Panel
from seqcast.plans.scoring import scaled_values

# A share has about so many blocks, so that shares are even.
BLOCKS_OF_SHARE = 16

# Whether a block is of the train split, the number of its first window, and its bars by position as raw 32-bit floats, the target last.
BLOCK = "train boolean, base long, bars binary"


@dataclass(frozen=True)
class Dealt:
    """A kept table of blocks with a partition per task, and how many train windows there are."""

    blocks: RDD
    n_samples: int


def _raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bars = [pa.array([b.values.to_numpy().astype(np.float32).tobytes()], pa.binary()) for b in batch.column("bars")]
        for i, raw in enumerate(bars):
            yield pa.RecordBatch.from_arrays([batch.column("train").slice(i, 1), batch.column("base").slice(i, 1), raw], ["train", "base", "bars"])


def _block_rows(panel: Panel, tasks: int) -> int:
    """Rows of a block: short enough that shares are even, long enough that few rows are in two blocks."""
    s = panel.settings
    bars = panel.split(TRAIN).count()
    return max(s.window, min(s.block_rows, max(4 * s.window, bars // (BLOCKS_OF_SHARE * tasks))))


def deal(panel: Panel, tasks: int) -> Dealt:
    """Deal the blocks of the train and validation splits to ``tasks`` tasks, consecutive windows to one, and keep them.

    A window's number is that in the order of symbols and positions; the table that is summed up for it has a row per symbol.
    """
    s = panel.settings
    block_rows = _block_rows(panel, tasks)
    shares, kept, n_samples = None, [], 0
    for split in (TRAIN, VALIDATION):
        blocks = gathered_blocks(panel.scaled(split), scaled_values(s.features, s.target), s.window, block_rows, panel.fit.cells, "float").persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(blocks)
        counts = blocks.groupBy("Symbol").agg(F.sum(F.size("rows") - s.window).alias("windows"))
        n = counts.agg(F.sum("windows")).first()[0] or 0
        n_samples = n if split == TRAIN else n_samples
        before = Window.orderBy("Symbol").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("Symbol", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("start"))
        numbered = blocks.join(starts, "Symbol").select(
            F.lit(split == TRAIN).alias("train"), (F.col("start") + F.col("rows")[0]["position"]).cast("long").alias("base"),
            F.flatten("rows.bar").alias("bars"))
        placed = numbered.withColumn("task", F.least(F.lit(tasks - 1), F.floor(F.col("base") * tasks / max(1, n))).cast("int"))
        shares = placed if shares is None else shares.union(placed)
    # In order, so that a task that runs again adds up in the same order.
    dealt = (shares.repartitionById(tasks, F.col("task")).sortWithinPartitions("train", "base").drop("task")
             .mapInArrow(_raw, BLOCK).rdd.persist(StorageLevel.MEMORY_AND_DISK))
    dealt.count()
    for blocks in kept:
        blocks.unpersist()
    return Dealt(dealt, n_samples)


def batch_size_of(settings: Settings, n_samples: int, step: int) -> int:
    """Windows of each rank in a step: all steps are full but the last."""
    in_rank = -(-n_samples // settings.world_size)
    return min(settings.batch_size, in_rank - step * settings.batch_size)


class Share:
    """Windows of the blocks that a task holds: views into one table of bars."""

    def __init__(self, rows: Iterable[Row], settings: Settings, train: bool = True) -> None:
        self.window, width = settings.window, len(settings.features) + 1
        bars, starts, numbers, held = [np.empty((0, width), np.float32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for row in rows:
            if row.train == train:
                block = np.frombuffer(row.bars, np.float32).reshape(-1, width)
                n = len(block) - self.window
                bars.append(block)
                starts.append(held + np.arange(n))
                numbers.append(row.base + np.arange(n))
                held += len(block)
        self.bars, self.starts, self.numbers = np.concatenate(bars), np.concatenate(starts), np.concatenate(numbers)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and targets, by their places in the share."""
        first = self.starts[at]
        return self.bars[first[:, None] + np.arange(self.window), :-1], self.bars[first + self.window, -1]

    def places(self, n_samples: int, settings: Settings, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the epoch's permutation, in order, and the window of the share at each. Some windows come again at its end."""
        pos = permuted(self.numbers, n_samples, settings.seed, epoch)
        padded = -(-n_samples // settings.world_size) * settings.world_size
        every, again = [(pos, np.arange(len(pos)))], n_samples
        while len(more := np.flatnonzero(pos + again < padded)):
            every.append((pos[more] + again, more))
            again += n_samples
        pos, at = (np.concatenate(c) for c in zip(*every, strict=True))
        order = np.argsort(pos, kind="stable")
        return pos[order], at[order]
