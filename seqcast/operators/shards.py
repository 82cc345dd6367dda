"""Samples over ranks and mini-batches.

These work on sample keys, not on windows: only keys are numbered, once, and an epoch's permutation is a function of a key's number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.operators.ordering import number_groups, number_rows
from seqcast.operators.windows import Cells

# Fixed values of the permutation, which its SQL shares: a prime, the factors of what goes into a round, and the rounds.
PRIME = 2_147_483_647
VALUE_FACTOR, SEED_FACTOR, EPOCH_FACTOR, ROUND_FACTOR = 1_103_515_245, 69_621, 48_271, 16_807
ROUNDS = 6
# Keys of a series with positions that one task ranks.
CELL_ROWS = 250_000


def sides(n: int) -> tuple[int, int]:
    """The sides of a grid with at least ``n`` cells and fewer than a side's more."""
    across = max(1, math.isqrt(max(0, n - 1)) + 1) if n else 1
    return across, max(1, -(-n // across))


def _round_key(seed: int, number: int) -> int:
    return (seed % PRIME * SEED_FACTOR + number * ROUND_FACTOR) % PRIME


def _mixed(numbers: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """All rounds of the permutation of the grid's cells."""
    across, down = sides(n)
    y, x = np.divmod(numbers, across)
    for r in range(ROUNDS):
        t = ((x if r % 2 else y) * VALUE_FACTOR + (epoch * EPOCH_FACTOR + _round_key(seed, r)) % PRIME) % PRIME
        cube = t * t % PRIME * t % PRIME
        if r % 2:
            y = (y + cube) % down
        else:
            x = (x + cube) % across
    return y * across + x


def permuted(numbers: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Places of the samples ``numbers`` (below ``n``) in an epoch: a permutation of all numbers below ``n``.

    A Feistel network over the cells of a grid of about ``n`` cells: in turn one coordinate is moved by a function of the other. A
    number that lands beyond ``n`` goes on from there until it lands below (cycle walking).
    """
    places = _mixed(np.asarray(numbers, np.int64), n, seed, epoch)
    while len(beyond := np.flatnonzero(places >= n)):
        places[beyond] = _mixed(places[beyond], n, seed, epoch)
    return places


def walks(n: int, seed: int, epochs: Sequence[int]) -> int:
    """How often at most a number has to go on: followed from the cells beyond ``n``, of which there are fewer than its root."""
    most = 0
    for epoch in epochs:
        start = np.arange(n, math.prod(sides(n)), dtype=np.int64)
        now, taken = start, 0
        while len(now):
            now, taken = _mixed(now, n, seed, epoch), taken + 1
            # A cell that comes back to itself is on a cycle beyond ``n``, which no number enters.
            on = (now >= n) & (now != start)
            start, now = start[on], now[on]
        most = max(most, taken)
    return most


def with_places(numbered: DataFrame, n: int, seed: int, epochs: Sequence[int], number: str = "_number", into: str = "_place") -> DataFrame:
    """``permuted`` as columns, for rows with an ``epoch`` of ``epochs``: projections only, nothing moves."""
    across, down = sides(n)
    out = numbered.withColumn(into, F.col(number).cast("long"))
    for walk in range(1 + walks(n, seed, epochs)):
        out = out.withColumns({"_x": F.col(into) % across, "_y": F.expr(f"{into} div {across}")})
        for r in range(ROUNDS):
            own, other, size = ("_y", "_x", down) if r % 2 else ("_x", "_y", across)
            key = (F.col("epoch").cast("long") * EPOCH_FACTOR + _round_key(seed, r)) % PRIME
            out = out.withColumn("_t", (F.col(other) * VALUE_FACTOR + key) % PRIME)
            out = out.withColumn(own, (F.col(own) + F.col("_t") * F.col("_t") % PRIME * F.col("_t") % PRIME) % size)
        moved = F.col("_y") * across + F.col("_x")
        out = out.withColumn(into, moved if not walk else F.when(F.col(into) >= n, moved).otherwise(F.col(into)))
    return out.drop("_x", "_y", "_t")


def number_samples(keys: DataFrame, within: Sequence[str] = (), cells: Cells = Cells(), into: str = "_number") -> DataFrame:
    """Samples numbered in symbol and date order, in the whole table or in each group of ``within``.

    Keys of one series are ranked by cells: runs of positions where they have one, else ``cells`` of their dates.
    """
    key = [c for c in ("Symbol", "Date", "position") if c in keys.columns]
    cut = {"run": F.floor(F.col("position") / CELL_ROWS)} if "position" in key else cells.columns(F.lit(0))
    in_series = number_rows(keys.select(*within, *key), *key[1:], cells=cut, within=[*within, "Symbol"], into="_in_series")
    return number_groups(in_series, "Symbol", "_in_series", within=within, into=into).select(*within, *key, into)


def dealt(pos: Column, world_size: int, batch_size: int) -> tuple[Column, Column]:
    """Rank and batch of a place."""
    return (pos % world_size).cast("int"), F.floor(F.floor(pos / world_size) / batch_size)


def assign_shards(keys: DataFrame, world_size: int, batch_size: int, seed: int = 0,
                  epochs: Sequence[int] = (0,), cells: Cells = Cells()) -> DataFrame:
    """Rank and batch of every sample in each of ``epochs``.

    Samples are numbered in symbol and date order. A sample at place ``pos`` of the epoch's permutation of the numbers goes to rank
    ``pos % world_size``. Keys that repeat a symbol and date have a ``position`` to tell them apart, which is then kept.
    All ranks get equally many: the permutation is continued from its start until it divides,
    so some samples appear again. One rank and no seed change is the single-process case.

    The keys are counted when the plan is built. They are moved to be numbered, whatever the number of epochs; places are projections.
    """
    n = keys.count()
    key = [c for c in ("Symbol", "Date", "position") if c in keys.columns]
    drawn = number_samples(keys, cells=cells).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    padded = -(-n // world_size) * world_size
    pos = F.explode(F.sequence("_place", F.lit(padded - 1).cast("long"), F.lit(max(1, n)).cast("long"))).alias("pos")
    placed = with_places(drawn, n, seed, epochs).select("epoch", *key, pos)
    rank, batch = dealt(F.col("pos"), world_size, batch_size)
    return placed.select("epoch", rank.alias("rank"), "pos", batch.alias("batch"), *key)


def ordered_batches(keys: DataFrame, batch_size: int, cells: Cells = Cells()) -> DataFrame:
    """Batches in symbol and date order within each split, the last one short."""
    placed = number_samples(keys, ["split"], cells, into="pos")
    return placed.withColumn("batch", F.floor(F.col("pos") / batch_size))


def steps_per_epoch(n_samples: int, world_size: int, batch_size: int) -> int:
    return -(-(-(-n_samples // world_size)) // batch_size)
