"""Sliding windows over the series of a panel.

A series is the rows of one symbol within one split, in the order of their dates. Rows of a symbol that share a
date are all kept; a hash of their values says which comes first. Whatever the length of a series and
however many rows share a date, series are cut into blocks of rows by position.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.operators.ordering import number_rows

SERIES = ("split", "Symbol")
BLOCK_ROWS = 4096
# Spans of time, as how much of a date's text they share, the longest first.
SPANS = {"year": 4, "month": 7, "day": 10, "hour": 13, "minute": 16, "second": 19, "instant": 26}


@dataclass(frozen=True)
class Cells:
    """How finely rows are cut to be counted: by a span of time and, within an instant, by bits of a hash."""

    span: str = "day"
    bits: int = 0

    def columns(self, row_hash: Column) -> dict[str, Column]:
        """A date's text begins with its span and knows no time zone; digits of equal length are in order."""
        date = F.date_format("Date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return {"span": F.substring(date, 1, SPANS[self.span]),
                "part": F.shiftrightunsigned(row_hash, 64 - self.bits) if self.bits else F.lit(0).cast("bigint")}


def choose_cells(profile: DataFrame, most: int) -> Cells:
    """The longest span of which none holds more than ``most`` rows of ``profile(Date, rows)``; parts of an instant if it must be.

    One aggregate over the calendar finds the largest cell of every span.
    """
    cells = profile.select("rows", *[c.alias(n) for n, c in ((n, Cells(n).columns(F.lit(0))["span"]) for n in SPANS)])
    sets = cells.groupingSets([[n] for n in SPANS], *SPANS).agg(F.sum("rows").alias("in_cell"), F.grouping_id().alias("of"))
    largest = {r["of"]: r["most"] for r in sets.groupBy("of").agg(F.max("in_cell").alias("most")).collect()}
    by_span = dict(zip(SPANS, (largest[k] for k in sorted(largest)), strict=True)) if largest else {}
    # grouping_id has a bit per column that is not grouped by, the first column's highest: the first span has the smallest.
    for span, rows in by_span.items():
        if rows <= most:
            return Cells(span)
    return Cells("instant", (-(-by_span["instant"] // most) - 1).bit_length()) if by_span else Cells()


def series_positions(rows: DataFrame, cells: Cells = Cells(), into: str = "position") -> DataFrame:
    """0-based place of each row in its series. A hash of the other columns, then these, order rows of one date."""
    values = [c for c in rows.columns if c not in (*SERIES, "Date")]
    row_hash = F.xxhash64(*values) if values else F.lit(0).cast("bigint")
    # The hash's sign bit is turned, so that it is in order as its leading bits are.
    hashed = rows.withColumn("_hash", row_hash.bitwiseXOR(F.lit(-(1 << 63))))
    numbered = number_rows(hashed, "Date", "_hash", *values, cells=cells.columns(row_hash), within=SERIES, into=into)
    return numbered.drop("_hash")


def blocked(rows: DataFrame, window: int, block_rows: int = BLOCK_ROWS, cells: Cells = Cells()) -> DataFrame:
    """Numbered rows dealt to the blocks that need them: ``block`` added, a row per block.

    A row belongs to block ``position / block_rows``; the last ``window`` rows of a block are needed by the next one
    too. A block never has fewer rows than a window, so that context comes from one block before.
    """
    size = max(block_rows, window)
    own = F.floor(F.col("position") / size)
    needed_next = F.col("position") % size >= size - window
    return series_positions(rows, cells).withColumn(
        "block", F.explode(F.when(needed_next, F.array(own, own + 1)).otherwise(F.array(own))))


def in_own_block(window: int, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col("position") / max(block_rows, window)) == F.col("block")


def gathered_blocks(rows: DataFrame, values: Sequence[str], window: int, block_rows: int = BLOCK_ROWS, cells: Cells = Cells(),
                    kind: str = "double") -> DataFrame:
    """A row per block that has a window: ``split, Symbol, block, rows`` with the position, date and values of each bar, in order.

    Windows are cut from a block where it lies; the first ``window`` rows of a block only serve as context.
    """
    wanted = rows.select(*SERIES, "Date", *dict.fromkeys(values))
    bar = F.struct("position", "Date", F.array(*[F.col(v).cast(kind) for v in values]).alias("bar"))
    return (blocked(wanted, window, block_rows, cells).groupBy(*SERIES, "block").agg(F.array_sort(F.collect_list(bar)).alias("rows"))
            .filter(F.size("rows") > window))


def sequences(rows: DataFrame, features: Sequence[str], target: str, window: int, block_rows: int = BLOCK_ROWS,
              cells: Cells = Cells()) -> DataFrame:
    """Every run of ``window`` consecutive rows of a series with the target of the row after it.

    ``rows`` has ``split``, ``Symbol``, ``Date`` and the feature columns. A result row carries
    the date and position of its target. Series of at most ``window`` rows give nothing.

    Rows are moved twice, whatever the length of a series: to their cells to find positions, and then to
    their blocks, in each of which a window is a plain bounded frame. No task has to hold more of a series than a cell or a block.
    """
    frame = Window.partitionBy(*SERIES, "block").orderBy("position").rowsBetween(-window, -1)
    wanted = rows.select(*SERIES, "Date", *dict.fromkeys([*features, target]))
    return (blocked(wanted, window, block_rows, cells)
            .select(*SERIES, "Date", "position", "block", F.array(*features).alias("_bar"), F.col(target).alias("y"))
            .withColumn("x", F.collect_list("_bar").over(frame))
            .filter((F.col("position") >= window) & in_own_block(window, block_rows))
            .select(*SERIES, "Date", "position", "x", "y"))


def sequence_keys(rows: DataFrame, window: int, features: Sequence[str] = (), cells: Cells = Cells()) -> DataFrame:
    """Key and series position of every sequence, without building the arrays.

    ``features`` decide the order of rows that share a date.
    """
    return (series_positions(rows.select(*SERIES, "Date", *features), cells).drop(*features)
            .where(F.col("position") >= window))


def sequence_counts(rows: DataFrame, window: int) -> DataFrame:
    """Rows and sequences of each series: a count, no window."""
    n = F.count(F.lit(1))
    return rows.groupBy(*SERIES).agg(n.alias("n_rows"), F.greatest(n - window, F.lit(0)).alias("n_sequences"))


def flat_features(x: Column) -> Column:
    """A window as one vector, time step by time step."""
    return F.flatten(x)


def last_step(x: Column) -> Column:
    return F.element_at(x, -1)


def float_window(x: Column) -> Column:
    """A window as one vector of 32-bit floats."""
    return F.flatten(x).cast("array<float>")
