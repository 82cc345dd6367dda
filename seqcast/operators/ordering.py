"""Row numbers over a whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, *order: str, cells: Mapping[str, Column], within: Sequence[str] = (),
                into: str = "position") -> DataFrame:
    """0-based position of every row in the order given, in the whole table or in each group of ``within``.

    ``cells`` are columns that follow the order: a row in a later cell, by these columns in turn, comes later. They are
    functions of the row alone, so the two looks at the table, one that counts the rows of each cell and one that
    ranks rows within their cell, see the same cells however they are planned. A plain ``row_number``
    would bring a whole group into one task; here a task holds a cell, and counts are combined before they move. The
    table of counts, which is summed up within each group, has a row per group and cell.

    Nothing runs before the result is asked for, and nothing is written. Rows equal in ``order`` get different positions in
    no particular order.
    """
    named = {f"_cell_{name}": column for name, column in cells.items()}
    celled = df.withColumns(named)
    key = [*within, *named]
    before = Window.partitionBy(*within).orderBy(*named).rowsBetween(Window.unboundedPreceding, -1)
    starts = (celled.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
              .select(*[F.col(c).alias(f"_of_{c}") for c in key], "_start"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return (celled.withColumn("_rank", rank).join(starts, same)
            .select(*df.columns, (F.col("_start") + F.col("_rank")).alias(into)))


def number_groups(df: DataFrame, group: str, position: str, within: Sequence[str] = (), into: str = "position") -> DataFrame:
    """Positions within groups turned into positions over all groups in order, in the whole table or in each of ``within``.

    The table of groups, which is summed up, has a row per group.
    """
    before = Window.partitionBy(*within).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*within, group).agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    return df.join(starts, [*within, group]).withColumn(into, F.col("_before") + F.col(position)).drop("_before")
