"""Bounded samples to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A sample's hashes are drawn from so much more of their range than its size asks for, so that enough rows are found.
MARGIN = 1.3
RANGE = 1 << 40


def smallest_hashes(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``column``, or all if there are fewer. Rows without a value are left out.

    A share of the hashes' range is kept first, by the number of rows, so that what tasks sort and send is
    about as much as is wanted, however many tasks there are.
    """
    present = rows.filter(F.col(column).isNotNull())
    n = present.count()
    share = min(RANGE, int(RANGE * (MARGIN * most + 100) / max(1, n)))
    place = F.xxhash64(column)
    return present.filter(F.pmod(place, F.lit(RANGE)) < share).orderBy(F.pmod(place, F.lit(RANGE)), column).limit(most)
