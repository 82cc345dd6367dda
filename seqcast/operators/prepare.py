"""Cleaning a bar table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.config import Settings
from seqcast.operators.ordering import number_groups
from seqcast.operators.windows import Cells, series_positions


def filter_symbols(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    return bars.where(F.col("Symbol").isin(*symbols))


def parse_dates(bars: DataFrame, lenient: bool = False, date_format: str | None = None, time_zone: str = "UTC") -> DataFrame:
    """``Date`` as a timestamp without time zone, whatever the session's zone.

    Text is read as ISO, or by ``date_format`` (a date or a date and time, in Spark's pattern letters). Text that is no
    date raises, or becomes null with ``lenient``. A timestamp with a time zone is an instant; it
    becomes the day and time that clocks in ``time_zone`` show.
    """
    date = F.col("Date")
    if bars.schema["Date"].dataType.typeName() == "timestamp":
        # Not a cast, which goes by the session's zone and is ambiguous where clocks are set back.
        seconds = (F.unix_micros(date).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
        utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
        return bars.withColumn("Date", F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc))
    if date_format is None or bars.schema["Date"].dataType.typeName() != "string":
        return bars.withColumn("Date", date.try_cast("timestamp_ntz") if lenient else date.cast("timestamp_ntz"))
    pattern = F.lit(date_format)
    # Spark parses a date and time only by a pattern that has both.
    has_time = any(letter in date_format for letter in "HhKka")
    if has_time:
        parsed = F.expr("try_to_timestamp(Date, '{0}')".format(date_format.replace("'", "''"))) if lenient else F.to_timestamp_ntz(date, pattern)
    else:
        parsed = F.try_to_date(date, date_format) if lenient else F.to_date(date, date_format)
    return bars.withColumn("Date", parsed.cast("timestamp_ntz"))


def project_features(bars: DataFrame, features: Sequence[str]) -> DataFrame:
    return bars.select("Symbol", "Date", *features)


def drop_missing(bars: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop rows with a null or NaN feature or a null symbol.

    Written as null tests, which reach the scan, and NaN tests.
    """
    doubles = {f.name for f in bars.schema.fields if f.dataType.typeName() in ("double", "float")}
    present = [F.col(c).isNotNull() for c in ("Symbol", *features)]
    numbers = [~F.isnan(c) for c in features if c in doubles]
    return bars.where(reduce(lambda a, b: a & b, present + numbers))


def sort_bars(bars: DataFrame) -> DataFrame:
    """Output order only: operators that need an order state it in their window."""
    return bars.orderBy("Symbol", "Date")


def bar_positions(bars: DataFrame, cells: Cells = Cells()) -> DataFrame:
    """0-based place of each bar in symbol and date order over the whole table; a hash of its values orders bars of one symbol and date.

    ``cells`` are those of a fit, so that no task ranks more rows than the fit allows, also where many bars share an instant.
    """
    placed = series_positions(bars.withColumn("split", F.lit("")), cells, into="_place").drop("split")
    return number_groups(placed, "Symbol", "_place").drop("_place")


def prepare(bars: DataFrame, settings: Settings) -> DataFrame:
    """Filter, parse, project and clean. Rows without a date belong to no split and go too."""
    kept = filter_symbols(bars, settings.symbols)
    dated = parse_dates(kept, date_format=settings.date_format, time_zone=settings.time_zone).where(F.col("Date").isNotNull())
    return drop_missing(project_features(dated, settings.features), settings.features)
