"""Bar tables: one row per symbol and trading day."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.config import Settings

log = logging.getLogger(__name__)

# Cell texts of a CSV file that mean "missing".
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class BarsNotFound(FileNotFoundError):
    """The bar table's path does not exist."""


def read_bars(spark: SparkSession, path: str, settings: Settings = Settings(), format: str = "csv",
              missing_ok: bool = False) -> DataFrame | None:
    """Scan a bar table by column name, keeping its other columns.

    A CSV file is read as text, so that the order of its columns does not matter and the
    missing-value markers become null in every column, also in ``Symbol``. Features are then
    cast to double; text that is no number raises. ``Date`` stays as it is in the file.

    A path that does not exist raises :class:`BarsNotFound`, or gives None with ``missing_ok``.
    """
    try:
        if format == "csv":
            raw = spark.read.csv(path, header=True)
        else:
            raw = spark.read.format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if missing_ok:
            log.error("no bar table at %s", path)
            return None
        raise BarsNotFound(f"no bar table at {path}") from error

    absent = [c for c in ("Symbol", "Date", *settings.features) if c not in raw.columns]
    if absent:
        raise ValueError(f"bar table at {path} lacks {', '.join(absent)}")

    def cell(name: str):
        column = F.col(f"`{name}`")
        if format == "csv":
            column = F.when(~column.isin(*MISSING_MARKERS), column)
        if name in settings.features:
            column = column.cast("double")
        return column.alias(name)

    return raw.select(*[cell(c) for c in raw.columns])
