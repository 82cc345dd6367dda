"""From a bar table to scaled windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.config import Settings
from seqcast.operators.prepare import prepare
from seqcast.operators.scale import bounds_from_profile, scale
from seqcast.operators.split import cutoffs, date_profile, in_split, split_name
from seqcast.operators.windows import Cells, blocked, choose_cells, sequence_keys, sequences


def _date(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@dataclass(frozen=True)
class PanelFit:
    """What one pass over the bars decides: cut-off dates, scaler bounds, and how finely series are cut to be numbered.

    A handful of plain values whatever the size of the bars, so that everything downstream
    compares columns with literals.
    """

    n_dates: int
    train_end: str
    val_end: str
    bounds: dict[str, tuple[float, float]]
    cells: Cells = Cells()

    @property
    def cuts(self) -> tuple[Column, Column]:
        return _date(self.train_end), _date(self.val_end)


@dataclass(frozen=True)
class Panel:
    """Clean bars with a fit, and the tables that follow from the two."""

    bars: DataFrame
    fit: PanelFit
    settings: Settings

    def split(self, only: str | None = None) -> DataFrame:
        """Bars with their split, or those of one split."""
        date = F.col("Date")
        if only is None:
            return self.bars.withColumn("split", split_name(date, *self.fit.cuts))
        return self.bars.where(in_split(only, date, *self.fit.cuts)).withColumn("split", F.lit(only))

    def scaled(self, only: str | None = None) -> DataFrame:
        return scale(self.split(only), self.fit.bounds)

    def sequences(self, only: str | None = None) -> DataFrame:
        s = self.settings
        return sequences(self.scaled(only), [f"{c}_scaled" for c in s.features], f"{s.target}_scaled", s.window, s.block_rows, self.fit.cells)

    def sequence_keys(self, only: str | None = None) -> DataFrame:
        """Keys of the windows. Scaled values order rows of one date, as they do for the windows themselves."""
        return sequence_keys(self.scaled(only), self.settings.window, self.scaled_columns, self.fit.cells)

    def blocks(self, only: str) -> DataFrame:
        """Scaled bars of a split dealt to the blocks that need them."""
        s = self.settings
        return blocked(self.scaled(only).select("split", "Symbol", "Date", *self.scaled_columns), s.window, s.block_rows, self.fit.cells)

    @property
    def scaled_columns(self) -> list[str]:
        s = self.settings
        return list(dict.fromkeys(f"{c}_scaled" for c in (*s.features, s.target)))

    @property
    def target_bounds(self) -> tuple[float, float]:
        return self.fit.bounds[self.settings.target]


def fit_panel(clean: DataFrame, settings: Settings) -> PanelFit:
    """Fit on prepared bars, which are grouped by date once."""
    return fit_from_profile(date_profile(clean, settings.features), settings)


def fit_from_profile(profile: DataFrame, settings: Settings) -> PanelFit:
    """Fit on the numbered calendar with each date's ranges. That table, a row per date, is kept for the few looks at it."""
    profile = profile.persist()
    try:
        cuts = cutoffs(profile, settings.train_ratio, settings.val_ratio).select(
            "n_dates", F.col("train_end").cast("string").alias("train_end"), F.col("val_end").cast("string").alias("val_end")).first()
        if not cuts.n_dates:
            raise ValueError("no bars left to split")
        cells = choose_cells(profile, settings.cell_rows)
        found = bounds_from_profile(profile, _date(cuts.train_end), settings.features).first()
    finally:
        profile.unpersist()
    return PanelFit(
        n_dates=cuts.n_dates, train_end=cuts.train_end, val_end=cuts.val_end,
        bounds={c: (float(found[f"{c}_min"]), float(found[f"{c}_max"])) for c in settings.features}, cells=cells)


def build_panel(bars: DataFrame, settings: Settings) -> Panel:
    clean = prepare(bars, settings)
    return Panel(clean, fit_panel(clean, settings), settings)
