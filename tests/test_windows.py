import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import data_dir
from checks.stand_in import SETTINGS, daily_panel
from panels import FEATURES, bars, brute_sequences, settings
from seqcast.operators.prepare import prepare
from seqcast.operators.split import date_profile
from seqcast.operators.windows import (SPANS, Cells, blocked, choose_cells, flat_features, last_step, sequence_counts, sequence_keys,
                                       sequences, series_positions)
from seqcast.plans.panel import build_panel

KNOWN_COUNTS = {
    ("0.001", 60): (651, 0, 0), ("0.01", 60): (5273, 467, 427), ("0.1", 60): (7460, 720, 720),
    ("0.001", 5): (871, 97, 97), ("0.01", 5): (5493, 687, 647), ("0.1", 5): (7680, 940, 940),
}


@pytest.mark.parametrize("scale_factor, window", KNOWN_COUNTS)
def test_known_sequence_counts(spark, scale_factor, window):
    panel = daily_panel(spark, data_dir(scale_factor), SETTINGS.override(window=window))
    counted = {r.split: r[1] for r in sequence_counts(panel.split(), window).groupBy("split").agg(F.sum("n_sequences")).collect()}
    assert tuple(counted[s] for s in ("train", "val", "test")) == KNOWN_COUNTS[scale_factor, window]
    made = {r.split: r["count"] for r in panel.sequences().groupBy("split").count().collect()}
    assert tuple(made.get(s, 0) for s in ("train", "val", "test")) == KNOWN_COUNTS[scale_factor, window]


@pytest.mark.parametrize("block", [1, 13, 5000])
@pytest.mark.parametrize("window", [1, 4, 40])
def test_windows_equal_brute_force(spark, block, window):
    """Blocks shorter than the window and longer than a series, and a series of exactly ``window`` bars."""
    raw, pdf = bars(spark, {"A": 500, "B": 60, "C": 50, "D": window, "E": window + 1}, every={"B": 5, "C": 37})
    rows = prepare(raw, settings(symbols=tuple("ABCDE"))).withColumn("split", F.lit("train"))
    got = sequences(rows, FEATURES, "Close", window, block, Cells("month")).collect()
    want = brute_sequences(pdf.assign(split="train"), ["split", "Symbol"], FEATURES, "Close", window)
    assert len(got) == len(want)
    for r in got:
        x, y = want[r.split, r.Symbol, r.Date]
        assert np.array_equal(np.array(r.x), x) and r.y == y


@pytest.mark.parametrize("span", SPANS)
def test_windows_of_seconds(spark, span):
    """Cells of every span: seconds with fractions up to years."""
    rng = np.random.default_rng(5)
    gaps = rng.choice([0.25, 1, 45, 3600, 86400 * 20], 200)
    text = [str(d) for d in pd.Timestamp("2019-11-03") + pd.to_timedelta(np.cumsum(gaps), "s")]
    pdf = pd.DataFrame({"Symbol": "A", "Date": text, **{c: rng.random(200) for c in FEATURES}})
    rows = prepare(spark.createDataFrame(pdf), settings()).withColumn("split", F.lit("train"))
    want = brute_sequences(pdf.assign(split="train", Date=pd.to_datetime(pdf.Date, format="ISO8601")), ["split", "Symbol"],
                           FEATURES, "Close", 6)
    got = sequences(rows, FEATURES, "Close", 6, 32, Cells(span)).collect()
    assert len(got) == len(want) == 194
    assert all(np.array_equal(np.array(r.x), want[r.split, r.Symbol, r.Date][0]) for r in got)


@pytest.mark.parametrize("most, cells", [
    (1000, Cells("year")), (366, Cells("year")), (365, Cells("month")), (31, Cells("month")), (30, Cells("day")), (1, Cells("day"))])
def test_cells_bound_the_rows_counted_together(spark, most, cells):
    raw, _ = bars(spark, {"A": 731})
    profile = date_profile(prepare(raw, settings()))
    assert choose_cells(profile, most) == cells
    assert choose_cells(profile.filter("false"), most) == Cells()


@pytest.mark.parametrize("most, bits", [(100, 0), (99, 1), (50, 1), (49, 2), (9, 4)])
def test_an_instant_with_many_rows_is_cut_by_hash(spark, most, bits):
    raw, _ = bars(spark, {"A": 1})
    many = prepare(raw, settings()).drop("Close").crossJoin(spark.range(100).select(F.col("id").cast("double").alias("Close")))
    cells = choose_cells(date_profile(many), most)
    assert cells.bits == bits
    rows = many.withColumn("split", F.lit("train"))
    usual = {r.Close: r.position for r in series_positions(rows).collect()}
    assert sorted(usual.values()) == list(range(100))
    assert {r.Close: r.position for r in series_positions(rows, cells).collect()} == usual


def test_windows_take_two_full_exchanges(spark, tmp_path):
    """One to the cells, one to the blocks; and what the positions need besides is counts."""
    raw, _ = bars(spark, {"A": 400, "B": 300})
    raw.withColumn("Date", F.col("Date").cast("timestamp_ntz")).write.parquet(str(tmp_path / "b"))
    panel = build_panel(spark.read.parquet(str(tmp_path / "b")), settings())
    plan = panel.sequences("train")._jdf.queryExecution().executedPlan().toString()
    full = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_of_" not in line]
    by = [line.split("hashpartitioning(")[1].split("), ")[0] for line in full]
    moved = [b for b in by if "block" in b or "_cell_" in b]
    # The bars' and the counts' exchange by cell, and the bars' by block.
    assert sum("block" in b for b in moved) == 1 and sum("_cell_" in b for b in moved) <= 2 and len(by) <= 4
    assert "SinglePartition" not in plan


def test_windows_stay_within_series_and_split(spark):
    raw, pdf = bars(spark, {"A": 50, "B": 50})
    panel = build_panel(raw, settings(block_rows=7, cell_rows=40))
    assert panel.fit.cells == Cells("day")
    split = panel.split().toPandas()
    want = brute_sequences(split, ["split", "Symbol"], FEATURES, "Close", 4)
    got = panel.sequences().collect()
    assert len(got) == len(want)
    lows = {c: panel.fit.bounds[c] for c in FEATURES}
    for r in got:
        x, _ = want[r.split, r.Symbol, r.Date]
        scaled = np.array([[(v - lows[c][0]) / (lows[c][1] - lows[c][0]) for v, c in zip(bar, FEATURES)] for bar in x])
        assert np.allclose(np.array(r.x), scaled, atol=1e-12)


def test_length_guard(spark):
    raw, pdf = bars(spark, {"A": 4, "B": 5})
    rows = prepare(raw, settings()).withColumn("split", F.lit("train"))
    assert {r.Symbol: r.n_sequences for r in sequence_counts(rows, 4).collect()} == {"A": 0, "B": 1}
    assert [r.Symbol for r in sequences(rows, FEATURES, "Close", 4).collect()] == ["B"]


@pytest.mark.parametrize("span", ["year", "month", "instant"])
def test_positions_and_keys(spark, span):
    raw, pdf = bars(spark, {"A": 90, "B": 30}, every={"B": 13})
    rows = prepare(raw, settings()).withColumn("split", F.lit("train"))
    for r in series_positions(rows, Cells(span)).collect():
        mine = sorted(pdf[pdf.Symbol == r.Symbol].Date)
        assert mine[r.position] == r.Date
    keys = {(r.Symbol, r.Date) for r in sequence_keys(rows, 4, cells=Cells(span)).collect()}
    assert keys == {(r.Symbol, r.Date) for r in sequences(rows, FEATURES, "Close", 4, cells=Cells(span)).collect()}


def test_flat_and_last(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "x array<array<double>>")
    row = df.select(flat_features(F.col("x")).alias("f"), last_step(F.col("x")).alias("l")).first()
    assert (row.f, row.l) == ([1.0, 2.0, 3.0, 4.0], [3.0, 4.0])


def test_a_hot_series_is_spread_over_tasks(spark):
    """A third of the rows in one series: neither a cell nor a block of it holds much."""
    raw, pdf = bars(spark, {"A": 3000, **{f"s{i}": 60 for i in range(100)}})
    panel = build_panel(raw, settings(symbols=tuple(pdf.Symbol.unique()), block_rows=100, cell_rows=2000))
    assert panel.fit.cells == Cells("day")
    made = panel.sequences("train")
    assert made.count() == sequence_counts(panel.split("train"), 4).agg(F.sum("n_sequences")).first()[0]
    blocks = blocked(panel.split("train"), 4, 100).groupBy("Symbol", "block").count()
    assert blocks.agg(F.max("count")).first()[0] <= 104 and blocks.filter("Symbol = 'A'").count() > 20


def test_split_and_symbols_reach_the_scan(spark, tmp_path, capsys):
    raw, _ = bars(spark, {"A": 60, "B": 60, "Z": 60})
    raw.withColumn("Date", F.col("Date").cast("timestamp_ntz")).withColumn("Other", F.lit(1)).write.parquet(str(tmp_path / "b"))
    panel = build_panel(spark.read.parquet(str(tmp_path / "b")), settings())
    panel.sequences("test").explain("formatted")
    plan = capsys.readouterr().out
    pushed, read = (next(line for line in plan.splitlines() if line.startswith(k)) for k in ("PushedFilters", "ReadSchema"))
    assert "GreaterThan(Date" in pushed and "In(Symbol" in pushed
    assert "Other" not in read
