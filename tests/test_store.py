from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panels import bars, settings
from seqcast.operators.prepare import prepare
from seqcast.plans.incremental import add_to_profile, fit_kept
from seqcast.plans.panel import build_panel, fit_panel
from seqcast.sources.store import read_store, stored_sequences, write_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    raw, _ = bars(spark, {"A": 900, "B": 500, "C": 400, "D": 30})
    clean = prepare(raw, settings(symbols=("A", "B", "C", "D")))
    write_store(clean, "stored_bars", str(tmp_path_factory.mktemp("store") / "bars"), 4)
    yield clean
    spark.sql("DROP TABLE stored_bars")


def test_the_store_holds_the_bars(spark, store):
    assert sorted(map(tuple, read_store(spark, "stored_bars").collect())) == sorted(map(tuple, store.collect()))


def test_years_outside_are_not_read(spark, store):
    some = read_store(spark, "stored_bars", datetime(2021, 3, 1), datetime(2021, 9, 30))
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in store.collect() if datetime(2021, 3, 1) <= r.Date <= datetime(2021, 9, 30))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and {f.split("year=")[1][:4] for f in some.inputFiles()} >= {"2021"}
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("year=2021" in r.f for r in read)


def test_windows_of_a_store_move_nothing(spark, store):
    panel = build_panel(read_store(spark, "stored_bars"), settings(symbols=("A", "B", "C", "D")))
    columns = [f"{c}_scaled" for c in panel.settings.features]
    found = stored_sequences(panel.scaled(), columns, "Close_scaled", 4)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, panel.sequences().collect()))


def test_a_fit_follows_new_days_without_the_old_bars(spark, store, tmp_path):
    """Three batches of days, one added again after a change: the kept fit is that of all bars."""
    s = settings(symbols=("A", "B", "C", "D"))
    path = str(tmp_path / "profile")
    cuts = [datetime(2019, 1, 1), datetime(2020, 9, 1), datetime(2021, 2, 1), datetime(2030, 1, 1)]
    batches = [store.where((F.col("Date") >= F.lit(a)) & (F.col("Date") < F.lit(b))) for a, b in zip(cuts[:-1], cuts[1:])]
    add_to_profile(batches[1].withColumn("Close", F.col("Close") * 9), s.features, path, "second")
    so_far = None
    for name, batch in zip(("first", "second", "third"), batches):
        add_to_profile(batch, s.features, path, name)
        so_far = batch if so_far is None else so_far.union(batch)
        if name != "first":
            assert fit_kept(spark, s, path) == fit_panel(so_far, s)
