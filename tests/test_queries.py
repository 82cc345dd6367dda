from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import queries
from checks.compare import database, difference
from checks.queries import QUERIES
from checks.stand_in import SETTINGS, daily_panel
from conftest import data_dir

SCALE = "0.001"
# Training is checked by properties; its summary has times and ids of its own.
UNCHECKED = {"train_sequence_model", "train_each_step", "train_single", "fit_window_regressor_60"}
OWN = set(QUERIES)


def test_every_query_has_sql_but_those_on_a_model():
    assert OWN - set(contract.oracle_sql()) == UNCHECKED
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(OWN & set(contract.oracle_sql())))
def test_query_equals_its_sql(spark, name):
    got = contract.queries()[name](spark, data_dir(SCALE)).toPandas()
    want = database(data_dir(SCALE)).execute(contract.oracle_sql()[name]).df()
    assert difference(got, want) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.Symbol for r in rows} == {"1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"}
    assert sum(r.n for r in rows) == 97 and all(r.RMSE > 0 for r in rows)


def test_regression_on_60_bars(spark):
    rows = contract.queries()["fit_window_regressor_60"](spark, data_dir("0.01")).collect()
    assert sum(r.n for r in rows) == 427 and all(r.RMSE > 0 for r in rows)


def test_trained_queries_give_a_summary(spark):
    summary = contract.queries()["train_single"](spark, data_dir("0.001").replace("0.001", "0.01")).first()
    assert summary.run_type == "standalone" and summary.total_training_samples == 5273


def test_training_reads_the_orders_once(spark, monkeypatch):
    """Whatever a run looks at comes from bars that are made already."""
    seen = []
    monkeypatch.setattr(queries, "forecast", lambda panel, *_: panel.bars)
    monkeypatch.setattr(queries, "summary_of", lambda *_: None)
    monkeypatch.setattr(queries, "train", lambda panel: seen.append(panel) or SimpleNamespace(weights=None))
    queries._trained(spark, data_dir(SCALE), SETTINGS)
    assert not [f for f in seen[0].bars.inputFiles() if "orders" in f]
    plain = daily_panel(spark, data_dir(SCALE))
    assert seen[0].fit == plain.fit and sorted(seen[0].bars.collect()) == sorted(plain.bars.collect())
