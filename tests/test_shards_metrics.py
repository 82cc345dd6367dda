import math

import numpy as np
import pytest
from hypothesis import given, settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import data_dir
from checks.stand_in import SETTINGS, daily_panel, persistence
from seqcast.operators.metrics import (batch_losses, mape, rank_epoch_loss, reduced_epoch_loss, regression_metrics,
                                       weighted_epoch_loss)
from seqcast.operators.scale import unscale
from seqcast.operators.shards import assign_shards, number_samples, ordered_batches, permuted, sides, steps_per_epoch, walks, with_places


def keys(spark, n):
    return spark.range(n).select(F.lit("train").alias("split"), F.concat(F.lit("s"), F.col("id") % 3).alias("Symbol"),
                                 F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int))").alias("Date"))


@pytest.mark.parametrize("n, world", [(10, 4), (12, 4), (1, 3), (2, 5), (130, 1), (257, 2)])
def test_shards_are_equal_and_complete(spark, n, world):
    rows = assign_shards(keys(spark, n), world, 8, seed=3, epochs=(0, 5)).collect()
    for epoch in (0, 5):
        mine = [r for r in rows if r.epoch == epoch]
        each = math.ceil(n / world)
        assert sorted(r.pos for r in mine) == list(range(each * world))
        assert all(r.rank == r.pos % world and r.batch == r.pos // world // 8 for r in mine)
        # Places up to n are a permutation, later ones repeat it from its start.
        by_pos = {r.pos: (r.Symbol, r.Date) for r in mine}
        assert len({by_pos[p] for p in range(n)}) == n
        assert all(by_pos[p] == by_pos[p % n] for p in by_pos)
        assert max(r.batch for r in mine) + 1 == steps_per_epoch(n, world, 8)


def test_order_comes_from_the_number_alone(spark):
    got = assign_shards(keys(spark, 40).repartition(7), 1, 8, seed=3, epochs=(2,)).collect()
    in_order = sorted((r.Symbol, r.Date) for r in keys(spark, 40).collect())
    want = [in_order[i] for i in np.argsort(permuted(np.arange(40), 40, 3, 2))]
    assert [(r.Symbol, r.Date) for r in sorted(got, key=lambda r: r.pos)] == want


@examples(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40), st.integers(0, 10**6))
def test_a_permutation_of_all_numbers(n, seed, epoch):
    places = permuted(np.arange(n), n, seed, epoch)
    assert np.array_equal(np.sort(places), np.arange(n))
    across, down = sides(n)
    assert n <= across * down < n + across


def test_walks_end_where_cells_beyond_go_round_among_themselves():
    assert all(0 <= walks(n, 0, (0, 1)) <= 60 for n in range(1, 1500))


def test_large_numbers_neither_overflow_nor_meet():
    n = 10**15 + 37
    numbers = np.concatenate([np.arange(1000), np.arange(n - 1000, n)])
    places = permuted(numbers, n, 5, 7)
    assert len(np.unique(places)) == 2000 and places.min() >= 0 and places.max() < n


def test_columns_equal_the_array_version(spark):
    for n in (1, 2, 3, 7, 50, 1001):
        df = spark.range(n).select(F.col("id").alias("_number"), F.explode(F.array(F.lit(0), F.lit(9), F.lit(200))).alias("epoch"))
        got = {(r._number, r.epoch): r._place for r in with_places(df, n, 11, (0, 9, 200)).collect()}
        assert got == {(i, e): p for e in (0, 9, 200) for i, p in enumerate(permuted(np.arange(n), n, 11, e).tolist())}


def test_places_are_spread(spark):
    """Neighbours part, and an epoch says nothing of the next."""
    n = 10_000
    a, b = (permuted(np.arange(n), n, 0, e) for e in (0, 1))
    for x, y in ((a[:-1], a[1:]), (a, b), (a, np.arange(n))):
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.05
    assert np.histogram(a[:1000], 10, (0, n))[0].min() > 60


def test_more_epochs_move_no_more(spark):
    """The only exchanges are those that number the keys."""
    def exchanges(epochs):
        plan = assign_shards(keys(spark, 40), 2, 8, epochs=epochs)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange ")
    numbered = number_samples(keys(spark, 40))._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges((0,)) == exchanges(tuple(range(50))) == numbered


def test_epochs_differ_and_repeat(spark):
    def order(epoch, seed=0):
        rows = assign_shards(keys(spark, 60), 2, 8, seed, (epoch,)).collect()
        return [r.Date for r in sorted(rows, key=lambda r: r.pos)]
    assert order(0) == order(0) != order(1)
    assert order(0) != order(0, seed=1)


def test_ordered_batches(spark):
    rows = ordered_batches(keys(spark, 70), 32).collect()
    in_order = sorted(rows, key=lambda r: r.pos)
    assert [(r.Symbol, r.Date) for r in in_order] == sorted((r.Symbol, r.Date) for r in rows)
    sizes = [sum(r.batch == b for r in rows) for b in range(3)]
    assert sizes == [32, 32, 6]


@given(st.integers(1, 10**6), st.integers(1, 64), st.integers(1, 512))
def test_steps(n, world, batch):
    assert steps_per_epoch(n, world, batch) == math.ceil(math.ceil(n / world) / batch)


KNOWN_METRICS = {
    ("0.001", 5): (97, 34134118297.3431, 184754.2105, 148887.4053, 377.197),
    ("0.01", 60): (427, 42355195004.3886, 205803.7779, 171577.1098, 226.4481),
    ("0.01", 5): (647, 41050937120.8211, 202610.3085, 168841.6517, 197.0785),
    ("0.1", 60): (720, 39584365303.069, 198958.1999, 162125.7469, 199.4498),
    ("0.1", 5): (940, 40457927392.481, 201141.5606, 163960.6038, 274.2142),
}


@pytest.mark.parametrize("scale_factor, window", KNOWN_METRICS)
def test_known_persistence_metrics(spark, scale_factor, window):
    panel = daily_panel(spark, data_dir(scale_factor), SETTINGS.override(window=window))
    forecasts = unscale(persistence(panel, "test"), panel.target_bounds, {"y": "y_actual", "p": "y_pred"})
    got = regression_metrics(forecasts).first()
    assert tuple(got) == pytest.approx(KNOWN_METRICS[scale_factor, window], rel=1e-6)


@examples(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 1.5, -2.0, 40.0]), st.floats(-50, 50)), min_size=1, max_size=20))
def test_metrics_equal_numpy(spark, pairs):
    y, p = np.array(pairs).T
    got = regression_metrics(spark.createDataFrame(pairs, "y_actual double, y_pred double")).first()
    nonzero = y != 0
    percent = np.mean(np.abs((y[nonzero] - p[nonzero]) / y[nonzero])) * 100 if nonzero.any() else 0
    want = (len(y), np.mean((y - p) ** 2), math.sqrt(np.mean((y - p) ** 2)), np.mean(np.abs(y - p)), percent)
    assert tuple(got) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_mape_without_any_truth_is_zero(spark):
    df = spark.createDataFrame([(0.0, 3.0)], "y double, p double")
    assert df.agg(mape(F.col("y"), F.col("p"))).first()[0] == 0.0


def test_epoch_losses(spark):
    errors = spark.createDataFrame(
        [(0, 0, 0, 1.0), (0, 0, 0, 3.0), (0, 0, 1, 2.0), (0, 1, 0, 1.0)], "epoch int, rank int, batch long, error double")
    losses = batch_losses(errors)
    assert {(r.rank, r.batch): (r.loss, r["size"]) for r in losses.collect()} == {(0, 0): (5.0, 2), (0, 1): (4.0, 1), (1, 0): (1.0, 1)}
    assert weighted_epoch_loss(losses).first().loss == pytest.approx(15 / 4)
    assert {r["rank"]: r.loss for r in rank_epoch_loss(losses).collect()} == {0: 4.5, 1: 1.0}
    assert reduced_epoch_loss(losses).first().loss == pytest.approx(2.75)
