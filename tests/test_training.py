import json
import math
import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import data_dir
from checks.stand_in import SETTINGS, daily_panel
from panels import bars, settings
from seqcast.functions.lstm import (Adam, from_vector, initial_weights, loss_and_gradient, predict, to_vector,
                                    weight_shapes)
from seqcast.operators.shards import assign_shards, number_samples
from seqcast.operators.windows import float_window
from seqcast.plans import training
from seqcast.plans.panel import Panel, build_panel
from seqcast.plans.reports import accuracy_report, speedup_report, storage_report
from seqcast.plans.run import run, run_panel, run_repeatedly
from seqcast.plans.scoring import forecast, score
from seqcast.plans.shares import deal
from seqcast.plans.training import EpochLoss, train, train_single
from seqcast.plans.window_regressor import WindowRegressor, fit_window_regressor, regressor_forecast
from seqcast.sources.runs import (CURVE_SCHEMA, WEIGHTS_SCHEMA, parameter_counts, read_summaries, read_table,
                                  weights_from_table, weights_table)


def doubles(weights):
    return {k: v.astype(np.float64) for k, v in weights.items()}


@pytest.fixture(scope="module")
def panel(spark):
    raw, _ = bars(spark, {"A": 120, "B": 90, "C": 61})
    return build_panel(raw, settings(batch_size=16, world_size=2, epochs=3, learning_rate=0.01))


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    weights = doubles(initial_weights(3, 4, 2, 0))
    x, y = rng.random((5, 6, 3)), rng.random(5)
    _, grad = loss_and_gradient(weights, x, y)
    for name, value in weights.items():
        for at in np.ndindex(value.shape):
            old, step = value[at], 1e-6
            value[at] = old + step
            up, _ = loss_and_gradient(weights, x, y)
            value[at] = old - step
            down, _ = loss_and_gradient(weights, x, y)
            value[at] = old
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-8)


def plain_lstm(weights, x):
    """The network one sample and step at a time."""
    def sigmoid(v):
        return 1 / (1 + np.exp(-v))
    out = []
    for sample in x:
        steps = sample
        layer = 0
        while f"lstm.weight_ih_l{layer}" in weights:
            w, u, b, c = (weights[f"lstm.{n}_l{layer}"] for n in ("weight_ih", "weight_hh", "bias_ih", "bias_hh"))
            n = u.shape[1]
            h, cell, states = np.zeros(n), np.zeros(n), []
            for bar in steps:
                i, f, g, o = np.split(w @ bar + b + u @ h + c, 4)
                cell = sigmoid(f) * cell + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(cell)
                states.append(h)
            steps, layer = states, layer + 1
        out.append(weights["fc.weight"][0] @ steps[-1] + weights["fc.bias"][0])
    return np.array(out)


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_network_equals_the_plain_one(layers):
    rng = np.random.default_rng(1)
    weights = doubles(initial_weights(5, 6, layers, 2))
    x = rng.standard_normal((4, 9, 5))
    assert np.allclose(predict(weights, x), plain_lstm(weights, x), atol=1e-12)


def test_dropout_scales_what_it_keeps():
    weights, rng = doubles(initial_weights(2, 30, 2, 0)), np.random.default_rng(0)
    x, y = rng.random((200, 3, 2)), np.zeros(200)
    losses = [loss_and_gradient(weights, x, y, 0.2, rng)[0] for _ in range(5)]
    still = loss_and_gradient(weights, x, y)[0]
    assert len(set(losses)) == 5 and np.mean(losses) == pytest.approx(still, rel=0.3)


def test_parameter_count():
    assert sum(math.prod(s) for s in weight_shapes(5, 50, 2).values()) == 31_851
    weights = initial_weights(5, 50, 2, 0)
    assert all(np.abs(w).max() <= 1 / math.sqrt(50) for w in weights.values())


def test_vector_round_trip():
    weights = initial_weights(5, 7, 2, 1)
    again = from_vector(to_vector(weights), weight_shapes(5, 7, 2))
    assert all(np.array_equal(weights[k], again[k]) for k in weights)


def test_first_adam_step_has_the_size_of_the_rate():
    moved = Adam(3, 0.01).step(np.zeros(3), np.array([2.0, -0.5, 0.0]))
    assert moved == pytest.approx([-0.01, 0.01, 0.0], abs=1e-6)


def test_shard_gradients_average_to_the_whole():
    rng = np.random.default_rng(3)
    weights = doubles(initial_weights(5, 4, 2, 0))
    x, y = rng.random((32, 6, 5)), rng.random(32)
    whole = to_vector(loss_and_gradient(weights, x, y)[1])
    shards = [to_vector(loss_and_gradient(weights, x[r::4], y[r::4])[1]) for r in range(4)]
    assert np.allclose(np.mean(shards, axis=0), whole, atol=1e-14)


def test_one_rank_equals_two_ranks_with_half_batches(spark, panel):
    """Two ranks of 16 see the samples that one rank of 32 sees, when nothing is padded or dropped."""
    assert panel.sequence_keys("train").count() % 2 == 0
    two = train(type(panel)(panel.bars, panel.fit, panel.settings.override(dropout=0.0)))
    one = train(type(panel)(panel.bars, panel.fit, panel.settings.override(dropout=0.0, world_size=1, batch_size=32)))
    assert np.allclose(to_vector(two.weights), to_vector(one.weights), atol=2e-5)


def test_training_lowers_the_loss_and_repeats(spark, panel):
    first, again = train(panel), train(panel)  # jobs that lay two epochs out together
    assert first.curve == again.curve
    assert np.array_equal(to_vector(first.weights), to_vector(again.weights))
    assert first.curve[-1][1] < first.curve[0][1]
    assert [point[0] for point in first.curve] == [1, 2, 3] and first.stopped_epoch == 3
    assert first.n_samples == panel.sequence_keys("train").count()
    other = train(type(panel)(panel.bars, panel.fit, panel.settings.override(seed=1)))
    assert not np.array_equal(to_vector(first.weights), to_vector(other.weights))


def trained(panel, **changes):
    """Weights without dropout, which is drawn by task."""
    return to_vector(train(Panel(panel.bars, panel.fit, panel.settings.override(dropout=0.0, **changes))).weights)


def test_layout_does_not_change_the_result(spark, panel, monkeypatch):
    """Neither the number of tasks, nor how they add up, nor how many epochs or steps are laid out together; what is left is the order of sums."""
    usual = trained(panel)
    for changes in ({"block_rows": 7}, {"tasks": 1}, {"tasks": 3}, {"tasks": 3, "exchange": "jobs"}, {"tasks": 1, "exchange": "jobs"}):
        assert np.allclose(trained(panel, **changes), usual, atol=1e-5), changes
    monkeypatch.setattr(training, "LAYOUT_PARTITIONS", 5)
    monkeypatch.setattr(training, "EPOCHS_TOGETHER", 2)
    assert np.allclose(trained(panel), usual, atol=1e-5)


def test_tasks_that_exchange_among_themselves_equal_jobs(spark, panel):
    """And what a stage that is run again begins with is the state it was given, so it gives the same."""
    short = {"epochs": 1, "batch_size": 32}
    assert np.allclose(trained(panel, exchange="barrier", **short), trained(panel, exchange="jobs", **short), atol=1e-5)
    s = panel.settings.override(epochs=2, sync_every=100)
    dealt, state = deal(panel, 2), training.first_state(panel.settings)
    first, again = (training.run_epochs(dealt, state, s, 2, "rank") for _ in range(2))
    assert np.array_equal(first.vector, again.vector) and first.curve == again.curve and state.epoch == 0
    dealt.blocks.unpersist()


def test_a_step_reads_its_windows_only(spark, panel):
    """The partitions of a step's job hold the step's windows and no others, each once."""
    s = panel.settings
    dealt = deal(panel, 2)
    intervals = training._intervals(s, dealt.n_samples)
    layout = training.laid_out(dealt, s, [(0, steps) for steps in intervals])
    assert layout.getNumPartitions() == 2 * len(intervals) and len(intervals) > 3
    for number, steps in enumerate(intervals):
        records = spark.sparkContext.runJob(layout, list, range(2 * number, 2 * number + 2))
        assert {r[1][0] for r in records} == set(steps)
        windows = sum(len(r[1][3]) // 4 for r in records)
        assert windows == 2 * training.batch_size_of(s, dealt.n_samples, steps[0])
        assert sum(len(r[1][2]) for r in records) == windows * 4 * s.window * 5
    dealt.blocks.unpersist()


def test_shares_hold_every_window_once_and_are_even(spark, panel):
    dealt = deal(panel, 3)
    shares = dealt.blocks.glom().collect()
    held = [training.Share(rows, panel.settings) for rows in shares]
    assert sorted(np.concatenate([h.numbers for h in held]).tolist()) == list(range(dealt.n_samples))
    assert max(map(len, held)) < 0.6 * dealt.n_samples
    keys = {(r.Symbol, r.Date): r.y for r in panel.sequences("train").collect()}
    numbered = {r._number: keys[r.Symbol, r.Date] for r in number_samples(panel.sequence_keys("train")).collect()}
    for h in held:
        _, y = h.windows(np.arange(len(h)))
        assert np.allclose(y, [numbered[n] for n in h.numbers.tolist()], atol=1e-6)
    dealt.blocks.unpersist()


class Killed(Exception):
    pass


@pytest.mark.parametrize("changes", [{}, {"exchange": "barrier", "sync_every": 100}, {"sync_every": 3}])
def test_a_killed_run_goes_on(spark, panel, tmp_path, monkeypatch, changes):
    """From the last state written; dropout is on, and the result is that of an unbroken run."""
    monkeypatch.setattr(training, "EPOCHS_TOGETHER", 2)
    long = Panel(panel.bars, panel.fit, panel.settings.override(epochs=5, **changes))
    whole = train(long)
    path = str(tmp_path / "state")

    def kill(epoch, *_):
        if epoch == 4:
            raise Killed

    with pytest.raises(Killed):
        train(long, progress=kill, state_path=path)
    assert [f for f in os.listdir(path) if f.startswith("epoch-")] == [f for f in os.listdir(path) if f.startswith("epoch-0000004")]
    (tmp_path / "state" / "epoch-0000009-broken").mkdir()  # a state that was not finished
    model = train(long, state_path=path)
    assert np.array_equal(to_vector(model.weights), to_vector(whole.weights)) and model.curve == whole.curve and model.stopped_epoch == 5
    assert train(long, state_path=path).curve == whole.curve
    with pytest.raises(ValueError, match="other settings"):
        train(Panel(panel.bars, panel.fit, long.settings.override(seed=3)), state_path=path)


def test_patience_gives_the_best_weights():
    s = settings()
    state = training.first_state(s)
    for loss, vector in ((0.5, 1.0), (0.3, 2.0), (0.4, 3.0), (0.35, 4.0)):
        state = training.after_epoch(state, np.float32([vector]), state.adam, 1.0, loss, 2)
    assert state.stopped and state.best.tolist() == [2.0] and state.epoch == 4 and state.stale == 2 and state.best_loss == 0.3


def test_ranks_average_weights_every_few_steps(spark, panel):
    settings_of = panel.settings.override(sync_every=3, epochs=4)
    first, again = (train(Panel(panel.bars, panel.fit, settings_of)) for _ in range(2))
    assert first.curve == again.curve and first.curve[-1][1] < first.curve[0][1]


def test_blocks_bound_what_a_row_holds(spark):
    raw, _ = bars(spark, {"A": 900})
    s = settings(block_rows=50, world_size=1)
    panel = build_panel(raw.coalesce(1), s)
    dealt = deal(panel, 2)
    rows = dealt.blocks.collect()
    assert max(len(r.bars) for r in rows) <= 4 * 6 * (50 + s.window) and len(rows) > 10
    dealt.blocks.unpersist()


def test_training_leaves_the_shared_folder_empty(spark, panel, tmp_path):
    def files():
        folder = spark.sparkContext.getCheckpointDir()
        return set(os.listdir(folder.removeprefix("file:"))) if folder else set()
    before = files()
    train(panel)
    assert files() == before


def test_lone_rank_takes_the_steps_of_the_general_path(spark, panel):
    """By hand: the batches of the shard table, one gradient and one step each."""
    s = panel.settings.override(world_size=1, dropout=0.0, epochs=2)
    model = train_single(type(panel)(panel.bars, panel.fit, s))
    rows = {(r.Symbol, r.Date): (np.array(r.x, np.float32).reshape(4, 5), np.float32(r.y)) for r in
            panel.sequences("train").select("Symbol", "Date", float_window(F.col("x")).alias("x"), "y").collect()}
    dealt = assign_shards(panel.sequence_keys("train"), 1, s.batch_size, s.seed, (0, 1)).collect()
    shapes = weight_shapes(5, s.hidden_size, s.num_layers)
    vector, curve = to_vector(initial_weights(5, s.hidden_size, s.num_layers, s.seed)), []
    adam = Adam(len(vector), s.learning_rate)
    for epoch in (0, 1):
        mine = sorted((r for r in dealt if r.epoch == epoch), key=lambda r: r.pos)
        total = 0.0
        for at in range(0, len(mine), s.batch_size):
            part = [rows[r.Symbol, r.Date] for r in mine[at:at + s.batch_size]]
            x, y = np.stack([p[0] for p in part]), np.array([p[1] for p in part])
            loss, grad = loss_and_gradient(from_vector(vector, shapes), x, y)
            vector = adam.step(vector, to_vector(grad))
            total += loss * len(y)
        curve.append(total / len(mine))
    assert np.allclose(to_vector(model.weights), vector, atol=1e-6)
    assert [c[1] for c in model.curve] == pytest.approx(curve, rel=1e-5)


def test_large_batches_are_worked_off_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    weights, s = initial_weights(5, 3, 2, 0), settings(world_size=2, dropout=0.0)
    x, y, ranks = rng.random((50, 4, 5), np.float32), rng.random(50, np.float32), np.arange(50) % 2
    total, losses = training._sums(weights, x, y, ranks, s, rng)
    monkeypatch.setattr(training, "PIECE", 7)
    in_pieces, by_rank = training._sums(weights, x, y, ranks, s, rng)
    assert by_rank == pytest.approx(losses) and np.allclose(in_pieces, total, atol=1e-4)
    whole, gradient = loss_and_gradient(weights, x, y)
    assert losses.sum() / 50 == pytest.approx(whole) and np.allclose(total / 50, to_vector(gradient), atol=1e-5)


def test_validation_is_optional(spark):
    raw, _ = bars(spark, {"A": 60})
    short = build_panel(raw, settings(window=10, batch_size=16, world_size=1, epochs=1))
    assert train(short).curve[0][2] is None


def test_bars_that_repeat_a_date_are_kept(spark):
    """They are samples of their own, ordered by a hash of their values, wherever windows are made."""
    raw, _ = bars(spark, {"A": 60})
    twice = raw.union(raw.limit(40)).union(raw.limit(20).withColumn("Close", F.col("Close") + 1))
    panel = build_panel(twice, settings(epochs=1))
    rows = panel.split("train").count()
    assert train(panel).n_samples == rows - 4 == panel.sequences("train").count() == panel.sequence_keys("train").count()
    values = sorted((r.position, r.y) for r in panel.sequences("train").collect())
    again = build_panel(twice.repartition(7), settings(epochs=1))
    assert values == sorted((r.position, r.y) for r in again.sequences("train").collect())


def test_runs_of_the_same_minute(spark, tmp_path):
    """Nothing is replaced: each run has an id, a model, a curve and a summary."""
    _, pdf = bars(spark, {"A": 80})
    pdf.to_csv(tmp_path / "bars.csv", index=False)
    s = settings(data_dir=str(tmp_path), bars_file="bars.csv", output_dir=str(tmp_path / "out"), symbols=("A",),
                 world_size=1, batch_size=32, epochs=1)
    stats = run_repeatedly(spark, s, 3).collect()
    assert [(r.run_type, r.num_processes, r.runs) for r in stats] == [("distributed", 1, 3)]
    ids = {r.run_id for r in read_summaries(spark, f"{s.output_dir}/risultati").collect()}
    assert len(ids) == 3
    for one in ids:
        assert read_table(spark, f"{s.output_dir}/grafico_loss", CURVE_SCHEMA, one).count() == 1
        assert read_table(spark, f"{s.output_dir}/modello", WEIGHTS_SCHEMA, one).count() == 10
    assert run_repeatedly(spark, s.override(bars_file="none.csv"), 3, single=True) is None


def test_reports_on_runs_as_they_are_logged(spark, tmp_path):
    _, pdf = bars(spark, {"A": 80})
    pdf.to_csv(tmp_path / "bars.csv", index=False)
    s = settings(data_dir=str(tmp_path), bars_file="bars.csv", output_dir=str(tmp_path / "out"), symbols=("A",),
                 world_size=2, batch_size=16, epochs=1)
    run(spark, s, single=True)
    run(spark, s)
    run(spark, s.override(storage="hdfs"))
    log = read_summaries(spark, f"{s.output_dir}/risultati")
    assert {r.num_processes: r.speedup is not None for r in speedup_report(log).collect()} == {1: True, 2: True}
    assert {r.storage for r in storage_report(log, "local").collect()} == {"local", "hdfs"}
    assert {r.num_processes: r.runs for r in accuracy_report(log).collect()} == {1: 1, 2: 2}


def test_progress_is_told_during_a_run(spark, panel, caplog):
    with caplog.at_level("INFO", "seqcast.plans.run"):
        run_panel(panel)
    assert [r.message[:15] for r in caplog.records] == ["Epoch [001/3] -"]


def test_no_series_is_long_enough(spark):
    raw, _ = bars(spark, {"A": 20})
    with pytest.raises(ValueError, match="longer than the window"):
        train(build_panel(raw, settings(window=30)))


def test_patience_stops_and_is_reported(spark, panel):
    stuck = panel.settings.override(learning_rate=1e-12, patience=2, epochs=9)
    model = train(type(panel)(panel.bars, panel.fit, stuck))
    assert model.stopped_epoch == len(model.curve) < 9


def test_epoch_loss_weightings():
    by_rank, by_sample = EpochLoss(2, "rank"), EpochLoss(2, "sample")
    for seen in (by_rank, by_sample):
        seen.add([1.0, 2.0], [4, 4])
        seen.add([3.0, 6.0], [1, 1])
    assert by_rank.value == pytest.approx((2 + 4) / 2)
    assert by_sample.value == pytest.approx((4 + 8 + 3 + 6) / 10)


def test_scores_equal_the_network(spark, panel):
    weights = initial_weights(5, 3, 2, 4)
    rows = panel.sequences("test").collect()
    scored = {(r.Symbol, r.Date): r for r in score(panel.sequences("test").repartition(3), weights, 5).collect()}
    assert len(rows) == len(scored) > 0
    want = predict(weights, np.array([r.x for r in rows], np.float32))
    low, high = panel.target_bounds
    priced = {(r.Symbol, r.Date): r for r in forecast(panel, weights, "test").collect()}
    for r, p in zip(rows, want):
        assert scored[r.Symbol, r.Date].p == pytest.approx(p, abs=1e-6)
        assert scored[r.Symbol, r.Date].y == pytest.approx(r.y, abs=1e-6)
        assert priced[r.Symbol, r.Date].y_pred == pytest.approx(p * (high - low) + low, rel=1e-5)


def test_whole_run_is_saved_and_read_back(spark, tmp_path):
    raw, pdf = bars(spark, {"A": 120, "B": 90, "Z": 30})
    pdf.to_csv(tmp_path / "bars.csv", index=False)
    s = settings(data_dir=str(tmp_path), bars_file="bars.csv", output_dir=str(tmp_path / "out"),
                 symbols=("A", "B"), world_size=2, batch_size=32, epochs=2)
    before = datetime.now()
    both = [run(spark, s), run(spark, s, single=True)]
    summaries = {r.run_type: r for r in read_summaries(spark, f"{s.output_dir}/risultati").collect()}
    assert set(summaries) == {"distributed", "standalone"}
    d, alone = summaries["distributed"], summaries["standalone"]
    assert d.run_id.startswith(f"Distributed_MultiStock_2proc_{before:%Y%m%d}")
    assert alone.run_id.startswith("Standalone_MultiStock_2tickers_")
    assert (d.num_processes, d.stopped_at_epoch, alone.num_processes) == (2, 2, None)
    assert d.stocks_analyzed == ["A", "B"] and d.total_training_samples == both[0].model.n_samples
    metrics = d.aggregate_performance_metrics
    assert metrics.RMSE == pytest.approx(math.sqrt(metrics.MSE), abs=1e-3) and metrics == round_trip(metrics)
    curve = read_table(spark, f"{s.output_dir}/grafico_loss", CURVE_SCHEMA, d.run_id).orderBy("epoch").collect()
    assert [(r.epoch, r.train_loss, r.val_loss) for r in curve] == both[0].model.curve
    table = read_table(spark, f"{s.output_dir}/modello", WEIGHTS_SCHEMA, d.run_id)
    weights = weights_from_table(table, 5, 3, 2)
    assert all(np.array_equal(weights[k], both[0].model.weights[k]) for k in weights)
    with pytest.raises(ValueError, match="weights table"):
        weights_from_table(table, 5, 3, 3)


def round_trip(metrics):
    return type(metrics)(**{k: round(v, 4) for k, v in json.loads(json.dumps(metrics.asDict())).items()})


def test_parameter_counts_from_the_table(spark):
    table = weights_table(spark, initial_weights(5, 50, 2, 0), "r")
    assert [tuple(r) for r in parameter_counts(table).collect()] == [("r", 31_851)]


def test_a_test_period_without_windows_has_no_metrics(spark):
    raw, _ = bars(spark, {"A": 60})
    result = run_panel(build_panel(raw, settings(window=10, batch_size=16, world_size=1, epochs=1)))
    assert result.summary.aggregate_performance_metrics.asDict() == dict.fromkeys(("MSE", "RMSE", "MAE", "MAPE"))


@pytest.mark.parametrize("ridge", [0.0, 1e-3, 0.5])
def test_window_regressor_equals_that_of_spark(spark, panel, ridge):
    """Products at a lag, block by block, against windows and normal equations."""
    cut = Panel(panel.bars, panel.fit, panel.settings.override(block_rows=7))
    model = fit_window_regressor(cut, ridge=ridge)
    rows = panel.sequences("train").select("y", array_to_vector(F.flatten("x")).alias("x"))
    want = LinearRegression(featuresCol="x", labelCol="y", solver="normal", regParam=ridge, tol=1e-12).fit(rows)
    assert np.allclose(model.getOrDefault("coefficients"), want.coefficients.toArray(), atol=1e-8)
    assert model.getOrDefault("intercept") == pytest.approx(want.intercept, abs=1e-8)
    low, high = panel.target_bounds
    got = {(r.Symbol, r.Date): r.y_pred for r in regressor_forecast(panel, model, "test").collect()}
    tests = panel.sequences("test").collect()
    assert len(got) == len(tests) > 0
    for r in tests:
        p = np.ravel(r.x) @ want.coefficients.toArray() + want.intercept
        assert got[r.Symbol, r.Date] == pytest.approx(p * (high - low) + low, rel=1e-6)


def test_a_value_that_does_not_vary_has_no_coefficient(spark):
    raw, _ = bars(spark, {"A": 80})
    panel = build_panel(raw.withColumn("Volume", F.lit(5.0)), settings(symbols=("A",)))
    model = fit_window_regressor(panel, ridge=0.0)
    coefficients = np.array(model.getOrDefault("coefficients")).reshape(4, 5)
    assert (coefficients[:, 4] == 0).all() and (coefficients[:, :4] != 0).all()


def test_regressor_is_saved_and_loaded_in_a_pipeline(spark, panel, tmp_path):
    columns = [f"{c}_scaled" for c in panel.settings.features]
    stage = WindowRegressor(inputCols=columns, labelCol="Close_scaled", predictionCol="p", window=4, regParam=0.01)
    stage.write().save(str(tmp_path / "stage"))
    assert WindowRegressor.load(str(tmp_path / "stage")).getRegParam() == 0.01
    model = Pipeline(stages=[stage]).fit(panel.scaled("train"))
    model.write().save(str(tmp_path / "model"))
    before, after = (sorted(m.transform(panel.scaled("test")).collect()) for m in (model, PipelineModel.load(str(tmp_path / "model"))))
    assert before == after and len(before) == panel.sequences("test").count()
    with pytest.raises(ValueError, match="not one of"):
        WindowRegressor(inputCols=columns[:2], labelCol="Close_scaled", window=4).fit(panel.scaled("train"))


def test_forecasts_move_bars_not_windows(spark, panel):
    plan = forecast(panel, initial_weights(5, 3, 2, 4), "test")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("MapInArrow")[0] and plan.count("MapInArrow") == 1


def test_daily_panel_trains(spark):
    """The stand-in bars at the smallest scale, with the default network."""
    panel = daily_panel(spark, data_dir("0.001"), SETTINGS.override(window=5, world_size=4, epochs=1))
    model = train(panel)
    assert model.n_samples == 871 and model.curve[0][2] is not None
