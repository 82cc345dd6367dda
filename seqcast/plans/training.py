"""Data-parallel training over bars that stay where they are.

Blocks of bars are dealt to tasks once and kept (``plans.shares``). A step's gradient is the sum over its windows, wherever they lie, so tasks
need not be as many as ranks: the ranks say which windows make up a step, the tasks share its work. There are two ways to add up:

- ``jobs``: a job per step. The windows of a run of steps are cut and laid out by step, and a step's job
  runs on the partitions of its own windows only.
- ``barrier``: one job for several epochs. Its tasks run at the same time, hold their share, and exchange gradients among themselves after
  every step; the driver sees the weights when the job ends. Spark looks for the answer to an exchange once a second, so this is for few long steps.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import RDD, BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import Row

from seqcast.config import Settings
from seqcast.functions.lstm import Adam, Weights, errors_and_gradient, from_vector, initial_weights, to_vector, weight_shapes
from seqcast.operators.shards import steps_per_epoch
from seqcast.plans.panel import Panel
from seqcast.plans.scoring import CHUNK, predict_in_chunks
from seqcast.plans.shares import Dealt, Share, batch_size_of, deal
from seqcast.sources.ship import ship_package
from seqcast.sources.states import TrainingState, newest_state, save_state

# A task's windows of a step are worked off in pieces of this many, whose gradients add up.
PIECE = 512
# Epochs that are laid out together, or are one barrier job, and after which a state is written.
EPOCHS_TOGETHER = 5
# Partitions of a layout by step.
LAYOUT_PARTITIONS = 2000

Progress = Callable[[int, float, float | None], None]


@dataclass(frozen=True)
class TrainedModel:
    weights: Weights
    settings: Settings
    run_type: str
    n_samples: int
    seconds: float
    stopped_epoch: int
    curve: list[tuple[int, float, float | None]] = field(default_factory=list)
    steps: int = 0


class EpochLoss:
    """Running train loss of one epoch, per rank or per sample."""

    def __init__(self, world_size: int, weighting: str):
        self.weighting = weighting
        self.totals, self.counts = np.zeros(world_size), np.zeros(world_size)

    def add(self, losses: Sequence[float], sizes: Sequence[int]) -> None:
        """The losses of one step, by rank."""
        weights = np.array(sizes if self.weighting == "sample" else [1] * len(losses))
        self.totals += np.array(losses) * weights
        self.counts += weights

    @property
    def value(self) -> float:
        if self.weighting == "sample":
            return float(self.totals.sum() / self.counts.sum())
        return float((self.totals / self.counts).mean())


def first_state(settings: Settings) -> TrainingState:
    vector = to_vector(initial_weights(len(settings.features), settings.hidden_size, settings.num_layers, settings.seed))
    return TrainingState(vector, Adam(len(vector), settings.learning_rate), vector)


def after_epoch(state: TrainingState, vector: np.ndarray, adam: Adam, train_loss: float, val_loss: float | None, patience: int | None) -> TrainingState:
    """The state one epoch on. The best weights are those of the smallest validation loss so far, the last ones where there is none."""
    epoch = state.epoch + 1
    better = val_loss is None or val_loss < state.best_loss
    stale = 0 if better else state.stale + 1
    return TrainingState(vector, adam, vector if better else state.best, epoch, state.best_loss if not better or val_loss is None else val_loss, stale,
                         [*state.curve, (epoch, train_loss, val_loss)], patience is not None and stale >= patience)


def _sums(weights: Weights, x: np.ndarray, y: np.ndarray, ranks: np.ndarray, settings: Settings,
          rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sum over windows of the gradient of their squared error, and sums of squared errors by rank."""
    total, losses = np.zeros(sum(map(np.size, weights.values()))), np.zeros(settings.world_size)
    for at in range(0, len(y), PIECE):
        part = slice(at, at + PIECE)
        errors, gradient = errors_and_gradient(weights, x[part], y[part], settings.dropout, rng)
        total += len(errors) * to_vector(gradient).astype(np.float64)
        losses += np.bincount(ranks[part], errors, settings.world_size)
    return total, losses


Windows = tuple[np.ndarray, np.ndarray, np.ndarray]


def interval_part(vector: np.ndarray, adam: Adam | None, settings: Settings, n_samples: int, epoch: int, steps: range, task: int,
                  windows: Callable[[int], Windows | None]) -> tuple[np.ndarray, np.ndarray]:
    """One task's share of the steps of an interval, in numbers that add up, and sums of squared errors by step and rank.

    A lone step gives the task's part of the mean gradient over ranks. Several steps are taken on
    the task's own windows and give its weights, optimiser moments and a count, to be averaged; only these need ``adam``. ``windows`` gives the
    task's windows, targets and ranks of a step, or nothing.
    """
    shapes = weight_shapes(len(settings.features), settings.hidden_size, settings.num_layers)
    losses = np.zeros((len(steps), settings.world_size))
    moved, own, taken, gradient = vector, adam and adam.at(adam.mean, adam.square, adam.steps), 0, np.zeros(len(vector))
    for step in steps:
        found = windows(step)
        if found is None:
            continue
        x, y, ranks = found
        total, by_rank = _sums(from_vector(moved, shapes), x, y, ranks, settings, np.random.default_rng((settings.seed, epoch, step, task)))
        losses[step - steps.start] = by_rank
        if len(steps) == 1:
            gradient = total / (settings.world_size * batch_size_of(settings, n_samples, step))
        else:
            moved, taken = own.step(moved, (total / len(y)).astype(np.float32)), taken + 1
    if len(steps) == 1:
        return gradient, losses
    # A task without windows in the interval has no say in the mean.
    say = float(taken > 0)
    return np.concatenate([say * np.concatenate([moved, own.mean, own.square]), [say, say * own.steps]]), losses


def after_interval(vector: np.ndarray, adam: Adam, total: np.ndarray, steps: range) -> tuple[np.ndarray, Adam]:
    """Weights and optimiser after an interval whose parts add up to ``total``."""
    n = len(vector)
    if len(steps) == 1:
        return adam.step(vector, total.astype(np.float32)), adam
    mean = total[: 3 * n] / total[3 * n]
    return mean[:n].astype(np.float32), adam.at(mean[n: 2 * n].astype(np.float32), mean[2 * n:].astype(np.float32), round(total[3 * n + 1] / total[3 * n]))


def _squares(share: Share, vector: np.ndarray, settings: Settings) -> np.ndarray:
    """Sum of squared errors and number of a share's windows."""
    shapes = weight_shapes(len(settings.features), settings.hidden_size, settings.num_layers)
    weights, sums = from_vector(vector, shapes), np.zeros(2)
    for at in range(0, len(share), CHUNK):
        x, y = share.windows(np.arange(at, min(at + CHUNK, len(share))))
        sums += np.square(predict_in_chunks(weights, x) - y, dtype=np.float64).sum(), len(y)
    return sums


def _intervals(settings: Settings, n_samples: int) -> list[range]:
    steps = steps_per_epoch(n_samples, settings.world_size, settings.batch_size)
    return [range(first, min(first + settings.sync_every, steps)) for first in range(0, steps, settings.sync_every)]


def _epoch_loss(settings: Settings, n_samples: int, errors: Iterable[tuple[int, np.ndarray]], weighting: str) -> float:
    """From sums of squared errors by step and rank."""
    seen = EpochLoss(settings.world_size, weighting)
    for step, by_rank in errors:
        size = batch_size_of(settings, n_samples, step)
        seen.add(by_rank / size, [size] * settings.world_size)
    return seen.value


def _packed(numbers: np.ndarray, wide: bool = False) -> str:
    return base64.b64encode(numbers.astype(np.float64 if wide else np.float32).tobytes()).decode()


def _added(messages: list[str], wide: bool = False) -> np.ndarray:
    """The sum of what all tasks sent, in the order of tasks, so that every task has the same."""
    total = 0.0
    for message in messages:
        total = total + np.frombuffer(base64.b64decode(message), np.float64 if wide else np.float32).astype(np.float64)
    return total


def epochs_task(state: TrainingState, settings: Settings, n_samples: int, epochs: int, weighting: str, alone: bool) -> Callable:
    """Several epochs in one task of a barrier stage, or in a lone task. All tasks hold the same weights throughout; the first hands them back."""

    def task(index: int, rows: Iterable[Row]) -> Iterator[TrainingState]:
        gather = (lambda message: [message]) if alone else BarrierTaskContext.get().allGather
        rows = list(rows)
        share, held, now = Share(rows, settings), Share(rows, settings, train=False), state
        del rows

        def added(numbers: np.ndarray, wide: bool = False) -> np.ndarray:
            return _added(gather(_packed(numbers, wide)), wide)

        for _ in range(epochs):
            pos, at = share.places(n_samples, settings, now.epoch)
            step_of = pos // settings.world_size // settings.batch_size
            vector, adam, errors = now.vector, now.adam.at(now.adam.mean, now.adam.square, now.adam.steps), []

            def windows(step: int) -> Windows | None:
                a, b = np.searchsorted(step_of, [step, step + 1])
                return None if a == b else (*share.windows(at[a:b]), pos[a:b] % settings.world_size)

            for steps in _intervals(settings, n_samples):
                part, losses = interval_part(vector, adam, settings, n_samples, now.epoch, steps, index, windows)
                vector, adam = after_interval(vector, adam, added(part, len(steps) > 1), steps)
                errors.append(losses)
            every = np.concatenate(errors)
            sums = added(np.concatenate([every.ravel(), _squares(held, vector, settings)]), wide=True)
            train_loss = _epoch_loss(settings, n_samples, enumerate(sums[:-2].reshape(every.shape)), weighting)
            now = after_epoch(now, vector, adam, train_loss, float(sums[-2] / sums[-1]) if sums[-1] else None, settings.patience)
            if now.stopped:
                break
        if index == 0:
            yield now

    return task


def run_epochs(dealt: Dealt, state: TrainingState, settings: Settings, epochs: int, weighting: str) -> TrainingState:
    """The state after more epochs in one job of tasks that run at the same time."""
    blocks = dealt.blocks
    alone = blocks.getNumPartitions() == 1
    task = epochs_task(state, settings, dealt.n_samples, epochs, weighting, alone)
    return (blocks if alone else blocks.barrier()).mapPartitionsWithIndex(task).collect()[0]


def laid_out(dealt: Dealt, settings: Settings, work: Sequence[tuple[int, range]]) -> RDD:
    """The windows of some intervals, given by epoch and steps, in the files of one exchange: a partition per interval and task.

    A record is a task's windows of one step that go to one partition, as raw numbers. The windows of the intervals are moved once, all others not at
    all. Each partition is read by one job, so nothing is kept beside the files.
    """
    parts, n_samples = dealt.blocks.getNumPartitions(), dealt.n_samples
    epochs: dict[int, list[tuple[int, range]]] = {}
    for number, (epoch, steps) in enumerate(work):
        epochs.setdefault(epoch, []).append((number, steps))

    def cut(index: int, rows: Iterable[Row]) -> Iterator[tuple]:
        share = Share(rows, settings)
        for epoch, intervals in epochs.items():
            pos, at = share.places(n_samples, settings, epoch)
            step_of = pos // settings.world_size // settings.batch_size
            for number, steps in intervals:
                for step in steps:
                    a, b = np.searchsorted(step_of, [step, step + 1])
                    for part in range(parts):
                        mine = np.flatnonzero(pos[a:b] % parts == part) + a
                        if len(mine):
                            x, y = share.windows(at[mine])
                            yield number * parts + part, (step, index, x.tobytes(), y.tobytes(), (pos[mine] % settings.world_size).tobytes())

    return dealt.blocks.mapPartitionsWithIndex(cut).partitionBy(len(work) * parts, int)


def run_interval(layout: RDD, number: int, parts: int, vector: np.ndarray, adam: Adam, settings: Settings, n_samples: int, epoch: int,
                 steps: range) -> tuple[np.ndarray, Adam, np.ndarray]:
    """Weights and optimiser after the interval, by a job on the partitions of its windows, and sums of squared errors by step and rank."""
    width, own = len(settings.features), adam if len(steps) > 1 else None

    def task(records: Iterable[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found: dict[int, list] = {}
        # By step and the task they come from, so that a task that runs again adds up in the same order.
        for _, (step, source, x, y, ranks) in sorted(records, key=lambda r: r[1][:2]):
            found.setdefault(step, []).append((np.frombuffer(x, np.float32).reshape(-1, settings.window, width), np.frombuffer(y, np.float32),
                                               np.frombuffer(ranks, np.int64)))

        def windows(step: int) -> Windows | None:
            return tuple(np.concatenate(c) for c in zip(*found[step], strict=True)) if step in found else None

        part, losses = interval_part(vector, own, settings, n_samples, epoch, steps, TaskContext.get().partitionId() % parts, windows)
        yield part.astype(np.float32) if len(steps) == 1 else part, losses

    answers = layout.context.runJob(layout, task, range(number * parts, (number + 1) * parts))
    total, errors = (sum(c[1:], c[0].astype(np.float64)) for c in zip(*answers, strict=True))
    return *after_interval(vector, adam, total, steps), errors


def run_epochs_by_jobs(dealt: Dealt, state: TrainingState, settings: Settings, epochs: int, weighting: str) -> TrainingState:
    """The state after more epochs, a job per interval."""
    parts, n_samples = dealt.blocks.getNumPartitions(), dealt.n_samples
    intervals, most = _intervals(settings, n_samples), max(1, LAYOUT_PARTITIONS // parts)
    work = [(epoch, steps) for epoch in range(state.epoch, state.epoch + epochs) for steps in intervals]
    layout, errors, now = None, [], state
    vector, adam = state.vector, state.adam.at(state.adam.mean, state.adam.square, state.adam.steps)
    for i, (epoch, steps) in enumerate(work):
        if i % most == 0:
            layout = laid_out(dealt, settings, work[i: i + most])
        vector, adam, found = run_interval(layout, i % most, parts, vector, adam, settings, n_samples, epoch, steps)
        errors.append(found)
        if steps is intervals[-1]:
            squares, n = dealt.blocks.mapPartitions(lambda rows: [_squares(Share(rows, settings, train=False), vector, settings)]).reduce(np.add)
            train_loss = _epoch_loss(settings, n_samples, enumerate(np.concatenate(errors)), weighting)
            now = after_epoch(now, vector, adam, train_loss, float(squares / n) if n else None, settings.patience)
            errors, adam = [], now.adam.at(now.adam.mean, now.adam.square, now.adam.steps)
            if now.stopped:
                break
    return now


def train(panel: Panel, weighting: str = "rank", run_type: str = "distributed", progress: Progress | None = None,
          state_path: str | None = None) -> TrainedModel:
    """Train on the panel's train windows, ``world_size`` batches per step, shared by ``tasks`` tasks.

    ``weighting`` says how an epoch's train loss is averaged: over ranks and their batches
    ("rank"), or over samples ("sample"). ``progress`` is called with each epoch and its losses, a few epochs at a time. Weights and dropout depend
    on the seed and the number of tasks alone.

    Gradients are averaged after every step, or tasks take ``sync_every`` steps on their own windows and then average
    their weights. ``exchange`` chooses between the two ways of the module; "auto" takes jobs, but for a lone task, which has nobody to exchange with.

    With ``patience`` training stops after so many epochs without a better validation loss, and the model is that of the best epoch.

    With ``state_path`` the state is written there after every few epochs, in a folder of its own that counts once it is whole, and a run that finds a
    state of the same settings goes on from there; the result is that of an unbroken run.
    """
    settings = panel.settings
    if weighting not in ("rank", "sample"):
        raise ValueError(f"no loss weighting named {weighting!r}")
    spark = panel.bars.sparkSession
    ship_package(spark.sparkContext)
    tasks = settings.tasks or settings.world_size
    together = tasks == 1 if settings.exchange == "auto" else settings.exchange == "barrier"
    state = (newest_state(spark, state_path, settings) if state_path else None) or first_state(settings)
    resumed = state.epoch

    dealt = deal(panel, tasks)
    try:
        if not dealt.n_samples:
            raise ValueError(f"no train series is longer than the window of {settings.window}")
        started = time.time()
        while state.epoch < settings.epochs and not state.stopped:
            before = state.epoch
            more = run_epochs if together else run_epochs_by_jobs
            state = more(dealt, state, settings, min(EPOCHS_TOGETHER, settings.epochs - before), weighting)
            if state_path:
                save_state(spark, state_path, state, settings)
            for point in state.curve[before:]:
                if progress:
                    progress(*point)
        seconds = time.time() - started
    finally:
        dealt.blocks.unpersist()
    shapes = weight_shapes(len(settings.features), settings.hidden_size, settings.num_layers)
    steps = steps_per_epoch(dealt.n_samples, settings.world_size, settings.batch_size)
    return TrainedModel(from_vector(state.vector if settings.patience is None else state.best, shapes), settings, run_type, dealt.n_samples, seconds,
                        state.epoch, state.curve, steps * (state.epoch - resumed))


def train_single(panel: Panel, progress: Progress | None = None, state_path: str | None = None) -> TrainedModel:
    """One rank, loss averaged over samples. Its steps are shared by as many tasks as the settings' ranks, unless they name ``tasks``."""
    s = panel.settings
    alone = replace(panel, settings=s.override(world_size=1, tasks=s.tasks or s.world_size))
    return train(alone, weighting="sample", run_type="standalone", progress=progress, state_path=state_path)
