"""States of a training that can be gone on with."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from seqcast.config import Settings
from seqcast.functions.lstm import Adam

STATE = ("settings string, epoch int, vector binary, mean binary, square binary, steps int, best binary, best_loss double, stale int, "
         "stopped boolean, curve array<struct<epoch: int, train_loss: double, val_loss: double>>")
# Settings that do not change what is learned.
FREE = {"data_dir": "", "bars_file": "", "output_dir": "", "epochs": 1, "storage": "", "exchange": "auto"}


@dataclass(frozen=True)
class TrainingState:
    """Weights and optimiser after ``epoch`` epochs, the best weights so far, and what led there."""

    vector: np.ndarray
    adam: Adam
    best: np.ndarray
    epoch: int = 0
    best_loss: float = float("inf")
    stale: int = 0
    curve: list[tuple[int, float, float | None]] = field(default_factory=list)
    stopped: bool = False


def _key(settings: Settings) -> str:
    return repr(settings.override(**FREE))


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _states(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Epoch and folder of each whole state, the newest last. A folder that was not finished has no mark of success."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    found = []
    for status in files.listStatus(where):
        folder = status.getPath()
        name = folder.getName()
        if name.startswith("epoch-") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append((int(name.split("-")[1]), folder.toString()))
    return sorted(found)


def save_state(spark: SparkSession, path: str, state: TrainingState, settings: Settings) -> None:
    """Write a state into a folder of its own, then delete those it replaces."""
    old = _states(spark, path)
    row = (_key(settings), state.epoch, state.vector.tobytes(), state.adam.mean.tobytes(), state.adam.square.tobytes(), state.adam.steps,
           state.best.tobytes(), float(state.best_loss), state.stale, state.stopped, state.curve)
    spark.createDataFrame([row], STATE).coalesce(1).write.parquet(f"{path.rstrip('/')}/epoch-{state.epoch:07d}-{uuid.uuid4().hex}")
    files, _ = _folder(spark, path)
    for _, folder in old:
        files.delete(_folder(spark, folder)[1], True)


def newest_state(spark: SparkSession, path: str, settings: Settings) -> TrainingState | None:
    """The newest whole state, or None. One of other settings is refused."""
    found = _states(spark, path)
    if not found:
        return None
    row = spark.read.schema(STATE).parquet(found[-1][1]).first()
    if row["settings"] != _key(settings):
        raise ValueError(f"{path} holds the training of other settings")
    # Moments keep the precision they have after an interval of several steps, or of single ones.
    size = len(row["vector"]) // 4
    mean, square = (np.frombuffer(row[c], np.float64 if len(row[c]) == 8 * size else np.float32) for c in ("mean", "square"))
    adam = Adam(size, settings.learning_rate).at(mean, square, row["steps"])
    return TrainingState(np.frombuffer(row["vector"], np.float32), adam, np.frombuffer(row["best"], np.float32), row["epoch"], row["best_loss"],
                         row["stale"], [tuple(p) for p in row["curve"]], row["stopped"])
