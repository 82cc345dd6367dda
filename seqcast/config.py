"""Run parameters."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

# The defaults a run starts from.
DEFAULT_SYMBOLS = ("AES", "ALL", "CCL", "GIS")
DEFAULT_FEATURES = ("Open", "High", "Low", "Close", "Volume")
DEFAULT_TARGET = "Close"
DEFAULT_BARS_FILE = "sp500_stocks.csv"
DEFAULT_WORLD_SIZE = 2
WORLD_SIZE_VARIABLE = "NUM_PROCESSES"


def _checked(name: str, kind: str, value: object) -> object:
    """The value as a setting of its kind. One name stands for a tuple of names; a whole number for any number."""
    if kind == "tuple[str, ...]":
        names = (value,) if isinstance(value, str) else tuple(value) if isinstance(value, (list, tuple)) else ()
        if not names or not all(isinstance(n, str) for n in names):
            raise ValueError(f"{name} takes names, not {value!r}")
        return names
    if kind.endswith(" | None") and value is None:
        return None
    expected = {"str": str, "int": int, "float": (int, float)}[kind.removesuffix(" | None")]
    if not isinstance(value, expected) or isinstance(value, bool):
        raise ValueError(f"{name} takes {kind}, not {value!r}")
    return float(value) if kind == "float" else value


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on. Immutable: change it with :meth:`override`."""

    data_dir: str = "./"
    bars_file: str = DEFAULT_BARS_FILE
    output_dir: str = "./"

    symbols: tuple[str, ...] = DEFAULT_SYMBOLS
    features: tuple[str, ...] = DEFAULT_FEATURES
    target: str = DEFAULT_TARGET
    window: int = 60

    train_ratio: float = 0.8
    val_ratio: float = 0.1

    world_size: int = DEFAULT_WORLD_SIZE
    batch_size: int = 64
    epochs: int = 200
    learning_rate: float = 0.001
    hidden_size: int = 50
    num_layers: int = 2
    dropout: float = 0.2
    seed: int = 0
    # Stop after this many epochs without a better validation loss; None never stops.
    patience: int | None = None

    # Steps that ranks take on their own before they average; 1 averages the gradients of every step.
    sync_every: int = 1
    # Tasks that share the work of a step; None takes as many as there are ranks.
    tasks: int | None = None
    # How tasks add up: "jobs" by a job per step, "barrier" among themselves, "auto" jobs unless there is one task.
    exchange: str = "auto"
    # Rows of a series that are windowed together, and rows of the table that are counted together.
    block_rows: int = 4096
    cell_rows: int = 250_000
    # Where a run's bars are kept, as a name for comparisons.
    storage: str = "local"
    # Pattern of dates that are text, as Spark spells it; None reads ISO dates.
    date_format: str | None = None
    # Zone in which a date with a time zone is read as a day and time.
    time_zone: str = "UTC"

    def __post_init__(self) -> None:
        for f in fields(self):
            object.__setattr__(self, f.name, _checked(f.name, f.type, getattr(self, f.name)))
        if self.target not in self.features:
            raise ValueError(f"target {self.target!r} is not one of {self.features}")
        if self.train_ratio <= 0 or self.val_ratio < 0 or self.train_ratio + self.val_ratio >= 1:
            raise ValueError("the two ratios must leave room for a test period")
        if self.exchange not in ("auto", "barrier", "jobs"):
            raise ValueError(f"no exchange named {self.exchange!r}")
        if self.tasks is not None and self.tasks < 1:
            raise ValueError("tasks must be at least 1")
        for name in ("window", "world_size", "batch_size", "epochs", "hidden_size", "num_layers", "sync_every",
                     "block_rows", "cell_rows"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def override(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: Mapping[str, object]) -> Settings:
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **changes) -> Settings:
        """Settings whose world size comes from the environment unless given."""
        env = os.environ if env is None else env
        if "world_size" not in changes and WORLD_SIZE_VARIABLE in env:
            changes["world_size"] = int(env[WORLD_SIZE_VARIABLE])
        return cls(**changes)

    @property
    def bars_path(self) -> str:
        """Directory and file joined; any Hadoop filesystem URI works."""
        return f"{self.data_dir.rstrip('/')}/{self.bars_file}" if self.data_dir else self.bars_file

    @property
    def target_index(self) -> int:
        return self.features.index(self.target)
