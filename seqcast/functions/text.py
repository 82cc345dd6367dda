"""Names and report lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How runs and their artefacts are named.
DISTRIBUTED_TAG = "Distributed_MultiStock_%dproc"
STANDALONE_TAG = "Standalone_MultiStock_%dtickers"
STAMP_FORMAT = "yyyyMMdd_HHmm"
ARTEFACTS = {"weights": "modello", "summary": "risultati", "curve": "grafico_loss"}
PROGRESS_LINE = "Epoch [%03d/%d] - Train Loss: %.6f - Val Loss: %.6f"


def run_tag(run_type: Column, world_size: Column, n_symbols: Column) -> Column:
    return F.when(run_type == "distributed", F.format_string(DISTRIBUTED_TAG, world_size)).otherwise(
        F.format_string(STANDALONE_TAG, n_symbols))


def run_name(run_type: Column, world_size: Column, n_symbols: Column, finished: Column) -> Column:
    """Tag and minute of a run, for people to read; runs of one minute share it."""
    return F.concat_ws("_", run_tag(run_type, world_size, n_symbols), F.date_format(finished, STAMP_FORMAT))


def run_id(name: Column, unique: Column) -> Column:
    """The id of a run's rows in every table it writes: its name and something no other run has."""
    return F.concat_ws("-", name, unique)


def artefact_name(artefact: str, run_id: Column) -> Column:
    return F.concat_ws("_", F.lit(ARTEFACTS[artefact]), run_id)


def progress_line(epoch: Column, epochs: Column, train_loss: Column, val_loss: Column) -> Column:
    return F.format_string(PROGRESS_LINE, epoch, epochs, train_loss, val_loss)
