"""Time the headline queries and the trainer; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402
from checks.stand_in import SETTINGS, daily_panel  # noqa: E402
from seqcast.operators.split import TRAIN  # noqa: E402
from seqcast.plans.scoring import forecast  # noqa: E402
from seqcast.plans.training import train, train_single  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = ("split_cutoffs", "scaler_fit", "scaled_bars", "sequence_counts", "sequences", "last_step", "flat_features",
            "regression_metrics", "metrics_by_symbol", "shard_assignment", "ordered_batches", "epoch_loss_allreduce",
            "scan_bars", "run_summary", "repeat_stats", "fit_window_regressor", "fit_window_regressor_60", "window_gram", "sequences_from_store",
            "scaler_fit_in_batches", "equivalence_report")
# Each world size is timed over epochs that are laid out together. A whole run has a rank per core, which average every few steps.
EPOCHS = 5
WORLDS = (1, 2, 3, 4)
WHOLE_RUN = {"epochs": 200, "sync_every": 8}


def timed(work) -> float:
    started = time.time()
    work()
    return round(time.time() - started, 3)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(CPUS)).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    run("scaled_bars")  # start the JVM's and Python's engines
    seconds = {name: timed(lambda: run(name)) for name in HEADLINE}

    # Seconds per epoch, the layout of the keys included.
    rates, steps = {}, {}
    for world in [w for w in WORLDS if w <= CPUS]:
        panel = daily_panel(spark, SF_DIR, SETTINGS.override(world_size=world, epochs=EPOCHS))
        model = train_single(panel) if world == 1 else train(panel)
        seconds[f"train_epoch_{world}_ranks"] = round(model.seconds / EPOCHS, 3)
        rates[str(world)] = round(model.n_samples * EPOCHS / model.seconds)
        steps[str(world)] = round(model.steps / model.seconds, 1)
    whole = train(daily_panel(spark, SF_DIR, SETTINGS.override(world_size=CPUS, **WHOLE_RUN)))
    speedups = {w: round(r / rates["1"], 2) for w, r in rates.items()}
    seconds["score_train_windows"] = timed(
        lambda: forecast(panel, model.weights, TRAIN).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total wall time of headline queries and one training epoch per world size",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "trained_windows_per_sec": rates, "steps_per_sec": steps, "speedup": speedups,
        "whole_run": {**WHOLE_RUN, "ranks": CPUS, "sec": round(whole.seconds, 1)},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
