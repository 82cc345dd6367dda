import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcast.functions.student import log_gamma, with_student_above
from seqcast.functions.text import artefact_name, progress_line, run_name
from seqcast.plans.reports import accuracy_report, equivalence_report, milestones, repeat_stats, speedup_report, storage_report

# Published times by world size, and by storage.
TIMES = [(1, 2053.34), (2, 1050.34), (3, 894.32), (4, 789.16)]


def test_speedups_of_the_published_times(spark):
    runs = spark.createDataFrame(TIMES, "num_processes int, training_time_seconds double")
    got = {r.num_processes: (round(r.speedup, 2), round(r.efficiency, 2)) for r in speedup_report(runs).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.95, 0.98), 3: (2.3, 0.77), 4: (2.6, 0.65)}


def test_improvement_of_the_published_storage_times(spark):
    runs = spark.createDataFrame([("local", 789.16), ("hdfs", 675.12)], "storage string, training_time_seconds double")
    got = {r.storage: round(r.improvement, 2) for r in storage_report(runs, "local").collect()}
    assert got == {"local": 0.0, "hdfs": 14.45}


def test_accuracy_and_repeats(spark):
    runs = spark.createDataFrame([(1, 10.0, (3.0, 8.0)), (1, 14.0, (4.0, 9.0)), (4, 5.0, (3.2, 6.0))],
                                 "num_processes int, training_time_seconds double, "
                                 "aggregate_performance_metrics struct<MAPE: double, RMSE: double>")
    accuracy = {r.num_processes: (r.runs, r.MAPE, r.RMSE) for r in accuracy_report(runs).collect()}
    assert accuracy == {1: (2, 3.5, 8.5), 4: (1, 3.2, 6.0)}
    one, = repeat_stats(runs, "num_processes").where("num_processes = 1").collect()
    assert (one.runs, one["mean"], one.low, one.high) == (2, 12.0, 10.0, 14.0)
    assert one.spread == pytest.approx(8 ** 0.5)


def test_milestones(spark):
    curve = spark.createDataFrame([("r", e, 1 / e, None) for e in range(1, 26)],
                                  "run_id string, epoch int, train_loss double, val_loss double")
    assert [r.epoch for r in milestones(curve, F.lit(25)).orderBy("epoch").collect()] == [1, 10, 20]


def test_names_and_lines(spark):
    row = spark.range(1).select(
        run_name(F.lit("distributed"), F.lit(4), F.lit(9), F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("d"),
        run_name(F.lit("standalone"), F.lit(1), F.lit(9), F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("s"),
        progress_line(F.lit(7), F.lit(200), F.lit(0.5), F.lit(0.25)).alias("line"),
        artefact_name("summary", F.lit("x")).alias("a")).first()
    assert row.d == "Distributed_MultiStock_4proc_20240506_0708"
    assert row.s == "Standalone_MultiStock_9tickers_20240506_0708"
    assert row.line == "Epoch [007/200] - Train Loss: 0.500000 - Val Loss: 0.250000"
    assert row.a == "risultati_x"


def test_student_and_log_gamma(spark):
    """Against tables: the chances beyond well-known quantiles, and factorials."""
    rows = [(0.0, 5.0, 0.5), (12.706204736, 1.0, 0.025), (2.570581836, 5.0, 0.025), (-2.570581836, 5.0, 0.975), (1.812461123, 10.0, 0.05),
            (3.169272667, 10.0, 0.005), (1.959963985, 1e7, 0.025), (1.644853627, 1e7, 0.05), (1.0, 1.0, 0.25)]
    df = spark.createDataFrame(rows, "t double, freedom double, want double")
    for r in with_student_above(df, "t", "freedom", "p").collect():
        assert r.p == pytest.approx(r.want, abs=2e-6 if r.freedom > 1e6 else 1e-9)
    values = spark.createDataFrame([(z,) for z in (0.5, 1.0, 3.0, 10.0, 171.0, 5000.5)], "z double")
    for r in values.select("z", log_gamma(F.col("z")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.z), rel=1e-12, abs=1e-12)


def test_equivalence_of_runs(spark):
    rng = np.random.default_rng(0)
    rows = [(n, float(v)) for n, mean in ((1, 10.0), (2, 10.05), (4, 10.9)) for v in rng.normal(mean, 0.2, 40)] + [(8, 10.0)]
    runs = spark.createDataFrame(rows, "num_processes int, error double")
    got = {r.num_processes: r for r in equivalence_report(runs, F.col("error"), 0.05).collect()}
    assert set(got) == {2, 4, 8} and got[2].equivalent and not got[4].equivalent and got[8].p is None
    a, b = (np.array([v for n, v in rows if n == k]) for k in (1, 2))
    va, vb = a.var(ddof=1) / 40, b.var(ddof=1) / 40
    assert got[2].freedom == pytest.approx((va + vb) ** 2 / ((va**2 + vb**2) / 39))
    assert got[2].difference == pytest.approx(b.mean() - a.mean())
