import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import data_dir
from checks.stand_in import SETTINGS, daily_bars, daily_panel
from panels import bars, settings
from seqcast.operators.ordering import number_groups, number_rows
from seqcast.operators.prepare import parse_dates, prepare, sort_bars
from seqcast.operators.scale import bounds_from_profile, narrowed, scale, unscale
from seqcast.operators.shards import assign_shards, ordered_batches
from seqcast.operators.split import cutoffs, date_profile
from seqcast.plans.panel import build_panel

# Known values of the stand-in bars.
KNOWN = {
    "0.001": dict(n=932, at=(745, 838), ends=("2000-02-11", "2000-11-08"), rows=(891, 117, 117),
                  Close=(1411.48, 499705.05), Volume=(1, 3)),
    "0.01": dict(n=2387, at=(1909, 2147), ends=("2000-04-07", "2000-12-03"), rows=(5513, 707, 667),
                 Close=(1013.7, 499889.12), Volume=(1, 8)),
    "0.1": dict(n=2405, at=(1924, 2164), ends=("2000-04-08", "2000-12-04"), rows=(7700, 960, 960),
                Close=(1041.36, 499882.39), Volume=(1, 26)),
}


@pytest.mark.parametrize("scale_factor", KNOWN)
def test_known_cutoffs_bounds_and_rows(spark, scale_factor):
    known = KNOWN[scale_factor]
    panel = daily_panel(spark, data_dir(scale_factor))
    assert panel.fit.n_dates == known["n"]
    assert (panel.fit.train_end[:10], panel.fit.val_end[:10]) == known["ends"]
    assert panel.fit.bounds["Close"] == known["Close"]
    assert panel.fit.bounds["Volume"] == known["Volume"]
    rows = {r.split: r["count"] for r in panel.split().groupBy("split").count().collect()}
    assert (rows["train"], rows["val"], rows["test"]) == known["rows"]
    profile = date_profile(prepare(daily_bars(spark, data_dir(scale_factor)), SETTINGS))
    cut = cutoffs(profile, 0.8, 0.1).first()
    assert (cut.train_pos, cut.val_pos) == known["at"]
    assert (str(cut.train_end)[:10], str(cut.val_end)[:10]) == known["ends"]


def test_one_split_is_the_same_part_of_all(spark):
    panel = daily_panel(spark, data_dir("0.001"))
    whole = panel.split()
    for split in ("train", "val", "test"):
        part = whole.where(F.col("split") == split)
        assert panel.split(split).exceptAll(part).isEmpty() and part.exceptAll(panel.split(split)).isEmpty()
    with pytest.raises(ValueError):
        panel.split("holdout")


def test_splits_are_disjoint_and_ordered(spark):
    ends = {r.split: (r.first, r.last) for r in daily_panel(spark, data_dir("0.01")).split().groupBy("split").agg(
        F.min("Date").alias("first"), F.max("Date").alias("last")).collect()}
    assert ends["train"][1] < ends["val"][0] <= ends["val"][1] < ends["test"][0]


@pytest.mark.parametrize("n, groups", [(5000, 3), (1, 1)])
def test_numbering_follows_the_order(spark, n, groups):
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") % groups).alias("g")).repartition(6)
    numbered = number_rows(df, "v", cells={"part": F.floor(F.col("v") / 100)}, within=["g"], into="place")
    rows = sorted(number_groups(numbered, "g", "place").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(n))
    assert [(r.g, r.v) for r in rows] == sorted((r.g, r.v) for r in rows)


def test_numbering_does_not_depend_on_how_rows_lie(spark):
    """Of a kept table, too, whose two passes are planned apart."""
    df = spark.range(1000).select((F.col("id") * 337 % 1000).alias("v")).repartition(5).persist()
    numbered = number_rows(df, "v", cells={"part": F.floor(F.col("v") / 7)})
    assert numbered.where(F.col("v") != F.col("position")).isEmpty() and numbered.count() == 1000
    df.unpersist()


def test_building_a_plan_runs_nothing(spark):
    panel = daily_panel(spark, data_dir("0.001"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        ordered_batches(panel.sequence_keys(), 8)
        assign_shards(panel.sequence_keys("train"), 2, 8)
        panel.sequences()
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_bounds_from_the_calendar_equal_those_from_the_rows(spark):
    raw, _ = bars(spark, {"A": 40, "B": 25, "C": 31}, every={"B": 2})
    clean = prepare(raw, settings())
    end = F.lit("2020-01-20").cast("timestamp_ntz")
    by_date = bounds_from_profile(date_profile(clean, settings().features), end, settings().features)
    train = clean.where(F.col("Date") <= end)
    by_row = train.agg(*[f(c).alias(f"{c}_{n}") for c in settings().features for n, f in (("min", F.min), ("max", F.max))])
    assert by_date.collect() == by_row.collect()


def test_train_features_lie_in_the_unit_interval(spark):
    panel = daily_panel(spark, data_dir("0.01"))
    spans = panel.scaled("train").agg(*[f(f"{c}_scaled").alias(f"{f.__name__}{c}") for c in SETTINGS.features for f in (F.min, F.max)])
    assert set(spans.first()) == {0.0, 1.0}


def test_a_constant_feature_scales_to_zero(spark):
    raw, _ = bars(spark, {"A": 30})
    panel = build_panel(raw.withColumn("Volume", F.lit(7.0)), settings())
    assert {r[0] for r in panel.scaled().select("Volume_scaled").distinct().collect()} == {0.0}


def test_unscale_inverts_scale(spark):
    panel = daily_panel(spark, data_dir("0.01"))
    back = unscale(panel.scaled(), panel.target_bounds, {"Close_scaled": "back"})
    assert back.where(F.abs(F.col("back") - F.col("Close")) > 1e-9 * F.col("Close")).isEmpty()


def test_values_outside_the_bounds_are_not_clipped(spark):
    df = scale(spark.createDataFrame([(-1.0,), (3.0,)], "v double"), {"v": (0.0, 2.0)})
    assert sorted(r.v_scaled for r in df.collect()) == [-0.5, 1.5]


def test_narrowing_keeps_single_precision(spark):
    value = spark.range(1).select(narrowed(F.lit(0.1))).first()[0]
    assert value == float(np.float32(0.1)) != 0.1


def test_dates(spark):
    df = spark.createDataFrame([("2020-01-05",), ("no date",)], "Date string")
    assert [str(r.Date) for r in parse_dates(df, lenient=True).collect()] == ["2020-01-05 00:00:00", "None"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parse_dates(df).collect()


@pytest.mark.parametrize("text, pattern", [("01/04/2010", "MM/dd/yyyy"), ("20100104", "yyyyMMdd"), ("Jan 4, 2010", "MMM d, yyyy")])
@pytest.mark.parametrize("lenient", [False, True])
def test_dates_by_format(spark, text, pattern, lenient):
    df = spark.createDataFrame([(text,)], "Date string")
    assert [str(r.Date) for r in parse_dates(df, lenient, pattern).collect()] == ["2010-01-04 00:00:00"]
    timed = spark.createDataFrame([(f"{text} 13:05",)], "Date string")
    assert [str(r.Date) for r in parse_dates(timed, lenient, f"{pattern} HH:mm").collect()] == ["2010-01-04 13:05:00"]


def test_the_session_zone_changes_nothing(spark):
    """Instants in the hour that New York's clocks show twice, among others."""
    instants = spark.range(8).select(F.timestamp_seconds(F.lit(1604203200) + F.col("id") * 1800).alias("Date"))
    found = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.append([[str(r[0]) for r in parse_dates(instants, time_zone=z).select(F.col("Date").cast("string")).orderBy("Date").collect()]
                      for z in ("UTC", "Asia/Tokyo")])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1] == found[2]
    assert found[0][0][0] == "2020-11-01 04:00:00" and found[0][1][0] == "2020-11-01 13:00:00"


def test_sorting(spark):
    raw, pdf = bars(spark, {"B": 5, "A": 4})
    got = [(r.Symbol, r.Date) for r in sort_bars(raw.repartition(3)).collect()]
    assert got == sorted(got) and len(got) == len(pdf)


def test_nothing_left_to_split(spark):
    raw, _ = bars(spark, {"A": 5})
    with pytest.raises(ValueError, match="no bars"):
        build_panel(raw, settings(symbols=("Z",)))
