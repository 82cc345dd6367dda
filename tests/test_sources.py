import math

import pytest
from pyspark.sql import functions as F

from checks.queries import _summaries
from conftest import data_dir
from panels import settings
from seqcast.operators.prepare import prepare
from seqcast.plans.run import run
from seqcast.sources import runs
from seqcast.sources.bars import BarsNotFound, read_bars


def write(tmp_path, text):
    path = tmp_path / "bars.csv"
    path.write_text(text)
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path, "Close,Extra,Symbol,Volume,High,Low,Open,Date\n4,e,A,5,2,3,1,2020-01-02\n")
    row = read_bars(spark, path).first()
    assert [row[c] for c in ("Open", "High", "Low", "Close", "Volume")] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert row.Extra == "e"


def test_markers_are_missing_in_every_column(spark, tmp_path):
    path = write(tmp_path, "Date,Symbol,Open,High,Low,Close,Volume\n"
                 "2020-01-01,A,1,1,1,1,1\n2020-01-02,A,,1,1,1,1\n2020-01-03,A,NA,1,1,1,1\n"
                 "2020-01-04,A,1,nan,1,1,1\n2020-01-05,A,1,1,NaN,1,1\n2020-01-06,NA,1,1,1,1,1\n,A,1,1,1,1,1\n")
    bars = read_bars(spark, path)
    assert bars.where(F.col("Symbol").isNull()).count() == 1
    kept = prepare(bars, settings(symbols=("A", "NA"))).collect()
    assert [(r.Symbol, str(r.Date)) for r in kept] == [("A", "2020-01-01 00:00:00")]
    assert not any(math.isnan(r.Open) for r in kept)


def test_text_that_is_no_number_raises(spark, tmp_path):
    path = write(tmp_path, "Date,Symbol,Open,High,Low,Close,Volume\n2020-01-01,A,x,1,1,1,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_bars(spark, path).collect()


@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_other_formats_read_the_same(spark, tmp_path, format):
    csv = read_bars(spark, write(tmp_path, "Date,Symbol,Open,High,Low,Close,Volume\n2020-01-01,A,1,2,3,4,5\n"))
    csv.write.format(format).save(str(tmp_path / "t"))
    assert read_bars(spark, str(tmp_path / "t"), format=format).select(*csv.columns).collect() == csv.collect()


def test_missing_input(spark, tmp_path):
    with pytest.raises(BarsNotFound):
        read_bars(spark, str(tmp_path / "none.csv"))
    assert read_bars(spark, str(tmp_path / "none.csv"), missing_ok=True) is None
    lost = settings(data_dir=str(tmp_path), bars_file="none.csv")
    assert run(spark, lost, single=True) is None
    with pytest.raises(BarsNotFound):
        run(spark, lost)


def test_missing_column_is_named(spark, tmp_path):
    path = write(tmp_path, "Date,Symbol,Open,High,Low,Volume\n2020-01-01,A,1,1,1,1\n")
    with pytest.raises(ValueError, match="Close"):
        read_bars(spark, path)


def test_a_log_of_summaries_takes_little_room(spark, tmp_path, monkeypatch):
    """Less than a fifth of the plain lines, in files of so many rows, and the same rows again beside plain ones."""
    monkeypatch.setattr(runs, "ROWS_OF_FILE", 1000, raising=False)
    summaries = _summaries(spark, data_dir("0.001"))
    summaries.write.json(str(tmp_path / "plain"))
    runs.append_summary(summaries.coalesce(1), str(tmp_path / "log"))

    def room(name):
        return sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))

    assert 5 * room("log") < room("plain") and len(list((tmp_path / "log").glob("part-*"))) == -(-summaries.count() // 1000)
    assert sorted(map(str, runs.read_summaries(spark, str(tmp_path / "log")).collect())) == sorted(map(str, summaries.collect()))
    summaries.write.mode("append").json(str(tmp_path / "log"))
    assert runs.read_summaries(spark, str(tmp_path / "log")).count() == 2 * summaries.count()
