"""Published tables, plug-in fetchers, one-pass counts."""

import datetime as dt
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barflow.operators.store import completeness
from barflow.sources.plugin import BarFetcher, SilverFetcher, fetch_bars, register_fetcher
from barflow.sources.store import current_version, read_silver, silver_versions, write_silver
from tests.helpers import bars_frame


def bars(spark, symbols=("A", "B"), days=3, close=1.0):
    return bars_frame(spark, [(s, i * 200, 1, 2, 0.5, close + i, 10) for s in symbols for i in range(days)])


def test_a_failed_write_leaves_the_old_table(spark):
    path = tempfile.mkdtemp(prefix="barflow-silver-") + "/bars"
    with pytest.raises(FileNotFoundError):
        read_silver(spark, path)
    first = write_silver(bars(spark), path)
    old = read_silver(spark, path)
    bad = bars(spark, close=5.0).withColumn("volume", F.when(F.col("symbol") == "B", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("volume")))
    with pytest.raises(PySparkException):
        write_silver(bad, path)
    assert current_version(spark, path) == first and read_silver(spark, path).count() == 6
    # A table that was replaced can still be read by who began with it; what the failed write left is gone.
    second = write_silver(bars(spark, close=7.0), path)
    assert silver_versions(spark, path) == [first, second]
    assert old.agg(F.min("close")).first()[0] == 1.0 and read_silver(spark, path, ["B"]).agg(F.min("close"), F.count("*")).first()[:] == (7.0, 3)
    write_silver(read_silver(spark, path).withColumn("close", F.col("close") + 1), path)  # from itself
    assert read_silver(spark, path).agg(F.min("close")).first()[0] == 8.0 and first not in silver_versions(spark, path)
    assert not [n for n in os.listdir(path) if n.startswith("_next")]


class Watched(SilverFetcher):
    """Notes every fetch in a folder (the test's executors share it)."""

    def fetch(self, symbol, start, end):
        with open(f"{self.options['log']}/{symbol}_{start}_{end}", "w"):
            pass
        yield from super().fetch(symbol, start, end)


@pytest.mark.parametrize("pushed", [False, True])
def test_only_the_partitions_asked_for_are_fetched(spark, pushed):
    path, log = tempfile.mkdtemp(prefix="barflow-plug-"), tempfile.mkdtemp(prefix="barflow-log-")
    d = bars(spark, ("A", "B", "C"), days=8)  # 200 days apart: 2020 to 2023
    version = write_silver(d, path)
    register_fetcher(spark, "watched", Watched, pushed)
    where = (F.col("symbol").isin("A", "C")) & (F.col("date") >= F.lit("2020-06-01").cast("date")) & (F.col("date") < F.lit("2022-01-01").cast("date"))
    if pushed:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        try:
            got = fetch_bars(spark, "watched", path=f"{path}/{version}", log=log).where(where).collect()
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    else:
        got = fetch_bars(spark, "watched", ["A", "C"], "2020-06-01", "2022-01-01", path=f"{path}/{version}", log=log).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, d.where(where).select("symbol", "date", "open", "high", "low", "close", "volume").collect()))
    assert sorted(os.listdir(log)) == sorted(f"{s}_{a}_{b}" for s in "AC" for a, b in (("2020-06-01", "2021-01-01"), ("2021-01-01", "2022-01-01")))


class Odd(BarFetcher):
    def symbols(self):
        return [("A", 2020)]

    def fetch(self, symbol, start, end):
        day = dt.date(2020, 1, 1) if self.options["kind"] != "day" else dt.date(1999, 1, 1)
        cols = {"symbol": [symbol if self.options["kind"] != "name" else "Z"], "date": [day], "open": [1.0], "high": [float("nan")], "low": [1.0], "close": [2],
                "volume": [3.0]}
        if self.options["kind"] == "lacking":
            del cols["volume"]
        yield pa.RecordBatch.from_pydict(cols)


def test_every_batch_is_validated(spark):
    register_fetcher(spark, "odd", Odd)
    r = fetch_bars(spark, "odd", kind="good").first()
    assert (r.symbol, r.high, r.close) == ("A", None, 2.0)
    for kind, message in (("day", "others came"), ("name", "others came"), ("lacking", "lack volume")):
        with pytest.raises(PySparkException, match=message):
            fetch_bars(spark, "odd", kind=kind).collect()
    assert fetch_bars(spark, "odd", ["B"], kind="day").count() == 0


def test_rows_before_and_after_the_drop_come_from_one_scan(spark):
    path = tempfile.mkdtemp(prefix="barflow-rows-") + "/t"
    spark.createDataFrame([("A", 1.0, None), ("A", 1.0, 2.0), ("B", None, 1.0)], "symbol string, x double, y double").write.parquet(path)
    out = completeness(spark.read.parquet(path))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, out.collect())) == [("A", 2, 1, 1), ("B", 1, 0, 1)]
    assert sorted(map(tuple, completeness(spark.read.parquet(path), ["x"]).collect())) == [("A", 2, 2, 0), ("B", 1, 0, 1)]
