"""Histograms from counted values: no scan of their own, same bins as from rows."""

import pytest
from pyspark.sql import functions as F
from siftwell import Constraints, Dataset, ProfileOptions
from siftwell.operators.frequency import bin_values, frequency_summary
from siftwell.operators.histogram import DateBuckets, NumericBins, bin_counts
from siftwell.plans import profile as profiles
from siftwell.plans.profile import profile_dataset

COLUMNS = [
    "id AS k",
    "CAST(id % 997 AS int) AS i",
    "IF(id % 11 = 0, NULL, IF(id % 13 = 0, double('NaN'), sqrt(id % 800) - 9)) AS d",
    "CAST((id * id) % 5000 / 7 AS decimal(12,3)) AS m",
    "IF(id % 5 = 0, NULL, date_add(DATE'1999-12-20', CAST(id % 1700 AS int))) AS day",
    "timestamp_seconds(id * 40000) AS moment",
    "date_format(date_add(DATE'2020-01-01', CAST(id % 300 AS int)), 'yyyy-MM-dd') AS written",
    "id % 7 - 3 + 9223372036854775000 AS big",
]
SPECS = [
    NumericBins("k", 0, 2999),
    NumericBins("i", 0, 996),
    NumericBins("d", -9.0, 19.3),
    NumericBins("m", 0.0, 714.2),
    NumericBins("big", 9223372036854774997, 9223372036854775003),
    DateBuckets("day", "year"),
    DateBuckets("moment", "month"),
    DateBuckets("written", "day"),
]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bins") / "mixed.parquet")
    spark.range(3000).selectExpr(*COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_bins_as_from_rows(mixed):
    rows = {(r["ordinal"], r["bin"]): r["n"] for r in bin_counts(mixed, SPECS).collect()}
    found = bin_values(mixed, SPECS).collect()
    assert {(mixed.columns.index(r["column"]), r["bin"]): r["count"] for r in found} == rows
    for name in ("k", "i", "d", "m", "big", "day"):
        distinct = mixed.where(~F.isnan(name) if name == "d" else "true").select(name).distinct().dropna().count()
        assert sum(r["distinct_count"] for r in found if r["column"] == name) == distinct


def test_bins_need_no_scan(mixed):
    """With bins, the frequencies scan as often as without: once a type class, of which they share the shuffle."""
    names = [n for n in mixed.columns if n != "written"]
    plain = frequency_summary(mixed, names)
    binned = frequency_summary(mixed, names, bins=SPECS)
    assert sorted(plain.columns) == sorted(binned.columns)
    assert plan(binned).count("FileScan") == plan(plain).count("FileScan")
    binned.collect()
    classes = len({mixed.schema[n].dataType.simpleString().replace("int", "bigint").replace("bigbig", "big") for n in names})
    final = plan(binned).split("Initial Plan")[0]
    assert final.count("ReusedExchange") == classes and final.count("FileScan") == classes


def test_a_profile_scans_nothing_for_bins(spark, mixed, monkeypatch):
    expected = {(r["ordinal"], r["bin"]): r["n"] for r in bin_counts(mixed, SPECS[5:6]).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(profiles, "bin_counts", lambda *a: pytest.fail("a scan for bins"))
        data = Dataset.from_frames(spark, {"t": mixed})
        found = profile_dataset(data)
        histogram = found.histogram.collect()
    charted = {r["column"] for r in found.columns.where("chart = 'histogram'").collect()}
    assert {r["column"] for r in histogram} == charted >= {"k", "i", "d", "m", "day", "moment", "written"}
    assert "big" not in charted  # seven values: a bar chart, its bins are dropped
    years = sorted((r["bin"], r["count"]) for r in histogram if r["column"] == "day")
    assert [n for _, n in years] == [n for _, n in sorted(expected.items())]
    totals = {c["column"]: (c["count"], c["distinct_count"]) for c in found.columns.collect()}
    for name in charted:
        assert sum(r["count"] for r in histogram if r["column"] == name) == totals[name][0]
    assert totals["i"][1] == 997 and totals["big"][1] == 7 and totals["k"][1] == 3000


def test_trusted_columns_are_scanned_for_their_bins(spark, mixed):
    keys = Constraints(primary_keys={"t": ("k",)})
    data = Dataset.from_frames(spark, {"t": mixed}, constraints=keys)
    key = ["column", "bin", "count", "label"]
    counted, trusted = (profile_dataset(data, ProfileOptions(trust_unique=t)).histogram.select(key) for t in (False, True))
    assert sorted(counted.collect()) == sorted(trusted.collect())
    assert counted.where("column = 'k'").count() == 24


def test_bins_of_empty_and_null_columns(spark):
    df = spark.range(5).selectExpr("CAST(NULL AS int) AS n", "CAST(NULL AS date) AS d", "id AS a")
    found = bin_values(df, [NumericBins("n", 0, 1), DateBuckets("d", "day"), NumericBins("a", 0, 4)]).collect()
    assert sorted((r["column"], r["bin"], r["count"]) for r in found) == [("a", b, 1) for b in (0, 6, 12, 18, 23)]
    assert bin_values(df.where("false"), [NumericBins("a", 0, 4)]).collect() == []
    empty = profile_dataset(Dataset.from_frames(spark, {"t": df.where("false")}))
    assert empty.histogram.collect() == [] and empty.columns.where("distinct_count = 0").count() == 3
