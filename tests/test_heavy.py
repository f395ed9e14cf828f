"""Top values from summaries: the same rows as a full count, and no shuffle of all values."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from siftwell.operators import heavy
from siftwell.operators.frequency import top_values


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def skewed(spark, n=6000):
    """Values of falling frequency, each type of value, among many rare ones."""
    draw = random.Random(11)
    data = []
    for i in range(n):
        v = min(int(draw.paretovariate(0.9)), 40) if draw.random() < 0.7 else 1000 + i
        day = datetime.date(2000, 1, 1) + datetime.timedelta(days=v)
        data.append((v if i % 10 else None, v / 4, f"w{v}", f"{v} " * 40, day, datetime.datetime(2001, 1, 1) + datetime.timedelta(hours=v), Decimal(v) / 100, v % 2 == 0, str(v).encode(), i))
    return spark.createDataFrame(data, "a int, b double, c string, d string, e date, f timestamp, g decimal(12,2), h boolean, i binary, k long").repartition(4)


def test_same_rows_as_a_full_count(spark):
    df = skewed(spark).cache()
    names = list("abcdefghi")
    found, doubtful = heavy.certain_values(df, names, tracked=200)
    assert set(found) == set(names) and not doubtful
    assert rows_of(heavy.heavy_values(df, names, tracked=200)) == rows_of(top_values(df, names))


def test_keys_and_flat_columns_are_counted_in_full(spark):
    df = skewed(spark, 3000).withColumn("flat", F.col("k") % 500)
    found, doubtful = heavy.certain_values(df, ["k", "flat", "h"], tracked=50)
    assert set(found) == {"h"} and set(doubtful) == {"k", "flat"}
    assert rows_of(heavy.heavy_values(df, ["k", "flat", "h"], tracked=50)) == rows_of(top_values(df, ["k", "flat", "h"]))


def test_few_values_ties_and_awkward_columns(spark):
    data = [("x" * 100, None, float("nan"), 0.0, [1], 1)] * 3 + [("x" * 99 + "y", None, 1.0, -0.0, [2], 2)] * 3 + [("", None, 2.5, 1e300, None, None), (None, None, None, 1e-300, None, 3)]
    df = spark.createDataFrame(data, "a string, b string, c double, d double, e array<int>, `odd ``name` int")
    for top in (1, 2, 12):
        assert rows_of(heavy.heavy_values(df, top=top)) == rows_of(top_values(df, top=top))
    assert rows_of(heavy.heavy_values(df.limit(0))) == []
    assert rows_of(heavy.heavy_values(df.select("e"))) == []


def test_hours_that_a_clock_repeats(spark):
    """Two instants with one wall-clock time stay two values."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.range(30).selectExpr("timestamp_seconds(1540683000 + 3600 * (id % 3)) AS a", "CAST(timestamp_seconds(id % 3) AS timestamp_ntz) AS b", "date_from_unix_date(4000000 + id % 3) AS c")
        found, doubtful = heavy.certain_values(df)
        assert not doubtful and [len(v) for v in found.values()] == [3, 3, 3]
        assert rows_of(heavy.heavy_values(df)) == rows_of(top_values(df))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bound_of_the_summary(spark):
    """No value that the summary leaves out counts more than the bound."""
    df = skewed(spark, 5000)
    rows, _ = heavy._keyed(df, [df.schema["c"]])
    counted = {r["key"]: r for r in heavy.recount(rows, 64).collect()}
    exact = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    bound = next(iter(counted.values()))["bound"]
    assert all(r["n"] == exact[k] for k, r in counted.items())
    assert max(n for v, n in exact.items() if v not in counted) <= bound < max(exact.values())


def test_one_digest_for_two_values_is_a_doubt(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 100,), ("y" * 120,), ("y" * 120,), ("z",)] * 5, "a string")
    real = F.sha2
    monkeypatch.setattr(heavy.F, "sha2", lambda value, bits: F.substring(real(value, bits), 1, 0).cast("string"))
    monkeypatch.setattr(heavy, "SHORT", 64)
    found, doubtful = heavy.certain_values(df, ["a"])
    assert not found and doubtful == ["a"]
    monkeypatch.undo()
    assert rows_of(heavy.heavy_values(df)) == rows_of(top_values(df))


def test_only_summaries_and_named_values_are_shuffled(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, _ = heavy._keyed(df, [df.schema["text"], df.schema["lang"]])
    plan = heavy.recount(rows, 100)._jdf.queryExecution().executedPlan().toString()
    # by column for the summaries, and by the named values, which are joined before they are counted
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count("FileScan") == 2 and plan.count("BroadcastHashJoin") == 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    shuffled = plan[plan.index("Exchange hashpartitioning(column") :]
    assert shuffled.index("HashAggregate") < shuffled.index("BroadcastHashJoin") and "approx_top_k" in shuffled
