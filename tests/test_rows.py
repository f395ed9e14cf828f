"""Quantiles, key checks and row retrieval against brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from siftwell.operators import rows
from siftwell.operators.frequency import distinct_counts, top_values
from siftwell.operators.integrity import orphan_count, orphan_rows
from siftwell.operators.quantiles import quantiles
from siftwell.operators.value_types import json_value_types
from siftwell.sources.constraints import ResolvedKey


def brute_quantile(values, p):
    values = sorted(v for v in values if v is not None)
    return values[max(0, math.floor(p * (len(values) - 1) + 0.5))]


@pytest.mark.parametrize("limit", [2, 40, 10_000])
def test_quantiles_against_sorting(spark, limit):
    generator = random.Random(3)
    skewed = [7 if generator.random() < 0.4 else generator.randrange(-50, 400) for _ in range(2000)] + [None] * 10
    spread = [generator.gauss(0, 1e6) for _ in range(2010)]
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(days=generator.randrange(900)) for _ in range(2010)]
    moments = [datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=generator.randrange(10**6)) for _ in range(2010)]
    df = spark.createDataFrame(list(zip(skewed, spread, days, moments)), "a int, b double, d date, t timestamp_ntz").repartition(5)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = quantiles(df, {n: ps for n in "abdt"}, rank_limit=limit).collect()
    got = {(r["column"], r["p"]): r["value"] for r in found}
    numbers = {(r["column"], r["p"]): r["value_num"] for r in found}
    for p in ps:
        assert numbers["a", p] == brute_quantile(skewed, p)
        assert numbers["b", p] == brute_quantile(spread, p)
        assert got["d", p] == str(brute_quantile(days, p))
        assert got["t", p] == str(brute_quantile(moments, p))


def test_quantiles_of_large_integers(spark):
    values = [2**60 + i for i in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert [r["value"] for r in quantiles(df, {"x": [0.5]}, rank_limit=3).collect()] == [str(2**60 + 250)]


def test_quantiles_of_decimals_and_infinities(spark):
    df = spark.sql(
        "SELECT CAST(12345678901234567890 + CAST(id AS decimal(9,4)) * 0.25 AS decimal(30,4)) AS d, "
        "CASE WHEN id < 40 THEN double('-inf') WHEN id > 60 THEN double('inf') ELSE double(id) END AS f FROM range(101)"
    )
    found = {r["column"]: r["value"] for r in quantiles(df, {"d": [0.5], "f": [0.5]}, rank_limit=3).collect()}
    assert found == {"d": "12345678901234567902.5000", "f": "50.0"}


def test_quantiles_without_values(spark):
    assert quantiles(spark.createDataFrame([(None,)], "x int"), {"x": [0.5]}).count() == 0


def test_top_values_order(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (9, "b"), (10, "a"), (8, None)], "n int, s string")
    top = top_values(df).orderBy("column", "rank").collect()
    assert [(t["column"], t["value"], t["value_count"]) for t in top] == [
        ("n", "9", 2), ("n", "10", 2), ("n", "8", 1), ("s", "a", 2), ("s", "b", 2)
    ]


def test_distinct_counts_of_many_types(spark):
    df = spark.sql(
        "SELECT id AS a, CAST(id % 3 AS decimal(5,1)) AS d, CAST(id % 2 AS boolean) AS b, "
        "timestamp_seconds(id % 5) AS t, CAST(id % 7 AS float) AS f, array(id % 4) AS arr FROM range(100)"
    )
    assert {r["column"]: r["distinct_count"] for r in distinct_counts(df).collect()} == {
        "a": 100, "d": 3, "b": 2, "t": 5, "f": 7, "arr": 4
    }


def test_hot_key_orphans_both_ways(spark):
    child = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN 1000000 ELSE id % 50 END AS k, id FROM range(9000)")
    parent = spark.range(40).toDF("p")
    key = ResolvedKey(0, "child", "parent", (("k", "p"),))
    expected = sum(1 for i in range(9000) if i % 3 == 0 or i % 50 >= 40)
    assert orphan_count(child, parent, key).first()[0] == expected
    assert orphan_count(child, parent, key, parent_rows=40).first()[0] == expected
    by_value = {r["k0"]: r["n"] for r in orphan_rows(child, parent, key).collect()}
    assert by_value[1000000] == 3000 and sum(by_value.values()) == expected


def test_keys_of_different_types(spark):
    child = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "k string")
    key = ResolvedKey(0, "child", "parent", (("k", "p"),))
    assert orphan_count(child, spark.createDataFrame([(1,)], "p int"), key).first()[0] == 2
    back = ResolvedKey(0, "parent", "child", (("p", "k"),))
    assert orphan_count(spark.createDataFrame([(1,), (7,)], "p int"), child, back).first()[0] == 1


def test_json_types(spark):
    texts = ['{"k": 1}', '{"k": 1.5}', '{"k": 1.5e300}', '{"k": "x"}', '{"k": null}', "{}", "not json", '{"k": [1]}', '{"k": true}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert {r["value_type"]: r["value_count"] for r in json_value_types(df, "j", "$.k").collect()} == {
        "integer": 1, "real": 2, "text": 1, "array": 1, "boolean": 1
    }


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "Ann", 2.5), (2, "bob_x", None), (3, None, 2.5), (4, "ÄB%c", 12345678.5), (5, "ann", -1.0)]
    return spark.createDataFrame(data, "id int, name string, score double")


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_lookups(people):
    assert ids(rows.rows_by_value(people, "score", 2.5)) == [1, 3]
    assert ids(rows.rows_by_value(people, "name", None)) == [3]
    assert ids(rows.null_rows(people, "score")) == [2]
    assert ids(rows.rows_matching(people, {"score": 2.5, "name": None})) == [3]
    assert rows.value_count(people, "name", "Ann").first()["row_count"] == 1
    assert len(rows.rows_by_value(people, "score", 2.5, limit=1).collect()) == 1


def test_shown_rows_and_samples(people):
    shown, total = rows.view_rows(people, "score", 2.5)
    assert ids(shown) == [1, 3] and total.first()["row_count"] == 2
    assert {r["value"] for r in rows.sample_values(people, "score").collect()} == {2.5, 12345678.5, -1.0}
    assert rows.sample_values(people, "score", 2).count() == 2


def test_groups_and_order(people):
    assert [tuple(r) for r in rows.group_count(people, "score").collect()] == [
        (2.5, 2), (None, 1), (-1.0, 1), (12345678.5, 1)
    ]
    assert [r["value"] for r in rows.distinct_values(people, "name").collect()] == [None, "Ann", "ann", "bob_x", "ÄB%c"]
    assert [r["id"] for r in rows.ordered_rows(people, "score", True, key=["id"]).collect()] == [4, 1, 3, 5, 2]
    assert [r["id"] for r in rows.ordered_rows(people, "score", False, limit=2, key=["id"]).collect()] == [2, 5]


def test_bins(people):
    assert ids(rows.bin_rows(people, "score", -1.0, 2.5)) == [5]
    assert ids(rows.bin_rows(people, "score", -1.0, 2.5, last=True)) == [1, 3, 5]


def test_text_filter(people):
    assert ids(rows.filtered(people, "ANN")) == [1, 5]
    assert ids(rows.filtered(people, "_")) == [2]
    assert ids(rows.filtered(people, "%")) == [4]
    assert ids(rows.filtered(people, "ä")) == []  # only ASCII letters fold
    assert ids(rows.filtered(people, "12345678.5")) == [4]
    assert ids(rows.filtered(people, "  ")) == [1, 2, 3, 4, 5]
    assert rows.filtered_count(people, "ann").first()["row_count"] == 2


@pytest.mark.parametrize("sort", [None, "score", "name"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_offset_and_by_key(people, sort, descending):
    pages, last = [], None
    for number in range(3):
        by_offset = rows.sorted_page(people, number, sort, descending, key=["id"], size=2).collect()
        if last is not None:
            by_key = rows.next_page(people, last, sort, descending, key=["id"], size=2).collect()
            assert by_key == by_offset
        last = by_offset[-1].asDict()
        pages += by_offset
    assert sorted(r["id"] for r in pages) == [1, 2, 3, 4, 5]


def test_pages_without_a_key(people):
    assert rows.row_key(people) == ["id", "name", "score"]
    assert [r["id"] for r in rows.sorted_page(people, 0).collect()] == [1, 2, 3, 4, 5]


def test_time_buckets(spark):
    df = spark.sql(
        "SELECT id, TIMESTAMP_NTZ '2020-02-28 23:00:00' + make_dt_interval(0, id) AS t, "
        "date_format(TIMESTAMP_NTZ '2020-02-28 23:00:00' + make_dt_interval(0, id), 'yyyy-MM-dd HH:mm') AS s FROM range(100)"
    )
    for name in ("t", "s"):
        assert ids(rows.bucket_rows(df, name, "yyyy-MM-dd", "2020-02-29", limit=None)) == list(range(1, 25))
        assert ids(rows.bucket_rows(df, name, "yyyy-MM", "2020-03", limit=None)) == list(range(25, 100))
        assert len(ids(rows.bucket_rows(df, name, "yyyy", "2020", limit=None))) == 100


def test_follow_keys(spark):
    parent = spark.createDataFrame([(1, 1, "p"), (2, 2, "q")], "a int, b int, w string")
    child = spark.createDataFrame([(1, 1), (1, 2), (None, 2)], "x int, y int")
    key = ResolvedKey(0, "child", "parent", (("x", "a"), ("y", "b")))
    assert [r["w"] for r in rows.parent_rows(parent, {"x": 1, "y": 1}, key).collect()] == ["p"]
    assert rows.parent_rows(parent, {"x": None, "y": 1}, key).count() == 0
    assert [r["w"] for r in rows.referenced_parents(child, parent, key).collect()] == ["p"]


def test_shared_value_counts(people):
    found = rows.value_counts_of(people.where("id <= 3"), people, "score").select("id", "shared_count")
    assert {r["id"]: r["shared_count"] for r in found.collect()} == {1: 2, 2: 1, 3: 2}


def test_predicates_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for frame in (
        rows.rows_by_value(orders, "o_custkey", 42),
        rows.bin_rows(orders, "o_totalprice", 10.0, 20.0),
        rows.bucket_rows(orders, "o_orderdate", "yyyy-MM", "1997-02"),
    ):
        plan = frame.select(F.lit(1))._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert pushed.count(",") >= 1, plan
