"""Defaults are exact, keys are counted, plans stay narrow."""

import pytest
from pyspark.sql import functions as F

from siftwell import Constraints, Dataset, ForeignKey, ProfileOptions, UniqueKey, profile_dataset, profile_table
from siftwell.functions.iso import iso_seconds
from siftwell.operators import aggregates, integrity, rows, stats
from siftwell.operators.histogram import date_histogram
from siftwell.plans.profile import table_catalog
from siftwell.sources.constraints import ResolvedKey
from tests.helpers import one


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stray_dates_lose_no_rows(spark):
    df = spark.sql("SELECT DATE '2000-01-01' + make_interval(0, 0, 0, CAST(id * 9 AS int)) AS d FROM range(1000) UNION ALL SELECT DATE '0001-01-01'")
    bins = date_histogram(df, "d").orderBy("bin").collect()
    assert sum(b["count"] for b in bins) == 1001
    assert (bins[0]["label"], bins[0]["date_fmt"], bins[-1]["label"]) == ("0000s", "yyy0s", "2020s")
    profiled = profile_table(df, "t").histogram
    assert profiled.agg(F.sum("count")).first()[0] == 1001
    shown = {b["label"]: rows.bucket_rows(df, "d", b["date_fmt"], b["label"]).count() for b in bins}
    assert shown == {b["label"]: b["count"] for b in bins}


@pytest.mark.parametrize("last, pattern, label", [("5000-01-01", "yy00s", "5000s"), ("2100-01-01", "yyyy", "2100")])
def test_coarser_grains(spark, last, pattern, label):
    first = "0050-06-01" if pattern == "yy00s" else "1990-01-01"
    bins = date_histogram(spark.sql(f"SELECT explode(array(DATE '{first}', DATE '{last}')) AS d"), "d").orderBy("bin").collect()
    assert (bins[0]["date_fmt"], bins[-1]["label"], sum(b["count"] for b in bins)) == (pattern, label, 2)


def test_no_limit_is_the_default(spark):
    df = spark.range(1000).selectExpr("id", "id % 300 AS g", "CAST(NULL AS int) AS n")
    assert rows.null_rows(df, "n").count() == 1000 and rows.bin_rows(df, "id", 0, 900).count() == 900
    assert rows.distinct_values(df, "g").count() == 300 and rows.group_count(df, "g").count() == 300
    assert rows.distinct_values(df, "g", limit=3).count() == 3 and rows.rows_by_value(df, "g", 1, limit=2).count() == 2


def test_samples_keep_the_kinds_of_all_rows(spark):
    df = spark.sql("SELECT IF(id = 5, 'x', '2020-01-01') AS t, IF(id = 5, 5L, id % 2) AS f, CAST(id % 2 AS int) AS flag FROM range(100000)")
    kinds = lambda options: {c["column"]: (c["kind"], c["max"]) for c in profile_table(df, "t", options=options).columns.collect()}
    assert kinds(ProfileOptions(sample_above=100, sample_size=100)) | {"t": ("text", None)} == kinds(None) | {"t": ("text", None)}
    assert kinds(None)["f"][0] == "integer" and kinds(None)["flag"][0] == "boolean"


def test_declared_keys_are_counted(spark):
    df = spark.range(50).selectExpr("id % 5 AS k", "id AS a", "id % 10 AS b")
    keys = Constraints({"t": ("k",)}, unique_keys=(UniqueKey("t", ("a", "b")), UniqueKey("t", ("b",), "a < 12")))
    found = profile_dataset(Dataset.from_frames(spark, {"t": df}, constraints=keys))
    assert one(found.columns, "column = 'k'")["distinct_count"] == 5
    assert {(r["label"], r["repeats"]) for r in found.repeats.collect()} == {("k", 45), ("(a, b)", 0), ("b", 2)}
    assert [(f["severity"], f["column"], f["detail"]) for f in found.findings.where("kind = 'duplicate-key'").collect()] == [
        ("high", "k", "declared unique"),
        ("high", "b", "declared unique where a < 12"),
    ]
    trusted = profile_dataset(Dataset.from_frames(spark, {"t": df}, constraints=keys), ProfileOptions(trust_unique=True))
    assert one(trusted.columns, "column = 'k'")["distinct_count"] == 50


def test_a_bad_key_stays_with_its_table(spark):
    df = spark.range(3).selectExpr("id AS a")
    keys = Constraints(foreign_keys=(ForeignKey("t", ("a",), "p"), ForeignKey("t", ("a",), "p", ("x", "y"))))
    found = profile_dataset(Dataset.from_frames(spark, {"t": df, "p": df}, constraints=keys))
    assert found.tables.where("error IS NULL AND row_count = 3").count() == 2
    assert found.findings.where("kind = 'unresolved-key' AND severity = 'high'").count() == 2


def test_text_columns_are_read_once(spark, tmp_path):
    spark.range(20).selectExpr(*[f"concat('v', id % {i + 1}) AS c{i}" for i in range(40)]).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    found = aggregates.column_aggregates(wide)
    assert plan(found).count("FileScan") == 1
    expected = {f"c{i}": (20, 20, i == 0) for i in range(40)}
    assert {r["column"]: (r["row_count"], r["count"], r["one_value"]) for r in found.collect()} == expected
    empty = {r["column"]: (r["row_count"], r["count"]) for r in aggregates.column_aggregates(wide.where("false")).collect()}
    assert empty == {f"c{i}": (0, 0) for i in range(40)}


def test_maps_and_variants(spark):
    df = spark.sql(
        "SELECT map('k', id % 3) AS m, array(map('a', id % 2)) AS n, "
        "parse_json(CASE id % 4 WHEN 0 THEN '1' WHEN 1 THEN '[1]' WHEN 2 THEN 'null' ELSE '2.5' END) AS v FROM range(30)"
    )
    found = {c["column"]: c for c in profile_table(df, "t").columns.collect()}
    assert [(found[c]["distinct_count"], found[c]["count"], found[c]["storage_types"]) for c in "mnv"] == [(3, 30, 1), (2, 30, 1), (None, 30, 3)]


def test_sketches_of_all_types(spark):
    df = spark.range(20_000).selectExpr("id % 500 AS a", "CAST(id AS double) AS d", "concat('x', id % 70) AS s", "encode(CAST(id % 9 AS string), 'utf-8') AS b", "IF(id > 5, NULL, id) AS n")
    found = {r["column"]: r["distinct_count"] for r in aggregates.approx_distinct(df).collect()}
    assert all(abs(found[c] / n - 1) < 0.06 for c, n in {"a": 500, "d": 20_000, "s": 70, "b": 9, "n": 6}.items())


def test_time_zone_moves_no_text(spark):
    texts = ["2020-01-01 10:00:00", "2020-07-01 10:00:00", "2020-03-08 02:30:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert stats.date_median(df, "t").first()["value"] == "2020-03-08 02:30:00"
        seconds = df.select(F.expr(iso_seconds("t"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seconds == df.select(F.expr(iso_seconds("t"))).collect()


def test_both_sides_of_a_key_are_aggregated(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        child, parent = spark.range(100).selectExpr("id % 9 AS a"), spark.range(100).selectExpr("id % 4 AS b")
        found = integrity.orphan_rows(child, parent, ResolvedKey(0, "c", "p", (("a", "b"),)))
        text = plan(found)
        assert text.count("HashAggregate") >= 4 and "LeftAnti" in text
        assert {(r["k0"], r["n"]) for r in found.collect()} == {(k, 11) for k in range(4, 9)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_following_a_key_to_text(spark):
    parent = spark.createDataFrame([("1", "one"), ("x", "none"), ("2", "two")], "code string, name string")
    child = spark.createDataFrame([(1,), (3,), (None,)], "ref bigint")
    key = ResolvedKey(0, "c", "p", (("ref", "code"),))
    assert [r["name"] for r in rows.referenced_parents(child, parent, key).collect()] == ["one"]
    found, total = rows.follow(parent, {"ref": 2}, key)
    assert ([r["name"] for r in found.collect()], total.first()["row_count"]) == (["two"], 1)
    numbers = spark.range(3).selectExpr("id")
    back = ResolvedKey(0, "c", "p", (("ref", "id"),))
    assert rows.parent_rows(numbers, {"ref": "x"}, back).count() == 0 and rows.parent_rows(numbers, {"ref": "2"}, back).count() == 1


@pytest.mark.parametrize("needle, hits", [("the", 2), ("THE", 2), (".", 1), ("\\E", 1), ("É", 1), ("é", 1), ("(", 0), ("K", 1)])
def test_filter_is_literal(spark, needle, hits):
    """ASCII letters alone lose their case: É and the Kelvin sign stay what they are."""
    df = spark.createDataFrame([("The end.",), ("oTHEr k",), ("a\\Eb É",), ("é K",)], "t string")
    assert rows.filtered(df, needle).count() == hits


def test_queries_leave_temp_views_alone(spark):
    spark.range(3).createOrReplaceTempView("things")
    data = Dataset.from_frames(spark, {"things": spark.range(10)}, views={"few": "SELECT * FROM things WHERE id < 4"})
    before = len(spark.catalog.listTables())
    assert data.sql("SELECT count(*) FROM things").first()[0] == 10
    assert data.sql("WITH few AS (SELECT 1) SELECT * FROM few").collect() == [(1,)]
    assert data.sql("SELECT id FROM few ORDER BY id DESC LIMIT 1;").first()[0] == 3
    assert spark.table("things").count() == 3 and len(spark.catalog.listTables()) == before
    spark.catalog.dropTempView("things")


def test_views_are_held_if_asked(spark):
    data = Dataset.from_frames(spark, {"t": spark.range(10)}, views={"v": "SELECT id % 3 AS m FROM t"})
    for options in (ProfileOptions(), ProfileOptions(keep_views=True)):
        assert one(profile_dataset(data, options).columns, "table = 'v'")["distinct_count"] == 3
    assert table_catalog(data).count() == 2
