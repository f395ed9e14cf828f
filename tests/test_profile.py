"""Kinds, charts, interest, histograms, samples, findings."""

import json

import pytest
from pyspark.sql import functions as F
from siftwell import Constraints, Dataset, ProfileOptions, profile_dataset, profile_table
from siftwell.functions.iso import iso_seconds
from siftwell.functions.kinds import declared_kind, type_name
from siftwell.functions.labels import grouped_number, percent, plain_number, span_label
from siftwell.operators.histogram import date_histogram, numeric_histogram
from siftwell.operators.stats import uniqueness
from siftwell.sinks.report import profile_json, profile_markdown, write_json, write_markdown

from tests.helpers import one


def values(spark, items, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def test_percent_never_rounds_to_the_ends(spark):
    items = [0.001, 0.999, 1.0, 0.0, 0.994, 0.455, 0.01]
    assert values(spark, items, "double", percent(F.col("v"))) == ["<1%", ">99%", "100%", "0%", ">99%", "46%", "1%"]


def test_number_labels(spark):
    items = [1234567.0, 1.625, 0.005, -1234.5, 10.0]
    assert values(spark, items, "double", grouped_number(F.col("v"))) == ["1,234,567", "1.63", "0.01", "-1,234.5", "10"]
    items = [1e7, 12345678.25, 0.25, 3.0, 1e-5, 100.0, None]
    expected = ["10000000", "12345678.25", "0.25", "3", "0.00001", "100", None]
    assert values(spark, items, "double", F.expr(plain_number("v"))) == expected


def test_span_labels(spark):
    items = [731.0, 730.0, 61.0, 60.0, 0.4]
    assert values(spark, items, "double", span_label(F.col("v"))) == ["2.0 years", "24 months", "2 months", "60 days", "0 days"]


def test_declared_kinds(spark):
    items = ["BOOLEAN", "datetime", "TIME", "DATE", "BIGINT", "varchar(9)", "clob", "blob", "REAL", "double", "decimal", "", None]
    expected = ["boolean", "datetime", "date", "date", "integer", "text", "text", "blob", "real", "real"] + ["unknown"] * 3
    assert values(spark, items, "string", declared_kind(F.col("v"))) == expected


def test_value_types(spark):
    items = ["12", "-1.5", ".5", "1e5", "1e", "2020-01-01xyz", "2020-01-01 10:00", "TRUE", "truer", "", "+", None, "٣"]
    expected = ["integer", "real", "real", "real", "text", "date", "date", "boolean", "text", "text", "text", None, "text"]
    assert values(spark, items, "string", F.expr(type_name("v"))) == expected


def test_iso_parsing(spark):
    items = {
        "1970-01-02": 86400,
        "1970-01-01 00:01": 60,
        "1970-01-01T00:00:05.5": 5,
        "1970-01-01 01:00:00+01:00": 0,
        "1970-01-01T01:00Z": 3600,
        "1970-02-30": None,
        "1970-02-32": None,
        "1970-13-01": None,
        "1970-01-01 10:61": None,
        "1970-01-01xyz": None,
        "10:00": None,
    }
    assert values(spark, list(items), "string", F.expr(iso_seconds("v"))) == list(items.values())


def test_text_dates(spark):
    rows = [("2020-01-01", "2020-01-01 10:00", "2020-01-01", "2020-01-01xyz"), ("2020-02-30", "2020-01-02", "no", "2020-01-02")]
    p = profile_table(spark.createDataFrame(rows, "d string, dt string, mixed string, prefix string"))
    kinds = {c["column"]: c["kind"] for c in p.columns.collect()}
    assert kinds == {"d": "date", "dt": "datetime", "mixed": "text", "prefix": "date"}


def test_time_histogram_of_text_with_unparsed_ends(spark):
    days = [(f"2020-01-{d:02d}",) for d in range(1, 32)] + [(f"2020-03-{d:02d}",) for d in range(1, 32)]
    days += [("0000-00-00",), ("2020-99-99",)]
    p = profile_table(spark.createDataFrame(days, "d string"), "t")
    assert one(p.columns, "true")["chart"] == "histogram"
    bins = p.histogram.orderBy("bin").collect()
    assert [(b["label"], b["date_fmt"]) for b in bins] == [(f"2020-0{m}", "yyyy-MM") for m in (1, 2, 3)]
    assert sum(b["count"] for b in bins) == 62
    assert min(b["label"] for b in bins) >= "2020-01"


def test_booleans(spark):
    rows = [(0, 1, 2, True), (1, 1, 3, False), (None, 1, 2, None)]
    p = profile_table(spark.createDataFrame(rows, "flag int, one int, two int, b boolean"))
    kinds = {c["column"]: (c["kind"], c["chart"]) for c in p.columns.collect()}
    assert kinds == {
        "flag": ("boolean", "bar"),
        "one": ("boolean", "bar"),
        "two": ("integer", "bar"),
        "b": ("boolean", "bar"),
    }


def test_nan_is_null_and_negative_zero_is_zero(spark):
    rows = [(float("nan"),), (0.0,), (-0.0,), (1.0,)]
    c = one(profile_table(spark.createDataFrame(rows, "x double")).columns, "true")
    assert (c["count"], c["null_count"], c["distinct_count"], c["min"], c["max"]) == (3, 1, 2, "0", "1")


def test_infinite_values_have_no_histogram(spark):
    rows = [(float(i),) for i in range(30)] + [(float("inf"),)]
    p = profile_table(spark.createDataFrame(rows, "x double"))
    assert one(p.columns, "true")["chart"] == "none"
    assert p.histogram.count() == 0


def test_unchartable_types(spark):
    df = spark.sql(
        "SELECT array(id) AS a, map('k', id) AS m, named_struct('x', id) AS s, parse_json('1') AS v, "
        "CAST(CAST(id % 2 AS string) AS binary) AS b, CAST(NULL AS void) AS n, CAST(id AS decimal(10,2)) AS d FROM range(20)"
    )
    columns = {c["column"]: c for c in profile_table(df).columns.collect()}
    assert {n: c["kind"] for n, c in columns.items()} == {
        "a": "unknown", "m": "unknown", "s": "unknown", "v": "unknown", "b": "blob", "n": "unknown", "d": "real"
    }
    assert columns["a"]["distinct_count"] == 20 and columns["b"]["distinct_count"] == 2
    assert columns["m"]["count"] == 20 and columns["n"]["count"] == 0
    assert columns["d"]["chart"] == "histogram" and columns["a"]["chart"] == "none"


def test_chart_limits(spark):
    df = spark.range(1000).selectExpr(
        "id % 15 AS n15", "id % 16 AS n16", "concat('v', id % 949) AS t949", "concat('v', id % 950) AS t950",
        "7 AS same", "date_add(DATE '2020-01-01', int(id % 40)) AS d40", "date_add(DATE '2020-01-01', int(id % 41)) AS d41",
    )
    p = profile_table(df)
    charts = {c["column"]: c["chart"] for c in p.columns.collect()}
    assert charts == {
        "n15": "bar", "n16": "histogram", "t949": "bar", "t950": "none", "same": "none", "d40": "bar", "d41": "histogram"
    }
    kept = {r["column"]: r["n"] for r in p.top_values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {"n15": 12, "t949": 12, "t950": 6, "d40": 12, "d41": 12}
    scores = {c["column"]: round(c["interest"], 4) for c in p.columns.collect()}
    assert scores == {"n15": 0.7, "n16": 0.7, "t949": 0.28, "t950": 0.4, "same": 0.05, "d40": 0.455, "d41": 0.78}


def test_invariants(spark, sf_dir):
    names = ["customer", "events", "lineitem", "orders"]
    p = profile_dataset(Dataset.from_dir(spark, sf_dir, tables=names))
    columns = p.columns
    joined = columns.join(p.tables.select("table", "row_count"), "table")
    assert joined.where("count + null_count != row_count or distinct_count > count").count() == 0
    totals = p.histogram.groupBy("table", "column").agg(F.sum("count").alias("total"))
    assert totals.join(columns, ["table", "column"]).where("total != count").count() == 0
    for column in p.top_values.select("table", "column").distinct().collect():
        counts = [
            r["value_count"]
            for r in p.top_values.where((F.col("table") == column[0]) & (F.col("column") == column[1])).orderBy("rank").collect()
        ]
        assert counts == sorted(counts, reverse=True)


def test_numeric_histogram_edges(spark):
    bins = numeric_histogram(spark.range(0, 25).toDF("x"), "x").orderBy("bin").collect()
    assert [b["count"] for b in bins] == [1] * 23 + [2]
    assert bins[-1]["hi"] == 24.0 and bins[0]["label"] == "0 – 1"
    assert numeric_histogram(spark.range(1).toDF("x"), "x").count() == 0
    big = spark.createDataFrame([(2**62 + i,) for i in range(48)], "x bigint")
    assert [b["count"] for b in numeric_histogram(big, "x").orderBy("bin").collect()][0] in (2, 3)


def test_time_histogram_grains(spark):
    def grain(last):
        df = spark.sql(f"SELECT explode(array(DATE '2000-01-01', DATE '2000-01-01' + INTERVAL {last} DAYS)) AS d")
        rows = date_histogram(df, "d").orderBy("bin").collect()
        return rows[0]["date_fmt"], len(rows)

    assert grain(0) == ("yyyy-MM-dd", 1)
    assert grain(75) == ("yyyy-MM-dd", 76)
    assert grain(76) == ("yyyy-MM", 3)
    assert grain(1464) == ("yyyy-MM", 49)
    assert grain(1465) == ("yyyy", 5)
    assert grain(366 * 500)[0] == "yyy0s"


def test_time_zone_does_not_move_buckets(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2020-03-08 02:30:00', TIMESTAMP_NTZ '2020-03-09 23:59:59')) AS t")
        assert [r["label"] for r in date_histogram(df, "t").orderBy("bin").collect()] == ["2020-03-08", "2020-03-09"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="module")
def big(spark):
    df = spark.sql(
        "SELECT CAST(id AS int) AS id, concat('c', id % 4) AS cat, id / 10.0D AS val, "
        "CASE WHEN id = 7777 THEN 42 END AS rare, 'x' AS same, concat('u', id) AS u FROM range(1, 10001)"
    )
    ds = Dataset.from_frames(spark, {"big": df}, constraints=Constraints({"big": ("id",)}))
    return profile_dataset(ds, ProfileOptions(sample_above=1000, sample_size=2000))


def test_samples_keep_exact_figures(big):
    t = one(big.tables, "true")
    assert t["row_count"] == 10000 and 1500 < t["sample_rows"] < 2500
    val = one(big.columns, "column = 'val'")
    assert (val["count"], val["null_count"], val["min_num"], val["max_num"], val["approx"]) == (10000, 0, 0.1, 1000.0, True)
    assert abs(val["avg"] - 500.05) < 1e-5
    rare = one(big.columns, "column = 'rare'")
    assert (rare["count"], rare["null_count"], rare["distinct_count"]) == (1, 9999, 1)
    assert one(big.columns, "column = 'same'")["distinct_count"] == 1
    assert one(big.columns, "column = 'id'")["distinct_count"] == 10000


def test_samples_scale_to_the_table(big):
    assert one(big.columns, "column = 'cat'")["distinct_count"] == 4
    total = big.top_values.where("column = 'cat'").agg(F.sum("value_count")).first()[0]
    assert 9900 < total < 10100
    assert 9000 < one(big.columns, "column = 'u'")["distinct_count"] <= 10000
    assert abs(big.histogram.where("column = 'val'").agg(F.sum("count")).first()[0] - 10000) < 100


def test_constants_of_every_type_are_exact_on_samples(spark):
    df = spark.sql(
        "SELECT 'long text' AS t, CAST('b' AS binary) AS b, array(1) AS a, named_struct('x', 1) AS s, 2.5D AS d, "
        "DATE '2020-01-01' AS day, '2020-01-01' AS day_text, true AS f, CAST(1.5 AS decimal(5,2)) AS m, "
        "CASE WHEN id = 77 THEN 'other' ELSE 'long text' END AS two FROM range(5000)"
    )
    p = profile_table(df, "t", options=ProfileOptions(sample_above=10, sample_size=500))
    distinct = {c["column"]: c["distinct_count"] for c in p.columns.collect()}
    assert distinct.pop("two") == 2 and set(distinct.values()) == {1}
    assert {f["column"] for f in p.findings.where("kind = 'constant'").collect()} == set(distinct)


def test_sketched_distinct_counts(spark):
    df = spark.range(20_000).selectExpr("id % 6000 AS k", "concat('v', id % 3000) AS v", "1 AS one", "map('a', id) AS m")
    options = ProfileOptions(sample_above=10, sample_size=1000, sketch_distinct=True)
    distinct = {c["column"]: c["distinct_count"] for c in profile_table(df, options=options).columns.collect()}
    assert abs(distinct["k"] - 6000) < 600 and abs(distinct["v"] - 3000) < 300 and distinct["one"] == 1


def test_findings_are_exact_on_samples(big):
    def about(name):
        return [r["kind"] for r in big.findings.where(F.col("column") == name).collect()]

    assert about("rare") == ["constant"] and about("same") == ["constant"] and about("cat") == []


def test_details_use_all_rows(big):
    details = {r["label"]: r["value"] for r in big.details("big", "val").collect()}
    assert details["median"] == "500.1" and details["sum"] == "5,000,500" and details["uniqueness"].startswith("≈")
    assert [r["label"] for r in big.details("big", "cat").orderBy("position").collect()] == [
        "min length", "avg length", "max length", "uniqueness"
    ]
    assert [r["value"] for r in big.details("big", "rare").orderBy("position").collect()] == ["42", "42", "42", "0", "42", "≈100%"]


def test_approximate_columns_are_marked(big):
    labels = {r["column"]: r for r in uniqueness(big.columns).collect()}
    assert labels["id"]["label"] == "≈100%" and not labels["id"]["all_distinct"]


def test_findings_order_and_precedence(spark):
    df = spark.sql(
        "SELECT id, CAST(NULL AS string) AS empty_col, CASE WHEN id = 3 THEN 'x' END AS rare, "
        "CASE WHEN id < 3 THEN id END AS sparse, CASE WHEN id % 2 = 0 THEN '1' ELSE 'a' END AS mixed FROM range(10)"
    )
    p = profile_dataset(Dataset.from_frames(spark, {"t": df}, views={"v": "SELECT * FROM t"}))
    found = [(f["severity"], f["kind"], f["table"], f["column"]) for f in p.findings.orderBy("position").collect()]
    assert found == [
        ("warn", "empty", "t", "empty_col"),
        ("warn", "high-null", "t", "sparse"),
        ("warn", "mixed-type", "t", "mixed"),
        ("info", "constant", "t", "rare"),
    ]
    assert one(p.findings, "kind = 'high-null'")["message"] == "70% of t.sparse missing"


def test_reports(spark, tmp_path, big):
    document = json.loads(profile_json(big).first()["json"])
    assert document["totalRows"] == 10000 and document["views"] == []
    columns = {c["name"]: c for c in document["tables"][0]["columns"]}
    assert list(columns) == ["id", "cat", "val", "rare", "same", "u"]
    assert columns["val"]["max"] == 1000 and columns["rare"]["min"] == 42 and "generated" not in columns["id"]
    assert len(columns["val"]["histogram"]) == 24 and "dateFmt" not in columns["val"]["histogram"][0]
    assert columns["cat"]["topValues"][0]["value"].startswith("c")
    lines = [r["line"] for r in profile_markdown(big).orderBy("line_no").collect()]
    assert lines[0] == "# Data profile — dataset" and "- **Total rows:** 10,000" in lines
    assert any(line.startswith("| id 🔑 | int | integer | ≈10,000 | 0% | 1 | 10000 |") for line in lines)
    write_markdown(big, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == len(lines)
    write_json(big, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["rowCount"] == 10000
