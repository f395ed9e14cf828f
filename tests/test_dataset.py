"""Datasets, declared keys, names, errors."""

import gzip

import pytest
from siftwell import Constraints, Dataset, ForeignKey, ProfileOptions, UniqueKey, profile_dataset
from siftwell.operators.frequency import repeated_keys, top_values
from siftwell.sources.constraints import ConstraintError

from tests.helpers import one


def test_names_that_need_quoting(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, None)], "`select` int, `a b` string, ".rstrip(", "))
    odd = df.withColumnRenamed("select", "se`l.e'c\"t")
    p = profile_dataset(Dataset.from_frames(spark, {'we"ird table': df, "o'dd": odd}))
    assert one(p.tables, "table = 'we\"ird table'")["row_count"] == 3
    columns = p.columns.where("table = 'we\"ird table'").orderBy("ordinal").collect()
    assert [c["column"] for c in columns] == ["select", "a b"]
    assert columns[1]["null_count"] == 1
    assert p.tables.where("error is not null").count() == 0
    assert p.columns.where("table != 'we\"ird table'").orderBy("ordinal").first()["column"] == "se`l.e'c\"t"


def test_tables_then_views_by_name(spark):
    df = spark.range(3)
    ds = Dataset.from_frames(spark, {"tabx": df, "b": df, "a": df}, views={"0v": "SELECT * FROM a"})
    assert [r.name for r in ds.relations()] == ["a", "b", "tabx", "0v"]


def test_broken_view_is_isolated(spark):
    ds = Dataset.from_frames(
        spark, {"ok": spark.createDataFrame([(1,)], "id int")}, views={"v": "SELECT * FROM a_dropped_table"}
    )
    p = profile_dataset(ds)
    assert one(p.tables, "type = 'table'")["row_count"] == 1
    broken = one(p.tables, "type = 'view'")
    assert broken["table"] == "v" and "a_dropped_table" in broken["error"] and broken["row_count"] == 0
    assert p.findings.where("kind = 'unreadable' and table = 'v'").count() == 1


def test_file_that_breaks_when_read(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "good.parquet"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "bad.parquet"))
    part = next((tmp_path / "bad.parquet").glob("part-*.parquet"))
    data = part.read_bytes()
    footer = data.rindex(b"PAR1")
    part.write_bytes(data[:4] + b"\xff" * (len(data[4:footer]) // 3) + data[4 + len(data[4:footer]) // 3 :])
    for crc in (tmp_path / "bad.parquet").glob(".*.crc"):
        crc.write_bytes(b"")
    p = profile_dataset(Dataset.from_dir(spark, str(tmp_path)))
    assert one(p.tables, "table = 'good'")["row_count"] == 10
    assert one(p.tables, "table = 'bad'")["error"]


def test_implicit_parent_key(spark):
    ds = Dataset.from_frames(
        spark,
        {
            "parent": spark.createDataFrame([(1, "a")], "pk int, name string"),
            "child": spark.createDataFrame([(1, 1), (2, 99)], "id int, pid int"),
        },
        constraints=Constraints({"parent": ("pk",)}, [ForeignKey("child", ("pid",), "parent")]),
    )
    assert [(k.id, k.table, k.parent, k.pairs) for k in ds.foreign_keys()] == [(0, "child", "parent", (("pid", "pk"),))]
    p = profile_dataset(ds)
    assert one(p.findings, "kind = 'orphan-fk'")["message"] == "1 orphaned pid value in child"
    assert one(p.columns, "column = 'pid'")["fk"] == "parent.pk"


def test_composite_key_is_one_key(spark):
    ds = Dataset.from_frames(
        spark,
        {
            "parent": spark.createDataFrame([(1, 1), (2, 2)], "a int, b int"),
            "child": spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 1, 2), (4, None, 5)], "id int, x int, y int"),
        },
        constraints=Constraints({"parent": ("a", "b")}, [ForeignKey("child", ("x", "y"), "parent", ("a", "b"))]),
    )
    p = profile_dataset(ds)
    assert [r["columns"] for r in p.relationships.collect()] == ["(x, y) → (a, b)"]
    found = one(p.findings, "kind = 'orphan-fk'")
    assert found["message"] == "1 orphaned (x, y) value in child"
    assert found["detail"] == "→ parent.(a, b) (no matching parent row)"
    assert p.columns.where("fk is not null").count() == 2


def test_implicit_composite_key_order(spark):
    constraints = Constraints({"parent": ("b", "a")}, [ForeignKey("child", ("x", "y"), "parent")])
    assert constraints.resolve(["parent", "child"])[0].pairs == (("x", "b"), ("y", "a"))


def test_unresolvable_keys():
    with pytest.raises(ConstraintError):
        Constraints({}, [ForeignKey("child", ("x",), "parent")]).resolve(["parent", "child"])
    with pytest.raises(ConstraintError):
        Constraints({"parent": ("a", "b")}, [ForeignKey("child", ("x",), "parent")]).resolve(["parent"])


def test_missing_parent_and_uncheckable_key(spark):
    ds = Dataset.from_frames(
        spark,
        {"child": spark.createDataFrame([(1, 2)], "a int, b int"), "parent": spark.createDataFrame([(1,)], "id int")},
        views={"elsewhere": "SELECT 1 AS id"},
        constraints=Constraints(
            {},
            [
                ForeignKey("child", ("a",), "elsewhere", ("id",)),
                ForeignKey("child", ("b",), "parent", ("no_such_column",)),
            ],
        ),
    )
    found = profile_dataset(ds).findings.where("kind = 'orphan-fk'").collect()
    assert [f["message"] for f in found] == ["child.a refers to elsewhere, which is no table here"]


def test_generated_columns_and_flags(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "a int").selectExpr("a", "a * 2 AS b", "a || 'x' AS c")
    ds = Dataset.from_frames(
        spark, {"g": df}, constraints=Constraints(generated={"g": ("b", "c")}, not_null={"g": ("a",)})
    )
    columns = profile_dataset(ds).columns.orderBy("ordinal").collect()
    assert [c["generated"] for c in columns] == [False, True, True]
    assert [c["not_null"] for c in columns] == [True, False, False]
    assert columns[1]["max"] == "6"
    assert ds.columns().where("generated").count() == 2


def test_unique_columns_are_not_grouped(spark):
    df = spark.createDataFrame([(3, "c", "dup"), (1, "a", "dup"), (2, None, "x")], "id int, code string, tag string")
    constraints = Constraints(
        {"u": ("id",)}, unique_keys=[UniqueKey("u", ("code",)), UniqueKey("u", ("tag",), where="tag <> 'dup'")]
    )
    assert constraints.unique_columns("u") == {"id", "code"}
    p = profile_dataset(Dataset.from_frames(spark, {"u": df}, constraints=constraints))
    ids = one(p.columns, "column = 'id'")
    assert ids["distinct_count"] == 3 and ids["pk"]
    code = one(p.columns, "column = 'code'")
    assert (code["count"], code["distinct_count"]) == (2, 2)
    assert one(p.columns, "column = 'tag'")["distinct_count"] == 2
    first = one(p.top_values, "column = 'tag' and rank = 1")
    assert (first["value"], first["value_count"]) == ("dup", 2)
    top = top_values(df, ["id"], unique=["id"]).orderBy("rank").collect()
    assert [(t["value"], t["value_count"]) for t in top] == [("1", 1), ("2", 1), ("3", 1)]


def test_declared_unique_can_be_checked(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    ds = Dataset.from_frames(spark, {"t": df}, constraints=Constraints({"t": ("id",)}))
    assert one(profile_dataset(ds).columns, "true")["distinct_count"] == 2
    assert one(profile_dataset(ds, ProfileOptions(trust_unique=True)).columns, "true")["distinct_count"] == 3
    assert [tuple(r) for r in repeated_keys(df, ["id"]).collect()] == [(1, 2)]


def test_view_is_read_once_and_released(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", None)], "k string, n int")
    p = profile_dataset(Dataset.from_frames(spark, {"t": t}, views={"v": "SELECT k, n * 10 AS n10 FROM t"}))
    view = one(p.tables, "table = 'v'")
    assert view["row_count"] == 4 and view["sample_rows"] is None
    top = one(p.top_values, "table = 'v' and column = 'k' and rank = 1")
    assert (top["value"], top["value_count"]) == ("a", 2)
    n10 = one(p.columns, "table = 'v' and column = 'n10'")
    assert (n10["count"], n10["null_count"], n10["min"], n10["max"]) == (3, 1, "10", "30")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_views_over_views(spark):
    ds = Dataset.from_frames(
        spark, {"base": spark.range(6)}, views={"a_small": "SELECT * FROM z_even WHERE id < 3", "z_even": "SELECT id FROM base WHERE id % 2 = 0"}
    )
    assert {t["table"]: t["row_count"] for t in profile_dataset(ds).tables.collect()} == {"base": 6, "a_small": 2, "z_even": 3}
    loop = Dataset.from_frames(spark, {"base": spark.range(6)}, views={"loop_1": "SELECT * FROM loop_2", "loop_2": "SELECT * FROM loop_1"})
    assert profile_dataset(loop).tables.where("error is not null").count() == 2


def test_empty_table(spark):
    p = profile_dataset(Dataset.from_frames(spark, {"e": spark.createDataFrame([], "a int, b string")}))
    assert one(p.tables, "true")["row_count"] == 0
    assert [c["count"] for c in p.columns.collect()] == [0, 0]
    assert [c["null_fraction"] for c in p.columns.collect()] == [0.0, 0.0]
    assert p.findings.count() == 0
    assert p.histogram.count() == 0 and p.top_values.count() == 0


def test_directory_of_csv(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,price,word,day\n1,2.5,x,2020-01-01\n2,3,y,2020-01-02\n")
    with gzip.open(tmp_path / "two.csv.gz", "wt") as file:
        file.write("id\n7\n8\n")
    (tmp_path / "_hidden.csv").write_text("x\n1\n")
    ds = Dataset.from_dir(spark, str(tmp_path), "csv", untyped=True, header="true")
    assert ds.table_names() == ["one", "two"]
    kinds = {(c["table"], c["column"]): c["kind"] for c in profile_dataset(ds).columns.collect()}
    assert kinds == {
        ("one", "id"): "integer",
        ("one", "price"): "real",
        ("one", "word"): "text",
        ("one", "day"): "date",
        ("two", "id"): "integer",
    }


@pytest.mark.parametrize("fmt", ["json", "orc", "parquet"])
def test_directory_formats(spark, tmp_path, fmt):
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, w string").write.format(fmt).save(str(tmp_path / f"t.{fmt}"))
    ds = Dataset.from_dir(spark, str(tmp_path), fmt)
    assert ds.size_bytes > 0
    assert one(profile_dataset(ds).tables, "table = 't'")["row_count"] == 2


def test_catalog_schema(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS siftwell_test")
    try:
        spark.range(5).write.mode("overwrite").saveAsTable("siftwell_test.numbers")
        spark.sql("CREATE OR REPLACE VIEW siftwell_test.evens AS SELECT * FROM siftwell_test.numbers WHERE id % 2 = 0")
        p = profile_dataset(Dataset.from_catalog(spark, "siftwell_test"))
        assert [(t["table"], t["type"], t["row_count"]) for t in p.tables.orderBy("ordinal").collect()] == [
            ("numbers", "table", 5),
            ("evens", "view", 3),
        ]
    finally:
        spark.sql("DROP DATABASE siftwell_test CASCADE")


def test_adhoc_sql_with_arguments(spark):
    ds = Dataset.from_frames(spark, {"t": spark.range(10)})
    assert ds.sql("SELECT count(*) AS n FROM t WHERE id >= :low", {"low": 7}).first()["n"] == 3
    assert ds.sql("SELECT id FROM t WHERE id > 99").columns == ["id"]
