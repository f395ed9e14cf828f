"""The given tables with their declared keys, and tables derived from them.

The given tables hold no nulls, orphans or constant columns, so findings are shown on
derived ones. A derived table is defined once, in SQL that both engines read the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell import Constraints, Dataset, ForeignKey, UniqueKey

# Column names and types of the given tables.
SCHEMAS: dict[str, str] = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}

PRIMARY_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}

FOREIGN_KEYS = (
    ForeignKey("nation", ("n_regionkey",), "region"),
    ForeignKey("customer", ("c_nationkey",), "nation"),
    ForeignKey("supplier", ("s_nationkey",), "nation"),
    ForeignKey("orders", ("o_custkey",), "customer"),
    ForeignKey("lineitem", ("l_orderkey",), "orders"),
    ForeignKey("lineitem", ("l_partkey",), "part"),
    ForeignKey("lineitem", ("l_suppkey",), "supplier"),
    ForeignKey("labels", ("doc_id",), "documents"),
    ForeignKey("events", ("user_id",), "customer"),
)

CONSTRAINTS = Constraints(PRIMARY_KEYS, FOREIGN_KEYS, (UniqueKey("customer", ("c_name",)),))

# SQL that Spark and DuckDB read the same.
DERIVED = {
    "orders_dirty": (
        "SELECT *, CAST(NULL AS STRING) AS empty_col, 'x' AS const_col, "
        "CASE WHEN o_orderkey % 10 < 3 THEN o_totalprice END AS sparse_col, "
        "CASE WHEN o_orderkey = 77 THEN 42 END AS rare_col, "
        "CASE o_orderkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN 'abc' ELSE '2020-01-01' END AS mixed_col "
        "FROM orders"
    ),
    "mixed_values": (
        "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '12' WHEN 1 THEN '1.5e3' WHEN 2 THEN 'abc' "
        "WHEN 3 THEN 'true' ELSE '2020-01-01' END AS v FROM orders"
    ),
    "text_dates": (
        "SELECT o_orderkey, substring(CAST(o_orderdate AS STRING), 1, 10) AS day_text, "
        "concat(substring(CAST(o_orderdate AS STRING), 1, 10), ' 10:30') AS minute_text, "
        "CASE WHEN o_orderkey = 77 THEN 'n/a' ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS almost_day "
        "FROM orders"
    ),
    "untyped_orders": (
        "SELECT CAST(o_orderkey AS STRING) AS whole, "
        "CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '2.25' END AS number, "
        "o_orderstatus AS word, substring(CAST(o_orderdate AS STRING), 1, 10) AS day_text, "
        "CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE o_orderpriority END AS mixture FROM orders"
    ),
    "customer_subset": "SELECT * FROM customer WHERE c_custkey % 7 <> 0",
    "dialogs": (
        "SELECT conv_id, CASE WHEN turn = 5 THEN NULL ELSE turn END AS turn, role FROM conversations"
    ),
    "turn_parent": "SELECT conv_id, turn FROM conversations WHERE turn < 3",
    "orders_gap": (
        "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' "
        "OR o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'"
    ),
    "orders_one_year": (
        "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' "
        "AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'"
    ),
    "orders_stray_dates": (
        "SELECT o_orderkey, CASE WHEN o_orderkey = 77 THEN TIMESTAMP '0001-01-01 00:00:00' "
        "WHEN o_orderkey % 1000 = 3 THEN TIMESTAMP '3999-12-31 00:00:00' ELSE o_orderdate END AS o_orderdate FROM orders"
    ),
    "rare_values": (
        "SELECT o_orderkey, CASE WHEN o_orderkey = 77 THEN 'x' ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS almost_dates, "
        "CASE WHEN o_orderkey = 77 THEN 5 ELSE CAST(o_orderkey % 2 AS INT) END AS almost_flag FROM orders"
    ),
    "customer_orders": (
        "SELECT c.c_mktsegment, c.c_nationkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority "
        "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
    ),
    "sparse_priorities": (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority, "
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders"
    ),
    "declared_columns": (
        "SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(20)' WHEN 2 THEN 'Boolean' "
        "WHEN 3 THEN 'datetime' WHEN 4 THEN 'TIME' WHEN 5 THEN 'BLOB' WHEN 6 THEN 'DOUBLE PRECISION' "
        "WHEN 7 THEN 'DECIMAL(10,2)' WHEN 8 THEN 'POINT' ELSE '' END AS declared FROM part"
    ),
}

# Shape of the derived tables, as in ``SCHEMAS``.
DERIVED_SCHEMAS = {
    "orders_dirty": SCHEMAS["orders"]
    + ", empty_col string, const_col string, sparse_col double, rare_col int, mixed_col string",
    "customer_subset": SCHEMAS["customer"],
    "dialogs": "conv_id bigint, turn bigint, role string",
    "turn_parent": "conv_id bigint, turn bigint",
    "text_dates": "o_orderkey bigint, day_text string, minute_text string, almost_day string",
    "customer_orders": (
        "c_mktsegment string, c_nationkey int, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "untyped_orders": "whole string, number string, word string, day_text string, mixture string",
}

SAMPLE_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
SAMPLE_SIZE = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, tables: list[str] | None = None, views=None) -> Dataset:
    """The given tables, or some of them, with their declared keys."""
    names = tables or list(SCHEMAS)
    keys = [k for k in FOREIGN_KEYS if k.table in names and k.parent in names]
    constraints = Constraints(PRIMARY_KEYS, keys, CONSTRAINTS.unique_keys)
    return Dataset.from_dir(spark, sf_dir, tables=names, views=views, constraints=constraints)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    base = Dataset.from_dir(spark, sf_dir, tables=list(SCHEMAS), views={name: DERIVED[name]})
    return base.open(name)


def dirty_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """Tables on which every finding shows."""
    frames = {n: derived(spark, sf_dir, n) for n in ("orders_dirty", "customer_subset", "dialogs", "turn_parent")}
    return Dataset.from_frames(
        spark,
        frames,
        views={"broken_view": "SELECT * FROM a_table_that_does_not_exist"},
        constraints=Constraints(
            {"orders_dirty": ("o_orderkey",), "customer_subset": ("c_custkey",), "turn_parent": ("conv_id", "turn")},
            (
                ForeignKey("orders_dirty", ("o_custkey",), "customer_subset"),
                ForeignKey("dialogs", ("conv_id", "turn"), "turn_parent"),
                ForeignKey("customer_subset", ("c_nationkey",), "country", ("id",)),
            ),
        ),
        name="dirty",
    )
