"""Registered queries: name → function of a session and a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import Constraints, Dataset, ForeignKey, ProfileOptions, UniqueKey, profile_dataset, profile_table
from siftwell.functions.kinds import declared_kind
from siftwell.functions.labels import percent
from siftwell.operators import aggregates, details, frequency, histogram, integrity, pages, ranking, rows, stats, value_types
from siftwell.operators import findings as findings_ops
from siftwell.operators.heavy import heavy_values
from siftwell.operators.quantiles import quantiles
from siftwell.plans.graph import KeyGraph
from siftwell.plans.profile import table_catalog as catalog_of
from siftwell.sinks import json_rows
from siftwell.sinks.report import profile_json as whole_json
from siftwell.sinks.report import profile_markdown as markdown_of
from siftwell.sinks.report import table_json
from siftwell.sources.constraints import ResolvedKey
from siftwell.sources.sampling import exact_sample, hash_sample
from workload import fixtures
from workload.fixtures import dataset, derived, dirty_dataset, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Every row is profiled, whatever the size of the table.
EXACT = ProfileOptions(sample_above=None)
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded_profile(columns: DataFrame) -> DataFrame:
    """Profile columns that can be compared between engines."""
    return columns.select(
        "table",
        "column",
        "kind",
        "count",
        "null_count",
        "distinct_count",
        F.round("null_fraction", 6).alias("null_fraction"),
        "min",
        "max",
        F.round("avg", 4).alias("avg"),
        "chart",
        F.round("interest", 6).alias("interest"),
        "storage_types",
    )


# -- sources and catalog --------------------------------------------------------------


@query
def column_profile(spark, sf_dir):
    """Flagship: the exact profile of every column of orders."""
    return rounded_profile(profile_dataset(dataset(spark, sf_dir, ["orders"]), EXACT).columns)


@query
def dataset_profile(spark, sf_dir):
    """The exact profile of every column of every table."""
    return rounded_profile(profile_dataset(dataset(spark, sf_dir), EXACT).columns)


@query
def table_catalog(spark, sf_dir):
    return catalog_of(Dataset.from_dir(spark, sf_dir)).select("table", "type", "row_count", "column_count")


@query
def column_catalog(spark, sf_dir):
    columns = dataset(spark, sf_dir).columns().select("table", "ordinal", "column", "pk", "not_null", "generated")
    counts = catalog_of(dataset(spark, sf_dir)).select("table", "row_count")
    return columns.join(counts, "table")


@query
def declared_kinds(spark, sf_dir):
    columns = derived(spark, sf_dir, "declared_columns")
    return columns.groupBy(declared_kind(F.col("declared")).alias("kind")).agg(F.count(F.lit(1)).alias("column_count"))


@query
def declared_type_kinds(spark, sf_dir):
    """Declared types decide the kind where the values can be taken so; a brand is no number."""
    types = {"p_partkey": "BOOLEAN", "p_size": "DOUBLE PRECISION", "p_name": "BLOB", "p_type": "VARCHAR(25)", "p_brand": "INTEGER", "p_retailprice": "POINT"}
    data = Dataset.from_frames(spark, {"part": table(spark, sf_dir, "part")}, declared_types={"part": types})
    return profile_dataset(data, EXACT).columns.select("column", "declared_type", "kind", "count", "distinct_count")


@query
def column_flags(spark, sf_dir):
    """Primary keys, references, not-null and generated columns as the profile shows them."""
    constraints = Constraints(
        {"orders": ("o_orderkey",), "customer": ("c_custkey",)},
        [ForeignKey("orders", ("o_custkey",), "customer")],
        not_null={"orders": ("o_orderkey", "o_orderdate"), "customer": ("c_custkey",)},
        generated={"orders": ("o_totalprice",)},
    )
    data = Dataset.from_dir(spark, sf_dir, tables=["orders", "customer"], constraints=constraints)
    return profile_dataset(data, EXACT).columns.select("table", "column", "pk", "not_null", "generated", "fk", "null_count")


@query
def unreadable_table(spark, sf_dir):
    """A broken view is a row with an error; the table beside it is profiled."""
    members = dataset(spark, sf_dir, ["orders"], views={"broken_view": "SELECT * FROM a_table_that_does_not_exist"})
    return profile_dataset(members, EXACT).tables.select(
        "table", "type", "row_count", "column_count", F.col("error").isNotNull().alias("unreadable")
    )


@query
def view_profile(spark, sf_dir):
    views = {"customer_orders": fixtures.DERIVED["customer_orders"]}
    members = dataset(spark, sf_dir, ["customer", "orders"], views=views)
    return rounded_profile(profile_dataset(members, EXACT).columns.where("table = 'customer_orders'"))


@query
def adhoc_sql(spark, sf_dir):
    return dataset(spark, sf_dir).sql(
        "SELECT n_name, count(*) AS order_count, round(sum(o_totalprice), 2) AS revenue "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "WHERE o_orderstatus = :status GROUP BY n_name",
        args={"status": "F"},
    )


@query
def profile_json(spark, sf_dir):
    """Every table as a JSON document, read back from it."""
    documents = table_json(profile_dataset(dataset(spark, sf_dir), EXACT))
    parsed = documents.select("table", F.parse_json("json").alias("j"))
    column = F.explode(F.expr("CAST(variant_get(j, '$.columns') AS array<variant>)"))
    return parsed.select("table", F.expr("variant_get(j, '$.rowCount', 'bigint')").alias("row_count"), column.alias("c")).select(
        "table",
        "row_count",
        F.expr("variant_get(c, '$.name', 'string')").alias("column"),
        F.expr("variant_get(c, '$.kind', 'string')").alias("kind"),
        F.expr("variant_get(c, '$.distinctCount', 'bigint')").alias("distinct_count"),
        F.expr("size(try_cast(try_variant_get(c, '$.histogram') AS array<variant>))").alias("bins"),
    ).withColumn("bins", F.when(F.col("bins") > 0, F.col("bins")))


@query
def profile_markdown(spark, sf_dir):
    """The lines of a report, apart from the title and the unknown file size."""
    lines = markdown_of(profile_dataset(dataset(spark, sf_dir, ["customer", "nation", "orders", "region"]), EXACT))
    body = lines.where("line_no > 2 AND NOT startswith(line, '- **File size')")
    return body.groupBy("line").agg(F.count(F.lit(1)).alias("times"))


@query
def markdown_lines(spark, sf_dir):
    """The same lines in their order."""
    lines = markdown_of(profile_dataset(dataset(spark, sf_dir, ["customer", "nation", "orders", "region"]), EXACT))
    body = lines.where("line_no > 2 AND NOT startswith(line, '- **File size')")
    return body.selectExpr("CAST(row_number() OVER (ORDER BY line_no) AS bigint) AS position", "line")


# -- per-column aggregates ------------------------------------------------------------


@query
def null_profile(spark, sf_dir):
    return aggregates.null_profile(derived(spark, sf_dir, "orders_dirty"))


@query
def distinct_counts(spark, sf_dir):
    return frequency.distinct_counts(table(spark, sf_dir, "lineitem"))


@query
def distinct_documents(spark, sf_dir):
    return frequency.distinct_counts(table(spark, sf_dir, "documents"))


@query
def unique_shortcut(spark, sf_dir):
    """Declared unique columns are counted without grouping."""
    return frequency.distinct_counts(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], unique=["o_orderkey"])


@query
def repeated_keys(spark, sf_dir):
    """Pairs that would break a key if one were declared."""
    return frequency.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def approx_distinct(spark, sf_dir):
    """Sketched distinct counts lie near the exact ones."""
    lineitem = table(spark, sf_dir, "lineitem")
    sketched = aggregates.approx_distinct(lineitem).withColumnRenamed("distinct_count", "estimate")
    exact = frequency.distinct_counts(lineitem)
    near = F.abs(F.col("estimate") - F.col("distinct_count")) <= F.col("distinct_count") * 0.1
    return exact.join(sketched, "column").select("column", "distinct_count", near.alias("within_tenth"))


@query
def min_max_mean(spark, sf_dir):
    found = stats.min_max_mean(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS)
    return found.withColumn("mean_value", F.round("mean_value", 4))


@query
def value_types_string(spark, sf_dir):
    return value_types.text_value_types(derived(spark, sf_dir, "mixed_values"), "v")


@query
def value_types_documents(spark, sf_dir):
    return value_types.text_value_types(table(spark, sf_dir, "documents"), "text")


@query
def value_types_json(spark, sf_dir):
    return value_types.json_value_types(table(spark, sf_dir, "events"), "props", "$.k")


@query
def top_values_text(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]).drop("value_num")


@query
def top_values_documents(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"]).drop("value_num")


@query
def top_values_numeric(spark, sf_dir):
    names = ["l_quantity", "l_linenumber", "l_discount", "l_suppkey"]
    return frequency.top_values(table(spark, sf_dir, "lineitem"), names)


@query
def top_values_summaries(spark, sf_dir):
    """Columns that a summary decides, and keys that are counted in full."""
    lines = heavy_values(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber", "l_discount", "l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey"], tracked=1024)
    return lines.drop("value_num")


@query
def top_values_long(spark, sf_dir):
    """Long texts are counted as digests."""
    return heavy_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"]).drop("value_num")


@query
def top_values_unique(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"], unique=["c_custkey", "c_name"])


@query
def text_date_kind(spark, sf_dir):
    found = profile_table(derived(spark, sf_dir, "text_dates"), "text_dates", options=EXACT)
    return found.columns.select("column", "kind", "chart", "min", "max", "distinct_count")


@query
def boolean_kind(spark, sf_dir):
    found = profile_table(table(spark, sf_dir, "labels"), "labels", options=EXACT)
    return found.columns.select("column", "kind", "chart", "distinct_count")


@query
def untyped_kind(spark, sf_dir):
    return value_types.untyped_kinds(derived(spark, sf_dir, "untyped_orders"))


@query
def untyped_profile(spark, sf_dir):
    """Text columns that hold only numbers are profiled as numbers, by the types of the first pass."""
    data = Dataset.from_frames(spark, {"untyped_orders": derived(spark, sf_dir, "untyped_orders")}, untyped=["untyped_orders"])
    return rounded_profile(profile_dataset(data, EXACT).columns)


@query
def numeric_histogram(spark, sf_dir):
    found = histogram.numeric_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "count")


@query
def histogram_integer(spark, sf_dir):
    return histogram.numeric_histogram(table(spark, sf_dir, "documents"), "n_chars").select("bin", "count", "label")


@query
def values_per_bin(spark, sf_dir):
    """Rows and different values per bin, both from one count of the values."""
    lineitem = table(spark, sf_dir, "lineitem")
    numbers = ["l_extendedprice", "l_partkey"]
    low, high, first, last = lineitem.agg(*[f(n) for n in numbers for f in (F.min, F.max)]).first()
    specs = [
        histogram.NumericBins(numbers[0], low, high),
        histogram.NumericBins(numbers[1], first, last),
        histogram.DateBuckets("l_shipdate", "month"),
    ]
    return frequency.bin_values(lineitem, specs)


@query
def histogram_labels(spark, sf_dir):
    return histogram.numeric_histogram(table(spark, sf_dir, "events"), "value").select("bin", "label", "count")


@query
def date_histogram_year(spark, sf_dir):
    return histogram.date_histogram(table(spark, sf_dir, "orders"), "o_orderdate")


@query
def date_histogram_month(spark, sf_dir):
    return histogram.date_histogram(derived(spark, sf_dir, "orders_one_year"), "o_orderdate")


@query
def date_histogram_day(spark, sf_dir):
    return histogram.date_histogram(table(spark, sf_dir, "events"), "ts")


@query
def date_histogram_gapfill(spark, sf_dir):
    return histogram.date_histogram(derived(spark, sf_dir, "orders_gap"), "o_orderdate")


@query
def date_histogram_text(spark, sf_dir):
    """Dates held in text; values that do not parse fall into no bucket."""
    return histogram.date_histogram(derived(spark, sf_dir, "text_dates"), "almost_day")


@query
def chart_choice(spark, sf_dir):
    members = dataset(spark, sf_dir, ["customer", "documents", "events", "part"])
    return profile_dataset(members, EXACT).columns.select("table", "column", "kind", "chart")


@query
def text_lengths(spark, sf_dir):
    members = dataset(spark, sf_dir, ["benchmark", "customer", "pages", "supplier"])
    return profile_dataset(members, EXACT).columns.where("kind = 'text'").select("table", "column", "min", "max")


@query
def interest_scores(spark, sf_dir):
    members = dataset(spark, sf_dir, ["conversations", "labels", "lineitem", "orders"])
    return profile_dataset(members, EXACT).columns.select("table", "column", F.round("interest", 6).alias("interest"))


@query
def profile_histograms(spark, sf_dir):
    """All bins of all charted columns of a profile."""
    found = profile_dataset(dataset(spark, sf_dir, ["lineitem", "orders"]), EXACT).histogram
    return found.select("table", "column", "bin", "count", "date_fmt")


def _sampled(spark: SparkSession, sf_dir: str):
    options = ProfileOptions(
        sample_above=0, sample_size=fixtures.SAMPLE_SIZE, sample_keys={"lineitem": fixtures.SAMPLE_KEY}
    )
    return profile_dataset(dataset(spark, sf_dir, ["lineitem"]), options)


@query
def sampled_rows(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    sample = hash_sample(lineitem, fixtures.SAMPLE_KEY, lineitem.count(), fixtures.SAMPLE_SIZE)
    return sample.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("row_count"))


@query
def sampled_profile(spark, sf_dir):
    """Top values taken from a sample and scaled to the table."""
    return _sampled(spark, sf_dir).top_values.select("table", "column", "rank", "value_count").where(
        F.col("column").isin("l_linenumber", "l_discount", "l_returnflag")
    )


@query
def calibrated_profile(spark, sf_dir):
    return rounded_profile(_sampled(spark, sf_dir).columns)


@query
def sketched_profile(spark, sf_dir):
    """Distinct counts of a sampled profile from sketches lie near the exact ones."""
    options = ProfileOptions(sample_above=0, sample_size=fixtures.SAMPLE_SIZE, sketch_distinct=True)
    estimates = profile_dataset(dataset(spark, sf_dir, ["lineitem"]), options).columns
    exact = frequency.distinct_counts(table(spark, sf_dir, "lineitem")).withColumnRenamed("distinct_count", "exact")
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.1
    return estimates.join(exact, "column").select("column", "approx", F.col("exact").alias("distinct_count"), near.alias("within_tenth"))


# -- extended statistics --------------------------------------------------------------


@query
def top30(spark, sf_dir):
    return frequency.most_frequent(table(spark, sf_dir, "part"), "p_name")


@query
def quantiles_numeric(spark, sf_dir):
    found = stats.quartiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_partkey"])
    return found.select("column", "p", "rank", "value_num")


@query
def quantiles_narrowed(spark, sf_dir):
    """The same search when only few rows may be ranked at once."""
    found = stats.quartiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_suppkey"], rank_limit=1000)
    return found.select("column", "p", "rank", "value_num")


@query
def stddev_sum(spark, sf_dir):
    found = stats.spread(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS)
    return found.select(
        "column", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("std_dev", 4).alias("std_dev")
    )


@query
def date_median(spark, sf_dir):
    orders = stats.date_median(table(spark, sf_dir, "orders"), "o_orderdate")
    return orders.unionAll(stats.date_median(table(spark, sf_dir, "lineitem"), "l_shipdate")).select("column", "rank", "value")


@query
def distinct_days(spark, sf_dir):
    return stats.distinct_days(table(spark, sf_dir, "events"), "ts")


@query
def time_span(spark, sf_dir):
    return stats.time_span(table(spark, sf_dir, "orders"), "o_orderdate")


@query
def text_length_stats(spark, sf_dir):
    found = stats.text_length_stats(table(spark, sf_dir, "documents"), ["text", "lang", "source"])
    return found.withColumn("avg_length", F.round("avg_length", 4))


@query
def empty_strings(spark, sf_dir):
    found = stats.text_length_stats(derived(spark, sf_dir, "sparse_priorities"), ["priority", "status"])
    return found.select("column", "empty_count")


@query
def uniqueness(spark, sf_dir):
    found = stats.uniqueness(profile_dataset(dataset(spark, sf_dir, ["customer", "part"]), EXACT).columns)
    return found.withColumn("uniqueness", F.round("uniqueness", 6))


@query
def all_distinct(spark, sf_dir):
    """Columns without repeats that are no primary keys."""
    return stats.all_distinct(profile_dataset(dataset(spark, sf_dir, ["customer", "part", "supplier"]), EXACT).columns)


@query
def value_share(spark, sf_dir):
    found = profile_table(derived(spark, sf_dir, "sparse_priorities"), "sparse_priorities", options=EXACT)
    shares = stats.value_shares(found.top_values, found.columns).where("column != 'o_orderkey'")
    return shares.withColumns({n: F.round(n, 6) for n in ("row_share", "value_share")})


@query
def percent_labels(spark, sf_dir):
    """Share of orders per customer, as labels of different sizes."""
    orders = table(spark, sf_dir, "orders")
    per_day = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") < 77).alias("early"))
    return per_day.select("o_orderstatus", percent(F.col("early") / F.col("n")).alias("label"))


def _details(df: DataFrame, name: str, kind: str) -> DataFrame:
    distinct = frequency.distinct_counts(df, [name]).first()["distinct_count"]
    return details.column_details(df, name, kind, distinct)


@query
def details_numeric(spark, sf_dir):
    return _details(table(spark, sf_dir, "part"), "p_retailprice", "real")


@query
def details_date(spark, sf_dir):
    return _details(table(spark, sf_dir, "orders"), "o_orderdate", "datetime")


@query
def details_text(spark, sf_dir):
    return _details(derived(spark, sf_dir, "sparse_priorities"), "status", "text")


# -- dataset level --------------------------------------------------------------------


@query
def fk_edges(spark, sf_dir):
    """Relationship edges with the rows on both ends."""
    members = dataset(spark, sf_dir)
    rows_of = catalog_of(members).select("table", "row_count")
    edges = integrity.relationships(spark, members.foreign_keys())
    ends = [rows_of.toDF("from_table", "from_rows"), rows_of.toDF("to_table", "to_rows")]
    return edges.join(ends[0], "from_table").join(ends[1], "to_table").drop("fk_id")


@query
def edge_collapse(spark, sf_dir):
    """Parallel declared keys between two tables as one edge, with the rows that it leaves without a parent."""
    found = _key_graph(spark, sf_dir)
    orphans = found.orphans.groupBy(F.col("table").alias("from_table"), F.col("parent").alias("to_table")).agg(F.sum("orphans").alias("orphans"))
    rows_of = found.tables.select(F.col("table").alias("from_table"), "row_count")
    return found.edges().join(orphans, ["from_table", "to_table"]).join(rows_of, "from_table")


def _key_graph(spark: SparkSession, sf_dir: str) -> KeyGraph:
    """Tables with parallel keys and a key to the table itself, as a dataset declares them."""
    names = ["documents", "labels", "lineitem", "orders"]
    constraints = Constraints(
        {"documents": ("doc_id",), "orders": ("o_orderkey",)},
        (
            ForeignKey("lineitem", ("l_orderkey",), "orders"),
            ForeignKey("lineitem", ("l_partkey",), "orders"),
            ForeignKey("orders", ("o_custkey",), "orders"),
            ForeignKey("labels", ("doc_id",), "documents"),
        ),
    )
    return KeyGraph(Dataset.from_dir(spark, sf_dir, tables=names, constraints=constraints))


@query
def self_references(spark, sf_dir):
    """Tables whose rows refer to rows of the same table, their size and their orphans."""
    graph = _key_graph(spark, sf_dir)
    orphans = graph.orphans.where("table = parent").select("table", "orphans")
    return graph.self_references().join(graph.tables, "table").join(orphans, "table")


def _key(child: str, columns: tuple[str, ...], parent: str, targets: tuple[str, ...]) -> ResolvedKey:
    return ResolvedKey(0, child, parent, tuple(zip(columns, targets)))


@query
def orphans_single(spark, sf_dir):
    key = _key("orders", ("o_custkey",), "customer_subset", ("c_custkey",))
    return integrity.orphan_count(table(spark, sf_dir, "orders"), derived(spark, sf_dir, "customer_subset"), key)


@query
def orphans_broadcast(spark, sf_dir):
    """The same check when the parent is known to be small."""
    key = _key("orders", ("o_custkey",), "customer_subset", ("c_custkey",))
    parent = derived(spark, sf_dir, "customer_subset")
    return integrity.orphan_count(table(spark, sf_dir, "orders"), parent, key, parent_rows=parent.count())


@query
def orphan_values(spark, sf_dir):
    key = _key("lineitem", ("l_partkey",), "parts", ("p_partkey",))
    parts = table(spark, sf_dir, "part").where("p_size > 5")
    return integrity.orphan_rows(table(spark, sf_dir, "lineitem"), parts, key).select(
        F.col("k0").alias("l_partkey"), F.col("n").alias("row_count")
    )


@query
def orphans_composite(spark, sf_dir):
    key = _key("dialogs", ("conv_id", "turn"), "turn_parent", ("conv_id", "turn"))
    return integrity.orphan_count(derived(spark, sf_dir, "dialogs"), derived(spark, sf_dir, "turn_parent"), key)


@query
def missing_parent(spark, sf_dir):
    found = profile_dataset(dirty_dataset(spark, sf_dir), EXACT).orphans
    return found.select("table", "parent", "from_label", "to_label", "missing_parent", "orphans")


@query
def findings_all(spark, sf_dir):
    found = profile_dataset(dirty_dataset(spark, sf_dir), EXACT).findings
    # what an engine says of a broken view is its own
    return found.withColumn("detail", F.when(F.col("kind") != "unreadable", F.col("detail")))


@query
def findings_by_severity(spark, sf_dir):
    return findings_ops.findings_by_severity(profile_dataset(dirty_dataset(spark, sf_dir), EXACT).findings)


@query
def findings_for_column(spark, sf_dir):
    found = profile_dataset(dirty_dataset(spark, sf_dir), EXACT).findings
    return findings_ops.findings_of(found, "orders_dirty", "sparse_col").select("severity", "kind", "message")


@query
def dataset_rollup(spark, sf_dir):
    """Totals need the catalog and the keys only."""
    members = dataset(spark, sf_dir)
    return ranking.dataset_rollup(catalog_of(members), integrity.relationships(spark, members.foreign_keys()))


@query
def highlights(spark, sf_dir):
    return profile_dataset(dataset(spark, sf_dir), EXACT).highlights().withColumn("interest", F.round("interest", 6))


@query
def table_ranking(spark, sf_dir):
    return profile_dataset(dataset(spark, sf_dir), EXACT).table_ranking().withColumn("score", F.round("score", 6))


# -- rows and drill-down --------------------------------------------------------------


@query
def rows_by_value(spark, sf_dir):
    return rows.rows_by_value(table(spark, sf_dir, "orders"), "o_custkey", 42, limit=None)


@query
def value_count(spark, sf_dir):
    return rows.value_count(table(spark, sf_dir, "lineitem"), "l_returnflag", "R")


@query
def sample_values(spark, sf_dir):
    """Any values will do, as long as the column holds them."""
    priorities = derived(spark, sf_dir, "sparse_priorities")
    values = rows.sample_values(priorities, "priority")
    held = values.join(priorities.select(F.col("priority").alias("value")).distinct(), "value", "left_semi")
    return held.agg(F.count(F.lit(1)).alias("value_count"))


@query
def view_rows(spark, sf_dir):
    """Rows shown for a value, and their total."""
    shown, total = rows.view_rows(table(spark, sf_dir, "lineitem"), "l_linestatus", "F", limit=100)
    return shown.agg(F.count(F.lit(1)).alias("shown")).crossJoin(total)  # one row each


@query
def value_counts_of_rows(spark, sf_dir):
    """Suppliers with how many lineitems share their key."""
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return rows.value_counts_of(suppliers, table(spark, sf_dir, "lineitem"), "l_suppkey")


@query
def group_count_with_null(spark, sf_dir):
    return rows.group_count(derived(spark, sf_dir, "sparse_priorities"), "priority")


@query
def distinct_values(spark, sf_dir):
    return rows.distinct_values(derived(spark, sf_dir, "sparse_priorities"), "priority")


@query
def order_top(spark, sf_dir):
    return rows.ordered_rows(table(spark, sf_dir, "orders"), "o_totalprice", descending=True, limit=rows.TOP_ROWS, key=["o_orderkey"])


@query
def null_rows(spark, sf_dir):
    return rows.null_rows(derived(spark, sf_dir, "sparse_priorities"), "priority", limit=None)


@query
def bin_rows(spark, sf_dir):
    """Rows of the last bin of a histogram."""
    lineitem = table(spark, sf_dir, "lineitem")
    last = histogram.numeric_histogram(lineitem, "l_extendedprice").where("bin = 23").first()
    found = rows.bin_rows(lineitem, "l_extendedprice", last["lo"], last["hi"], last=True, limit=None)
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query
def date_bucket_rows(spark, sf_dir):
    found = rows.bucket_rows(table(spark, sf_dir, "orders"), "o_orderdate", "yyyy-MM", "1997-02", limit=None)
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query
def key_lookup(spark, sf_dir):
    return rows.rows_matching(table(spark, sf_dir, "conversations"), {"conv_id": 7, "turn": 1}, limit=None)


@query
def fk_follow(spark, sf_dir):
    """Customers that at least one urgent order refers to."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    key = _key("orders", ("o_custkey",), "customer", ("c_custkey",))
    return rows.referenced_parents(urgent, table(spark, sf_dir, "customer"), key)


@query
def text_filter(spark, sf_dir):
    """Documents with a text in any column, whatever the case."""
    return rows.filtered(table(spark, sf_dir, "documents"), "THE").select("doc_id", "lang", "source", "n_chars")


@query
def text_filter_literal(spark, sf_dir):
    """Wildcards are plain characters."""
    return rows.filtered(table(spark, sf_dir, "pages"), "_").select("page_id", "url")


@query
def filtered_count(spark, sf_dir):
    return rows.filtered_count(table(spark, sf_dir, "customer"), "building")


@query
def sorted_page(spark, sf_dir):
    return rows.sorted_page(table(spark, sf_dir, "orders"), 3, "o_orderdate", descending=True, key=["o_orderkey"])


@query
def keyset_page(spark, sf_dir):
    """The same page found from the last row of the page before."""
    orders = table(spark, sf_dir, "orders")
    before = rows.sorted_page(orders, 2, "o_orderdate", descending=True, key=["o_orderkey"])
    last = before.orderBy(F.asc("o_orderdate"), F.desc("o_orderkey")).first()
    return rows.next_page(orders, last.asDict(), "o_orderdate", descending=True, key=["o_orderkey"])


# -- defaults, exactness and declared keys --------------------------------------------


@query
def default_profile_lineitem(spark, sf_dir):
    """Without options every row is profiled."""
    return rounded_profile(profile_table(table(spark, sf_dir, "lineitem"), "lineitem").columns)


@query
def date_histogram_centuries(spark, sf_dir):
    """Two stray dates make the buckets wider; every row is in one."""
    return histogram.date_histogram(derived(spark, sf_dir, "orders_stray_dates"), "o_orderdate")


@query
def rows_by_value_all(spark, sf_dir):
    """All rows holding a value, as no limit is given."""
    return rows.rows_by_value(table(spark, sf_dir, "lineitem"), "l_returnflag", "R").select("l_orderkey", "l_linenumber")


@query
def bin_rows_all(spark, sf_dir):
    return rows.bin_rows(table(spark, sf_dir, "lineitem"), "l_quantity", 10.0, 20.0).select("l_orderkey", "l_linenumber", "l_quantity")


@query
def calibrated_kinds(spark, sf_dir):
    """One text that is no date and one 5 among flags, which a sample misses: kinds are those of all rows."""
    options = ProfileOptions(sample_above=0, sample_size=50)
    found = profile_table(derived(spark, sf_dir, "rare_values"), "rare_values", options=options).columns
    return found.where("column != 'o_orderkey'").select("column", "kind", "storage_types")


@query
def duplicate_key_findings(spark, sf_dir):
    """A declared key that rows repeat."""
    keys = Constraints({"lineitem": ("l_orderkey", "l_linenumber")})
    found = profile_dataset(Dataset.from_dir(spark, sf_dir, tables=["lineitem"], constraints=keys)).findings
    return found.where("kind = 'duplicate-key'").drop("position")


@query
def partial_unique_key(spark, sf_dir):
    """A key of some rows, beside the primary key."""
    keys = Constraints({"orders": ("o_orderkey",)}, unique_keys=(UniqueKey("orders", ("o_custkey",), "o_orderstatus = 'P'"),))
    found = profile_dataset(Dataset.from_dir(spark, sf_dir, tables=["orders"], constraints=keys)).repeats
    return found.select("label", "where", "repeats")


@query
def distinct_maps(spark, sf_dir):
    """Maps are grouped, whatever the order of their keys."""
    lineitem = table(spark, sf_dir, "lineitem")
    one, two = (F.lit("flag"), F.col("l_returnflag")), (F.lit("line"), F.col("l_linenumber").cast("string"))
    flags = F.when(F.col("l_orderkey") % 2 == 0, F.create_map(*one, *two)).otherwise(F.create_map(*two, *one))
    found = profile_table(lineitem.select(flags.alias("flags")), "maps").columns
    return found.select("column", "distinct_count", "count")


@query
def variant_profile(spark, sf_dir):
    """The types of VARIANT values; they cannot be grouped, so their distinct count is unknown."""
    json = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN '\"a\"' ELSE '{\"k\": 1}' END")
    found = profile_table(table(spark, sf_dir, "orders").select(F.parse_json(json).alias("v")), "variants").columns
    return found.select("column", "count", "distinct_count", "storage_types")


@query
def date_median_text(spark, sf_dir):
    """Wall-clock times in text."""
    texts = table(spark, sf_dir, "orders").select(F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.lit(" 10:00:00")).alias("t"))
    return stats.date_median(texts, "t").select("value")


@query
def fk_follow_text(spark, sf_dir):
    """Numbers that refer to text; text that is no number is referred to by none."""
    customer = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("x")).otherwise(F.col("c_custkey").cast("string"))
    parent = customer.withColumn("code", text)
    child = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return rows.referenced_parents(child, parent, _key("orders", ("o_custkey",), "customer", ("code",))).select("c_custkey", "c_name")


@query
def fk_follow_total(spark, sf_dir):
    """The rows that one row refers to, a few of them and their number."""
    order = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").first().asDict()
    key = _key("orders", ("o_orderkey",), "lineitem", ("l_orderkey",))
    shown, total = rows.follow(table(spark, sf_dir, "lineitem"), order, key, limit=3)
    return shown.agg(F.count(F.lit(1)).alias("shown")).crossJoin(total)  # one row each


@query
def bad_key_isolated(spark, sf_dir):
    """A key that cannot be resolved is a finding; its table is profiled."""
    keys = Constraints(foreign_keys=(ForeignKey("orders", ("o_custkey",), "customer"),))
    found = profile_dataset(Dataset.from_dir(spark, sf_dir, tables=["customer", "orders"], constraints=keys))
    bad = found.findings.where("kind = 'unresolved-key'").select("table", "column")
    return found.tables.select("table", "row_count").join(bad, "table")


# -- pages, quantiles and samples that hold at any size; the JSON document as rows ----------


@query
def deep_page(spark, sf_dir):
    """A page far down, found by a directory of ranks; only small ranges are sorted."""
    lineitem = table(spark, sf_dir, "lineitem")
    return pages.deep_page(lineitem, lineitem.count() // 150, "l_extendedprice", True, ["l_orderkey", "l_linenumber"], leaf=2_000)


@query
def deep_pages_filtered(spark, sf_dir):
    """Two pages of filtered rows from one directory, by a column of few values."""
    directory = pages.RankDirectory(table(spark, sf_dir, "orders"), "o_orderpriority", False, ["o_orderkey"], needle="URGENT", leaf=500)
    first, second = (directory.page(p, 20).withColumn("page", F.lit(p)) for p in (3, 9))
    return first.unionAll(second)


@query
def quantiles_many(spark, sf_dir):
    """Many quantiles of many columns, 64-bit integers beyond the reach of a double among them."""
    wide = table(spark, sf_dir, "lineitem").withColumn("wide", F.lit(2**60) + F.col("l_orderkey") * 7 + F.col("l_linenumber"))
    names = ["wide", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate"]
    found = quantiles(wide, {n: [i / 20 for i in range(21)] for n in names}, rank_limit=1_000)
    return found.select("column", "p", "rank", F.when(F.col("column") != "l_shipdate", F.col("value_num")).alias("value_num"))


@query
def sample_exact_size(spark, sf_dir):
    """A sample of exactly 1,000 rows that does not depend on how the table is split."""
    return exact_sample(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 1_000).select("l_orderkey", "l_linenumber", "l_quantity")


@query
def json_top_values(spark, sf_dir):
    """Top values as the JSON document holds them."""
    found = json_rows.json_top_values(whole_json(profile_dataset(dataset(spark, sf_dir, ["part"]), EXACT)))
    return found.where(F.col("column").isin("p_name", "p_brand", "p_type")).drop("table")


@query
def json_bins(spark, sf_dir):
    """All bins of all charted columns, from the document."""
    found = json_rows.json_bins(whole_json(profile_dataset(dataset(spark, sf_dir, ["lineitem", "orders"]), EXACT)))
    return found.select("table", "column", "bin", "count", "date_fmt")


@query
def json_findings(spark, sf_dir):
    """All findings in their order, from the document."""
    fields = {"severity": "string", "kind": "string", "table": "string", "column": "string", "message": "string", "detail": "string"}
    found = json_rows.json_findings(whole_json(profile_dataset(dirty_dataset(spark, sf_dir), EXACT)), fields)
    return found.withColumn("detail", F.when(F.col("kind") != "unreadable", F.col("detail")))


@query
def json_keys(spark, sf_dir):
    """Foreign keys, edges and row counts of both ends, from the document."""
    document = whole_json(profile_dataset(dataset(spark, sf_dir, ["customer", "lineitem", "orders"]), EXACT))
    rows_of = json_rows.json_tables(document).select("table", "row_count")
    edges = json_rows.json_relationships(document).select(F.col("from_table").alias("table"), F.col("to_table").alias("parent"), "columns")
    return json_rows.json_keys(document).drop("key_id").join(edges, ["table", "parent"]).join(rows_of, "table")


@query
def json_columns(spark, sf_dir):
    """Columns with their counts, and how many bins they have, from the document."""
    return json_rows.json_columns(whole_json(profile_dataset(dataset(spark, sf_dir, ["customer", "nation"]), EXACT))).drop("kind", "bins")
