"""What to look at first: interesting columns and rich tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
HIGHLIGHTS = 9
HIGHLIGHT_INTEREST = 0.4
KEY_COLUMNS = 6
KEY_COLUMN_INTEREST = 0.12
SCORE_COLUMNS = 3


def dataset_rollup(table_profile: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables, views, rows, columns and relationships; rows and columns of tables only."""
    is_table = F.col("type") == "table"
    totals = table_profile.agg(
        F.count_if(is_table).alias("table_count"),
        F.count_if(~is_table).alias("view_count"),
        F.coalesce(F.sum(F.when(is_table, F.col("row_count"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(is_table, F.col("column_count"))), F.lit(0)).cast("bigint").alias("total_columns"),
    )
    return totals.crossJoin(edges.agg(F.count(F.lit(1)).alias("relationship_count")))  # one row each


def highlights(column_profile: DataFrame, table_profile: DataFrame) -> DataFrame:
    """The columns of tables most worth a chart."""
    tables = table_profile.where(F.col("type") == "table").select("table", F.col("ordinal").alias("table_ord"))
    return (
        column_profile.where((F.col("chart") != "none") & (F.col("interest") >= HIGHLIGHT_INTEREST))
        .join(tables, "table")
        .orderBy(F.desc("interest"), "table_ord", "ordinal")
        .limit(HIGHLIGHTS)
        .select("table", "column", "kind", "chart", "interest")
    )


def table_ranking(column_profile: DataFrame, table_profile: DataFrame) -> DataFrame:
    """Tables by richness: their three most interesting columns and their size.

    ``key_columns`` lists up to six columns of some interest, best first.
    """
    best_first = Window.partitionBy("table").orderBy(F.desc("interest"), "ordinal")
    ranked = column_profile.withColumn("rank", F.row_number().over(best_first))
    shown = (F.col("rank") <= KEY_COLUMNS) & (F.col("interest") > KEY_COLUMN_INTEREST)
    per_table = ranked.groupBy("table").agg(
        F.avg(F.when(F.col("rank") <= SCORE_COLUMNS, F.col("interest"))).alias("top_interest"),
        F.sort_array(F.collect_list(F.when(shown, F.struct("rank", "column")))).alias("keys"),
    )
    size = F.least(F.lit(1.0), F.log10(F.col("row_count") + 1) / 6)
    score = F.coalesce("top_interest", F.lit(0.0)) * 0.7 + size * 0.3
    keys = F.transform(F.coalesce("keys", F.array()), lambda k: k["column"])
    order = Window.orderBy(F.desc("score"), "ordinal")  # one row per table
    return (
        table_profile.where(F.col("type") == "table")
        .join(per_table, "table", "left")
        .select("table", "ordinal", "row_count", score.alias("score"), F.array_join(keys, ", ").alias("key_columns"))
        .withColumn("position", F.row_number().over(order))
        .select("position", "table", "row_count", "score", "key_columns")
    )
