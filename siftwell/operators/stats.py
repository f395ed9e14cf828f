"""Extended statistics of columns, computed on demand over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.iso import iso_seconds
from siftwell.functions.kinds import clean
from siftwell.functions.labels import percent, span_label
from siftwell.functions.names import quoted
from siftwell.operators.histogram import day_of, instant_of
from siftwell.operators.quantiles import quantiles

# Fixed values.
QUARTILES = (0.25, 0.5, 0.75)


def _per_column(df: DataFrame, names: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate for all columns, one result row per column."""
    aggregates = [
        measure(F.expr(clean(n, df.schema[n].dataType))).alias(f"{key}{i}")
        for i, n in enumerate(names)
        for key, measure in measures.items()
    ]
    rows = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"{key}{i}").alias(key) for key in measures])
        for i, n in enumerate(names)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def spread(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sum, mean and population standard deviation of numeric columns.

    The deviation is merged from centred partial results, so large values do not cancel.
    """
    return _per_column(
        df,
        names,
        {
            "total": lambda v: F.sum(v.cast("double")),
            "mean": lambda v: F.avg(v.cast("double")),
            "std_dev": lambda v: F.stddev_pop(v.cast("double")),
        },
    )


def min_max_mean(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Range and mean of numeric columns as doubles."""
    return _per_column(
        df,
        names,
        {
            "min_value": lambda v: F.min(v).cast("double"),
            "max_value": lambda v: F.max(v).cast("double"),
            "mean_value": lambda v: F.avg(v.cast("double")),
        },
    )


def quartiles(df: DataFrame, names: Sequence[str], rank_limit: int | None = None) -> DataFrame:
    """Exact p25, median and p75 of numeric columns."""
    options = {} if rank_limit is None else {"rank_limit": rank_limit}
    return quantiles(df, {n: QUARTILES for n in names}, **options)


def date_median(df: DataFrame, name: str) -> DataFrame:
    """Exact median of a date, timestamp or ISO text column."""
    data_type = df.schema[name].dataType
    if not isinstance(data_type, T.StringType):
        return quantiles(df, {name: (0.5,)})
    seconds = df.select(F.expr(iso_seconds(quoted(name))).alias(name))
    # wall-clock time: no step depends on the session's time zone
    moment = F.expr("CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(value_num AS decimal(18, 6))) AS string)")
    return quantiles(seconds, {name: (0.5,)}).withColumn("value", moment).withColumn("value_num", F.lit(None))


def distinct_days(df: DataFrame, name: str) -> DataFrame:
    """Number of different calendar days."""
    day = day_of(name, df.schema[name].dataType)
    return df.agg(F.count_distinct(day).alias("distinct_days"))


def time_span(df: DataFrame, name: str) -> DataFrame:
    """Days between the first and the last moment, with a label."""
    moment = instant_of(name, df.schema[name].dataType)
    return df.agg((F.max(moment) - F.min(moment)).alias("span_days")).select(
        "span_days", span_label(F.col("span_days")).alias("span")
    )


def text_length_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Shortest, mean and longest text in code points, and how many texts are empty."""
    return _per_column(
        df,
        names,
        {
            "min_length": lambda v: F.min(F.length(v)),
            "avg_length": lambda v: F.avg(F.length(v)),
            "max_length": lambda v: F.max(F.length(v)),
            "empty_count": lambda v: F.count_if(v == ""),
        },
    )


def uniqueness(column_profile: DataFrame) -> DataFrame:
    """Distinct share of the non-null values, and whether every value differs."""
    share = F.col("distinct_count") / F.col("count")
    mark = F.when(F.col("approx"), F.lit("≈")).otherwise(F.lit(""))
    return column_profile.where(F.col("count") > 0).select(
        "table",
        "column",
        share.alias("uniqueness"),
        F.concat(mark, percent(share)).alias("label"),
        ((F.col("distinct_count") == F.col("count")) & ~F.col("approx")).alias("all_distinct"),
    )


def all_distinct(column_profile: DataFrame) -> DataFrame:
    """Columns without repeats that no primary key announces; estimates do not count."""
    every = (F.col("count") > 0) & (F.col("distinct_count") == F.col("count"))
    return column_profile.where(every & ~F.col("approx") & ~F.col("pk")).select("table", "column", "count")


def value_shares(top_values: DataFrame, column_profile: DataFrame) -> DataFrame:
    """Share of each top value among all rows and among the non-null values."""
    totals = column_profile.select("table", "column", "count", (F.col("count") + F.col("null_count")).alias("rows"))
    n = F.col("value_count")
    return top_values.join(totals, ["table", "column"]).select(
        "table",
        "column",
        "rank",
        "value",
        "value_count",
        (n / F.col("rows")).alias("row_share"),
        (n / F.col("count")).alias("value_share"),
        share_label(n / F.col("rows")).alias("row_share_label"),
        share_label(n / F.col("count")).alias("value_share_label"),
    )


def share_label(share: Column) -> Column:
    """A share as whole percent, plainly rounded."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))
