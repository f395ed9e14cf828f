"""The extended statistics of one column as labelled values, by its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.kinds import DATE_KINDS, NUMERIC_KINDS
from siftwell.functions.labels import grouped_number, percent
from siftwell.functions.names import column
from siftwell.operators.stats import date_median, distinct_days, quartiles, spread, text_length_stats, time_span

# The statistics of each kind, in the order they are shown.
NUMERIC_LABELS = {0.5: "median", 0.25: "p25", 0.75: "p75"}


def column_details(df: DataFrame, name: str, kind: str, distinct_count: int, approx: bool = False) -> DataFrame:
    """Ordered rows ``(position, label, value)``, always over all rows of the table.

    Numbers: median, quartiles, deviation and sum; dates: median, distinct days and span;
    text: lengths and empty strings. Columns with values end with their uniqueness.
    """
    if kind in NUMERIC_KINDS:
        parts = _numeric(df, name)
    elif kind in DATE_KINDS:
        parts = _dated(df, name)
    elif kind == "text":
        parts = _text(df, name)
    else:
        parts = []
    count = df.agg(F.count(column(name)).alias("n")).where("n > 0")
    mark = F.lit("≈" if approx else "")
    label = F.concat(mark, percent(F.lit(distinct_count) / F.col("n")))
    details = count.select(F.lit(9).alias("position"), F.lit("uniqueness").alias("label"), label.alias("value"))
    for part in parts:
        details = details.unionAll(part)
    return details.where("value IS NOT NULL")


def _row(df: DataFrame, position: int, label: str, value) -> DataFrame:
    return df.select(F.lit(position).alias("position"), F.lit(label).alias("label"), value.alias("value"))


def _rows(df: DataFrame, *labelled) -> DataFrame:
    """Several labelled values of a one-row frame, from one evaluation of it."""
    structs = [
        F.struct(F.lit(position).alias("position"), F.lit(label).alias("label"), value.alias("value"))
        for position, label, value in labelled
    ]
    return df.select(F.inline(F.array(*structs)))


def _numeric(df: DataFrame, name: str) -> list[DataFrame]:
    ranks = quartiles(df, [name])
    order = F.create_map(*[F.lit(x) for i, p in enumerate(NUMERIC_LABELS) for x in (p, i)])
    labels = F.create_map(*[F.lit(x) for p, label in NUMERIC_LABELS.items() for x in (p, label)])
    quantiles = ranks.select(
        order[F.col("p")].alias("position"), labels[F.col("p")].alias("label"), grouped_number(F.col("value_num")).alias("value")
    )
    found = spread(df, [name]).where("total IS NOT NULL")
    return [
        quantiles,
        _rows(found, (3, "std dev", grouped_number(F.col("std_dev"))), (4, "sum", grouped_number(F.col("total")))),
    ]


def _dated(df: DataFrame, name: str) -> list[DataFrame]:
    days = distinct_days(df, name)
    return [
        _row(date_median(df, name), 0, "median", F.col("value")),
        _row(days.where("distinct_days > 0"), 1, "distinct days", F.format_number("distinct_days", 0)),
        _row(time_span(df, name), 2, "time span", F.col("span")),
    ]


def _text(df: DataFrame, name: str) -> list[DataFrame]:
    lengths = text_length_stats(df, [name])
    return [
        _rows(
            lengths,
            (0, "min length", F.col("min_length").cast("string")),
            (1, "avg length", F.format_string("%.1f", "avg_length")),
            (2, "max length", F.col("max_length").cast("string")),
            (3, "empty ''", F.when(F.col("empty_count") > 0, F.format_number("empty_count", 0))),
        ).where("value != 'null'")
    ]
