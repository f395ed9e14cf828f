"""Histograms: equal-width bins of numbers and time buckets of dates.

Bounds come from the exact aggregates and enter as literals, so values are binned by an
expression. ``bin_counts`` bins the rows of all given columns in one scan; a profile bins the
distinct values that it has counted anyway (``siftwell.operators.frequency``) and scans nothing.
What is shuffled is one partial count per task, column and bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.iso import SECONDS_PER_DAY, iso_day, iso_seconds
from siftwell.functions.kinds import clean
from siftwell.functions.labels import grouped_number
from siftwell.functions.names import quoted
from siftwell.plans.local import local_frame

# Fixed values.
BINS = 24
YEAR_ABOVE_DAYS = 366 * 4
MONTH_ABOVE_DAYS = 75
DATE_FORMATS = {
    "millennium": "y000s",
    "century": "yy00s",
    "decade": "yyy0s",
    "year": "yyyy",
    "month": "yyyy-MM",
    "day": "yyyy-MM-dd",
}

# Years in a bucket. A grain is left for a coarser one when it would take more than WIDE buckets, so
# that a stray date costs resolution and no rows.
YEARS = {"year": 1, "decade": 10, "century": 100, "millennium": 1000}
WIDE = 400

LONG_RANGE = 2**63 - 1


@dataclass(frozen=True)
class NumericBins:
    """Equal-width bins of a numeric column between its extremes."""

    name: str
    low: float | int
    high: float | int

    @property
    def width(self) -> float:
        return float(self.high - self.low)


@dataclass(frozen=True)
class DateBuckets:
    """Time buckets of a date column; ``grain`` is a key of ``DATE_FORMATS``."""

    name: str
    grain: str


def date_grain(span_days: Column) -> Column:
    """Grain of a time histogram by the days it spans."""
    grain = F
    for coarse, fine in (("millennium", "century"), ("century", "decade"), ("decade", "year")):
        grain = grain.when(span_days > 366 * WIDE * YEARS[fine], F.lit(coarse))
    return (
        grain.when(span_days > YEAR_ABOVE_DAYS, F.lit("year"))
        .when(span_days > MONTH_ABOVE_DAYS, F.lit("month"))
        .when(span_days >= 0, F.lit("day"))
    )


def day_of(name: str, data_type: T.DataType) -> Column:
    """Day number of a date, timestamp or ISO text column."""
    return day_of_value(quoted(name), data_type)


def day_of_value(value: str, data_type: T.DataType) -> Column:
    return F.expr(iso_day(value) if isinstance(data_type, T.StringType) else f"unix_date(CAST({value} AS date))")


def instant_of(name: str, data_type: T.DataType) -> Column:
    """Wall-clock days since 1970-01-01 with fraction, independent of the time zone."""
    value = quoted(name)
    if isinstance(data_type, T.StringType):
        return F.expr(f"({iso_seconds(value)}) / {SECONDS_PER_DAY}")
    if isinstance(data_type, T.DateType):
        return F.expr(f"CAST(unix_date({value}) AS double)")
    clock = f"hour({value}) * 3600 + minute({value}) * 60 + CAST(extract(SECOND FROM {value}) AS double)"
    return F.expr(f"unix_date(CAST({value} AS date)) + ({clock}) / {SECONDS_PER_DAY}")


def bin_of(value: str, data_type: T.DataType, spec: NumericBins | DateBuckets) -> Column:
    """Bin of a cleaned value of a column of the given type."""
    if isinstance(spec, NumericBins):
        return numeric_bin(value, data_type, spec)
    return bucket_of_day(day_of_value(value, data_type), spec.grain)


def numeric_bin(value: str, data_type: T.DataType, bins: NumericBins) -> Column:
    """Index of the bin of a value; the maximum falls into the last bin, NULL into none."""
    if isinstance(data_type, T.IntegralType) and bins.high - bins.low <= LONG_RANGE:
        # Subtract as integers: beyond 2^53 neighbours are equal as doubles.
        offset = F.expr(f"CAST({value} - CAST('{int(bins.low)}' AS bigint) AS double)")
    else:
        offset = F.expr(f"CAST({value} AS double)") - F.lit(float(bins.low))
    index = F.floor(offset * BINS / F.lit(bins.width))
    return F.when(index.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), index))).cast("int")


def bucket_of_day(day: Column, grain: str) -> Column:
    """Integer bucket of a day number: count of years or of several, of months, or the day itself."""
    date = F.date_from_unix_date(day)
    if grain in YEARS:
        return F.floor(F.year(date) / YEARS[grain]).cast("int")
    if grain == "month":
        return F.year(date) * 12 + F.month(date) - 1
    return day


def bucket_label(bucket: Column, grain: Column) -> Column:
    month = F.concat(
        F.lpad(F.floor(bucket / 12).cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad((F.pmod(bucket, F.lit(12)) + 1).cast("string"), 2, "0"),
    )
    day = F.date_from_unix_date(F.when(grain == "day", bucket)).cast("string")
    label = F.when(grain == "month", month).when(grain == "year", F.format_string("%04d", bucket))
    for coarse in ("decade", "century", "millennium"):
        label = label.when(grain == coarse, F.format_string("%04ds", bucket * YEARS[coarse]))
    return label.otherwise(day)


def bin_counts(df: DataFrame, specs: Sequence[NumericBins | DateBuckets]) -> DataFrame:
    """Rows per ``(ordinal, bin)`` for all given columns, in one scan."""
    indexes = []
    for spec in specs:
        data_type = df.schema[spec.name].dataType
        index = bin_of(clean(spec.name, data_type), data_type, spec)
        indexes.append(index.alias(str(df.columns.index(spec.name))))
    projected = df.select(*indexes)
    if len(indexes) == 1:
        name = projected.columns[0]
        long = projected.select(F.lit(name).alias("ordinal"), F.col(quoted(name)).alias("bin"))
    else:
        long = projected.unpivot([], [quoted(c) for c in projected.columns], "ordinal", "bin")
    return (
        long.where(F.col("bin").isNotNull())
        .groupBy("ordinal", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("ordinal").cast("int").alias("ordinal"), "bin", "n")
    )


def numeric_frame(counts: DataFrame, bounds: DataFrame, key: Sequence[str]) -> DataFrame:
    """All bins of the columns of ``bounds`` (key, lo, hi) with their counts, empty ones too."""
    width = (F.col("hi") - F.col("lo")) / BINS
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    low = F.col("lo") + F.col("bin") * width
    frame = frame.select(
        *key,
        "bin",
        low.alias("lo"),
        F.when(F.col("bin") == BINS - 1, F.col("hi")).otherwise(low + width).alias("hi"),
    )
    return frame.join(counts, [*key, "bin"], "left").select(
        *key,
        "bin",
        "lo",
        "hi",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        bin_label(F.col("lo"), F.col("hi")).alias("label"),
        F.lit(None).cast("string").alias("date_fmt"),
    )


def bin_label(low: Column, high: Column) -> Column:
    return F.concat(grouped_number(low), F.lit(" – "), grouped_number(high))


def date_frame(counts: DataFrame, grains: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every bucket from the first to the last, empty ones too."""
    key = list(key)
    ends = counts.groupBy(*key).agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    buckets = ends.select(*key, "first", F.explode(F.sequence("first", "last")).alias("bin"))
    position = F.col("bin") - F.col("first")
    formats = F.create_map(*[F.lit(x) for item in DATE_FORMATS.items() for x in item])
    return (
        buckets.join(counts, [*key, "bin"], "left")
        .join(grains, key)
        .select(
            *key,
            position.alias("bin"),
            position.cast("double").alias("lo"),
            (position + 1).cast("double").alias("hi"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
            bucket_label(F.col("bin"), F.col("grain")).alias("label"),
            formats[F.col("grain")].alias("date_fmt"),
        )
    )


def numeric_histogram(df: DataFrame, name: str) -> DataFrame:
    """Equal-width histogram of a numeric column; no rows when it has no finite range."""
    spark = df.sparkSession
    value = clean(name, df.schema[name].dataType)
    low, high = df.selectExpr(f"min({value})", f"max({value})").first()
    if not is_finite_range(low, high):
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint, label string")
    counts = bin_counts(df, [NumericBins(name, low, high)])
    bounds = local_frame(
        spark,
        [{"ordinal": df.columns.index(name), "lo": float(low), "hi": float(high)}],
        {"ordinal": "int", "lo": "double", "hi": "double"},
    )
    return numeric_frame(counts, bounds, ["ordinal"]).select("bin", "lo", "hi", "count", "label")


def date_histogram(df: DataFrame, name: str, grain: str | None = None) -> DataFrame:
    """Time histogram of a date, timestamp or ISO text column; the span picks the grain."""
    spark = df.sparkSession
    schema = "bin int, label string, count bigint, date_fmt string"
    data_type = df.schema[name].dataType
    if grain is None:
        instant = instant_of(name, data_type)
        grain = df.agg((F.max(instant) - F.min(instant)).alias("span")).select(date_grain(F.col("span"))).first()[0]
    if grain is None:
        return spark.createDataFrame([], schema)
    counts = bin_counts(df, [DateBuckets(name, grain)])
    grains = local_frame(
        spark, [{"ordinal": df.columns.index(name), "grain": grain}], {"ordinal": "int", "grain": "string"}
    )
    return date_frame(counts, grains, ["ordinal"]).select("bin", "label", "count", "date_fmt")


def is_finite_range(low, high) -> bool:
    """Whether two extremes span a finite, non-empty range."""
    if low is None or high is None or not low < high:
        return False
    return all(isinstance(v, int) or (Decimal(v) if not isinstance(v, Decimal) else v).is_finite() for v in (low, high))
