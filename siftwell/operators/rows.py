"""From a profile back to rows: lookups, ranges, filters and pages.

All results are lazy frames. Predicates compare plain columns with literals so that they
reach the scan. A function that takes a ``limit`` returns all rows unless one is given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.kinds import orderable
from siftwell.functions.names import column, literal
from siftwell.operators.histogram import DATE_FORMATS, YEARS, day_of
from siftwell.operators.integrity import _key_columns
from siftwell.sources.constraints import ResolvedKey

# Fixed values.
SAMPLE_VALUES = 25
TOP_ROWS = 200
PAGE = 100


def equals(df: DataFrame, name: str, value) -> Column:
    """A column equal to a value, NULL matching NULL."""
    if isinstance(df.schema[name].dataType, T.BinaryType) and value is not None:
        raise ValueError(f"{name} is binary; rows are not looked up by binary values")
    return column(name).isNull() if value is None else column(name) == literal(value, df.schema[name].dataType)


def rows_where(df: DataFrame, condition: Column, limit: int | None = None) -> DataFrame:
    matching = df.where(condition)
    return matching if limit is None else matching.limit(limit)


def rows_by_value(df: DataFrame, name: str, value, limit: int | None = None) -> DataFrame:
    """Rows holding a value."""
    return rows_where(df, equals(df, name, value), limit)


def value_count(df: DataFrame, name: str, value) -> DataFrame:
    """How many rows hold a value."""
    return df.where(equals(df, name, value)).agg(F.count(F.lit(1)).alias("row_count"))


def view_rows(df: DataFrame, name: str, value, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows holding a value, and how many there are in all."""
    return rows_by_value(df, name, value, limit), value_count(df, name, value)


def sample_values(df: DataFrame, name: str, limit: int = SAMPLE_VALUES) -> DataFrame:
    """A few non-null values to look at; which ones is left open, so nothing is decided by them."""
    value = column(name)
    return df.where(value.isNotNull()).select(value.alias("value")).limit(limit)


def value_counts_of(rows: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """The given rows with how many rows of ``df`` share their value of a column."""
    counts = df.groupBy(column(name).alias("shared_value")).agg(F.count(F.lit(1)).alias("shared_count"))
    same = column(name).eqNullSafe(F.col("shared_value"))
    return rows.join(counts, same, "left").drop("shared_value")


def rows_matching(df: DataFrame, match: Mapping[str, object], limit: int | None = None) -> DataFrame:
    """Rows equal to every given (column, value) pair, such as a composite key."""
    return rows_where(df, reduce(Column.__and__, [equals(df, n, v) for n, v in match.items()]), limit)


def group_count(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Frequencies of a column's values, NULL being one of them, the most frequent first."""
    counts = df.groupBy(column(name).alias("value")).agg(F.count(F.lit(1)).alias("value_count"))
    ordered = counts.orderBy(F.desc("value_count"), F.asc_nulls_first("value"))
    return ordered if limit is None else ordered.limit(limit)


def distinct_values(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct values, NULL first."""
    ordered = df.select(column(name).alias("value")).distinct().orderBy(F.asc_nulls_first("value"))
    return ordered if limit is None else ordered.limit(limit)


def ordered_rows(
    df: DataFrame, name: str, descending: bool = False, limit: int | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """Rows by a column, all or the first ones; ``key`` columns break ties."""
    order = column(name).desc_nulls_last() if descending else column(name).asc_nulls_first()
    ordered = df.orderBy(order, *[column(k).asc_nulls_first() for k in key])
    return ordered if limit is None else ordered.limit(limit)


def null_rows(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    return rows_where(df, column(name).isNull(), limit)


def bin_rows(
    df: DataFrame, name: str, low: float, high: float, last: bool = False, limit: int | None = None
) -> DataFrame:
    """Rows of a histogram bin: from ``low`` up to but without ``high``; the last bin has both."""
    value = column(name)
    below = value <= F.lit(high) if last else value < F.lit(high)
    return rows_where(df, (value >= F.lit(low)) & below, limit)


def bucket_rows(df: DataFrame, name: str, date_format: str, label: str, limit: int | None = None) -> DataFrame:
    """Rows of a time bucket, as a range of dates so that files can be skipped."""
    grain = {pattern: name for name, pattern in DATE_FORMATS.items()}[date_format]
    if grain == "day":
        first = F.to_date(F.lit(label))
        following = F.date_add(first, 1)
    elif grain == "month":
        first = F.to_date(F.lit(f"{label}-01"))
        following = F.add_months(first, 1)
    else:
        first = F.make_date(F.lit(int(label.rstrip("s"))), F.lit(1), F.lit(1))
        following = F.add_months(first, 12 * YEARS[grain])
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        day = day_of(name, data_type)
        condition = (day >= F.unix_date(first)) & (day < F.unix_date(following))
    else:
        value = column(name)
        condition = (value >= first.cast(data_type)) & (value < following.cast(data_type))
    return rows_where(df, condition, limit)


def parent_rows(parent: DataFrame, row: Mapping[str, object], key: ResolvedKey, limit: int | None = None) -> DataFrame:
    """Parent rows one child row refers to; none when a part of its key is NULL."""
    match = {b: row[a] for a, b in key.pairs}
    if any(v is None for v in match.values()):
        return parent.limit(0)
    return rows_where(parent, reduce(Column.__and__, [_refers_to(parent, n, v) for n, v in match.items()]), limit)


def _refers_to(parent: DataFrame, name: str, value) -> Column:
    """A parent's column equal to a child's value, where text and numbers may meet; text that is no number matches none."""
    data_type = parent.schema[name].dataType
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(data_type, T.StringType) and number:
        return column(name).try_cast("bigint" if isinstance(value, int) else "double") == F.lit(value)
    if isinstance(data_type, T.NumericType) and isinstance(value, str):
        return column(name) == F.lit(value).try_cast(data_type)
    return equals(parent, name, value)


def follow(
    parent: DataFrame, row: Mapping[str, object], key: ResolvedKey, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Parent rows one child row refers to, and how many there are in all."""
    found = parent_rows(parent, row, key)
    return found if limit is None else found.limit(limit), found.agg(F.count(F.lit(1)).alias("row_count"))


def referenced_parents(child: DataFrame, parent: DataFrame, key: ResolvedKey) -> DataFrame:
    """Parent rows that at least one of many child rows refers to."""
    keys, targets = _key_columns(child, parent, key)
    refers = reduce(Column.__and__, [column(a).isNotNull() for a, _ in key.pairs])
    names = [f"__key{i}" for i in range(len(keys))]
    wanted = child.where(refers).select(*[k.alias(n) for k, n in zip(keys, names)]).distinct()
    same = [target == F.col(n) for target, n in zip(targets, names)]
    return parent.join(wanted, reduce(Column.__and__, same), "left_semi")


def contains_text(df: DataFrame, needle: str) -> Column:
    """Any column, as text, containing a string; case is ignored for ASCII letters only.

    The pattern is a literal, compiled once, and Java ignores the case of ASCII letters only
    unless it is told otherwise, so no value is copied to fold it.
    """
    quoted_needle = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pattern = F.lit(f"(?i){quoted_needle}")
    texts = []
    for field in df.schema.fields:
        value = column(field.name)
        if isinstance(field.dataType, T.VariantType):
            text = F.to_json(value)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            text = _decimal_text(value.cast("double"))
        else:
            text = value.cast("string")
        texts.append(F.coalesce(F.rlike(text, pattern), F.lit(False)))
    return reduce(Column.__or__, texts)


def _decimal_text(value: Column) -> Column:
    """A double as a person would type it, with a decimal point and no exponent; very large and very small ones, whose digits
    a decimal point would hide behind zeros, as Spark writes them."""
    plain = (F.abs(value) < 1e27) & (F.abs(value) >= 1e-6)
    exponent = value.cast("string").contains("E") & plain
    decimal = F.when(plain, value).cast("decimal(38,10)").cast("string")
    return F.when(exponent, F.regexp_replace(decimal, r"(\.\d+?)0+$", "$1")).otherwise(value.cast("string"))


def filtered(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the text in any column; blank text filters nothing."""
    return df.where(contains_text(df, needle)) if needle.strip() else df


def filtered_count(df: DataFrame, needle: str) -> DataFrame:
    return filtered(df, needle).agg(F.count(F.lit(1)).alias("row_count"))


def row_key(df: DataFrame, primary_key: Sequence[str] = ()) -> list[str]:
    """Columns that order rows reproducibly: the primary key, else all orderable columns."""
    return list(primary_key) or [f.name for f in df.schema.fields if orderable(f.dataType)]


def _page_order(df: DataFrame, sort: str | None, descending: bool, key: Sequence[str]) -> list[tuple[str, bool]]:
    order = [(sort, descending)] if sort else []
    return order + [(k, False) for k in row_key(df, key) if k != sort]


def sorted_page(
    df: DataFrame,
    page: int,
    sort: str | None = None,
    descending: bool = False,
    key: Sequence[str] = (),
    needle: str = "",
    size: int = PAGE,
) -> DataFrame:
    """A page of the filtered, sorted rows, ties broken by the row key."""
    order = [
        column(n).desc_nulls_last() if down else column(n).asc_nulls_first()
        for n, down in _page_order(df, sort, descending, key)
    ]
    return filtered(df, needle).orderBy(*order).offset(page * size).limit(size)


def next_page(
    df: DataFrame,
    after: Mapping[str, object],
    sort: str | None = None,
    descending: bool = False,
    key: Sequence[str] = (),
    needle: str = "",
    size: int = PAGE,
) -> DataFrame:
    """The page that follows a row, found by its sort and key values.

    Unlike an offset it does not sort and discard all earlier pages: each task keeps at
    most one page, however deep.
    """
    order = _page_order(df, sort, descending, key)
    past = F.lit(False)
    for name, down in reversed(order):
        value, last = column(name), after[name]
        equal = equals(df, name, last)
        if last is None:
            beyond = F.lit(False) if down else value.isNotNull()
        else:
            bound = literal(last, df.schema[name].dataType)
            beyond = (value < bound) | value.isNull() if down else value > bound
        past = beyond | (equal & past)
    columns = [column(n).desc_nulls_last() if down else column(n).asc_nulls_first() for n, down in order]
    return filtered(df, needle).where(_not_before(df, *order[0], after) & past).orderBy(*columns).limit(size)


def _not_before(df: DataFrame, name: str, down: bool, after: Mapping[str, object]) -> Column:
    """The first sort column alone: a plain range that the scan can skip files by."""
    value, last = column(name), after[name]
    if last is None:
        return value.isNull() if down else F.lit(True)
    bound = literal(last, df.schema[name].dataType)
    return (value <= bound) | value.isNull() if down else value >= bound
