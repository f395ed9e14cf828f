"""Frequencies of values: distinct counts and the most frequent values of many columns.

Columns of one type class are unpivoted to ``(column, value)`` and counted together, with
values in their own type (as text, 10 would sort before 9). Counting starts before the
shuffle, and the shuffle is keyed by column *and* value, so neither a hot value nor a
column of few values ends up in one task. The per-column totals and the top values read
the same shuffle: Spark reuses the exchange. Totals can be split by the bins of a histogram,
which then needs no scan: a value is binned once, however many rows hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.kinds import clean, value_class
from siftwell.functions.labels import plain_number
from siftwell.functions.names import column, quoted
from siftwell.operators.histogram import DateBuckets, NumericBins, bin_of

TOP_VALUES = 12
SHORT = 64  # bytes of a text that is shuffled as it is

SUMMARY_FIELDS = {
    "ordinal": "int",
    "rank": "int",
    "value": "string",
    "value_num": "double",
    "value_count": "bigint",
    "distinct_count": "bigint",
    "bin": "int",
}


def value_text(value: str, data_type: T.DataType) -> str:
    """A value as the profile shows it."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return plain_number(value)
    if isinstance(data_type, T.BinaryType):
        return f"hex({value})"
    return f"CAST({value} AS string)"


def value_number(value: str, data_type: T.DataType) -> str:
    return f"CAST({value if isinstance(data_type, (T.NumericType, T.BooleanType)) else 'NULL'} AS double)"


def frequency_tables(df: DataFrame, names: Iterable[str] | None = None) -> list[tuple[T.DataType, DataFrame]]:
    """Value counts ``(ordinal, value, n)`` of the columns, one frame per type class.

    Nulls are not values. Columns that cannot be grouped (variants) are left out.
    """
    wanted = set(df.columns if names is None else names)
    classes: dict[str, list[tuple[int, T.StructField]]] = {}
    for ordinal, field in enumerate(df.schema.fields):
        kind = value_class(field.dataType)
        if kind is not None and field.name in wanted:
            classes.setdefault(kind, []).append((ordinal, field))
    return [_class_frequencies(df, members) for members in classes.values()]


def _class_frequencies(df: DataFrame, members) -> tuple[T.DataType, DataFrame]:
    projected = df.selectExpr(*[f"{clean(f.name, f.dataType)} AS `{ordinal}`" for ordinal, f in members])
    data_type = projected.schema.fields[0].dataType
    if len(members) == 1:
        ordinal = members[0][0]
        long = projected.selectExpr(f"'{ordinal}' AS ordinal", f"`{ordinal}` AS value")
    else:
        long = projected.unpivot([], [quoted(c) for c in projected.columns], "ordinal", "value")
    return data_type, long.where("value IS NOT NULL").groupBy("ordinal", "value").agg(F.expr("count(1) AS n"))


def frequency_summary(
    df: DataFrame,
    names: Iterable[str] | None = None,
    unique: Iterable[str] = (),
    top: int = TOP_VALUES,
    bins: Iterable[NumericBins | DateBuckets] = (),
) -> DataFrame:
    """Distinct count and top values of the columns, and histograms of those in ``bins``.

    One row per column with rank 0 carries ``distinct_count``, for columns in ``bins`` one per bin
    that has values (and one without a bin for dates that do not parse); ``value_count`` are its rows.
    Ranks 1 … ``top`` are the most frequent values, ties in value order. Columns declared ``unique`` are not
    grouped: their first values in order have count 1 and their distinct count is their
    non-null count, which the caller already has (no rank 0 row).
    """
    names = list(df.columns if names is None else names)
    unique = set(unique)
    specs = {spec.name: spec for spec in bins}
    parts = []
    for data_type, counted in frequency_tables(df, [n for n in names if n not in unique]):
        parts.append(
            _binned(df, counted, data_type, specs).selectExpr(
                "CAST(ordinal AS int) AS ordinal",
                "0 AS rank",
                "CAST(NULL AS string) AS value",
                "CAST(NULL AS double) AS value_num",
                "n AS value_count",
                "distinct_count",
                "bin",
            )
        )
        if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
            continue  # counted, never shown
        ranked = counted.selectExpr(
            "*", "row_number() OVER (PARTITION BY ordinal ORDER BY n DESC, value ASC) AS rank"
        ).where(f"rank <= {top}")
        parts.append(_top_rows(ranked, data_type))
    for name in names:
        if name in unique:
            parts.append(_first_values(df, name, top))
    if not parts:
        schema = ", ".join(f"{n} {t}" for n, t in SUMMARY_FIELDS.items())
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


def _top_rows(ranked: DataFrame, data_type: T.DataType) -> DataFrame:
    return ranked.selectExpr(
        "CAST(ordinal AS int) AS ordinal",
        "CAST(rank AS int) AS rank",
        f"{value_text('value', data_type)} AS value",
        f"{value_number('value', data_type)} AS value_num",
        "n AS value_count",
        "CAST(NULL AS bigint) AS distinct_count",
        "CAST(NULL AS int) AS bin",
    )


def _binned(df: DataFrame, counted: DataFrame, data_type: T.DataType, specs: Mapping[str, NumericBins | DateBuckets]) -> DataFrame:
    """ordinal, bin, n, distinct_count of counted values; the bin of columns without a histogram is NULL."""
    index = F.lit(None).cast("int")
    for ordinal, field in enumerate(df.schema.fields):
        if field.name in specs and value_class(field.dataType) == value_class(data_type):
            index = F.when(F.col("ordinal") == str(ordinal), bin_of("value", field.dataType, specs[field.name])).otherwise(index)
    # The sum keeps ``n`` alive here so that this and the top values share one exchange.
    return counted.groupBy("ordinal", index.alias("bin")).agg(F.expr("sum(n) AS n"), F.expr("count(1) AS distinct_count"))


def bin_values(df: DataFrame, specs: Sequence[NumericBins | DateBuckets]) -> DataFrame:
    """column, bin, count, distinct_count: rows and different values in each bin that has any, from counted values."""
    labels = F.create_map(*[x for i, n in enumerate(df.columns) for x in (F.lit(str(i)), F.lit(n))])
    wanted = {spec.name: spec for spec in specs}
    parts = [_binned(df, counted, data_type, wanted) for data_type, counted in frequency_tables(df, wanted)]
    found = reduce(DataFrame.unionAll, parts).where("bin IS NOT NULL")
    return found.select(labels[F.col("ordinal")].alias("column"), "bin", F.col("n").alias("count"), "distinct_count")


def _first_values(df: DataFrame, name: str, top: int) -> DataFrame:
    """First values in order of a unique column: a bounded heap per task, no grouping."""
    value = clean(name, df.schema[name].dataType)
    first = df.selectExpr(f"{value} AS value").where("value IS NOT NULL").orderBy("value").limit(top)
    ranked = first.selectExpr(
        f"{df.columns.index(name)} AS ordinal",
        "value",
        "1L AS n",
        "row_number() OVER (ORDER BY value) AS rank",  # over at most ``top`` rows
    )
    return _top_rows(ranked, first.schema["value"].dataType)


def _digest(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def distinct_counts(
    df: DataFrame,
    names: Sequence[str] | None = None,
    unique: Iterable[str] = (),
    short: int = SHORT,
    digest: Callable[[Column], Column] = _digest,
) -> DataFrame:
    """Exact distinct non-null values per column; unique columns are counted, not grouped.

    Texts and binaries of more than ``short`` bytes are shuffled as a digest with their length and a second hash, whatever their
    length. Where one digest comes with several lengths or second hashes, the values themselves are compared.
    """
    names = list(df.columns if names is None else names)
    unique = [n for n in names if n in set(unique)]
    labels = F.create_map(*[x for i, n in enumerate(df.columns) for x in (F.lit(str(i)), F.lit(n))])
    grouped = [n for n in names if n not in unique]
    long = [n for n in grouped if isinstance(df.schema[n].dataType, (T.StringType, T.BinaryType)) and bytewise(df.schema[n].dataType)]
    parts = [
        counted.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
        for _, counted in frequency_tables(df, [n for n in grouped if n not in long])
    ]
    if long:
        parts.append(_long_distinct(df, long, short, digest))
    parts += [
        df.selectExpr(f"count({clean(n, df.schema[n].dataType)}) AS distinct_count").selectExpr(
            f"'{df.columns.index(n)}' AS ordinal", "distinct_count"
        )
        for n in unique
    ]
    return reduce(DataFrame.unionAll, parts).select(labels[F.col("ordinal")].alias("column"), "distinct_count")


def bytewise(data_type: T.DataType) -> bool:
    """Whether values are equal only if their bytes are; other collations are grouped as values."""
    return not isinstance(data_type, T.StringType) or getattr(data_type, "collation", "UTF8_BINARY") == "UTF8_BINARY"


def _long_distinct(df: DataFrame, names: Sequence[str], short: int, digest: Callable[[Column], Column]) -> DataFrame:
    """ordinal, distinct_count of text and binary columns, by values up to ``short`` bytes and by digests beyond."""
    each = F.explode(F.array(*[F.struct(F.lit(str(df.columns.index(n))).alias("ordinal"), column(n).cast("binary").alias("value")) for n in names]))
    rows = df.select(each.alias("x")).where("x.value IS NOT NULL").select("x.ordinal", "x.value")
    beyond = F.octet_length("value") > short
    keyed = rows.select(
        "ordinal",
        F.when(~beyond, F.col("value")).alias("own"),
        F.when(beyond, digest(F.col("value"))).alias("digest"),
        F.when(beyond, F.octet_length("value")).alias("size"),
        F.when(beyond, F.xxhash64("value")).alias("check"),
        "value",
    )
    kinds = keyed.groupBy("ordinal", "own", "digest", "size", "check").agg(F.count(F.lit(1)).alias("n"))
    # digests with several lengths or second hashes: few, if any
    repeated = kinds.where("digest IS NOT NULL").groupBy("ordinal", "digest").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    same = [F.col("ordinal") == F.col("r_ordinal"), F.col("digest") == F.col("r_digest")]
    again = repeated.select(F.col("ordinal").alias("r_ordinal"), F.col("digest").alias("r_digest"))
    alone = kinds.join(again, same, "left_anti").groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    compared = keyed.where("digest IS NOT NULL").join(again, same, "left_semi").select("ordinal", "value").distinct()
    compared = compared.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
    # a column without values has no row, as elsewhere
    return alone.unionAll(compared).groupBy("ordinal").agg(F.sum("n").alias("distinct_count"))


def repeated_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, to check a declared key; keys with a NULL are skipped."""
    keys = [quoted(n) for n in names]
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return df.where(present).groupBy(*keys).agg(F.expr("count(1) AS row_count")).where("row_count > 1")


def top_values(
    df: DataFrame, names: Sequence[str] | None = None, top: int = TOP_VALUES, unique: Iterable[str] = ()
) -> DataFrame:
    """Most frequent values per column with their rank, ties in value order."""
    labels = F.create_map(*[x for i, n in enumerate(df.columns) for x in (F.lit(i), F.lit(n))])
    return (
        frequency_summary(df, names, unique, top)
        .where(F.col("rank") > 0)
        .select(labels[F.col("ordinal")].alias("column"), "rank", "value", "value_num", "value_count")
    )


def most_frequent(df: DataFrame, name: str, top: int = 30) -> DataFrame:
    """The most frequent non-null values of one column, in their own type."""
    value = clean(name, df.schema[name].dataType)
    return (
        df.selectExpr(f"{value} AS value")
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("value_count"))
        .orderBy(F.desc("value_count"), F.asc("value"))
        .limit(top)
    )
