"""Most frequent values from mergeable summaries, exact.

A summary per column names the values that may be frequent and bounds the count of all others: one scan whose
shuffle holds summaries only. A second scan counts the named values alone. A column's top values are certain when the last
of them is more frequent than the bound, or when the named values make up the column; columns that
leave a doubt (keys, flat distributions) are counted in full.

The summary keeps a counter per tracked value that is too high by at most what was ever taken from counters, so
no value outside the list is more frequent than the smallest count in it.

Texts and binaries beyond ``SHORT`` bytes are summarised and counted as digests, with the extremes of their length and of a second hash;
a digest that stands for several values leaves a doubt. Only top values are fetched as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.kinds import clean, value_class
from siftwell.functions.names import quoted
from siftwell.operators.frequency import SHORT, TOP_VALUES, bytewise, top_values, value_number, value_text

TRACKED = 4096  # values of a column in its summary
# Keys reach the driver, whose dates and times have fewer values than Spark's.
AS_KEY = {
    T.DateType: ("unix_date(value)", "date_from_unix_date(key)"),
    T.TimestampType: ("unix_micros(value)", "timestamp_micros(key)"),
    T.TimestampNTZType: ("CAST(value AS string)", "CAST(key AS timestamp_ntz)"),
}
TOP_FIELDS = "column string, rank int, value string, value_num double, value_count bigint"


def heavy_values(
    df: DataFrame, names: Sequence[str] | None = None, top: int = TOP_VALUES, tracked: int = TRACKED
) -> DataFrame:
    """Most frequent values per column with their rank, ties in value order: the rows of ``top_values``.

    Both scans run when this is called; ``top`` rows a column, and values that tie with the last, reach the driver.
    """
    found, doubtful = certain_values(df, names, top, tracked)
    rows = [(n, r, *v) for n, values in found.items() for r, v in enumerate(values, 1)]
    parts = [df.sparkSession.createDataFrame(rows, TOP_FIELDS)]
    if doubtful:
        parts.append(top_values(df, doubtful, top))
    return reduce(DataFrame.unionAll, parts)


def certain_values(
    df: DataFrame, names: Sequence[str] | None = None, top: int = TOP_VALUES, tracked: int = TRACKED
) -> tuple[dict[str, list[tuple[str, float | None, int]]], list[str]]:
    """Top values ``(value, number, count)`` of the columns that a summary decides, and the names of those that it does not."""
    names = list(df.columns if names is None else names)
    classes: dict[str, list[T.StructField]] = {}
    doubtful = []
    for field in df.schema.fields:
        kind = value_class(field.dataType) if field.name in names else None
        if kind is None or isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            continue  # never shown
        if isinstance(field.dataType, T.StringType) and not bytewise(field.dataType):
            doubtful.append(field.name)
        else:
            classes.setdefault(kind, []).append(field)
    found: dict[str, list[tuple[str, float | None, int]]] = {}
    for members in classes.values():
        rows, data_type = _keyed(df, members)
        counted = recount(rows, tracked).collect()
        by_name = {field.name: [r for r in counted if r["column"] == field.name] for field in members}
        sure = {n: _top(r, top) for n, r in by_name.items() if r and _certain(r, top)}
        doubtful += [n for n in by_name if n not in sure]
        found |= _shown(rows, sure, top, data_type)
    return found, doubtful


def _keyed(df: DataFrame, members: Sequence[T.StructField]) -> tuple[DataFrame, T.DataType]:
    """column, value, key of the non-null values of one type class, and the type of ``value``."""
    binary = isinstance(members[0].dataType, T.BinaryType)
    values = [f"hex({quoted(f.name)})" if binary else clean(f.name, f.dataType) for f in members]
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.expr(v).alias("value")) for f, v in zip(members, values)]))
    rows = df.select(each.alias("x")).where("x.value IS NOT NULL").select("x.column", "x.value")
    data_type = rows.schema["value"].dataType
    if isinstance(data_type, T.StringType):
        # One byte longer than any text that is its own key.
        long = F.concat(F.lit("#"), F.sha2(F.col("value").cast("binary"), 256))
        return rows.withColumn("key", F.when(F.octet_length("value") > SHORT, long).otherwise(F.col("value"))), data_type
    return rows.withColumn("key", F.expr(AS_KEY.get(type(data_type), ("value",))[0])), data_type


def recount(rows: DataFrame, tracked: int) -> DataFrame:
    """column, key, n, filled, bound, alike: exact counts of the values that the summaries name.

    ``filled`` counts the column's values, ``bound`` is the most that any other value can count, ``alike`` tells that a key stands for one value.
    A column whose summary names nothing has no row.
    """
    text = isinstance(rows.schema["value"].dataType, T.StringType)
    summary = rows.groupBy("column").agg(
        F.expr(f"approx_top_k(key, {tracked}, {tracked})").alias("items"), F.count(F.lit(1)).alias("filled")
    )
    bound = F.array_min(F.transform("items", lambda i: i["count"]))
    # At most ``tracked`` rows a column, of short keys.
    named = summary.select("column", "filled", bound.alias("bound"), F.explode("items.item").alias("key"))
    size, check = (F.octet_length("value"), F.xxhash64("value")) if text else (F.lit(0), F.lit(0))
    alike = (F.min("size") == F.max("size")) & (F.min("check") == F.max("check"))
    return (
        rows.select("column", "key", size.alias("size"), check.alias("check"))
        .join(F.broadcast(named), ["column", "key"])
        .groupBy("column", "key", "filled", "bound")
        .agg(F.count(F.lit(1)).alias("n"), alike.alias("alike"))
    )


def _certain(rows: Sequence, top: int) -> bool:
    if not all(r["alike"] for r in rows):
        return False
    counts = sorted((r["n"] for r in rows), reverse=True)
    return sum(counts) == rows[0]["filled"] or (len(counts) >= top and counts[top - 1] > rows[0]["bound"])


def _top(rows: Sequence, top: int) -> list[tuple[object, int]]:
    """Keys and counts of the top values, with all that tie with the last."""
    least = sorted((r["n"] for r in rows), reverse=True)[: max(top, 1)][-1]
    return [(r["key"], r["n"]) for r in rows if r["n"] >= least]


def _shown(rows: DataFrame, sure: dict, top: int, data_type: T.DataType) -> dict[str, list[tuple[str, float | None, int]]]:
    """The top values of each column as the profile shows them; long texts are fetched by their digests."""
    keys = [(name, key, n) for name, values in sure.items() for key, n in values]
    if not keys:
        return {}
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("column", T.StringType()), rows.schema["key"], T.StructField("n", T.LongType())])
    wanted = spark.createDataFrame(keys, schema)
    if isinstance(data_type, T.StringType):
        long = [(name, key) for name, key, _ in keys if len(key.encode()) > SHORT]
        whole = wanted.where(F.octet_length("key") <= SHORT).withColumn("value", F.col("key"))
        if long:
            digests = F.broadcast(spark.createDataFrame(long, "column string, key string"))
            fetched = rows.where(F.octet_length("value") > SHORT).join(digests, ["column", "key"]).groupBy("column", "key").agg(F.any_value("value").alias("value"))
            whole = whole.unionAll(wanted.join(fetched, ["column", "key"]).select("column", "key", "n", "value"))
    else:
        whole = wanted.withColumn("value", F.expr(AS_KEY.get(type(data_type), ("", "key"))[1]))
    ranked = whole.selectExpr("*", "row_number() OVER (PARTITION BY `column` ORDER BY n DESC, value ASC) AS rank").where(f"rank <= {top}")
    shown = ranked.selectExpr("`column`", "rank", f"{value_text('value', data_type)} AS value", f"{value_number('value', data_type)} AS number", "n")
    found: dict[str, list[tuple[str, float | None, int]]] = {}
    for row in sorted(shown.collect(), key=lambda r: (r["column"], r["rank"])):
        found.setdefault(row["column"], []).append((row["value"], row["number"], row["n"]))
    return found
