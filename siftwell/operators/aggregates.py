"""Exact per-column aggregates of a whole table.

Every figure that does not need the distinct values comes from one ungrouped aggregate:
partial per task, one small row per task to the final step. The row is of fixed width
whatever the columns hold: of text the lengths are kept (the profile shows extremes of
text only when it holds dates, see ``text_extremes``), and whether a column of text, binary
or nested values is constant is told from hashes.

Numbers and dates are aggregated apart from text, and very wide tables are cut into groups, so
the generated code stays small enough to be compiled; each group reads only its own
columns, so the bytes scanned do not grow. Several text columns are unpivoted and aggregated by
one short piece of code, in one scan however many they are; each task sends a row per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.kinds import clean, kind_of_type, orderable, type_bit, variant_type_bit
from siftwell.functions.labels import plain_number
from siftwell.functions.names import quoted

FIXED_WIDTH = ("integer", "real", "date", "datetime", "boolean")
FIXED_GROUP = 24
OTHER_GROUP = 24
SEVERAL_TEXTS = 3
SKETCH_BITS = 12  # 2^12 registers: a relative error of about 1.6 %

# Result columns and their types, one row per profiled column.
AGGREGATE_FIELDS = {
    "ordinal": "int",
    "column": "string",
    "row_count": "bigint",
    "count": "bigint",
    "type_mask": "int",
    "min_text": "string",
    "max_text": "string",
    "one_value": "boolean",
    "min_num": "double",
    "max_num": "double",
    "avg": "double",
    "min_len": "int",
    "max_len": "int",
    "sketch": "bigint",
}


def text_literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_aggregates(df: DataFrame, sketch: bool = False) -> DataFrame:
    """Row count, non-null count, range, mean, text lengths and value types per column.

    ``sketch`` adds an estimated distinct count, from sketches that merge like the rest.
    """
    fields = list(enumerate(df.schema.fields))
    if not fields:
        raise ValueError("a table without columns has no profile")
    fixed = [f for f in fields if kind_of_type(f[1].dataType) in FIXED_WIDTH]
    other = [f for f in fields if f not in fixed]
    texts = [f for f in other if kind_of_type(f[1].dataType) == "text"]
    parts = []
    if len(texts) >= SEVERAL_TEXTS:
        other = [f for f in other if f not in texts]
        parts.append(_aggregate_texts(df, texts, sketch))
    groups = [fixed[i : i + FIXED_GROUP] for i in range(0, len(fixed), FIXED_GROUP)]
    groups += [other[i : i + OTHER_GROUP] for i in range(0, len(other), OTHER_GROUP)]
    return reduce(DataFrame.unionAll, [*(_aggregate_group(df, group, sketch) for group in groups), *parts])


def sketched(value: str, data_type: T.DataType) -> str:
    """An estimate of the distinct values: one binary sketch per task, of hashes."""
    return f"hll_sketch_estimate(hll_sketch_agg(if({value} IS NULL, NULL, xxhash64({value})), {SKETCH_BITS}))"


def _aggregate_texts(df: DataFrame, fields, sketch: bool) -> DataFrame:
    """The aggregates of text columns from one scan of (ordinal, value) pairs."""
    projected = df.selectExpr(*[f"{clean(f.name, f.dataType)} AS `{ordinal}`" for ordinal, f in fields])
    long = projected.unpivot([], [quoted(c) for c in projected.columns], "ordinal", "value")
    value = T.StructField("value", T.StringType())
    measures = _measures(value, sketch)
    found = long.groupBy("ordinal").agg(F.expr("count(1) AS rows"), *[F.expr(f"{m} AS {name}_0") for name, m in measures.items()])
    # a column is there even where no row is
    names = F.create_map(*[x for ordinal, f in fields for x in (F.lit(str(ordinal)), F.lit(f.name))])
    known = df.sparkSession.range(1).select(F.explode(names).alias("own", "name"))
    row = {**_long_row(0, value, measures), "ordinal": "own", "column": "name", "row_count": "coalesce(rows, 0)", "count": "coalesce(count_0, 0)"}
    return known.join(found, F.col("own") == F.col("ordinal"), "left").selectExpr(
        *[f"CAST({row[name]} AS {t}) AS `{name}`" for name, t in AGGREGATE_FIELDS.items()]
    )


def _aggregate_group(df: DataFrame, fields, sketch: bool) -> DataFrame:
    plans = [(ordinal, field, _measures(field, sketch)) for ordinal, field in fields]
    measures = [f"{m} AS {name}_{ordinal}" for ordinal, _, ms in plans for name, m in ms.items()]
    row = df.selectExpr("count(1) AS rows", *measures)
    return long_rows(row, [_long_row(ordinal, field, ms) for ordinal, field, ms in plans], AGGREGATE_FIELDS)


def long_rows(row: DataFrame, rows: list[dict[str, str]], fields: dict[str, str]) -> DataFrame:
    """A one-row aggregate as one row per column; ``rows`` gives the expressions of each."""
    structs = [
        "struct(" + ", ".join(f"CAST({values[name]} AS {t}) AS `{name}`" for name, t in fields.items()) + ")"
        for values in rows
    ]
    return row.select(F.expr(f"inline(array({', '.join(structs)}))"))


def _measures(field: T.StructField, sketch: bool) -> dict[str, str]:
    """The aggregates a column needs, by its type."""
    value = clean(field.name, field.dataType)
    measures = {"count": f"count({value})"}
    if sketch and orderable(field.dataType):
        measures["sketch"] = sketched(value, field.dataType)
    kind = kind_of_type(field.dataType)
    if kind == "boolean":
        return measures | {"min": f"min(CAST({value} AS int))", "max": f"max(CAST({value} AS int))"}
    if kind in FIXED_WIDTH:
        measures |= {"min": f"min({value})", "max": f"max({value})"}
    elif orderable(field.dataType):
        hashed = f"if({value} IS NULL, NULL, xxhash64({value}))"
        measures |= {"min_hash": f"min({hashed})", "max_hash": f"max({hashed})"}
    if kind in ("integer", "real"):
        measures["avg"] = f"avg(CAST({value} AS double))"
    elif kind == "text":
        measures |= {
            "min_len": f"min(length({value}))",
            "max_len": f"max(length({value}))",
            "mask": f"bit_or({type_bit(value)})",
        }
    elif isinstance(field.dataType, T.VariantType):
        measures["mask"] = f"bit_or({variant_type_bit(value)})"
    return measures


def _long_row(ordinal: int, field: T.StructField, measures: dict[str, str]) -> dict[str, str]:
    def ref(name: str) -> str:
        return f"{name}_{ordinal}" if name in measures else "NULL"

    numeric = kind_of_type(field.dataType) in ("integer", "real", "boolean")
    low, high = ref("min"), ref("max")
    texts = low, high
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        texts = plain_number(low), plain_number(high)
    if isinstance(field.dataType, (T.MapType, T.VariantType)):
        one_value = "NULL"
    elif "min_hash" in measures:
        one_value = f"{ref('min_hash')} = {ref('max_hash')}"
        if "min_len" in measures:
            one_value += f" AND {ref('min_len')} = {ref('max_len')}"
    else:
        one_value = f"{low} = {high}"
    return {
        "ordinal": str(ordinal),
        "column": text_literal(field.name),
        "row_count": "rows",
        "count": ref("count"),
        "type_mask": ref("mask"),
        "min_text": texts[0],
        "max_text": texts[1],
        "one_value": one_value,
        "min_num": low if numeric else "NULL",
        "max_num": high if numeric else "NULL",
        "avg": ref("avg"),
        "min_len": ref("min_len"),
        "max_len": ref("max_len"),
        "sketch": ref("sketch"),
    }


def text_extremes(df: DataFrame, ordinals: list[int]) -> DataFrame:
    """First and last value in text order of some text columns, as ``min_<n>``, ``max_<n>``."""
    names = {o: quoted(df.columns[o]) for o in ordinals}
    return df.selectExpr(*[f"{side}({name}) AS {side}_{o}" for o, name in names.items() for side in ("min", "max")])


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, non-null values, nulls and null fraction of every column."""
    fields = df.schema.fields
    counts = [f"count({clean(f.name, f.dataType)}) AS c{i}" for i, f in enumerate(fields)]
    rows = [
        {
            "column": text_literal(f.name),
            "row_count": "rows",
            "count": f"c{i}",
            "null_count": f"rows - c{i}",
            "null_fraction": f"CASE WHEN rows > 0 THEN (rows - c{i}) / rows ELSE 0 END",
        }
        for i, f in enumerate(fields)
    ]
    types = {"column": "string", "row_count": "bigint", "count": "bigint", "null_count": "bigint", "null_fraction": "double"}
    return long_rows(df.selectExpr("count(1) AS rows", *counts), rows, types)


def approx_distinct(df: DataFrame) -> DataFrame:
    """Estimated distinct non-null values of every column that can be hashed.

    HyperLogLog sketches merge from task to task; nothing is grouped or shuffled but one
    sketch per task and column.
    """
    fields = [f for f in df.schema.fields if orderable(f.dataType)]
    sketches = [f"{sketched(clean(f.name, f.dataType), f.dataType)} AS d{i}" for i, f in enumerate(fields)]
    rows = [{"column": text_literal(f.name), "distinct_count": f"d{i}"} for i, f in enumerate(fields)]
    return long_rows(df.selectExpr(*sketches), rows, {"column": "string", "distinct_count": "bigint"})
