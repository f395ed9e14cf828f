"""Types of values inside text, JSON and untyped columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.kinds import INTEGER_BIT, REAL_BIT, type_bit, type_name, untyped_kind
from siftwell.functions.names import column, quoted

MOST_DIGITS = 18  # that surely fit into BIGINT


def text_value_types(df: DataFrame, name: str) -> DataFrame:
    """How many non-null values of a text column read as each type."""
    value = column(name)
    return (
        df.where(value.isNotNull())
        .groupBy(F.expr(type_name(quoted(name))).alias("value_type"))
        .agg(F.count(F.lit(1)).alias("value_count"))
    )


def json_type_name(variant: Column) -> Column:
    """Coarse type of a VARIANT value: its exact schema differs between 1.5 and 1.5e300."""
    schema = F.schema_of_variant(variant)
    return (
        F.when(schema == "VOID", F.lit("null"))
        .when(schema.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | schema.rlike(r"^DECIMAL\(\d+,0\)$"), F.lit("integer"))
        .when(schema.isin("FLOAT", "DOUBLE") | schema.startswith("DECIMAL"), F.lit("real"))
        .when(schema == "STRING", F.lit("text"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .when(schema.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lower(schema))
    )


def json_value_types(df: DataFrame, name: str, path: str) -> DataFrame:
    """How many values at a path of a JSON column are of each JSON type.

    A missing path, a JSON null and text that is not JSON are no value.
    """
    document = column(name)
    if not isinstance(df.schema[name].dataType, T.VariantType):
        document = F.try_parse_json(document)
    value_type = json_type_name(F.try_variant_get(document, path, "variant"))
    return (
        df.select(value_type.alias("value_type"))
        .where(F.col("value_type").isNotNull() & (F.col("value_type") != "null"))
        .groupBy("value_type")
        .agg(F.count(F.lit(1)).alias("value_count"))
    )


def untyped_kinds(df: DataFrame) -> DataFrame:
    """Kind of every text column judged by all its values, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    masks = [F.expr(f"bit_or({type_bit(quoted(n))})").alias(f"m{i}") for i, n in enumerate(names)]
    rows = [
        F.struct(F.lit(n).alias("column"), F.expr(untyped_kind(f"m{i}")).alias("kind")) for i, n in enumerate(names)
    ]
    return df.agg(*masks).select(F.inline(F.array(*rows)))


def cast_untyped(df: DataFrame) -> DataFrame:
    """The frame with text columns that hold only numbers cast to BIGINT or DOUBLE.

    Dates stay text: the profile recognises them by their values. Whole numbers too long
    for BIGINT become DECIMAL(38,0), longer ones stay text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    kinds = {row["column"]: row["kind"] for row in untyped_kinds(df).collect()}
    return cast_kinds(df, kinds)


def number_kind(mask: int | None) -> str | None:
    """integer or real where an OR of ``type_bit`` tells that all values of a column are numbers."""
    if not mask or mask & ~(INTEGER_BIT | REAL_BIT):
        return None
    return "integer" if mask == INTEGER_BIT else "real"


def cast_kinds(df: DataFrame, kinds: dict[str, str | None], lengths: dict[str, int] | None = None) -> DataFrame:
    """The frame with its text columns of kind integer and real cast.

    Where the longest text of a column (``lengths``) may be too long for BIGINT, its digits are counted by a scan.
    """
    integers = [n for n, k in kinds.items() if k == "integer" and (lengths or {}).get(n, MOST_DIGITS + 1) > MOST_DIGITS]
    widest = (
        df.agg(*[F.max(F.length(F.regexp_replace(column(n), "^[+-]?0*", ""))).alias(f"w{i}") for i, n in enumerate(integers)]).first()
        if integers
        else ()
    )
    digits = dict(zip(integers, widest))
    selected = []
    for field in df.schema.fields:
        value = column(field.name)
        kind = kinds.get(field.name)
        if kind == "integer":
            found = digits.get(field.name, MOST_DIGITS)
            value = value.cast("bigint" if found <= MOST_DIGITS else "decimal(38,0)" if found <= 38 else "string")
        elif kind == "real":
            value = value.cast("double")
        selected.append(value.alias(field.name))
    return df.select(*selected)
