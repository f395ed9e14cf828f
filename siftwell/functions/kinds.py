"""Semantic kinds of columns and lexical types of values.

A column has one of eight kinds: integer, real, text, blob, date, datetime, boolean and
unknown. Spark columns are statically typed, so the kind starts from the ``DataType``;
the *values* then refine it (text that is all ISO dates, integers that are only 0 and 1).

``type_bit`` is the per-value counterpart for text columns. Spark has no per-value storage
class, so a text value is classed by how it reads: integer, real, boolean, date (with or
without time) or text. OR-ing the bits over a column gives, in one aggregate and without a
distinct count, both how many types the column mixes and whether it is all dates.

Expressions are SQL text over the text of their operands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.iso import has_time_part, looks_like_date
from siftwell.functions.names import quoted

# Lexical patterns, tried in this order; anything else is text.
INTEGER_TEXT = r"^[+-]?\d+$"
REAL_TEXT = r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?$"
FIRST_CHARACTERS = ("+", ":")  # signs, the point and digits lie from the first up to the second

INTEGER_BIT = 1
REAL_BIT = 2
BOOLEAN_BIT = 4
DATE_BIT = 8
DATETIME_BIT = 16
TEXT_BIT = 32
# only inside VARIANT columns
ARRAY_BIT = 64
OBJECT_BIT = 128
OTHER_BIT = 256

NUMERIC_KINDS = ("integer", "real")
DATE_KINDS = ("date", "datetime")


def kind_of_type(data_type: T.DataType) -> str:
    """Kind of a column by its Spark type, before values refine it."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.DecimalType):
        return "integer" if data_type.scale == 0 else "real"
    if isinstance(data_type, T.FractionalType):
        return "real"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.BinaryType):
        return "blob"
    return "unknown"


def declared_kind(declared: Column) -> Column:
    """Kind a declared type name stands for; the first matching word decides."""
    name = F.upper(F.coalesce(declared, F.lit("")))
    # Words looked for in a declared type, in order of precedence.
    rules = (
        ("boolean", ("BOOL",)),
        ("datetime", ("DATETIME", "TIMESTAMP")),
        ("date", ("DATE", "TIME")),
        ("integer", ("INT",)),
        ("text", ("CHAR", "CLOB", "TEXT")),
        ("blob", ("BLOB",)),
        ("real", ("REAL", "FLOA", "DOUB")),
    )
    kind = F.lit("unknown")
    for result, words in reversed(rules):
        kind = F.when(name.rlike("|".join(words)), F.lit(result)).otherwise(kind)
    return kind


# Kinds that a declared type may give to a column of a Spark type; others do not fit its values.
FITTING_KINDS = {
    "integer": ("integer", "real", "boolean"),
    "real": ("real",),
    "boolean": ("boolean",),
    "date": ("date", "datetime"),
    "datetime": ("date", "datetime"),
    "text": ("text", "blob"),
    "blob": ("blob",),
}


def fitting_kind(kind: str, declared: str | None) -> str:
    """Kind of a column: that of its declared type where the values can be taken so, else that of its Spark type."""
    return declared if declared in FITTING_KINDS.get(kind, ()) else kind


def _lexical_type(value: str, integer, real, date, boolean, text) -> str:
    # Patterns are only tried on values whose first character or length allows a match.
    return (
        f"CASE WHEN {value} IS NULL THEN NULL "
        f"WHEN {value} >= '{FIRST_CHARACTERS[0]}' AND {value} < '{FIRST_CHARACTERS[1]}' THEN "
        f"CASE WHEN {value} RLIKE r'{INTEGER_TEXT}' THEN {integer} "
        f"WHEN {value} RLIKE r'{REAL_TEXT}' THEN {real} "
        f"WHEN {looks_like_date(value)} THEN {date} ELSE {text} END "
        f"WHEN octet_length({value}) IN (4, 5) AND lower({value}) IN ('true', 'false') THEN {boolean} "
        f"ELSE {text} END"
    )


def type_bit(value: str) -> str:
    """Bit of the lexical type of a text value, NULL for NULL."""
    date = f"if({has_time_part(value)}, {DATETIME_BIT}, {DATE_BIT})"
    return _lexical_type(value, INTEGER_BIT, REAL_BIT, date, BOOLEAN_BIT, TEXT_BIT)


def variant_type_bit(value: str) -> str:
    """Bit of the type of a VARIANT value; NULL for NULL and for a JSON null."""
    schema = f"schema_of_variant({value})"
    return (
        f"CASE WHEN {value} IS NULL OR {schema} = 'VOID' THEN NULL "
        f"WHEN {schema} IN ('TINYINT', 'SMALLINT', 'INT', 'BIGINT') OR {schema} RLIKE r'^DECIMAL\\(\\d+,0\\)$' THEN {INTEGER_BIT} "
        f"WHEN {schema} IN ('FLOAT', 'DOUBLE') OR startswith({schema}, 'DECIMAL') THEN {REAL_BIT} "
        f"WHEN {schema} = 'STRING' THEN {TEXT_BIT} WHEN {schema} = 'BOOLEAN' THEN {BOOLEAN_BIT} "
        f"WHEN startswith({schema}, 'DATE') THEN {DATE_BIT} WHEN startswith({schema}, 'TIMESTAMP') THEN {DATETIME_BIT} "
        f"WHEN startswith({schema}, 'ARRAY') THEN {ARRAY_BIT} WHEN startswith({schema}, 'OBJECT') THEN {OBJECT_BIT} "
        f"ELSE {OTHER_BIT} END"
    )


def type_name(value: str) -> str:
    """Name of the lexical type of a text value; dates with and without time are one."""
    return _lexical_type(value, "'integer'", "'real'", "'date'", "'boolean'", "'text'")


def type_count(mask: str) -> str:
    """Number of types in an OR of ``type_bit``; both date bits are one type."""
    others = INTEGER_BIT | REAL_BIT | BOOLEAN_BIT | TEXT_BIT | ARRAY_BIT | OBJECT_BIT | OTHER_BIT
    dates = DATE_BIT | DATETIME_BIT
    return f"coalesce(if({mask} & {dates} != 0, 1, 0) + bit_count({mask} & {others}), 0)"


def text_kind(mask: str) -> str:
    """text, or date/datetime when every value of the column looks like a date."""
    only_dates = f"{mask} & {DATE_BIT | DATETIME_BIT} = {mask}"
    return (
        f"CASE WHEN {only_dates} AND {mask} & {DATETIME_BIT} != 0 THEN 'datetime' "
        f"WHEN {only_dates} THEN 'date' ELSE 'text' END"
    )


def untyped_kind(mask: str) -> str:
    """Kind of a column without a declared type, from the types of all its values."""
    return (
        f"CASE WHEN {mask} IS NULL THEN 'unknown' WHEN {mask} = {INTEGER_BIT} THEN 'integer' "
        f"WHEN {mask} & {INTEGER_BIT | REAL_BIT} = {mask} THEN 'real' ELSE {text_kind(mask)} END"
    )


def clean(name: str, data_type: T.DataType) -> str:
    """A column's value as the profile counts it.

    NaN counts as NULL and ``-0.0`` as ``0.0``; integral types widen to BIGINT and floating
    ones to DOUBLE so columns of one class can share an unpivot.
    """
    value = quoted(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        number = f"CAST({value} AS double)"
        return f"if(isnan({number}), NULL, {number} + 0.0D)"
    if isinstance(data_type, T.IntegralType):
        return f"CAST({value} AS bigint)"
    if isinstance(data_type, (T.CharType, T.VarcharType)):
        return f"CAST({value} AS string)"
    return value


def value_class(data_type: T.DataType) -> str | None:
    """Type in which a column enters the frequency table; NULL when it cannot be grouped."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(
        data_type,
        (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType),
    ):
        return data_type.simpleString()
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)) and not _holds(data_type, (T.VariantType,)):
        return data_type.simpleString()
    return None


def orderable(data_type: T.DataType) -> bool:
    """Whether values of a type can be sorted and hashed; maps can be grouped, but not that."""
    return value_class(data_type) is not None and not _holds(data_type, (T.MapType,))


def _holds(data_type: T.DataType, classes) -> bool:
    if isinstance(data_type, classes):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds(data_type.elementType, classes)
    if isinstance(data_type, T.StructType):
        return any(_holds(f.dataType, classes) for f in data_type.fields)
    if isinstance(data_type, T.MapType):
        return _holds(data_type.keyType, classes) or _holds(data_type.valueType, classes)
    return False
