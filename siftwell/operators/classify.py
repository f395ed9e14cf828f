"""Kind, chart, kept detail and interest of every column, from its aggregates.

The input is the facts frame: one row per column with exact or sampled aggregates. Only
column expressions, so it works on the facts of any number of tables at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftwell.functions.kinds import DATE_KINDS, NUMERIC_KINDS, text_kind, type_count
from siftwell.operators.frequency import TOP_VALUES

# Thresholds of the profile.
NUMERIC_BAR_MAX = 15
DATE_BAR_MAX = 40
NEAR_UNIQUE = 0.95
CHIP_VALUES = 6

FACT_FIELDS = {
    "table": "string",
    "type": "string",
    "ordinal": "int",
    "column": "string",
    "declared_type": "string",
    "base_kind": "string",
    "pk": "boolean",
    "not_null": "boolean",
    "generated": "boolean",
    "fk": "string",
    "is_unique": "boolean",
    "row_count": "bigint",
    "count": "bigint",
    "distinct_count": "bigint",
    "type_mask": "int",
    "min_text": "string",
    "max_text": "string",
    "min_num": "double",
    "max_num": "double",
    "avg": "double",
    "min_len": "int",
    "max_len": "int",
    "has_dates": "boolean",
    "approx": "boolean",
    "total_rows": "bigint",
    "exact_count": "bigint",
    "exact_mask": "int",
    "exact_one_value": "boolean",
    "exact_min_text": "string",
    "exact_max_text": "string",
    "exact_min_num": "double",
    "exact_max_num": "double",
    "exact_avg": "double",
    "exact_sketch": "bigint",
}


def _any_of(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


NUMERIC = f"kind IN {_any_of(NUMERIC_KINDS)}"
DATED = f"kind IN {_any_of(DATE_KINDS)}"


def storage_types(kind: str, count: str, mask: str) -> str:
    """Types mixed in a column: by reading for text, by value for VARIANT, at most one for typed columns."""
    return f"CASE WHEN {kind} = 'text' OR {mask} IS NOT NULL THEN {type_count(mask)} WHEN {count} > 0 THEN 1 ELSE 0 END"


def whole(name: str, exact: str | None = None) -> str:
    """A figure of all rows, where the others come from a sample."""
    return f"if(approx, {exact or 'exact_' + name}, {name})"


def refined_kind() -> str:
    """Kind after the values are known: all-ISO text is a date, 0/1 integers are boolean.

    It rests on types and ranges of all rows, also where distinct counts come from a sample.
    """
    mask, count = whole("type_mask", "exact_mask"), whole("count")
    return (
        f"CASE WHEN base_kind = 'text' AND {count} > 0 THEN {text_kind(f'({mask})')} "
        f"WHEN base_kind = 'integer' AND {whole('min_num')} >= 0 AND {whole('max_num')} <= 1 "
        "THEN 'boolean' ELSE base_kind END"
    )


def is_near_unique(distinct: str, count: str) -> str:
    """Nearly every value differs (identifiers, titles), so a ranking says nothing."""
    return f"{distinct} >= {count} * {NEAR_UNIQUE}D"


def chart_choice() -> str:
    """bar, histogram or none."""
    low, high = whole("min_num"), whole("max_num")
    spread = f"{high} > {low} AND {high} < double('Infinity') AND {low} > double('-Infinity')"
    bar = "distinct_count BETWEEN 2 AND {}"
    return (
        "CASE WHEN count = 0 THEN 'none' "
        f"WHEN {NUMERIC} THEN CASE WHEN {bar.format(NUMERIC_BAR_MAX)} THEN 'bar' WHEN {spread} THEN 'histogram' "
        "ELSE 'none' END "
        f"WHEN {DATED} THEN CASE WHEN {bar.format(DATE_BAR_MAX)} THEN 'bar' WHEN has_dates THEN 'histogram' "
        "ELSE 'none' END "
        "WHEN kind = 'boolean' THEN 'bar' "
        f"WHEN kind = 'text' AND distinct_count > 1 AND NOT {is_near_unique('distinct_count', 'count')} THEN 'bar' "
        "ELSE 'none' END"
    )


def kept_top_values() -> str:
    """How many top values the profile keeps for a column."""
    return (
        f"CASE WHEN count = 0 THEN 0 WHEN {DATED} OR chart = 'bar' THEN {TOP_VALUES} "
        f"WHEN kind = 'text' THEN {CHIP_VALUES} ELSE 0 END"
    )


def interest_score() -> str:
    """How rewarding a column is to look at, 0 to 1."""
    bars = "0.7D * CASE WHEN distinct_count <= 30 THEN 1.0D WHEN distinct_count <= 100 THEN 0.65D ELSE 0.4D END"
    base = (
        f"CASE WHEN chart = 'bar' THEN {bars} "
        f"WHEN chart = 'histogram' THEN if({DATED}, 0.78D, 0.7D) "
        "ELSE if(distinct_count / count > 0.95D, 0.12D, 0.4D) END"
    )
    extra = "if(fk IS NOT NULL, 0.15D, 0.0D) + if(kind = 'boolean', 0.05D, 0.0D)"
    score = f"({base} + {extra}) * (0.45D + 0.55D * (1.0D - null_fraction))"
    return (
        "CASE WHEN count = 0 THEN 0.0D WHEN distinct_count <= 1 THEN 0.05D "
        f"ELSE greatest(0.0D, least(1.0D, {score})) END"
    )


def shown_extreme(side: str) -> str:
    """Minimum or maximum as shown: values of numbers and dates, lengths of plain text."""
    return (
        f"CASE WHEN {NUMERIC} OR {DATED} THEN {side}_text "
        f"WHEN kind = 'text' AND chart = 'none' AND count > 0 THEN concat('len ', {side}_len) END"
    )


def null_fraction(nulls: str, rows: str) -> str:
    return f"CASE WHEN {rows} > 0 THEN ({nulls}) / {rows} ELSE 0.0D END"


def classify(facts: DataFrame) -> DataFrame:
    """Facts with kind, chart, kept top values, shown extremes and interest.

    One projection; later expressions refer to earlier ones by name.
    """
    return facts.selectExpr(
        "* EXCEPT (min_num, max_num, avg)",
        f"{refined_kind()} AS kind",
        "row_count - count AS null_count",
        f"{storage_types('base_kind', 'count', 'type_mask')} AS storage_types",
        f"{chart_choice()} AS chart",
        f"{null_fraction('row_count - count', 'row_count')} AS null_fraction",
        f"{kept_top_values()} AS top_limit",
        f"{shown_extreme('min')} AS min",
        f"{shown_extreme('max')} AS max",
        *[f"if({NUMERIC}, {name}, NULL) AS {name}" for name in ("min_num", "max_num", "avg")],
        f"{interest_score()} AS interest",
    )
