"""Labels of numbers, shares and time spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(value: str) -> str:
    """A double as text without exponent or trailing zeros: 10000000, 0.25, -3.

    SQL text over the text of a double expression.
    """
    size = f"abs({value})"
    return (
        f"CASE WHEN {size} >= 1e7D AND {size} < 1e27D "
        f"THEN {_strip_zeros(f'CAST(CAST({value} AS decimal(38,10)) AS string)')} "
        f"WHEN {size} < 1e-3D AND {size} >= 1e-6D "
        f"THEN {_strip_zeros(f'CAST(CAST({value} AS decimal(38,30)) AS string)')} "
        f"ELSE regexp_replace(CAST({value} AS string), r'\\.0$', '') END"
    )


def _strip_zeros(text: str) -> str:
    return f"regexp_replace({text}, r'\\.?0+$', '')"


def grouped_number(value: Column) -> Column:
    """A number with grouped thousands and at most two decimals: ``1,234.5``.

    Rounded before formatting, since ``format_number`` rounds half to even.
    """
    return F.call_function("format_number", F.round(value.cast("double"), 2), F.lit("#,##0.##"))


def percent(fraction: Column) -> Column:
    """A share as whole percent; only exact 0 and 1 read ``0%`` and ``100%``."""
    pct = fraction * 100
    return (
        F.when(pct <= 0, F.lit("0%"))
        .when(pct >= 100, F.lit("100%"))
        .when(pct < 1, F.lit("<1%"))
        .when(pct > 99, F.lit(">99%"))
        .otherwise(F.concat(F.floor(pct + 0.5).cast("string"), F.lit("%")))
    )


def span_label(days: Column) -> Column:
    """A number of days as years, months or days."""
    return (
        F.when(days > 730, F.format_string("%.1f years", days / 365.25))
        .when(days > 60, F.concat(F.floor(days / 30.44 + 0.5).cast("string"), F.lit(" months")))
        .when(days >= 0, F.concat(F.floor(days + 0.5).cast("string"), F.lit(" days")))
    )
