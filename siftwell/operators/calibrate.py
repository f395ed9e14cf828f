"""Full-table figures for a profile taken from a sample.

Counts, nulls, types, ranges and means are exact: they come from one aggregate over the
whole table, and data-quality findings rest on them. Distinct counts, top values and bins
are scaled up from the sample and marked approximate; where a sketch of the whole table was
taken, it gives the distinct count. Kinds rest on the exact figures too; text lengths stay as the
sample showed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.names import quoted
from siftwell.operators.classify import DATED, NUMERIC, interest_score, is_near_unique, null_fraction, storage_types


def rounded(value: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(value + 0.5).cast("bigint")


def calibrate(profile: DataFrame) -> DataFrame:
    """A classified frame with the rows that came from a sample brought to full size.

    Adds ``scale`` (1 for exact rows) and ``near_unique`` for the detail frames.
    """
    scale = "CASE WHEN NOT approx THEN 1.0D WHEN count > 0 THEN exact_count / count ELSE 0.0D END"
    near_unique = f"count > 0 AND {is_near_unique('distinct_count', 'count')}"
    exact_types = storage_types("base_kind", "exact_count", "exact_mask")
    distinct = (
        "CASE WHEN NOT approx OR distinct_count IS NULL THEN distinct_count WHEN exact_count = 0 THEN 0 WHEN is_unique THEN exact_count "
        f"WHEN exact_one_value AND ({exact_types}) <= 1 THEN 1 "
        "WHEN exact_sketch IS NOT NULL THEN least(exact_count, greatest(2, exact_sketch)) "
        "WHEN near_unique THEN least(exact_count, CAST(floor(distinct_count * scale + 0.5D) AS bigint)) "
        "ELSE greatest(2, distinct_count) END"
    )
    nulls = "total_rows - exact_count"
    replaced = {
        "count": "if(approx, exact_count, count)",
        "null_count": f"if(approx, {nulls}, null_count)",
        "null_fraction": f"if(approx, {null_fraction(nulls, 'total_rows')}, null_fraction)",
        "distinct_count": f"CAST({distinct} AS bigint)",
        "storage_types": f"if(approx, {exact_types}, storage_types)",
        "min": f"if(approx AND ({NUMERIC} OR {DATED}), exact_min_text, min)",
        "max": f"if(approx AND ({NUMERIC} OR {DATED}), exact_max_text, max)",
        **{n: f"if(approx AND {NUMERIC}, exact_{n}, {n})" for n in ("min_num", "max_num", "avg")},
    }
    kept = [quoted(c) for c in profile.columns if c not in replaced and c != "interest"]
    exact = [f"{value} AS {name}" for name, value in replaced.items()]
    calibrated = profile.selectExpr(*kept, f"{scale} AS scale", f"{near_unique} AS near_unique", *exact)
    return calibrated.selectExpr("*", f"{interest_score()} AS interest")


def scaled_count(count: Column, scale: Column, near_unique: Column) -> Column:
    """A top-value count at full size; a value seen once in a near-unique sample is kept."""
    return F.when(near_unique, count).otherwise(rounded(count * scale))
