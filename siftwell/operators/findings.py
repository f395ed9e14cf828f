"""Ranked data-quality findings, from the profile and the key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.labels import grouped_number, percent

# Fixed values.
HIGH_NULL = 0.6
SEVERITIES = ("high", "warn", "info")
MIXED_DETAIL = "values that read as different types"

FINDING_COLUMNS = ("severity", "kind", "table", "column", "message", "detail")


def findings(
    column_profile: DataFrame, table_profile: DataFrame, orphans: DataFrame, repeats: DataFrame | None = None, unresolved: DataFrame | None = None
) -> DataFrame:
    """All findings with their position: by severity, then table, keys before columns.

    Column findings are for tables with rows only, never for views. A constant column is
    reported as constant even when most of it is null; mixed types come on top.
    """
    tables = table_profile.select("table", "type", F.col("ordinal").alias("table_ord"), "row_count", "error")
    parts = [_unreadable(tables), *_key_findings(orphans, tables), *_column_findings(column_profile, tables)]
    if repeats is not None:
        parts.append(_repeated(repeats, tables))
    if unresolved is not None:
        parts.append(_unresolved(unresolved, tables))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", rank)
    # Findings are metadata: at most two per column and one per key, however large the data.
    order = Window.orderBy("rank", "phase", "table_ord", "group", "item", "smell")
    return found.select((F.row_number().over(order) - 1).alias("position"), *FINDING_COLUMNS)


def _finding(df: DataFrame, severity, kind, name, message, detail, phase, group, item, smell=0) -> DataFrame:
    return df.select(
        F.lit(severity).alias("severity"),
        F.lit(kind).alias("kind"),
        "table",
        name.cast("string").alias("column"),
        message.alias("message"),
        detail.cast("string").alias("detail"),
        F.lit(phase).alias("phase"),
        "table_ord",
        F.lit(group).alias("group"),
        item.cast("int").alias("item"),
        F.lit(smell).alias("smell"),
    )


def _unreadable(tables: DataFrame) -> DataFrame:
    return _finding(
        tables.where(F.col("error").isNotNull()),
        "warn",
        "unreadable",
        F.lit(None),
        F.concat(F.lit("cannot read "), "table"),
        F.col("error"),
        phase=0,
        group=0,
        item=F.lit(0),
    )


def _key_findings(orphans: DataFrame, tables: DataFrame) -> list[DataFrame]:
    keys = orphans.join(tables.where((F.col("type") == "table") & (F.col("row_count") > 0)), "table")
    missing = _finding(
        keys.where("missing_parent"),
        "high",
        "orphan-fk",
        F.col("first_column"),
        F.concat("table", F.lit("."), "from_label", F.lit(" refers to "), "parent", F.lit(", which is no table here")),
        F.lit(None),
        phase=1,
        group=0,
        item=F.col("fk_id"),
    )
    plural = F.when(F.col("orphans") == 1, F.lit("")).otherwise(F.lit("s"))
    # Fixed value: the wording of this message.
    orphaned = _finding(
        keys.where("not missing_parent and orphans > 0"),
        "high",
        "orphan-fk",
        F.col("first_column"),
        F.concat(
            grouped_number(F.col("orphans")),
            F.lit(" orphaned "),
            "from_label",
            F.lit(" value"),
            plural,
            F.lit(" in "),
            "table",
        ),
        F.concat(F.lit("→ "), "parent", F.lit("."), "to_label", F.lit(" (no matching parent row)")),
        phase=1,
        group=0,
        item=F.col("fk_id"),
    )
    return [missing, orphaned]


def _repeated(repeats: DataFrame, tables: DataFrame) -> DataFrame:
    """Keys that are declared unique and are not."""
    keys = repeats.where("repeats > 0").join(tables.where("type = 'table'"), "table")
    plural = F.when(F.col("repeats") == 1, F.lit(" row repeats ")).otherwise(F.lit(" rows repeat "))
    return _finding(
        keys,
        "high",
        "duplicate-key",
        F.col("first_column"),
        F.concat(grouped_number(F.col("repeats")), plural, F.lit("a value of "), "table", F.lit("."), "label"),
        F.concat(F.lit("declared unique"), F.coalesce(F.concat(F.lit(" where "), "where"), F.lit(""))),
        phase=1,
        group=0,
        item=F.lit(1000) + F.col("key_id"),
    )


def _unresolved(errors: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys whose declaration cannot be resolved."""
    return _finding(
        errors.join(tables, "table"),
        "high",
        "unresolved-key",
        F.col("first_column"),
        F.col("message"),
        F.lit(None),
        phase=1,
        group=0,
        item=F.lit(2000) + F.col("position"),
    )


def _column_findings(column_profile: DataFrame, tables: DataFrame) -> list[DataFrame]:
    scope = tables.where((F.col("type") == "table") & (F.col("row_count") > 0)).select("table", "table_ord")
    columns = column_profile.join(scope, "table")
    empty = F.col("count") == 0
    constant = ~empty & (F.col("distinct_count") == 1)
    sparse = ~empty & ~constant & (F.col("null_fraction") >= HIGH_NULL)
    mixed = F.col("storage_types") > 1
    name = F.concat("table", F.lit("."), "column")
    none = F.lit(None)

    def smell(condition, severity, kind, message, detail=none, order=0) -> DataFrame:
        return _finding(
            columns.where(condition),
            severity,
            kind,
            F.col("column"),
            message,
            detail,
            phase=1,
            group=1,
            item=F.col("ordinal"),
            smell=order,
        )

    return [
        smell(empty, "warn", "empty", F.concat(F.lit("no values in "), name)),
        smell(constant, "info", "constant", F.concat(F.lit("one value only in "), name)),
        smell(sparse, "warn", "high-null", F.concat(percent(F.col("null_fraction")), F.lit(" of "), name, F.lit(" missing"))),
        smell(
            mixed,
            "warn",
            "mixed-type",
            F.concat(F.col("storage_types").cast("string"), F.lit(" types of values in "), name),
            F.lit(MIXED_DETAIL),
            order=1,
        ),
    ]


def findings_by_severity(found: DataFrame) -> DataFrame:
    """Number of findings per severity."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("finding_count"))


def findings_of(found: DataFrame, table: str, name: str) -> DataFrame:
    """Findings of one column."""
    return found.where((F.col("table") == table) & (F.col("column") == name))
