"""Declared foreign keys: relationship edges and rows without a parent."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.names import column, key_label
from siftwell.plans.local import local_frame
from siftwell.sources.constraints import ResolvedKey, UniqueKey

# A parent whose key columns fit here is sent to every executor; larger ones are joined
# by shuffle. This chooses the join only: results are the same either way.
BROADCAST_BYTES = 32 * 1024 * 1024
KEY_BYTES = 64

RELATIONSHIP_FIELDS = {"from_table": "string", "fk_id": "int", "to_table": "string", "columns": "string"}
ORPHAN_FIELDS = {
    "table": "string",
    "fk_id": "int",
    "parent": "string",
    "first_column": "string",
    "from_label": "string",
    "to_label": "string",
    "missing_parent": "boolean",
    "orphans": "bigint",
}


def relationships(spark: SparkSession, keys: Sequence[ResolvedKey]) -> DataFrame:
    """One edge per foreign key; a composite key is one edge."""
    rows = [
        {"from_table": k.table, "fk_id": k.id, "to_table": k.parent, "columns": k.edge_label} for k in keys
    ]
    return local_frame(spark, rows, RELATIONSHIP_FIELDS)


def collapsed_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges merged into one with joined labels; a table's edges to itself left out."""
    labels = F.transform(
        F.sort_array(F.collect_list(F.struct("fk_id", "columns"))), lambda edge: edge["columns"]
    )
    return (
        edges.where(F.col("from_table") != F.col("to_table"))
        .groupBy("from_table", "to_table")
        .agg(F.array_join(labels, ", ").alias("label"))
    )


def self_references(edges: DataFrame) -> DataFrame:
    """Tables with a foreign key to themselves."""
    return edges.where(F.col("from_table") == F.col("to_table")).select(F.col("from_table").alias("table")).distinct()


def _key_columns(child: DataFrame, parent: DataFrame, key: ResolvedKey) -> tuple[list[Column], list[Column]]:
    """Key columns of a child and of its parent, made comparable."""
    child_keys, parent_keys = [], []
    for a, b in key.pairs:
        from_child, from_parent = _comparable(child.schema[a].dataType, parent.schema[b].dataType)
        child_keys.append(from_child(column(a)))
        parent_keys.append(from_parent(column(b)))
    return child_keys, parent_keys


def _key_frames(child: DataFrame, parent: DataFrame, key: ResolvedKey) -> tuple[DataFrame, DataFrame, list[str]]:
    """Key columns of the child rows that refer to a parent, and of the parent, as ``k0 …``."""
    names = [f"k{i}" for i in range(len(key.pairs))]
    child_keys, parent_keys = _key_columns(child, parent, key)
    refers = reduce(Column.__and__, [column(a).isNotNull() for a, _ in key.pairs])
    child_keys, parent_keys = ([c.alias(n) for c, n in zip(keys, names)] for keys in (child_keys, parent_keys))
    return child.where(refers).select(*child_keys), parent.select(*parent_keys), names


def orphan_rows(child: DataFrame, parent: DataFrame, key: ResolvedKey) -> DataFrame:
    """Key values of the child without a parent row, with how many rows hold them.

    A key with a NULL part refers to nothing and is no orphan. Child rows are counted per
    key before the join and parent keys made distinct, so the shuffle carries each key once per
    task however often it occurs on either side; the join keeps that partitioning.
    """
    keys, targets, names = _key_frames(child, parent, key)
    return keys.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).join(targets.distinct(), names, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: ResolvedKey, parent_rows: int | None = None) -> DataFrame:
    """Number of child rows whose key has no parent row, as a one-row frame.

    ``parent_rows`` is the exact row count of the parent when the caller knows it. Keys of
    a parent that small are broadcast: the child is filtered where it is read and nothing
    of it is shuffled.
    """
    if parent_rows is not None and _key_bytes(parent, key, parent_rows) <= BROADCAST_BYTES:
        keys, targets, names = _key_frames(child, parent, key)
        return keys.join(F.broadcast(targets), names, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return orphan_rows(child, parent, key).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans"))


def _key_bytes(parent: DataFrame, key: ResolvedKey, rows: int) -> float:
    """Size of the broadcast parent keys; keys without a fixed width have no bound and are never broadcast."""
    types = [parent.schema[b].dataType for _, b in key.pairs]
    if any(isinstance(t, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)) for t in types):
        return float("inf")
    return rows * KEY_BYTES * len(types)


def _comparable(child: T.DataType, parent: T.DataType):
    """Casts that let both sides of a key compare; text that is no number matches none."""

    def unchanged(value: Column) -> Column:
        return value

    text_child, text_parent = isinstance(child, T.StringType), isinstance(parent, T.StringType)
    if text_child and isinstance(parent, T.NumericType):
        return (lambda value: value.try_cast(parent)), unchanged
    if text_parent and isinstance(child, T.NumericType):
        return unchanged, (lambda value: value.try_cast(child))
    return unchanged, unchanged


def orphan_report(
    spark: SparkSession,
    frames: dict[str, DataFrame],
    keys: Sequence[ResolvedKey],
    row_counts: dict[str, int] | None = None,
) -> DataFrame:
    """Orphans of every foreign key; keys whose parent is no table are marked missing.

    All checks run as one query, so small ones do not wait for large ones. Keys that cannot
    be checked (a column that does not exist) are skipped, as are children without rows.
    """
    row_counts = row_counts or {}
    rows, checks = [], []
    for key in keys:
        if key.table not in frames or row_counts.get(key.table) == 0:
            continue
        row = {
            "table": key.table,
            "fk_id": key.id,
            "parent": key.parent,
            "first_column": key.pairs[0][0],
            "from_label": key.from_label,
            "to_label": key.to_label,
            "missing_parent": key.parent not in frames,
            "orphans": None,
        }
        rows.append(row)
        if row["missing_parent"] or frames[key.parent] is None or frames[key.table] is None:
            continue
        try:
            count = orphan_count(frames[key.table], frames[key.parent], key, row_counts.get(key.parent))
        except (PySparkException, KeyError):
            continue
        checks.append(count.select(F.lit(len(rows) - 1).alias("position"), "orphans"))
    for position, orphans in _run_checks(checks):
        rows[position]["orphans"] = orphans
    return local_frame(spark, rows, ORPHAN_FIELDS)


REPEAT_FIELDS = {"table": "string", "key_id": "int", "first_column": "string", "label": "string", "where": "string", "repeats": "bigint"}


def repeat_count(df: DataFrame, key: UniqueKey) -> DataFrame:
    """Rows beyond the first of each value of a declared key, as a one-row frame.

    A key with a NULL part is no value; a partial key looks at its rows only.
    """
    rows = df.where(key.where) if key.where else df
    present = rows.where(reduce(Column.__and__, [column(c).isNotNull() for c in key.columns]))
    counts = present.groupBy(*[column(c) for c in key.columns]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("repeats"))


def repeat_report(spark: SparkSession, frames: dict[str, DataFrame], keys: Sequence[UniqueKey], known: dict[tuple[str, str], int]) -> DataFrame:
    """Repeats of every declared key. ``known`` has those of single columns that were counted already."""
    rows, checks = [], []
    for number, key in enumerate(keys):
        if frames.get(key.table) is None:
            continue
        rows.append({"table": key.table, "key_id": number, "first_column": key.columns[0], "label": key_label(key.columns), "where": key.where, "repeats": None})
        if len(key.columns) == 1 and key.where is None and (key.table, key.columns[0]) in known:
            rows[-1]["repeats"] = known[key.table, key.columns[0]]
            continue
        try:
            count = repeat_count(frames[key.table], key)
        except (PySparkException, KeyError):
            continue
        checks.append(count.select(F.lit(len(rows) - 1).alias("position"), "repeats"))
    for position, repeats in _run_checks(checks):
        rows[position]["repeats"] = repeats
    return local_frame(spark, rows, REPEAT_FIELDS)


def _run_checks(checks: list[DataFrame]) -> list[tuple[int, int]]:
    """One row per check; a check that fails at run time is left out."""
    if not checks:
        return []
    try:
        return [tuple(row) for row in reduce(DataFrame.unionAll, checks).collect()]
    except PySparkException:
        results = []
        for check in checks:
            try:
                results += [tuple(row) for row in check.collect()]
            except PySparkException:
                continue
        return results
