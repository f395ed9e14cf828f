"""Small metadata frames.

A profile has rows per column, bin and top value, never per data row. Between passes such
results are held as local relations, so that later steps do not scan the data again.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession

ARROW_TYPES = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}


def schema_text(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {data_type}" for name, data_type in fields.items())


def local_frame(spark: SparkSession, rows: Iterable[dict | Row], fields: dict[str, str]) -> DataFrame:
    """A frame of a few metadata rows, planned as a local relation."""
    rows = [row.asDict() if isinstance(row, Row) else row for row in rows]
    columns = {
        name: pa.array([row.get(name) for row in rows], type=ARROW_TYPES[data_type])
        for name, data_type in fields.items()
    }
    return spark.createDataFrame(pa.table(columns), schema=schema_text(fields))
