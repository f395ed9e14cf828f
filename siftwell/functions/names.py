"""References to columns by their exact name, and literals to compare them with."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Backtick-quote an identifier so dots, spaces, quotes and keywords are literal."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def literal(value, data_type: T.DataType) -> Column:
    """A literal for a column of a type.

    A Python datetime would become a timestamp *with* time zone; for columns without one
    it is taken as wall-clock time.
    """
    if isinstance(data_type, T.TimestampNTZType) and isinstance(value, (date, datetime)):
        return F.lit(str(value)).cast("timestamp_ntz")
    return F.lit(value)


def key_label(columns) -> str:
    """``a`` for a single-column key, ``(a, b)`` for a composite one."""
    columns = list(columns)
    return columns[0] if len(columns) == 1 else "(" + ", ".join(columns) + ")"
