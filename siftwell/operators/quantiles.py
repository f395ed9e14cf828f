"""Exact order statistics without a global sort.

The value at 0-based rank ``floor(p * (n - 1) + 0.5)`` of the sorted non-null values; no
interpolation. All requested columns and quantiles share the scans: one samples splitters, one counts
the rows between them (a splitter's own rows apart, so frequent values are answered at once), and one ranks
the rows of the ranges that hold a rank. Only where such a range still has more than ``RANK_LIMIT``
rows is it cut once more. Splitters are values of the column in its own type, so 64-bit integers and
decimals are cut as finely as doubles.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.kinds import clean
from siftwell.functions.names import column, literal

RANK_LIMIT = 500_000
SPLITTERS = 255  # of a range
SAMPLE = 20  # sampled values for each of them


@dataclass
class _Search:
    """One rank of one column; the answer lies between ``low`` and ``high``, neither included (None: no bound),
    or is ``found``."""

    name: str
    p: float
    rank: int
    rows: int
    below: int = 0
    low: object = None
    high: object = None
    found: object = None

    @property
    def range(self) -> tuple:
        return self.name, self.below, self.rows


def rank_of(p: float, count: int) -> int:
    """0-based rank of a quantile, halves up."""
    return max(0, math.floor(p * (count - 1) + 0.5))


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], rank_limit: int = RANK_LIMIT) -> DataFrame:
    """Exact quantiles of numeric, date and timestamp columns.

    One row per column and quantile: ``(column, p, rank, value, value_num)``, the value as
    text and, for numbers, as a double. Columns without values give no rows.
    """
    names = list(wanted)
    values = df.select(*[_sortable(n, df.schema[n].dataType).alias(n) for n in names])
    total = df.count()
    if total <= rank_limit:
        counts = values.agg(*[F.count(column(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
        searches = [s for i, n in enumerate(names) for s in _searches(n, wanted[n], counts[f"n{i}"])]
    else:
        whole = [_Search(n, 0.0, 0, total) for n in names]  # a column's rows, at most
        cuts = _cut(values, whole)
        searches = []
        for name, (splitters, counts) in zip(names, cuts):
            own = _searches(name, wanted[name], sum(counts.values()))
            for s in own:
                _follow(s, splitters, counts)
            searches += own
    while open_ := [s for s in searches if s.found is None and s.rows > rank_limit]:
        ranges = {s.range: s for s in open_}
        cuts = dict(zip(ranges, _cut(values, list(ranges.values()))))
        for s in open_:
            _follow(s, *cuts[s.range])
    parts = [_rank_remaining(values, name, [s for s in searches if s.name == name]) for name in names]
    parts = [part for part in parts if part is not None]
    if not parts:
        schema = "column string, p double, rank bigint, value string, value_num double"
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


def _searches(name: str, ps: Sequence[float], count: int) -> list[_Search]:
    return [_Search(name, p, rank_of(p, count), count) for p in ps if count]


def _sortable(name: str, data_type: T.DataType) -> Column:
    """Timestamps are searched as wall-clock time, which reads back the same in any zone."""
    if isinstance(data_type, T.TimestampType):
        return column(name).cast("timestamp_ntz")
    return F.expr(clean(name, data_type))


def _literal(value) -> Column:
    return literal(value, T.TimestampNTZType()) if isinstance(value, datetime) else F.lit(value)


def _array(items: Sequence[Column], kind: str) -> Column:
    return F.array(*items).cast(f"array<{kind}>")


def _place(value: Column, splitters: Column, most: int) -> Column:
    """2 i before splitter i and 2 i + 1 at it, by halving an array of at most ``most`` splitters."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    return F.aggregate(
        _array([F.lit(i) for i in steps], "int"),
        F.lit(0),
        lambda upto, step: F.when(F.get(splitters, upto + step - 1) <= value, upto + step).otherwise(upto),
        lambda upto: F.when(F.get(splitters, upto - 1) == value, 2 * upto - 1).otherwise(2 * upto),
    )


def _number(values: DataFrame, ranges: Mapping[int, _Search]) -> Column:
    """Of one column's disjoint ranges, the number of the one that holds a row's value; null where none does."""
    name = next(iter(ranges.values())).name
    bounds = sorted({b for s in ranges.values() for b in ((s.low, s.high) if s.found is None else (s.found,)) if b is not None})
    at = {b: i for i, b in enumerate(bounds)}
    numbers: list[int | None] = [None] * (2 * len(bounds) + 1)
    for i, s in ranges.items():
        if s.found is not None:
            numbers[2 * at[s.found] + 1] = i
        else:  # from bound to bound, with what lies between them
            first = 0 if s.low is None else 2 * at[s.low] + 2
            last = 2 * len(bounds) if s.high is None else 2 * at[s.high]
            numbers[first : last + 1] = [i] * (last + 1 - first)
    array = _array([_literal(b) for b in bounds], values.schema[name].dataType.simpleString())
    place = _place(column(name), array, len(bounds))
    return F.when(column(name).isNotNull(), F.get(_array([F.lit(i) for i in numbers], "int"), place))


def _numbered(values: DataFrame, ranges: list[_Search]) -> tuple[DataFrame, list[str]]:
    """Of each name's column the value and the number of its range: ``v0`` and ``n0`` for the first of the names."""
    names = list(dict.fromkeys(s.name for s in ranges))
    numbers = [_number(values, {i: s for i, s in enumerate(ranges) if s.name == n}) for n in names]
    return values.select(*[column(n).alias(f"v{i}") for i, n in enumerate(names)], *[x.alias(f"n{i}") for i, x in enumerate(numbers)]), names


def _cut(values: DataFrame, ranges: list[_Search]) -> list[tuple[list, dict[int, int]]]:
    """Splitters of every range and the rows at each place, from two scans: a sample and a count."""
    rows, names = _numbered(values, ranges)
    shares = _array([F.lit(min(1.0, SPLITTERS * SAMPLE / s.rows)) for s in ranges], "double")
    drawn = [
        F.when(F.rand(17 + i) < F.get(shares, F.col(f"n{i}")), F.struct(F.col(f"n{i}").alias("i"), F.col(f"v{i}").alias("value"))).alias(f"r{i}")
        for i in range(len(names))
    ]
    any_drawn = reduce(Column.__or__, [F.col(f"r{i}").isNotNull() for i in range(len(names))])
    own: list[list] = [[] for _ in ranges]
    for r in rows.select(*drawn).where(any_drawn).collect():  # a few thousand rows for each range
        for x in r:
            if x is not None:
                own[x["i"]].append(x["value"])
    for x in own:
        x.sort()
    picked = [sorted({x[len(x) * j // (SPLITTERS + 1)] for j in range(1, SPLITTERS + 1)} if x else ()) for x in own]
    places = []
    for i, name in enumerate(names):
        kind = values.schema[name].dataType.simpleString()
        arrays = F.array(*[_array([_literal(x) for x in picked[j]] if s.name == name else [], kind) for j, s in enumerate(ranges)])
        most = max(len(picked[j]) for j, s in enumerate(ranges) if s.name == name)
        place = _place(F.col(f"v{i}"), F.get(arrays, F.col(f"n{i}")), most)
        places += [F.col(f"n{i}"), F.when(F.col(f"n{i}").isNotNull(), place)]
    # nothing is filtered before this: a filter would number every row's values once more
    found = rows.select(F.stack(F.lit(len(names)), *places).alias("i", "place")).where("i IS NOT NULL")
    counts: list[dict[int, int]] = [{} for _ in ranges]
    for r in found.groupBy("i", "place").count().collect():
        counts[r["i"]][r["place"]] = r["count"]
    return list(zip(picked, counts))


def _follow(s: _Search, splitters: list, counts: Mapping[int, int]) -> None:
    """Goes on in the place that holds the rank."""
    offset, before = s.rank - s.below, 0
    for place in sorted(counts):
        if offset < before + counts[place]:
            break
        before += counts[place]
    s.below, s.rows = s.below + before, counts[place]
    if place % 2:
        s.found = splitters[place // 2]
    else:
        i = place // 2
        s.low = splitters[i - 1] if i else s.low
        s.high = splitters[i] if i < len(splitters) else s.high


def _rank_remaining(values: DataFrame, name: str, searches: list[_Search]) -> DataFrame | None:
    """The values of the ranks of one column, from one scan of the ranges that are left.

    A range holds at most ``rank_limit`` rows, or one value. Searches that ended in the
    same range share its ranking.
    """
    if not searches:
        return None
    data_type = values.schema[name].dataType
    ranges = sorted({(s.below, s.rows): s for s in searches}.items())
    index = {bounds: i for i, (bounds, _) in enumerate(ranges)}
    rows, _ = _numbered(values, [s for _, s in ranges])
    counted = rows.where("n0 IS NOT NULL").groupBy(F.col("n0").alias("range"), F.col("v0").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(
        *[
            F.struct(
                F.lit(index[s.below, s.rows]).alias("range"),
                F.lit(s.p).alias("p"),
                F.lit(s.rank).cast("bigint").alias("rank"),
                F.lit(s.rank - s.below).alias("offset"),
            )
            for s in searches
        ]
    )
    hits = F.filter(
        wanted,
        lambda w: (w["range"] == F.col("range")) & (F.col("upto") > w["offset"]) & (F.col("upto") - F.col("n") <= w["offset"]),
    )
    number = F.col("value").cast("double") if isinstance(data_type, T.NumericType) else F.lit(None).cast("double")
    return counted.withColumn("upto", upto).select("value", F.explode(hits).alias("hit")).select(
        F.lit(name).alias("column"),
        F.col("hit.p").alias("p"),
        F.col("hit.rank").alias("rank"),
        F.col("value").cast("string").alias("value"),
        number.alias("value_num"),
    )
