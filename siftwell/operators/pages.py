"""Pages by number, however deep, by a directory of ranks over the sort key.

The rows in their order are cut into ranges by sampled splitters, and one scan counts the rows of every
range; sums of these counts say which range holds a page. A range that is still large is cut
again, so the directory grows only where pages are read. Only the rows of the one or two small ranges that a
page touches are sorted: no plan sorts or skips the pages before it. A directory is built once and
serves any number of pages, as long as the rows stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.names import column, literal
from siftwell.operators.rows import PAGE, _page_order, equals, filtered

FANOUT = 64  # ranges that a range is cut into
SAMPLE = 40  # sampled rows for each of them
LEAF = 20_000  # rows that are sorted for a page


@dataclass(frozen=True)
class Cut:
    """A place in the order: right before the rows with these values of the sort key, or right after them."""

    values: tuple
    after: bool = False


@dataclass
class Range:
    """Rows from one cut to the next (None: the end), how many come before them and how many they are."""

    low: Cut | None
    high: Cut | None
    start: int
    rows: int
    parts: list[Range] = field(default_factory=list)
    whole: bool = False  # cannot be cut: all rows have the same key


class RankDirectory:
    """The rows of a frame in the order of a column and the row key, by number."""

    def __init__(
        self,
        df: DataFrame,
        sort: str | None = None,
        descending: bool = False,
        key: Sequence[str] = (),
        needle: str = "",
        fanout: int = FANOUT,
        leaf: int = LEAF,
    ):
        self.order = _page_order(df, sort, descending, key)
        self.rows = filtered(df, needle)
        self.fanout, self.leaf = fanout, leaf
        self.root = Range(None, None, 0, self.rows.count())

    def page(self, page: int, size: int = PAGE) -> DataFrame:
        """A page of the rows; empty beyond the last one."""
        return self.slice(page * size, size)

    def slice(self, first: int, size: int) -> DataFrame:
        """Rows number ``first`` (from 0) up to ``first + size`` in the order."""
        last = min(first + size, self.root.rows)
        if first >= last:
            return self.rows.limit(0)
        found, at = [], first
        while at < last:
            leaf = self._leaf(at)
            found.append(leaf)
            at = leaf.start + leaf.rows
        if len(found) == 1 and found[0].whole and found[0].rows > self.leaf:
            # equal keys: the order says nothing more about them
            return self._between(found[0]).offset(first - found[0].start).limit(last - first)
        near = self._between(Range(found[0].low, found[-1].high, found[0].start, sum(r.rows for r in found)))
        # at most a few leaves are ranked in one task
        rank = F.row_number().over(Window.orderBy(*self._sorting()))
        ranked = near.withColumn("__rank", rank + F.lit(found[0].start))
        return ranked.where((F.col("__rank") > first) & (F.col("__rank") <= last)).drop("__rank")

    def _sorting(self) -> list[Column]:
        return [column(n).desc_nulls_last() if down else column(n).asc_nulls_first() for n, down in self.order]

    def _leaf(self, at: int) -> Range:
        """The smallest range with a row of this number."""
        here = self.root
        while True:
            if not here.parts and here.rows > self.leaf and not here.whole:
                self._cut(here)
            if not here.parts:
                return here
            here = next(p for p in here.parts if p.start <= at < p.start + p.rows)

    def _beyond(self, cut: Cut) -> Column:
        """Whether a row stands behind a cut."""
        past = F.lit(not cut.after)
        for (name, down), last in reversed(list(zip(self.order, cut.values))):
            value = column(name)
            if last is None:  # nulls come first going up and last going down
                beyond = F.lit(False) if down else value.isNotNull()
            else:
                bound = literal(last, self.rows.schema[name].dataType)
                beyond = (value < bound) | value.isNull() if down else value > bound
            past = F.coalesce(beyond, F.lit(False)) | (F.coalesce(equals(self.rows, name, last), F.lit(False)) & past)
        return past

    def _between(self, part: Range) -> DataFrame:
        """The rows of a range; its first sort column alone is a range that scans can skip files by."""
        rows, (name, down) = self.rows, self.order[0]
        for cut, lower in ((part.low, True), (part.high, False)):
            if cut is None:
                continue
            value, last = column(name), cut.values[0]
            if last is not None:
                bound = literal(last, rows.schema[name].dataType)
                rising = lower != down
                plain = value >= bound if rising else value <= bound
                nulls = lower == down  # nulls stand on the side that stays
                rows = rows.where(plain | value.isNull() if nulls else plain)
            rows = rows.where(self._beyond(cut) if lower else ~self._beyond(cut))
        return rows

    def _cut(self, part: Range) -> None:
        """Cuts a range by sampled splitters and counts its parts in one scan."""
        inside = self._between(part).select(*[column(n) for n, _ in self.order])
        fraction = min(1.0, self.fanout * SAMPLE / part.rows)
        sample = [tuple(r) for r in inside.sample(fraction=fraction, seed=11).orderBy(*self._sorting()).limit(2 * self.fanout * SAMPLE).collect()]
        picked = [sample[len(sample) * i // self.fanout] for i in range(1, self.fanout)] if sample else []
        cuts: list[Cut] = []
        for values in picked:
            if not cuts or cuts[-1].values != values:
                cuts.append(Cut(values))
            elif not cuts[-1].after:  # a key of many rows gets a range of its own
                cuts.append(Cut(values, True))
        cuts = [c for c in cuts if c not in (part.low, part.high)]
        if not cuts and sample:
            cuts = [c for c in (Cut(sample[0]), Cut(sample[0], True)) if c not in (part.low, part.high)]
        counts = {r["part"]: r["count"] for r in inside.groupBy(self._number(cuts, 0).alias("part")).count().collect()} if cuts else {0: part.rows}
        start, bounds = part.start, [part.low, *cuts, part.high]
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if counts.get(i):
                part.parts.append(Range(low, high, start, counts[i]))
                start += counts[i]
        for p in part.parts:
            same = p.low is not None and p.high is not None and p.low.values == p.high.values
            p.whole = same or (p.rows == part.rows and (p.low, p.high) == (part.low, part.high))

    def _number(self, cuts: list[Cut], first: int) -> Column:
        """Which part a row is in, by halving the cuts."""
        if not cuts:
            return F.lit(first)
        middle = len(cuts) // 2
        return F.when(self._beyond(cuts[middle]), self._number(cuts[middle + 1 :], first + middle + 1)).otherwise(self._number(cuts[:middle], first))


def deep_page(df: DataFrame, page: int, sort: str | None = None, descending: bool = False, key: Sequence[str] = (), needle: str = "", size: int = PAGE, leaf: int = LEAF) -> DataFrame:
    """One page of the filtered, sorted rows, by a directory of its own."""
    return RankDirectory(df, sort, descending, key, needle, leaf=leaf).page(page, size)
