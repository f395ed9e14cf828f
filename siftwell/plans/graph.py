"""The graph of a dataset's declared keys, without a profile: only keys are read, and rows are counted."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from siftwell.operators import integrity
from siftwell.plans.local import local_frame
from siftwell.sources.dataset import Dataset


class KeyGraph:
    """Edges, self references and orphans of the tables that declared keys join."""

    def __init__(self, dataset: Dataset):
        self._spark = dataset.spark
        self._keys = dataset.foreign_keys()
        known = set(dataset.table_names())
        named = sorted({t for k in self._keys for t in (k.table, k.parent)} & known)
        self._frames = {t: dataset.open(t) for t in named}

    @cached_property
    def _counts(self) -> dict[str, int]:
        return {t: df.count() for t, df in self._frames.items()}  # parquet and ORC count from their footers

    @property
    def relationships(self) -> DataFrame:
        """One edge per foreign key."""
        return integrity.relationships(self._spark, self._keys)

    def edges(self) -> DataFrame:
        """Edges between tables with parallel ones merged."""
        return integrity.collapsed_edges(self.relationships)

    def self_references(self) -> DataFrame:
        """Tables with a foreign key to themselves."""
        return integrity.self_references(self.relationships)

    @property
    def tables(self) -> DataFrame:
        """table, row_count of the tables that keys name."""
        rows = [{"table": t, "row_count": n} for t, n in self._counts.items()]
        return local_frame(self._spark, rows, {"table": "string", "row_count": "bigint"})

    @cached_property
    def orphans(self) -> DataFrame:
        """Rows without a parent per foreign key."""
        return integrity.orphan_report(self._spark, self._frames, self._keys, self._counts)
