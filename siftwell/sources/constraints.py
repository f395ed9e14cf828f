"""Declared keys of a dataset.

Parquet, CSV and JSON files carry no keys, so they are declared next to the data. Nothing enforces
them: a profile counts the values of declared columns like any others and reports keys that repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from siftwell.functions.names import key_label

IMPLICIT_TARGET = "rowid"


class ConstraintError(ValueError):
    """A declaration that cannot be resolved."""


@dataclass(frozen=True)
class ForeignKey:
    """Columns of a table that refer to a row of a parent table.

    Without ``parent_columns`` the key targets the parent's primary key, in key order.
    """

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class UniqueKey:
    """Columns without repeats; ``where`` restricts it to some rows (a partial key)."""

    table: str
    columns: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class ResolvedKey:
    """A foreign key with its column pairs; ``id`` counts the keys of its table."""

    id: int
    table: str
    parent: str
    pairs: tuple[tuple[str, str], ...]

    @property
    def from_label(self) -> str:
        return key_label(a for a, _ in self.pairs)

    @property
    def to_label(self) -> str:
        return key_label(b for _, b in self.pairs)

    @property
    def target(self) -> str:
        return f"{self.parent}.{self.to_label}"

    @property
    def edge_label(self) -> str:
        return f"{self.from_label} → {self.to_label}"


@dataclass
class Constraints:
    primary_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: Iterable[ForeignKey] = ()
    unique_keys: Iterable[UniqueKey] = ()
    not_null: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    generated: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def primary_key(self, table: str) -> tuple[str, ...]:
        return tuple(self.primary_keys.get(table, ()))

    def unique_columns(self, table: str) -> set[str]:
        """Columns that are unique on their own: a single-column primary key or full unique key."""
        keys = [k.columns for k in self.unique_keys if k.table == table and k.where is None]
        keys.append(self.primary_key(table))
        return {key[0] for key in keys if len(key) == 1}

    def declared_unique(self, table: str) -> list[UniqueKey]:
        """Everything declared unique in a table: its primary key, then its unique keys."""
        primary = [UniqueKey(table, self.primary_key(table))] if self.primary_key(table) else []
        return primary + [k for k in self.unique_keys if k.table == table]

    def resolve(self, known_tables: Iterable[str], errors: list[tuple[str, str, str]] | None = None) -> list[ResolvedKey]:
        """Foreign keys with explicit column pairs, in declaration order.

        A key that cannot be resolved raises, or goes to ``errors`` as (table, first column, message).
        """
        known = set(known_tables)
        counts: dict[str, int] = {}
        resolved = []
        for key in self.foreign_keys:
            target = key.parent_columns
            wrong = None
            if target is None:
                target = self.primary_key(key.parent)
                if not target and key.parent in known:
                    wrong = f"{key.table}.{key_label(key.columns)} refers to {key.parent}, which declares no primary key"
                elif not target:
                    target = (IMPLICIT_TARGET,) * len(key.columns)
            if wrong is None and len(target) != len(key.columns):
                wrong = f"{key.table}.{key_label(key.columns)} and {key.parent}.{key_label(target)} differ in length"
            if wrong is not None:
                if errors is None:
                    raise ConstraintError(wrong)
                errors.append((key.table, key.columns[0], wrong))
                continue
            number = counts.get(key.table, 0)
            counts[key.table] = number + 1
            resolved.append(ResolvedKey(number, key.table, key.parent, tuple(zip(key.columns, target))))
        return resolved
