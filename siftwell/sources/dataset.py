"""A dataset: named tables and views with declared constraints.

Nothing is read before a table is opened, and a table that cannot be opened stays a
member of the dataset: opening it raises, everything else goes on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions.names import quoted
from siftwell.operators.value_types import cast_untyped
from siftwell.plans.local import local_frame
from siftwell.sources.constraints import Constraints, ResolvedKey

_SUFFIX = re.compile(r"(\.(parquet|orc|json|jsonl|ndjson|csv|tsv|txt|gz|bz2|zst|snappy))+$")

CATALOG_FIELDS = {
    "table": "string",
    "type": "string",
    "ordinal": "int",
    "column": "string",
    "declared_type": "string",
    "pk": "boolean",
    "not_null": "boolean",
    "generated": "boolean",
}


class UnreadableTable(Exception):
    """A table or view of the dataset that could not be opened."""


@dataclass(frozen=True)
class Relation:
    name: str
    type: str
    load: Callable[[], DataFrame]


class Dataset:
    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, Callable[[], DataFrame] | DataFrame],
        views: Mapping[str, str | DataFrame] | None = None,
        constraints: Constraints | None = None,
        name: str = "dataset",
        size_bytes: int | None = None,
        declared_types: Mapping[str, Mapping[str, str]] | None = None,
        untyped: Iterable[str] = (),
    ):
        """``untyped`` names members whose text columns get types from their values, when they are first profiled or opened."""
        self.spark = spark
        self.name = name
        self._measure: Callable[[], int | None] = lambda: size_bytes
        self.constraints = constraints or Constraints()
        self.declared_types = declared_types or {}
        self._untyped = set(untyped)
        self._stored: dict[str, DataFrame] = {}
        self._opened: dict[str, DataFrame] = {}
        self._loading: set[str] = set()
        self._relations: dict[str, Relation] = {}
        for table, source in tables.items():
            self._relations[table] = Relation(table, "table", _loader(source))
        for view, source in (views or {}).items():
            if view in self._relations:
                raise ValueError(f"view {view} has the name of a table")
            load = self._sql_loader(source) if isinstance(source, str) else _loader(source)
            self._relations[view] = Relation(view, "view", load)

    # -- construction ---------------------------------------------------------------

    @classmethod
    def from_dir(
        cls,
        spark: SparkSession,
        path: str,
        fmt: str = "parquet",
        tables: list[str] | None = None,
        views: Mapping[str, str | DataFrame] | None = None,
        constraints: Constraints | None = None,
        untyped: bool = False,
        name: str | None = None,
        **options,
    ) -> Dataset:
        """One table per file or sub-directory of ``path``.

        One level of the directory is listed, on any file system the session can reach.
        ``tables`` names the members instead when only some are wanted.
        ``untyped`` infers the types of text columns from all their values (for CSV
        without a schema); compressed text is decompressed by Spark's codecs.
        """
        base = path.rstrip("/")
        members = _list_directory(spark, base) if tables is None else dict.fromkeys(tables)

        def loader(table: str, entry: str | None) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                target = f"{base}/{entry or table + '.' + fmt}"
                return spark.read.format(fmt).options(**options).load(target)

            return load

        sources = {table: loader(table, entry) for table, entry in members.items()}
        dataset = cls(spark, sources, views, constraints, name or base.rsplit("/", 1)[-1], untyped=members if untyped else ())
        if tables is None:
            dataset._measure = lambda: _directory_bytes(spark, base)
        return dataset

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, schema: str, constraints: Constraints | None = None, name: str | None = None
    ) -> Dataset:
        """All tables and views of a catalog schema."""
        tables: dict[str, Callable[[], DataFrame]] = {}
        views: dict[str, Callable[[], DataFrame]] = {}
        for entry in spark.catalog.listTables(schema):
            if entry.isTemporary:
                continue
            full = f"{schema}.{quoted(entry.name)}"
            target = views if entry.tableType == "VIEW" else tables
            target[entry.name] = lambda full=full: spark.table(full)
        dataset = cls(spark, tables, None, constraints, name or schema)
        for view, load in views.items():
            dataset._relations[view] = Relation(view, "view", load)
        return dataset

    @classmethod
    def from_frames(
        cls,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        views: Mapping[str, str | DataFrame] | None = None,
        constraints: Constraints | None = None,
        name: str = "dataset",
        **options,
    ) -> Dataset:
        return cls(spark, tables, views, constraints, name, **options)

    @cached_property
    def size_bytes(self) -> int | None:
        """Bytes of all files of a directory; asked for by reports only."""
        return self._measure()

    # -- members --------------------------------------------------------------------

    def relations(self) -> list[Relation]:
        """Tables, then views, each by name."""
        return sorted(self._relations.values(), key=lambda r: (r.type, r.name))

    def table_names(self) -> list[str]:
        return [r.name for r in self.relations() if r.type == "table"]

    def relation(self, name: str) -> Relation:
        return self._relations[name]

    def stored(self, name: str) -> DataFrame:
        """The rows of a table or view; columns of untyped members are text until their types are known."""
        if name in self._opened:
            return self._opened[name]
        if name not in self._stored:
            if name not in self._relations:
                raise UnreadableTable(f"no such table: {name}")
            try:
                self._stored[name] = self._relations[name].load()
            except Exception as error:
                raise UnreadableTable(first_line(error)) from error
        return self._stored[name]

    def open(self, name: str) -> DataFrame:
        """The rows of a table or view. An untyped member that was not profiled yet is read for its types."""
        if name not in self._opened:
            df = self.stored(name)
            try:
                self.bind(name, cast_untyped(df) if name in self._untyped else df)
            except Exception as error:
                raise UnreadableTable(first_line(error)) from error
        return self._opened[name]

    def is_untyped(self, name: str) -> bool:
        """Whether the types of a member are still to be found."""
        return name in self._untyped and name not in self._opened

    def bind(self, name: str, df: DataFrame) -> None:
        """The frame by which a member is known from now on."""
        self._opened[name] = df

    def foreign_keys(self) -> list[ResolvedKey]:
        """Resolved keys of the tables of the dataset, by table name; views carry none.

        Keys that cannot be resolved are left out, see ``key_errors``.
        """
        tables = self.table_names()
        keys = [k for k in self.constraints.resolve(tables, []) if k.table in set(tables)]
        return sorted(keys, key=lambda k: (k.table, k.id))

    def key_errors(self) -> list[tuple[str, str, str]]:
        """(table, first column, message) of the foreign keys that cannot be resolved."""
        tables, errors = self.table_names(), []
        self.constraints.resolve(tables, errors)
        return sorted(e for e in errors if e[0] in set(tables))

    def columns(self) -> DataFrame:
        """Every column of every readable member in order, with its declared flags."""
        rows = []
        for relation in self.relations():
            try:
                fields = self.open(relation.name).schema.fields
            except UnreadableTable:
                continue
            declared = relation.type == "table"
            pk = self.constraints.primary_key(relation.name) if declared else ()
            not_null = self.constraints.not_null.get(relation.name, ()) if declared else ()
            generated = self.constraints.generated.get(relation.name, ()) if declared else ()
            types = self.declared_types.get(relation.name, {})
            for ordinal, field in enumerate(fields):
                values = (
                    relation.name,
                    relation.type,
                    ordinal,
                    field.name,
                    types.get(field.name, field.dataType.simpleString()) or "(none)",
                    field.name in pk,
                    field.name in not_null,
                    field.name in generated,
                )
                rows.append(dict(zip(CATALOG_FIELDS, values)))
        return local_frame(self.spark, rows, CATALOG_FIELDS)

    # -- ad-hoc SQL -----------------------------------------------------------------

    def register(self) -> list[str]:
        """Make every readable member a temp view of the session; the names that failed."""
        failed = []
        for relation in self.relations():
            try:
                self.open(relation.name).createOrReplaceTempView(quoted(relation.name))
            except UnreadableTable:
                failed.append(relation.name)
        return failed

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Any Spark SQL query over the members, with bound parameters.

        Members are known to the query alone: temp views of the session stay as they are, and
        a member's name goes before a view's.
        """
        return self._query(text, args)

    def _query(self, text: str, args: dict | list | None = None, apart: Callable | None = None) -> DataFrame:
        """A query, with the members that it mentions as common table expressions over passing views."""
        members = {}
        for relation in self._relations.values():
            # a view cannot reach itself
            named = re.search(rf"(?<!\w){re.escape(relation.name)}(?!\w)", text)
            if named and relation.load is not apart and relation.name not in self._loading:
                self._loading.add(relation.name)
                try:
                    members[relation.name] = self.open(relation.name)
                except UnreadableTable:
                    pass
                finally:
                    self._loading.discard(relation.name)
        views = {name: f"siftwell_{uuid.uuid4().hex}" for name in members}
        try:
            for name, df in members.items():
                df.createOrReplaceTempView(views[name])
            parts = [f"{quoted(name)} AS (SELECT * FROM {view})" for name, view in views.items()]
            body = text.strip().rstrip(";")
            return self.spark.sql(f"WITH {', '.join(parts)} (\n{body}\n)" if parts else body, args=args)
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def _sql_loader(self, text: str) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            return self._query(text, apart=load)

        return load


def first_line(error: BaseException) -> str:
    """The message of an error without the plan or stack trace that follows it."""
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def _loader(source) -> Callable[[], DataFrame]:
    return (lambda: source) if isinstance(source, DataFrame) else source


def _directory(spark: SparkSession, base: str):
    """A path and its file system, whichever the session can reach."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list_directory(spark: SparkSession, base: str) -> dict[str, str]:
    """Members of a directory (table name → file or sub-directory); one level is listed."""
    path, file_system = _directory(spark, base)
    members: dict[str, str] = {}
    for status in file_system.listStatus(path):
        entry = status.getPath().getName()
        if entry.startswith(("_", ".")):
            continue
        table = _SUFFIX.sub("", entry)
        if table in members:
            raise ValueError(f"{members[table]} and {entry} are both table {table}")
        members[table] = entry
    return members


def _directory_bytes(spark: SparkSession, base: str) -> int:
    path, file_system = _directory(spark, base)
    return file_system.getContentSummary(path).getLength()
