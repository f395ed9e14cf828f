"""The profile of a table and of a dataset.

Per table, the data is scanned for

1. the exact aggregates of all columns (one ungrouped aggregate),
2. the value frequencies (one shuffle per type class, counted before it). Bounds and grains are known from 1, so
   the counted values are binned on their way to the distinct counts, and histograms need no scan.

Columns that 2 does not count, those declared unique and trusted, are scanned for their bins.
Tables above ``sample_above`` rows take 2 from a random sample; 1 is always exact.
Only results with a row per column, bin or top value come back to the driver, where they
become local frames; classification, calibration, findings and rankings are column
expressions over those, for all tables at once.

Each table goes through its passes on its own, several side by side, so a large table
does not hold up the others. Jobs carry a tag of the run and a description with table and pass.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.iso import SECONDS_PER_DAY, iso_seconds
from siftwell.functions.kinds import DATE_BIT, DATE_KINDS, DATETIME_BIT, declared_kind, fitting_kind, kind_of_type, value_class
from siftwell.functions.names import quoted
from siftwell.operators import findings as findings_ops
from siftwell.operators import ranking
from siftwell.operators.aggregates import column_aggregates, text_extremes, text_literal
from siftwell.operators.calibrate import calibrate, rounded, scaled_count
from siftwell.operators.classify import FACT_FIELDS, classify, whole
from siftwell.operators.details import column_details
from siftwell.operators.frequency import SUMMARY_FIELDS, frequency_summary
from siftwell.operators.histogram import (
    DateBuckets,
    NumericBins,
    bin_counts,
    date_frame,
    date_grain,
    instant_of,
    numeric_frame,
)
from siftwell.operators.integrity import collapsed_edges, orphan_report, relationships, repeat_report
from siftwell.operators.value_types import cast_kinds, number_kind
from siftwell.plans.local import local_frame
from siftwell.sources.constraints import Constraints, ResolvedKey
from siftwell.sources.dataset import Dataset, Relation, UnreadableTable, first_line
from siftwell.sources.sampling import gathered, hash_sample, random_sample

TABLE_FIELDS = {
    "table": "string",
    "type": "string",
    "ordinal": "int",
    "row_count": "bigint",
    "column_count": "int",
    "sample_rows": "bigint",
    "error": "string",
}
SPAN_FIELDS = {"table": "string", "ordinal": "int", "first_day": "double", "last_day": "double"}
GRAIN_FIELDS = {"table": "string", "ordinal": "int", "grain": "string"}
BOUND_FIELDS = {"table": "string", "ordinal": "int", "lo": "double", "hi": "double"}
COUNT_FIELDS = {"table": "string", "ordinal": "int", "bin": "int", "n": "bigint"}
DETAIL_KEY = ("table", "ordinal")
EXACT_FIGURES = ("count", "one_value", "min_text", "max_text", "min_num", "max_num", "avg", "sketch")


@dataclass(frozen=True)
class ProfileOptions:
    """How large tables are profiled.

    Every table is profiled in full unless ``sample_above`` is given: tables with more rows
    then take distinct counts, top values and histograms from a sample of about ``sample_size`` rows. ``sketch_distinct`` takes the distinct counts of sampled tables from
    sketches of all their rows, which is closer than scaling up the sample and costs no
    further scan. ``trust_unique=True`` takes columns declared unique at their word and does not
    count their values. ``keep_views`` holds the rows of views in executors (memory, then disk) while they are
    profiled, for views that are costly and small; others are computed in each pass.
    ``sample_keys`` names columns whose hash picks the sample of a
    table instead of a random number. ``parallel_tables`` queries run at a time.
    """

    sample_above: int | None = None
    sample_size: int = 200_000
    seed: int = 7
    sample_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    parallel_tables: int = 8
    sketch_distinct: bool = False
    trust_unique: bool = False
    keep_views: bool = False


@dataclass
class _TableResult:
    """What is known of one table: its frames while it is profiled, and collected metadata."""

    relation: Relation
    df: DataFrame | None = None
    source: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)
    row_count: int = 0
    column_count: int = 0
    sample_rows: int | None = None
    error: str | None = None
    step: str = ""
    exact: list[dict] = field(default_factory=list)
    aggregates: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    top: list[dict] = field(default_factory=list)
    bounds: list[dict] = field(default_factory=list)
    grains: list[dict] = field(default_factory=list)
    counts: list[dict] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.relation.name

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def fail(self, error: BaseException) -> None:
        """The table is reported as unreadable, without any figures."""
        self.release()
        message = str(error) if isinstance(error, UnreadableTable) else first_line(error)
        self.__dict__.update(_TableResult(self.relation, error=message, step=self.step).__dict__)


class _Run:
    """One profiling run: every table goes through all passes on its own.

    A table whose query fails ends there; the others go on. When the run is interrupted, the jobs of all its tables are cancelled.
    """

    def __init__(self, dataset: Dataset, options: ProfileOptions):
        self.dataset = dataset
        self.spark = dataset.spark
        self.options = options
        self.tag = f"siftwell-{uuid.uuid4().hex}"
        self.keys = dataset.foreign_keys()
        self.results = [_TableResult(relation) for relation in dataset.relations()]

    def run(self) -> list[_TableResult]:
        with ThreadPoolExecutor(max_workers=self.options.parallel_tables) as pool:
            tables = [pool.submit(self._advance, result) for result in self.results]
            try:
                for table in tables:
                    table.result()
            except BaseException:
                for table in tables:
                    table.cancel()
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                raise
        return self.results

    def _advance(self, result: _TableResult) -> None:
        steps = {
            "open": self._open,
            "aggregates": self._aggregate,
            "sample": self._take_sample,
            "sample aggregates": self._aggregate_sample,
            "text extremes": self._add_extremes,
            "bounds": self._plan_bins,
            "value frequencies": self._count_values,
            "histograms": self._fill_bins,
        }
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            for result.step, step in steps.items():
                context.setJobDescription(f"{result.name}: {result.step}")
                step(result)
        except Exception as error:  # whatever is wrong with a table stays with the table
            result.fail(error)
        finally:
            result.release()
            context.removeJobTag(self.tag)
            context.setJobDescription(None)

    # -- passes -----------------------------------------------------------------------

    def _open(self, result: _TableResult) -> None:
        df = self.dataset.stored(result.name)
        held = result.relation.type == "view" and self.options.keep_views
        result.df = result.source = result.hold(df) if held else df

    def _aggregate(self, result: _TableResult) -> None:
        if not result.df.columns:
            return
        # Without a threshold nothing is sampled, and every distinct count is exact.
        sketch = self.options.sketch_distinct and self.options.sample_above is not None
        exact = _by_ordinal(column_aggregates(result.df, sketch).collect())
        if self.dataset.is_untyped(result.name):
            exact = self._bind_types(result, exact, sketch)
        result.exact = result.aggregates = exact
        result.row_count = exact[0]["row_count"]
        result.column_count = len(exact)

    def _bind_types(self, result: _TableResult, exact: list[dict], sketch: bool) -> list[dict]:
        """Text columns that hold only numbers get their types from the masks of this pass, and the figures of numbers."""
        texts = [f.name for f in result.df.schema.fields if isinstance(f.dataType, T.StringType)]
        kinds = {a["column"]: number_kind(a["type_mask"]) for a in exact if a["column"] in texts}
        lengths = {a["column"]: a["max_len"] for a in exact}
        result.df = result.source = cast_kinds(result.df, kinds, lengths)
        self.dataset.bind(result.name, result.df)
        numbers = [a["ordinal"] for a in exact if kinds.get(a["column"])]
        if numbers:
            typed = result.df.select(*[F.col(quoted(result.df.columns[o])) for o in numbers])
            for ordinal, row in zip(numbers, _by_ordinal(column_aggregates(typed, sketch).collect())):
                exact[ordinal] = {**row, "ordinal": ordinal}
        return exact

    def _aggregate_sample(self, result: _TableResult) -> None:
        if result.source is not result.df:
            result.aggregates = _by_ordinal(column_aggregates(result.source).collect())
            result.sample_rows = result.aggregates[0]["row_count"]

    def _add_extremes(self, result: _TableResult) -> None:
        for df, aggregates in [(result.df, result.exact)] + [(result.source, result.aggregates)] * (result.source is not result.df):
            extremes = self._dated_extremes(result, df)
            if extremes is not None:
                _add_extremes(aggregates, extremes.first())

    def _count_values(self, result: _TableResult) -> None:
        if result.facts:
            filled = [fact["column"] for fact in result.facts if fact["count"]]
            summary = frequency_summary(result.source, filled, self._unique(result), bins=self._bins(result))
            self._add_counts(result, [row.asDict() for row in summary.collect()])

    def _fill_bins(self, result: _TableResult) -> None:
        """Keeps the bins of columns that are shown as histograms; those of columns that were not counted are scanned for."""
        if not result.bounds and not result.grains:
            return
        charted = {row["ordinal"] for row in self._classified(result).where("chart = 'histogram'").select("ordinal").collect()}
        result.bounds, result.grains, result.counts = (
            [row for row in rows if row["ordinal"] in charted] for rows in (result.bounds, result.grains, result.counts)
        )
        missing = [spec for spec in self._bins(result) if spec.name in self._unique(result)]
        if missing:
            result.counts += [{**row.asDict(), "table": result.name} for row in bin_counts(result.source, missing).collect()]

    def _take_sample(self, result: _TableResult) -> None:
        options = self.options
        if options.sample_above is None or result.row_count <= options.sample_above:
            return
        key = options.sample_keys.get(result.name)
        sample = (
            hash_sample(result.df, key, result.row_count, options.sample_size)
            if key
            else random_sample(result.df, result.row_count, options.sample_size, options.seed)
        )
        result.source = result.hold(gathered(sample, options.sample_size))

    def _dated_extremes(self, result: _TableResult, df: DataFrame) -> DataFrame | None:
        """Extremes of the text columns that hold dates, the only text shown by its range."""
        dates = DATE_BIT | DATETIME_BIT
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        dated = [a["ordinal"] for a in result.exact if a["column"] in text and a["type_mask"] and a["type_mask"] | dates == dates]
        return text_extremes(df, dated) if dated else None

    def _constraints(self, result: _TableResult) -> Constraints:
        return self.dataset.constraints if result.relation.type == "table" else Constraints()

    def _unique(self, result: _TableResult) -> set[str]:
        if not self.options.trust_unique:
            return set()
        return self._constraints(result).unique_columns(result.name) & set(result.source.columns)

    def _add_facts(self, result: _TableResult) -> None:
        """What is known of each column before its values are counted."""
        name, constraints, unique = result.name, self._constraints(result), self._unique(result)
        targets = {a: key.target for key in self.keys if key.table == name for a, _ in key.pairs}
        declared = self.dataset.declared_types.get(name, {})
        sampled = result.source is not result.df
        kinds = self._declared_kinds(declared)
        for a in result.aggregates:
            data_type = result.source.schema.fields[a["ordinal"]].dataType
            fact = {
                **a,
                "table": name,
                "type": result.relation.type,
                "declared_type": declared.get(a["column"], data_type.simpleString()) or "(none)",
                "base_kind": fitting_kind(kind_of_type(data_type), kinds.get(a["column"])),
                "pk": a["column"] in constraints.primary_key(name),
                "not_null": a["column"] in constraints.not_null.get(name, ()),
                "generated": a["column"] in constraints.generated.get(name, ()),
                "fk": targets.get(a["column"]),
                "is_unique": a["column"] in unique,
                "distinct_count": a["count"] if a["column"] in unique else None,
                "has_dates": False,
                "approx": sampled,
            }
            if sampled:
                whole = result.exact[a["ordinal"]]
                fact |= {f"exact_{k}": whole[k] for k in EXACT_FIGURES}
                fact |= {"total_rows": whole["row_count"], "exact_mask": whole["type_mask"]}
            result.facts.append(fact)

    def _add_counts(self, result: _TableResult, summary: list[dict]) -> None:
        """Distinct counts, top values and bins of the counted values; a column's distinct count is the sum over its bins."""
        counted = Counter()
        for row in summary:
            if row["rank"] == 0:
                counted[row["ordinal"]] += row["distinct_count"]
        for fact in result.facts:
            data_type = result.source.schema.fields[fact["ordinal"]].dataType
            if not fact["is_unique"] and value_class(data_type):
                fact["distinct_count"] = counted[fact["ordinal"]]
        result.top = [{**row, "table": result.name} for row in summary if row["rank"] > 0]
        result.counts = [
            {"table": result.name, "ordinal": row["ordinal"], "bin": row["bin"], "n": row["value_count"]}
            for row in summary
            if row["bin"] is not None
        ]

    def _declared_kinds(self, declared: Mapping[str, str]) -> dict[str, str]:
        """Kinds of the columns whose types are declared beside the data."""
        names = local_frame(self.spark, [{"column": n, "declared": t} for n, t in declared.items()], {"column": "string", "declared": "string"})
        return {row["column"]: row["kind"] for row in names.select("column", declared_kind(F.col("declared")).alias("kind")).collect()} if declared else {}

    def _classified(self, result: _TableResult) -> DataFrame:
        return classify(local_frame(self.spark, result.facts, FACT_FIELDS))

    def _plan_bins(self, result: _TableResult) -> None:
        """Bounds and grains of the columns whose chart is a histogram unless their distinct counts turn out to be few."""
        if not result.aggregates:
            return
        self._add_facts(result)
        grains = self._date_grains(result)
        for ordinal in grains:
            result.facts[ordinal]["has_dates"] = True
        charts = self._classified(result).where("chart = 'histogram'").select("ordinal", "kind")
        for ordinal, kind in charts.collect():
            fact = result.facts[ordinal]
            if kind in DATE_KINDS:
                result.grains.append({"table": result.name, "ordinal": ordinal, "grain": grains[ordinal]})
            else:
                low, high = (fact["exact_" + n] if fact["approx"] else fact[n] for n in ("min_num", "max_num"))
                result.bounds.append({"table": result.name, "ordinal": ordinal, "lo": low, "hi": high})

    def _bins(self, result: _TableResult) -> list[NumericBins | DateBuckets]:
        specs: list[NumericBins | DateBuckets] = []
        for b in result.bounds:
            fact = result.facts[b["ordinal"]]
            # As text, the extremes of whole numbers are exact beyond 2^53.
            whole = fact["base_kind"] == "integer"
            texts = [fact["exact_" + n] if fact["approx"] else fact[n] for n in ("min_text", "max_text")]
            low, high = map(int, texts) if whole else (b["lo"], b["hi"])
            specs.append(NumericBins(fact["column"], low, high))
        return specs + [DateBuckets(result.facts[g["ordinal"]]["column"], g["grain"]) for g in result.grains]

    def _date_grains(self, result: _TableResult) -> dict[int, str]:
        """Grain of the time histogram of every column with dates.

        The extremes already known give the span. Text whose first or last value in text
        order does not parse is scanned for the first and last value that does.
        """
        rows = (
            self._classified(result)
            .where(F.col("kind").isin(*DATE_KINDS) & (F.col("count") > 0))
            .selectExpr(
                "table",
                "ordinal",
                f"({iso_seconds(whole('min_text'))}) / {SECONDS_PER_DAY} AS first_day",
                f"({iso_seconds(whole('max_text'))}) / {SECONDS_PER_DAY} AS last_day",
            )
        )
        spans = {row["ordinal"]: row.asDict() for row in rows.collect()}
        unparsed = [o for o, s in spans.items() if s["first_day"] is None or s["last_day"] is None]
        if unparsed:
            fields = result.source.schema.fields
            moments = [(o, instant_of(fields[o].name, fields[o].dataType)) for o in unparsed]
            extremes = [F.min(m).alias(f"first_{o}") for o, m in moments] + [F.max(m).alias(f"last_{o}") for o, m in moments]
            found = result.source.agg(*extremes).first()
            for o in unparsed:
                spans[o] |= {"first_day": found[f"first_{o}"], "last_day": found[f"last_{o}"]}
        dated = local_frame(self.spark, spans.values(), SPAN_FIELDS)
        grains = dated.select("ordinal", date_grain(F.col("last_day") - F.col("first_day")).alias("grain"))
        return {row["ordinal"]: row["grain"] for row in grains.collect() if row["grain"] is not None}


def _add_extremes(aggregates: list[dict], extremes: Row) -> None:
    for name, value in extremes.asDict().items():
        side, ordinal = name.split("_")
        aggregates[int(ordinal)][f"{side}_text"] = value


def _by_ordinal(rows: list[Row]) -> list[dict]:
    return sorted((row.asDict() for row in rows), key=lambda row: row["ordinal"])


def table_catalog(dataset: Dataset) -> DataFrame:
    """Every table and view with its rows and columns, without profiling it.

    One query counts all members; row counts of parquet and ORC come from file footers.
    Members that cannot be opened have an error and no rows.
    """
    counts = []
    for ordinal, relation in enumerate(dataset.relations()):
        known = f"{text_literal(relation.name)} AS table", f"'{relation.type}' AS type", f"{ordinal} AS ordinal"
        try:
            df = dataset.stored(relation.name)
            rows = df.selectExpr("count(1) AS row_count")
            counts.append(rows.selectExpr(*known, "row_count", f"{len(df.columns)} AS column_count", "CAST(NULL AS string) AS error"))
        except UnreadableTable as error:
            row = {"table": relation.name, "type": relation.type, "ordinal": ordinal, "row_count": 0, "column_count": 0}
            frame = local_frame(dataset.spark, [{**row, "error": str(error)}], TABLE_FIELDS)
            counts.append(frame.drop("sample_rows"))
    return reduce(DataFrame.unionAll, counts)


# -- the dataset ----------------------------------------------------------------------


class DatasetProfile:
    """The profile of a dataset as flat frames.

    ``tables``, ``columns``, ``top_values``, ``histogram``, ``relationships`` and
    ``findings`` can be queried, joined and written like any frame.
    """

    def __init__(self, dataset: Dataset, results: list[_TableResult], keys: list[ResolvedKey]):
        self.spark = dataset.spark
        self.name = dataset.name
        self._dataset = dataset
        self._results = results
        self.constraints = dataset.constraints
        self.keys = keys

    @property
    def size_bytes(self) -> int | None:
        return self._dataset.size_bytes

    def _rows(self, part: str, fields: dict[str, str]) -> DataFrame:
        return local_frame(self.spark, [row for r in self._results for row in getattr(r, part)], fields)

    @cached_property
    def tables(self) -> DataFrame:
        """One row per table and view: rows, columns, sample size, error."""
        rows = [
            {
                "table": r.relation.name,
                "type": r.relation.type,
                "ordinal": ordinal,
                "row_count": r.row_count,
                "column_count": r.column_count,
                "sample_rows": r.sample_rows,
                "error": r.error,
            }
            for ordinal, r in enumerate(self._results)
        ]
        return local_frame(self.spark, rows, TABLE_FIELDS)

    def failed_steps(self) -> dict[str, str]:
        """The pass in which each unreadable table failed."""
        return {r.name: r.step for r in self._results if r.error is not None}

    @cached_property
    def _calibrated(self) -> DataFrame:
        return calibrate(classify(self._rows("facts", FACT_FIELDS)))

    @cached_property
    def columns(self) -> DataFrame:
        """One row per column: kind, counts, range, chart, interest."""
        return self._calibrated.select(
            "table",
            "ordinal",
            "column",
            "declared_type",
            "kind",
            "pk",
            "not_null",
            "generated",
            "approx",
            "fk",
            "count",
            "null_count",
            "distinct_count",
            "null_fraction",
            "min",
            "max",
            "min_num",
            "max_num",
            "avg",
            "chart",
            "interest",
            "storage_types",
        )

    def _scales(self) -> DataFrame:
        return self._calibrated.select(*DETAIL_KEY, "column", "scale", "near_unique", "top_limit")

    @cached_property
    def top_values(self) -> DataFrame:
        """Kept top values per column, counts scaled to the full table."""
        top = self._rows("top", {"table": "string", **SUMMARY_FIELDS})
        return (
            top.join(self._scales(), list(DETAIL_KEY))
            .where(F.col("rank") <= F.col("top_limit"))
            .select(
                "table",
                "ordinal",
                "column",
                "rank",
                "value",
                "value_num",
                scaled_count(F.col("value_count"), F.col("scale"), F.col("near_unique")).alias("value_count"),
            )
        )

    @cached_property
    def histogram(self) -> DataFrame:
        """Bins and time buckets per charted column, counts scaled to the full table."""
        counts = self._rows("counts", COUNT_FIELDS)
        grains = self._rows("grains", GRAIN_FIELDS)
        numbers = numeric_frame(counts, self._rows("bounds", BOUND_FIELDS), DETAIL_KEY)
        dates = date_frame(counts.join(grains.select(*DETAIL_KEY), list(DETAIL_KEY), "left_semi"), grains, DETAIL_KEY)
        scales = self._scales().select(*DETAIL_KEY, "column", "scale")
        return (
            numbers.unionByName(dates)
            .join(scales, list(DETAIL_KEY))
            .select(
                "table",
                "ordinal",
                "column",
                "bin",
                "lo",
                "hi",
                rounded(F.col("count") * F.col("scale")).alias("count"),
                "label",
                "date_fmt",
            )
        )

    @cached_property
    def relationships(self) -> DataFrame:
        """One edge per foreign key."""
        return relationships(self.spark, self.keys)

    def edges(self) -> DataFrame:
        """Edges with parallel ones merged."""
        return collapsed_edges(self.relationships)

    @cached_property
    def orphans(self) -> DataFrame:
        """Rows without a parent per foreign key; scans the keys once, when first asked for."""
        frames = {
            r.relation.name: self._dataset.open(r.relation.name) if r.error is None else None
            for r in self._results
            if r.relation.type == "table"
        }
        counts = {r.relation.name: r.row_count for r in self._results if r.error is None}
        counts |= {r.relation.name: 0 for r in self._results if r.error is not None}
        return orphan_report(self.spark, frames, self.keys, counts)

    @cached_property
    def repeats(self) -> DataFrame:
        """Rows that repeat a value of a key declared unique, per key; composite and partial keys are counted when first asked for."""
        tables = [r for r in self._results if r.relation.type == "table" and r.error is None]
        frames = {r.name: self._dataset.open(r.name) for r in tables}
        keys = [key for r in tables for key in self.constraints.declared_unique(r.name)]
        known = {
            (r.name, f["column"]): f["count"] - f["distinct_count"]
            for r in tables
            for f in r.facts
            if not f["approx"] and not f["is_unique"] and f["distinct_count"] is not None
        }
        return repeat_report(self.spark, frames, keys, known)

    @cached_property
    def unresolved_keys(self) -> DataFrame:
        """Foreign keys that cannot be resolved, with the reason."""
        rows = [dict(zip(("table", "first_column", "message"), e), position=i) for i, e in enumerate(self._dataset.key_errors())]
        return local_frame(self.spark, rows, {"table": "string", "first_column": "string", "message": "string", "position": "int"})

    @cached_property
    def findings(self) -> DataFrame:
        """Ranked data-quality findings."""
        return findings_ops.findings(self.columns, self.tables, self.orphans, self.repeats, self.unresolved_keys)

    def details(self, table: str, name: str) -> DataFrame:
        """Extended statistics of one column, over all its rows even where it was sampled."""
        about = self.columns.where((F.col("table") == table) & (F.col("column") == name)).first()
        return column_details(self._dataset.open(table), name, about["kind"], about["distinct_count"], about["approx"])

    def rollup(self) -> DataFrame:
        return ranking.dataset_rollup(self.tables, self.relationships)

    def highlights(self) -> DataFrame:
        return ranking.highlights(self.columns, self.tables)

    def table_ranking(self) -> DataFrame:
        return ranking.table_ranking(self.columns, self.tables)


def profile_dataset(dataset: Dataset, options: ProfileOptions | None = None) -> DatasetProfile:
    """Profile every table and view of a dataset."""
    run = _Run(dataset, options or ProfileOptions())
    return DatasetProfile(dataset, run.run(), run.keys)


def profile_table(
    df: DataFrame,
    name: str = "table",
    constraints: Constraints | None = None,
    options: ProfileOptions | None = None,
) -> DatasetProfile:
    """Profile one frame as a table."""
    dataset = Dataset.from_frames(df.sparkSession, {name: df}, constraints=constraints, name=name)
    return profile_dataset(dataset, options)
