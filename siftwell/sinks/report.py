"""A profile as JSON and as Markdown.

Both are built from the flat profile frames, whose size follows the number of columns and
not the number of data rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.kinds import NUMERIC_KINDS
from siftwell.operators.findings import FINDING_COLUMNS
from siftwell.plans.local import local_frame
from siftwell.plans.profile import DatasetProfile

KEY_FIELDS = {
    "table": "string",
    "id": "int",
    "seq": "int",
    "from": "string",
    "parent": "string",
    "to": "string",
}
UNIQUE_FIELDS = {"table": "string", "name": "string", "partial": "boolean", "columns": "string"}
COLUMN_SEPARATOR = "\u001f"


# -- JSON -----------------------------------------------------------------------------


def profile_json(profile: DatasetProfile, pretty: bool = False) -> DataFrame:
    """The whole profile as one JSON document (column ``json``); absent values are left out."""
    tables = _table_objects(profile)
    found = profile.findings.agg(
        _ordered("position", F.struct(*FINDING_COLUMNS)).alias("findings"),
    )
    edges = profile.relationships.agg(
        _ordered(
            "from_table",
            F.struct(
                F.col("fk_id"), F.col("from_table").alias("from"), F.col("to_table").alias("to"), F.col("columns")
            ),
        ).alias("edges")
    )
    members = tables.groupBy().agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("ordinal", "json")))),
                lambda t: t["json"],
            ).alias(f"{kind}s")
            for kind in ("table", "view")
        ],
        F.coalesce(F.sum(F.when(F.col("type") == "table", F.col("row_count"))), F.lit(0)).alias("totalRows"),
    )
    options = {"pretty": "true"} if pretty else {}
    edge = F.transform("edges", lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), e["columns"].alias("columns")))
    document = F.struct(
        F.lit(profile.name).alias("name"),
        F.lit(profile.size_bytes).cast("bigint").alias("size"),
        *[F.transform(kind, lambda t: F.parse_json(t)).alias(kind) for kind in ("tables", "views")],
        F.col("totalRows"),
        edge.alias("relationships"),
        F.col("findings"),
    )
    # One row each: the parts of one document.
    return members.crossJoin(edges).crossJoin(found).select(F.to_json(document, options).alias("json"))


def table_json(profile: DatasetProfile) -> DataFrame:
    """One JSON document per table and view (columns ``table``, ``json``)."""
    return _table_objects(profile).select("table", "json")


def write_json(profile: DatasetProfile, path: str) -> None:
    """The tables of the profile as a directory of JSON lines."""
    table_json(profile).select("json").write.mode("error").text(path)


def _ordered(key: str, value: Column) -> Column:
    """All values of a group as an array in the order of a key column."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
    return F.transform(pairs, lambda pair: pair["v"])


def _typed(kind: Column, text: Column, number: Column) -> Column:
    """A value as a JSON number or string, by the kind of its column."""
    whole = text.try_cast("bigint")
    return (
        F.when((kind == "integer") & whole.isNotNull(), whole.cast("variant"))
        .when(kind.isin(*NUMERIC_KINDS, "boolean") & number.isNotNull(), number.cast("variant"))
        .otherwise(text.cast("variant"))
    )


def _table_objects(profile: DatasetProfile) -> DataFrame:
    columns = _column_objects(profile)
    keys, unique = _key_objects(profile), _unique_objects(profile)
    empty = F.array()
    body = F.struct(
        F.col("table").alias("name"),
        F.col("type"),
        F.col("row_count").alias("rowCount"),
        F.transform(F.coalesce("columns", empty), lambda c: F.parse_json(c)).alias("columns"),
        F.transform(F.coalesce("foreignKeys", empty), lambda k: F.parse_json(k)).alias("foreignKeys"),
        F.transform(F.coalesce("indexes", empty), lambda k: F.parse_json(k)).alias("indexes"),
        F.when(F.col("sample_rows").isNotNull(), F.struct(F.col("sample_rows").alias("rows"))).alias("sample"),
        F.col("error"),
    )
    return (
        profile.tables.join(columns, "table", "left")
        .join(keys, "table", "left")
        .join(unique, "table", "left")
        .select("table", "type", "ordinal", "row_count", F.to_json(body).alias("json"))
    )


def _column_objects(profile: DatasetProfile) -> DataFrame:
    """Per table, its columns in order as JSON objects."""
    kinds = profile.columns.select("table", "ordinal", "kind")
    top_rows = _ordered("rank", F.struct("value", "value_num", "value_count", "kind"))
    top = (
        profile.top_values.join(kinds, ["table", "ordinal"])
        .groupBy("table", "ordinal")
        .agg(top_rows.alias("top"))
        .select(
            "table",
            "ordinal",
            F.transform(
                "top",
                lambda t: F.struct(
                    _typed(t["kind"], t["value"], t["value_num"]).alias("value"), t["value_count"].alias("count")
                ),
            ).alias("topValues"),
        )
    )
    bin_fields = F.struct("lo", "hi", "count", "label", F.col("date_fmt").alias("dateFmt"))
    bins = profile.histogram.groupBy("table", "ordinal").agg(_ordered("bin", bin_fields).alias("histogram"))
    body = F.struct(
        F.col("column").alias("name"),
        F.col("declared_type").alias("declaredType"),
        "kind",
        "pk",
        F.col("not_null").alias("notNull"),
        F.when(F.col("generated"), F.lit(True)).alias("generated"),
        F.when(F.col("approx"), F.lit(True)).alias("approx"),
        F.col("fk"),
        "count",
        F.col("null_count").alias("nullCount"),
        F.col("distinct_count").alias("distinctCount"),
        F.col("null_fraction").alias("nullFraction"),
        _typed(F.col("kind"), F.col("min"), F.col("min_num")).alias("min"),
        _typed(F.col("kind"), F.col("max"), F.col("max_num")).alias("max"),
        "avg",
        "topValues",
        "histogram",
        "chart",
        "interest",
        F.col("storage_types").alias("storageTypes"),
    )
    return (
        profile.columns.join(top, ["table", "ordinal"], "left")
        .join(bins, ["table", "ordinal"], "left")
        .groupBy("table")
        .agg(_ordered("ordinal", F.to_json(body)).alias("columns"))
    )


def _key_objects(profile: DatasetProfile) -> DataFrame:
    """Per table, one object per referencing column, each with all pairs of its key."""
    rows = [
        {"table": key.table, "id": key.id, "seq": seq, "from": a, "parent": key.parent, "to": b}
        for key in profile.keys
        for seq, (a, b) in enumerate(key.pairs)
    ]
    flat = local_frame(profile.spark, rows, KEY_FIELDS)
    pairs = flat.groupBy("table", "id").agg(_ordered("seq", F.struct("from", "to")).alias("pairs"))
    body = F.struct("id", "from", F.col("parent").alias("table"), "to", "pairs")
    position = F.col("id") * 1000 + F.col("seq")
    return (
        flat.join(pairs, ["table", "id"])
        .withColumn("position", position)
        .groupBy("table")
        .agg(_ordered("position", F.to_json(body)).alias("foreignKeys"))
    )


def _unique_objects(profile: DatasetProfile) -> DataFrame:
    rows = [
        {
            "table": key.table,
            "name": "unique_" + "_".join(key.columns),
            "partial": key.where is not None,
            "columns": COLUMN_SEPARATOR.join(key.columns),
        }
        for key in profile.constraints.unique_keys
    ]
    body = F.struct(
        "name", F.lit(True).alias("unique"), "partial", F.split("columns", COLUMN_SEPARATOR).alias("columns")
    )
    flat = local_frame(profile.spark, rows, UNIQUE_FIELDS)
    return flat.groupBy("table").agg(_ordered("name", F.to_json(body)).alias("indexes"))


# -- Markdown -------------------------------------------------------------------------


def profile_markdown(profile: DatasetProfile) -> DataFrame:
    """A readable report as ordered lines (columns ``line_no``, ``line``)."""
    parts = [_summary_lines(profile), _finding_lines(profile), _relationship_lines(profile), _table_lines(profile)]
    lines = reduce(DataFrame.unionByName, parts)
    order = Window.orderBy("section", "group", "part", "item", "within")  # report lines only
    return lines.select(F.row_number().over(order).alias("line_no"), "line")


def write_markdown(profile: DatasetProfile, path: str) -> None:
    """The report as a directory with one text file."""
    profile_markdown(profile).orderBy("line_no").select("line").coalesce(1).write.mode("error").text(path)


def _lines(df: DataFrame, section: int, group, part: int, item, lines: Column) -> DataFrame:
    """Lines of a report section; ``lines`` is an array per input row."""
    return df.select(
        F.lit(section).alias("section"),
        group.cast("int").alias("group"),
        F.lit(part).alias("part"),
        item.cast("int").alias("item"),
        F.posexplode(lines).alias("within", "line"),
    )


def _grouped(value: Column) -> Column:
    return F.format_number(value, 0)


def _summary_lines(profile: DatasetProfile) -> DataFrame:
    def fact(label: str, value) -> Column:
        return F.concat(F.lit(f"- **{label}:** "), value)

    lines = F.array(
        F.lit(f"# Data profile — {profile.name}"),
        F.lit(""),
        fact("Tables", F.col("table_count").cast("string")),
        fact("Views", F.col("view_count").cast("string")),
        fact("Total rows", _grouped(F.col("total_rows"))),
        fact("File size", F.lit("unknown") if profile.size_bytes is None else F.concat(F.format_number(F.lit(profile.size_bytes).cast("bigint"), 0), F.lit(" bytes"))),
        fact("Relationships", F.col("relationship_count").cast("string")),
        F.lit(""),
    )
    return _lines(profile.rollup(), 0, F.lit(0), 0, F.lit(0), lines)


def _section(df: DataFrame, section: int, title: str, position: Column, line: Column) -> DataFrame:
    """A titled list; nothing at all when it is empty."""
    numbered = df.select(position.alias("position"), line.alias("line"))
    ends = numbered.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    head = _lines(ends, section, F.lit(0), 0, F.lit(0), F.array(F.lit(f"## {title}"), F.lit("")))
    body = _lines(numbered, section, F.lit(0), 1, F.col("position"), F.array("line"))
    tail = _lines(ends, section, F.lit(0), 2, F.lit(0), F.array(F.lit("")))
    return head.unionByName(body).unionByName(tail)


def _finding_lines(profile: DatasetProfile) -> DataFrame:
    detail = F.coalesce(F.concat(F.lit(" — "), F.col("detail")), F.lit(""))
    line = F.concat(F.lit("- **["), F.upper("severity"), F.lit("]** "), F.col("message"), detail)
    return _section(profile.findings, 1, "Data quality", F.col("position"), line)


def _relationship_lines(profile: DatasetProfile) -> DataFrame:
    line = F.concat(F.lit("- "), "from_table", F.lit(" → "), "to_table", F.lit(" ("), "columns", F.lit(")"))
    position = F.row_number().over(Window.orderBy("from_table", "fk_id"))  # one row per key
    return _section(profile.relationships, 2, "Relationships", position, line)


def _table_lines(profile: DatasetProfile) -> DataFrame:
    title = F.concat(
        F.lit("## "), "table", F.lit(" ("), "type", F.lit(") — "), _grouped(F.col("row_count")), F.lit(" rows")
    )
    note = F.concat(
        F.lit("_Distinct counts (≈), top values and bins come from "),
        _grouped(F.col("sample_rows")),
        F.lit(" sampled rows._"),
    )
    header = F.array(
        F.lit("| column | declared | kind | distinct values | missing | least | greatest |"), F.lit("|:--|:--|:--|--:|--:|:--|:--|")
    )
    sampled = F.when(F.col("sample_rows").isNotNull(), F.array(note, F.lit(""))).otherwise(F.array().cast("array<string>"))
    heads = _lines(
        profile.tables, 3, F.col("ordinal"), 0, F.lit(0), F.concat(F.array(title, F.lit("")), sampled, header)
    )
    tails = _lines(profile.tables, 3, F.col("ordinal"), 2, F.lit(0), F.array(F.lit("")))
    mark = F.when(F.col("pk"), F.lit(" 🔑")).when(F.col("fk").isNotNull(), F.lit(" 🔗")).otherwise(F.lit(""))
    cells = [
        F.concat("column", mark),
        F.col("declared_type"),
        F.col("kind"),
        F.coalesce(F.concat(F.when(F.col("approx"), F.lit("≈")).otherwise(F.lit("")), _grouped(F.col("distinct_count"))), F.lit("")),
        F.concat(F.floor(F.col("null_fraction") * 100 + 0.5).cast("string"), F.lit("%")),
        _cell("min"),
        _cell("max"),
    ]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    columns = profile.columns.join(profile.tables.select("table", F.col("ordinal").alias("table_ord")), "table")
    rows = _lines(columns, 3, F.col("table_ord"), 1, F.col("ordinal"), F.array(row))
    return heads.unionByName(rows).unionByName(tails)


def _cell(name: str) -> Column:
    return F.coalesce(F.replace(F.col(name), F.lit("|"), F.lit("\\|")), F.lit(""))
