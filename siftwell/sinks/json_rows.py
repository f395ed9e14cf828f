"""A profile's JSON document read back as rows.

Every function takes documents as ``profile_json`` writes them (a column ``json``; any number of them) and
gives one flat frame. Nested arrays are walked by lateral ``variant_explode``; the document is parsed
once and values keep the types that they have in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_MEMBER = """
SELECT variant_get(m.value, '$.name', 'string') AS `table`, variant_get(m.value, '$.type', 'string') AS type,
       variant_get(m.value, '$.rowCount', 'bigint') AS row_count, variant_get(m.value, '$.error', 'string') AS error, m.value AS member
FROM (SELECT parse_json(json) AS d FROM {{documents}}), LATERAL variant_explode(variant_get(d, '$.{members}')) m
"""

_MEMBERS = " UNION ALL ".join(_MEMBER.format(members=m) for m in ("tables", "views"))

_COLUMNS = f"""
SELECT `table`, CAST(c.pos AS int) AS position, variant_get(c.value, '$.name', 'string') AS `column`, c.value AS body
FROM ({_MEMBERS}), LATERAL variant_explode(variant_get(member, '$.columns')) c
"""


def _rows(documents: DataFrame, query: str) -> DataFrame:
    return documents.sparkSession.sql(query, documents=documents)


def json_tables(documents: DataFrame) -> DataFrame:
    """table, type, row_count, error of every table and view."""
    return _rows(documents, f"SELECT `table`, type, row_count, error FROM ({_MEMBERS})")


def json_columns(documents: DataFrame) -> DataFrame:
    """table, position, column, kind, counts, and how many top values and bins the document holds (outer: 0 for none)."""
    return _rows(
        documents,
        f"""
        SELECT `table`, position, `column`, variant_get(any_value(body), '$.kind', 'string') AS kind,
               variant_get(any_value(body), '$.count', 'bigint') AS `count`, variant_get(any_value(body), '$.nullCount', 'bigint') AS null_count,
               variant_get(any_value(body), '$.distinctCount', 'bigint') AS distinct_count, count(b.pos) AS bins
        FROM ({_COLUMNS}), LATERAL variant_explode_outer(variant_get(body, '$.histogram')) b
        GROUP BY `table`, position, `column`
        """,
    )


def json_top_values(documents: DataFrame) -> DataFrame:
    """table, column, rank from 1, value as text, value_count."""
    return _rows(
        documents,
        f"""
        SELECT `table`, `column`, CAST(t.pos AS int) + 1 AS rank, variant_get(t.value, '$.value', 'string') AS value,
               variant_get(t.value, '$.count', 'bigint') AS value_count
        FROM ({_COLUMNS}), LATERAL variant_explode(variant_get(body, '$.topValues')) t
        """,
    )


def json_bins(documents: DataFrame) -> DataFrame:
    """table, column, bin from 0, count, lo, hi, label, date_fmt."""
    return _rows(
        documents,
        f"""
        SELECT `table`, `column`, CAST(b.pos AS int) AS bin, variant_get(b.value, '$.count', 'bigint') AS `count`,
               try_variant_get(b.value, '$.lo', 'double') AS lo, try_variant_get(b.value, '$.hi', 'double') AS hi,
               variant_get(b.value, '$.label', 'string') AS label, variant_get(b.value, '$.dateFmt', 'string') AS date_fmt
        FROM ({_COLUMNS}), LATERAL variant_explode(variant_get(body, '$.histogram')) b
        """,
    )


def json_keys(documents: DataFrame) -> DataFrame:
    """table, key_id, seq, from_column, parent, to_column: a row for each pair of columns of each foreign key."""
    return _rows(
        documents,
        f"""
        SELECT DISTINCT `table`, variant_get(k.value, '$.id', 'int') AS key_id, CAST(p.pos AS int) AS seq,
               variant_get(p.value, '$.from', 'string') AS from_column, variant_get(k.value, '$.table', 'string') AS parent,
               variant_get(p.value, '$.to', 'string') AS to_column
        FROM ({_MEMBERS}), LATERAL variant_explode(variant_get(member, '$.foreignKeys')) k,
        LATERAL variant_explode(variant_get(k.value, '$.pairs')) p
        """,
    )


def json_unique_keys(documents: DataFrame) -> DataFrame:
    """table, name, partial, seq, column of every unique key."""
    return _rows(
        documents,
        f"""
        SELECT `table`, variant_get(k.value, '$.name', 'string') AS name, variant_get(k.value, '$.partial', 'boolean') AS partial,
               CAST(c.pos AS int) AS seq, CAST(c.value AS string) AS `column`
        FROM ({_MEMBERS}), LATERAL variant_explode(variant_get(member, '$.indexes')) k,
        LATERAL variant_explode(variant_get(k.value, '$.columns')) c
        """,
    )


def json_findings(documents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The findings with the given fields (name to type)."""
    fields = ", ".join(f"variant_get(f.value, '$.{n}', '{t}') AS `{n}`" for n, t in columns.items())
    return _rows(documents, f"SELECT {fields} FROM (SELECT parse_json(json) AS d FROM {{documents}}), LATERAL variant_explode(variant_get(d, '$.findings')) f")


def json_relationships(documents: DataFrame) -> DataFrame:
    """from_table, to_table, columns of every edge."""
    return _rows(
        documents,
        """
        SELECT variant_get(e.value, '$.from', 'string') AS from_table, variant_get(e.value, '$.to', 'string') AS to_table,
               variant_get(e.value, '$.columns', 'string') AS columns
        FROM (SELECT parse_json(json) AS d FROM {documents}), LATERAL variant_explode(variant_get(d, '$.relationships')) e
        """,
    )
