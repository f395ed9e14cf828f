"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written from the definition of each figure, column by column, with nothing shared with the
Spark code but the names.
"""

from __future__ import annotations

from workload.fixtures import DERIVED, DERIVED_SCHEMAS, FOREIGN_KEYS, PRIMARY_KEYS, SAMPLE_SIZE, SCHEMAS

# The lexical patterns of text values.
INT = r"'^[+-]?[0-9]+$'"
REAL = r"'^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+[eE][+-]?[0-9]+$'"
DATE = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}'"
TIME = r"'[T ][0-9]{2}:[0-9]{2}'"
BOOL = r"'^(true|false)$', 'i'"
STAMP = "timestamp_ntz"


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ")) for part in schema.split(", ")]


def lexical(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, {INT}) THEN 'integer' WHEN regexp_matches({c}, {REAL}) THEN 'real' "
        f"WHEN regexp_matches({c}, {DATE}) THEN 'date' WHEN regexp_matches({c}, {BOOL}) THEN 'boolean' "
        f"WHEN {c} IS NOT NULL THEN 'text' END"
    )


def base_kind(data_type: str) -> str:
    return {
        "bigint": "integer",
        "int": "integer",
        "double": "real",
        "string": "text",
        STAMP: "datetime",
    }.get(data_type, "unknown")


def number_text(c: str) -> str:
    return rf"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '')"


def column_facts(relation: str, name: str, ordinal: int, column: str, data_type: str, fk: bool = False) -> str:
    """Counts and extremes of one column of a relation."""
    base = base_kind(data_type)
    c = f"({column} + 0.0)" if data_type == "double" else column
    numeric, text = base in ("integer", "real"), base == "text"
    shown = {"double": number_text}.get(data_type, lambda v: f"CAST({v} AS VARCHAR)")
    low, high = (shown(f"min({c})"), shown(f"max({c})")) if base != "unknown" else ("NULL", "NULL")
    pick = {
        "tbl": f"'{name}'",
        "ord": str(ordinal),
        "col": f"'{column}'",
        "base": f"'{base}'",
        "fk": str(fk).lower(),
        "n": "count(*)",
        "cnt": f"count({c})",
        "dist": f"count(DISTINCT {c})",
        "mn": f"CAST(min({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)",
        "mx": f"CAST(max({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)",
        "av": f"CAST(avg({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)",
        "mn_text": f"CAST({low} AS VARCHAR)",
        "mx_text": f"CAST({high} AS VARCHAR)",
        "mn_len": f"min(length({c}))" if text else "CAST(NULL AS BIGINT)",
        "mx_len": f"max(length({c}))" if text else "CAST(NULL AS BIGINT)",
        "types": f"count(DISTINCT {lexical(c)})" if text else f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END",
        "iso": f"bool_and(regexp_matches({c}, {DATE}))" if text else "NULL",
        "timed": f"bool_or(regexp_matches({c}, {TIME}))" if text else "NULL",
    }
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in pick.items()) + f" FROM {relation}"


def facts(tables: list[str], relation_of=lambda t: t, schemas: dict[str, str] | None = None, keys=True) -> str:
    """Facts of all columns of some tables."""
    shapes = {**SCHEMAS, **DERIVED_SCHEMAS, **(schemas or {})}
    children = {(k.table, c) for k in FOREIGN_KEYS if k.table in tables and k.parent in tables for c in k.columns}
    parts = [
        column_facts(relation_of(t), t, i, c, kind, keys and (t, c) in children)
        for t in tables
        for i, (c, kind) in enumerate(fields(shapes[t]))
    ]
    return " UNION ALL ".join(parts)


def profiled(facts_sql: str) -> str:
    """CTEs that classify facts: ``prof`` has one row per column."""
    return f"""
facts AS ({facts_sql}),
kinds AS (
  SELECT *, CASE
      WHEN base = 'text' AND cnt > 0 AND iso AND timed THEN 'datetime'
      WHEN base = 'text' AND cnt > 0 AND iso THEN 'date'
      WHEN base = 'integer' AND dist BETWEEN 1 AND 2 AND mn >= 0 AND mx <= 1 THEN 'boolean'
      ELSE base END AS kind,
    CASE WHEN n > 0 THEN (n - cnt) / CAST(n AS DOUBLE) ELSE 0 END AS nullf
  FROM facts),
charts AS (
  SELECT *, CASE
      WHEN cnt = 0 THEN 'none'
      WHEN kind IN ('integer', 'real') THEN
        CASE WHEN dist BETWEEN 2 AND 15 THEN 'bar' WHEN mx > mn THEN 'histogram' ELSE 'none' END
      WHEN kind IN ('date', 'datetime') THEN CASE WHEN dist BETWEEN 2 AND 40 THEN 'bar' ELSE 'histogram' END
      WHEN kind = 'boolean' THEN 'bar'
      WHEN kind = 'text' AND dist > 1 AND dist < cnt * 0.95 THEN 'bar'
      ELSE 'none' END AS chart
  FROM kinds),
{INTEREST}
"""


INTEREST = """prof AS (
  SELECT *, CASE WHEN cnt = 0 THEN 0.0 WHEN dist <= 1 THEN 0.05 ELSE greatest(0.0, least(1.0, (
      CASE chart
        WHEN 'bar' THEN 0.7 * CASE WHEN dist <= 30 THEN 1.0 WHEN dist <= 100 THEN 0.65 ELSE 0.4 END
        WHEN 'histogram' THEN CASE WHEN kind IN ('date', 'datetime') THEN 0.78 ELSE 0.7 END
        ELSE CASE WHEN dist / CAST(cnt AS DOUBLE) > 0.95 THEN 0.12 ELSE 0.4 END END
      + CASE WHEN fk THEN 0.15 ELSE 0 END + CASE WHEN kind = 'boolean' THEN 0.05 ELSE 0 END
    ) * (0.45 + 0.55 * (1 - nullf)))) END AS interest
  FROM charts)"""

SHOWN_MIN = (
    "CASE WHEN kind IN ('integer', 'real', 'date', 'datetime') THEN mn_text "
    "WHEN kind = 'text' AND chart = 'none' AND cnt > 0 THEN 'len ' || mn_len END"
)
SHOWN_MAX = SHOWN_MIN.replace("mn_", "mx_")
SHOWN_AVG = "CASE WHEN kind IN ('integer', 'real') THEN round(av, 4) END"

PROFILE_SELECT = f"""SELECT tbl AS "table", col AS "column", kind, cnt AS count, n - cnt AS null_count,
  dist AS distinct_count, round(nullf, 6) AS null_fraction, {SHOWN_MIN} AS min, {SHOWN_MAX} AS max,
  {SHOWN_AVG} AS avg, chart, CAST(round(interest, 6) AS DOUBLE) AS interest, CAST(types AS INTEGER) AS storage_types
FROM prof"""


def profile_of(tables: list[str], select: str = PROFILE_SELECT, **options) -> str:
    return f"WITH {profiled(facts(tables, **options))} {select}"


def derived(name: str) -> str:
    return f"({DERIVED[name]}) AS {name}"


def top_values(relation: str, columns: dict[str, str], top: int = 12, numbers: bool = True) -> str:
    """Most frequent values of columns; ``columns`` maps names to how their values are shown."""
    parts = []
    for c, shown in columns.items():
        number = f", CAST({'v' if shown == 'number' else 'NULL'} AS DOUBLE) AS value_num" if numbers else ""
        text = number_text("v") if shown == "number" else "v"
        value = f"{c} + 0.0" if shown == "number" else c
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(rank AS INTEGER) AS rank, CAST({text} AS VARCHAR) AS value{number}, "
            f"cnt AS value_count FROM (SELECT {value} AS v, count(*) AS cnt, "
            f"row_number() OVER (ORDER BY count(*) DESC, {value} ASC) AS rank FROM {relation} "
            f"WHERE {c} IS NOT NULL GROUP BY {value}) WHERE rank <= {top}"
        )
    return " UNION ALL ".join(parts)


def label_number(x: str) -> str:
    return f"rtrim(rtrim(format('{{:,.2f}}', round({x}, 2)), '0'), '.')"


def numeric_bins(relation: str, c: str) -> str:
    """CTE ``bins``: all 24 bins with their bounds and counts."""
    return f"""
m AS (SELECT CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx,
  CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE) AS rg FROM {relation}),
b AS (SELECT CAST(least(23, floor((CAST({c} AS DOUBLE) - mn) * 24 / rg)) AS INTEGER) AS bin, count(*) AS n
  FROM {relation}, m WHERE {c} IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(i AS INTEGER) AS bin, mn + i * (rg / 24) AS lo,
  CASE WHEN i = 23 THEN mx ELSE mn + i * (rg / 24) + rg / 24 END AS hi, coalesce(n, 0) AS count
  FROM range(24) AS r(i) CROSS JOIN m LEFT JOIN b ON b.bin = r.i)"""


def values_per_bin() -> str:
    """Rows and different values of each bin of two numeric columns and of each month of a date column."""
    parts = [
        f"""SELECT '{c}' AS "column", CAST(least(23, floor((CAST({c} AS DOUBLE) - mn) * 24 / rg)) AS INTEGER) AS bin,
count(*) AS count, count(DISTINCT {c}) AS distinct_count FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS mn,
CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE) AS rg FROM lineitem) WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in ("l_extendedprice", "l_partkey")
    ]
    parts.append("""SELECT 'l_shipdate', CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER), count(*),
count(DISTINCT l_shipdate) FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 2""")
    return " UNION ALL ".join(parts)


def date_bins(relation: str, c: str, unit: str, pattern: str, spark_format: str) -> str:
    return f"""
WITH counts AS (SELECT CAST(date_trunc('{unit}', {c}) AS DATE) AS d, count(*) AS n FROM {relation}
  WHERE {c} IS NOT NULL GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 {unit})) AS DATE) AS d FROM counts)
SELECT CAST(row_number() OVER (ORDER BY days.d) - 1 AS INTEGER) AS bin, strftime(days.d, '{pattern}') AS label,
  coalesce(n, 0) AS count, '{spark_format}' AS date_fmt FROM days LEFT JOIN counts ON days.d = counts.d"""


def ranks(relation: str, columns: list[str], ps: list[float], value: str = "CAST(v AS DOUBLE) AS value_num") -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, rn AS rank, {value} FROM ("
        f"SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS rn, count(*) OVER () AS n FROM {relation} "
        f"WHERE {c} IS NOT NULL) WHERE rn = floor({p} * (n - 1) + 0.5)"
        for c in columns
        for p in ps
    ]
    return " UNION ALL ".join(parts)


def per_column(relation: str, columns: list[str], select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {select.format(c=c)} FROM {relation}" for c in columns
    )


def catalog() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", 'table' AS type, (SELECT count(*) FROM {t}) AS row_count, "
        f"CAST({len(fields(shape))} AS INTEGER) AS column_count"
        for t, shape in SCHEMAS.items()
    )


def column_catalog() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", "
        f"{str(c in PRIMARY_KEYS.get(t, ())).lower()} AS pk, false AS not_null, false AS generated, "
        f"(SELECT count(*) FROM {t}) AS row_count"
        for t, shape in SCHEMAS.items()
        for i, (c, _) in enumerate(fields(shape))
    )


# -- sampled profile ------------------------------------------------------------------

SAMPLE = f"""sampled AS (
  SELECT * FROM lineitem WHERE CAST('0x' || substr(md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey), 1, 8) AS BIGINT)
    % 1000000 < (SELECT least(1000000, ceil({SAMPLE_SIZE} / CAST(count(*) AS DOUBLE) * 1000000)) FROM lineitem))"""


def calibrated() -> str:
    """The sampled profile of lineitem brought to the size of the table."""
    sample = facts(["lineitem"], relation_of=lambda t: "sampled")
    exact = facts(["lineitem"])
    calibration = f"""
whole AS ({exact}),
full_size AS (
  SELECT p.* REPLACE (
    w.cnt AS cnt, w.n AS n, w.mn_text AS mn_text, w.mx_text AS mx_text, w.av AS av, w.types AS types,
    CASE WHEN w.n > 0 THEN (w.n - w.cnt) / CAST(w.n AS DOUBLE) ELSE 0 END AS nullf,
    CAST(CASE WHEN w.cnt = 0 THEN 0 WHEN w.mn_text = w.mx_text AND w.types = 1 THEN 1
      WHEN p.dist >= p.cnt * 0.95 THEN least(w.cnt, floor(p.dist * (w.cnt / CAST(p.cnt AS DOUBLE)) + 0.5))
      ELSE greatest(2, p.dist) END AS BIGINT) AS dist)
  FROM charts p JOIN whole w USING (col))"""
    interest = INTEREST.replace("FROM charts)", "FROM full_size)")
    body = profiled(sample).replace(INTEREST, f"{calibration}, {interest}")
    return f"WITH {SAMPLE}, {body} {PROFILE_SELECT}"


def scaled_top_values() -> str:
    parts = top_values("sampled", {"l_linenumber": "text", "l_discount": "number", "l_returnflag": "text"}, numbers=False)
    return f"""WITH {SAMPLE}, scale AS (
  SELECT (SELECT count(*) FROM lineitem) / CAST(count(*) AS DOUBLE) AS f FROM sampled)
SELECT 'lineitem' AS "table", "column", rank, CAST(floor(value_count * f + 0.5) AS BIGINT) AS value_count
FROM ({parts}), scale"""


# -- findings -------------------------------------------------------------------------

DIRTY = ["customer_subset", "dialogs", "orders_dirty", "turn_parent"]

ORPHANS_SINGLE = f"""SELECT count(*) AS orphans FROM orders o WHERE o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {derived('customer_subset')} WHERE c_custkey = o.o_custkey)"""
ORPHANS_COMPOSITE = f"""SELECT count(*) AS orphans FROM ({DERIVED['dialogs']}) AS d
  WHERE d.conv_id IS NOT NULL AND d.turn IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {derived('turn_parent')} WHERE turn_parent.conv_id = d.conv_id AND turn_parent.turn = d.turn)"""


def percent_label(x: str) -> str:
    return (
        f"CASE WHEN {x} <= 0 THEN '0%' WHEN {x} * 100 >= 100 THEN '100%' WHEN {x} * 100 < 1 THEN '<1%' "
        f"WHEN {x} * 100 > 99 THEN '>99%' ELSE CAST(floor({x} * 100 + 0.5) AS INTEGER) || '%' END"
    )


def dirty_findings(unreadable: bool) -> str:
    """CTE ``found`` over the derived tables."""
    body = profiled(facts(DIRTY, relation_of=derived, keys=False))
    order = f"""
ordered AS (SELECT *, CASE tbl WHEN 'customer_subset' THEN 0 WHEN 'dialogs' THEN 1 WHEN 'orders_dirty' THEN 2 ELSE 3 END AS t
  FROM prof),
found AS (
  {"SELECT 1 AS r, 0 AS t, 0 AS g, 0 AS i, 0 AS s, 'warn' AS severity, 'unreadable' AS kind, 'broken_view' AS tbl, NULL AS col, 'cannot read broken_view' AS message, 'x' AS detail UNION ALL" if unreadable else ""}
  SELECT 0 AS r, 0 AS t, 0 AS g, 0 AS i, 0 AS s, 'high' AS severity, 'orphan-fk' AS kind, 'customer_subset' AS tbl,
    'c_nationkey' AS col, 'customer_subset.c_nationkey refers to country, which is no table here' AS message, NULL AS detail
  UNION ALL SELECT 0, 2, 0, 0, 0, 'high', 'orphan-fk', 'orders_dirty', 'o_custkey',
    format('{{:,}}', orphans) || ' orphaned o_custkey value' || CASE WHEN orphans = 1 THEN '' ELSE 's' END || ' in orders_dirty',
    '→ customer_subset.c_custkey (no matching parent row)' FROM ({ORPHANS_SINGLE}) WHERE orphans > 0
  UNION ALL SELECT 0, 1, 0, 0, 0, 'high', 'orphan-fk', 'dialogs', 'conv_id',
    format('{{:,}}', orphans) || ' orphaned (conv_id, turn) value' || CASE WHEN orphans = 1 THEN '' ELSE 's' END || ' in dialogs',
    '→ turn_parent.(conv_id, turn) (no matching parent row)' FROM ({ORPHANS_COMPOSITE}) WHERE orphans > 0
  UNION ALL SELECT 1, t, 1, ord, 0, 'warn', 'empty', tbl, col, 'no values in ' || tbl || '.' || col, NULL
    FROM ordered WHERE cnt = 0
  UNION ALL SELECT 2, t, 1, ord, 0, 'info', 'constant', tbl, col, 'one value only in ' || tbl || '.' || col, NULL
    FROM ordered WHERE cnt > 0 AND dist = 1
  UNION ALL SELECT 1, t, 1, ord, 0, 'warn', 'high-null', tbl, col,
    {percent_label('nullf')} || ' of ' || tbl || '.' || col || ' missing', NULL
    FROM ordered WHERE cnt > 0 AND dist <> 1 AND nullf >= 0.6
  UNION ALL SELECT 1, t, 1, ord, 1, 'warn', 'mixed-type', tbl, col,
    types || ' types of values in ' || tbl || '.' || col, 'values that read as different types' FROM ordered WHERE types > 1)"""
    return f"WITH {body}, {order}"


# -- report ---------------------------------------------------------------------------


def markdown(select: str = "SELECT line, count(*) AS times FROM lines GROUP BY line") -> str:
    tables = ["customer", "nation", "orders", "region"]
    pks = {c for t in tables for c in PRIMARY_KEYS[t]}
    body = profiled(facts(tables))
    types = " ".join(f"WHEN '{c}' THEN '{kind}'" for t in tables for c, kind in fields(SCHEMAS[t]))
    pk_list = ", ".join(f"'{c}'" for c in sorted(pks))
    edges = sorted(
        f"{k.table} → {k.parent} ({k.columns[0]} → {PRIMARY_KEYS[k.parent][0]})"
        for k in FOREIGN_KEYS
        if k.table in tables and k.parent in tables
    )
    edge_rows = " UNION ALL ".join(f"SELECT 1, {i + 2}, 0, '- {e}'" for i, e in enumerate(edges))
    total = " + ".join(f"(SELECT count(*) FROM {t})" for t in tables)
    heads = " UNION ALL ".join(
        f"SELECT {i + 2}, {j}, 0, {line}"
        for i, t in enumerate(tables)
        for j, line in enumerate(
            [
                f"'## {t} (table) — ' || format('{{:,}}', (SELECT count(*) FROM {t})) || ' rows'",
                "''",
                "'| column | declared | kind | distinct values | missing | least | greatest |'",
                "'|:--|:--|:--|--:|--:|:--|:--|'",
            ]
        )
    )
    tails = " UNION ALL ".join(f"SELECT {i + 2}, 6, 0, ''" for i in range(len(tables)))
    number = " ".join(f"WHEN '{t}' THEN {i + 2}" for i, t in enumerate(tables))
    return f"""WITH {body}, lines(a, b, c, line) AS (
  SELECT 0, 2, 0, '- **Tables:** {len(tables)}' UNION ALL SELECT 0, 3, 0, '- **Views:** 0'
  UNION ALL SELECT 0, 4, 0, '- **Total rows:** ' || format('{{:,}}', {total})
  UNION ALL SELECT 0, 6, 0, '- **Relationships:** {len(edges)}' UNION ALL SELECT 0, 7, 0, ''
  UNION ALL SELECT 1, 0, 0, '## Relationships' UNION ALL SELECT 1, 1, 0, ''
  UNION ALL {edge_rows} UNION ALL SELECT 1, 99, 0, ''
  UNION ALL {heads} UNION ALL {tails}
  UNION ALL SELECT CASE tbl {number} END, 5, ord,
    '| ' || col || CASE WHEN col IN ({pk_list}) THEN ' 🔑' WHEN fk THEN ' 🔗' ELSE '' END
    || ' | ' || CASE col {types} END || ' | ' || kind || ' | ' || format('{{:,}}', dist) || ' | '
    || CAST(floor(nullf * 100 + 0.5) AS INTEGER) || '% | ' || coalesce({SHOWN_MIN}, '') || ' | '
    || coalesce({SHOWN_MAX}, '') || ' |' FROM prof)
{select}"""


# -- the registry ---------------------------------------------------------------------

ALL_TABLES = sorted(SCHEMAS)
LINEITEM_NUMBERS = [c for c, kind in fields(SCHEMAS["lineitem"]) if kind in ("bigint", "int", "double")]
AGG_DOUBLE = "CAST(min({c} + 0.0) AS DOUBLE)"


def distinct_of(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c + ' + 0.0' if kind == 'double' else c}) AS distinct_count FROM {table}"
        for c, kind in fields(SCHEMAS[table])
    )


def contains(table: str, needle: str) -> str:
    ascii_lower = "translate(CAST({c} AS VARCHAR), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return " OR ".join(
        f"coalesce(contains({ascii_lower.format(c=c)}, '{needle}'), false)" for c, _ in fields(SCHEMAS[table])
    )


def ranking() -> str:
    columns = profiled(facts(ALL_TABLES))
    numbers = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(ALL_TABLES))
    return f"""WITH {columns}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY interest DESC, ord) AS rk FROM prof),
scored AS (SELECT tbl, max(n) AS row_count,
  avg(interest) FILTER (rk <= 3) * 0.7 + least(1.0, log10(max(n) + 1) / 6) * 0.3 AS score,
  string_agg(col, ', ' ORDER BY rk) FILTER (rk <= 6 AND interest > 0.12) AS key_columns FROM ranked GROUP BY tbl)
SELECT CAST(row_number() OVER (ORDER BY score DESC, CASE tbl {numbers} END) AS INTEGER) AS position, tbl AS "table",
  row_count, round(score, 6) AS score, coalesce(key_columns, '') AS key_columns FROM scored"""


def highlight_rows() -> str:
    numbers = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(ALL_TABLES))
    return profile_of(
        ALL_TABLES,
        f"""SELECT tbl AS "table", col AS "column", kind, chart, CAST(round(interest, 6) AS DOUBLE) AS interest
FROM prof WHERE chart <> 'none' AND interest >= 0.4 ORDER BY prof.interest DESC, CASE tbl {numbers} END, ord LIMIT 9""",
    )


def shares() -> str:
    """Top values of the nullable columns, as shares of rows and of values."""
    parts = top_values(derived("sparse_priorities"), {"priority": "text", "status": "text"}, numbers=False)
    return f"""WITH top AS ({parts}), totals AS (
  SELECT 'priority' AS "column", count(*) AS n, count(priority) AS cnt FROM {derived('sparse_priorities')}
  UNION ALL SELECT 'status', count(*), count(status) FROM {derived('sparse_priorities')})
SELECT 'sparse_priorities' AS "table", top."column", rank, value, value_count,
  round(value_count / CAST(n AS DOUBLE), 6) AS row_share, round(value_count / CAST(cnt AS DOUBLE), 6) AS value_share,
  CAST(floor(value_count / CAST(n AS DOUBLE) * 100 + 0.5) AS INTEGER) || '%' AS row_share_label,
  CAST(floor(value_count / CAST(cnt AS DOUBLE) * 100 + 0.5) AS INTEGER) || '%' AS value_share_label
FROM top JOIN totals ON top."column" = totals."column" """


def all_histograms() -> str:
    numeric = [
        ("lineitem", c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ] + [("orders", c) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    parts = [
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", bin, count, CAST(NULL AS VARCHAR) AS date_fmt "
        f"FROM (WITH {numeric_bins(t, c)} SELECT * FROM bins) WHERE (SELECT count(DISTINCT {c}) FROM {t}) > 15"
        for t, c in numeric
    ]
    parts += [
        f"SELECT '{t}', '{c}', bin, count, date_fmt FROM ({date_bins(t, c, 'year', '%Y', 'yyyy')})"
        for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))
    ]
    return " UNION ALL ".join(parts)


def untyped_profile() -> str:
    relation = (
        f"(SELECT CAST(whole AS BIGINT) AS whole, CAST(number AS DOUBLE) AS number, word, day_text, mixture "
        f"FROM {derived('untyped_orders')})"
    )
    shape = {"untyped_orders": "whole bigint, number double, word string, day_text string, mixture string"}
    return profile_of(["untyped_orders"], relation_of=lambda t: relation, schemas=shape)


ORACLE: dict[str, str] = {
    "column_profile": profile_of(["orders"]),
    "dataset_profile": profile_of(ALL_TABLES),
    "table_catalog": catalog(),
    "column_catalog": column_catalog(),
    "declared_kinds": f"""SELECT CASE
  WHEN upper(declared) LIKE '%BOOL%' THEN 'boolean'
  WHEN upper(declared) LIKE '%DATETIME%' OR upper(declared) LIKE '%TIMESTAMP%' THEN 'datetime'
  WHEN upper(declared) LIKE '%DATE%' OR upper(declared) LIKE '%TIME%' THEN 'date'
  WHEN upper(declared) LIKE '%INT%' THEN 'integer'
  WHEN upper(declared) LIKE '%CHAR%' OR upper(declared) LIKE '%CLOB%' OR upper(declared) LIKE '%TEXT%' THEN 'text'
  WHEN upper(declared) LIKE '%BLOB%' THEN 'blob'
  WHEN upper(declared) LIKE '%REAL%' OR upper(declared) LIKE '%FLOA%' OR upper(declared) LIKE '%DOUB%' THEN 'real'
  ELSE 'unknown' END AS kind, count(*) AS column_count FROM {derived('declared_columns')} GROUP BY 1""",
    "declared_type_kinds": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{declared}' AS declared_type, '{kind}' AS kind, count({c}) AS count, count(DISTINCT {c}) AS distinct_count FROM part"
        for c, declared, kind in (
            ("p_partkey", "BOOLEAN", "boolean"),
            ("p_size", "DOUBLE PRECISION", "real"),
            ("p_name", "BLOB", "blob"),
            ("p_type", "VARCHAR(25)", "text"),
            ("p_brand", "INTEGER", "text"),
            ("p_retailprice", "POINT", "real"),
        )
    ),
    "column_flags": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c in ('o_orderkey', 'c_custkey')} AS pk, {c in ('o_orderkey', 'o_orderdate', 'c_custkey')} AS not_null, "
        f"{c == 'o_totalprice'} AS generated, {repr('customer.c_custkey') if c == 'o_custkey' else 'NULL'} AS fk, count(*) - count({c}) AS null_count FROM {t}"
        for t in ("orders", "customer")
        for c, _ in fields(SCHEMAS[t])
    ),
    "unreadable_table": """SELECT 'orders' AS "table", 'table' AS type, count(*) AS row_count,
  CAST(6 AS INTEGER) AS column_count, false AS unreadable FROM orders
UNION ALL SELECT 'broken_view', 'view', 0, 0, true""",
    "view_profile": profile_of(["customer_orders"], relation_of=derived, keys=False),
    "adhoc_sql": """SELECT n_name, count(*) AS order_count, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name""",
    "profile_json": profile_of(
        ALL_TABLES,
        """SELECT tbl AS "table", n AS row_count, col AS "column", kind, dist AS distinct_count,
  CAST(CASE WHEN chart = 'histogram' AND kind IN ('integer', 'real') THEN 24
    WHEN chart = 'histogram' AND col = 'ts' THEN (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)
    WHEN chart = 'histogram' AND col = 'l_shipdate' THEN (SELECT max(year(l_shipdate)) - min(year(l_shipdate)) + 1 FROM lineitem)
    WHEN chart = 'histogram' THEN (SELECT max(year(o_orderdate)) - min(year(o_orderdate)) + 1 FROM orders)
  END AS INTEGER) AS bins FROM prof""",
    ),
    "profile_markdown": markdown(),
    "markdown_lines": markdown("SELECT CAST(row_number() OVER (ORDER BY a, b, c) AS BIGINT) AS position, line FROM lines"),
    "null_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS row_count, count({c}) AS count, count(*) - count({c}) AS null_count, "
        f"(count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS null_fraction FROM {derived('orders_dirty')}"
        for c, _ in fields(DERIVED_SCHEMAS["orders_dirty"])
    ),
    "distinct_counts": distinct_of("lineitem"),
    "distinct_documents": distinct_of("documents"),
    "unique_shortcut": per_column("orders", ["o_orderkey", "o_custkey"], "count(DISTINCT {c}) AS distinct_count"),
    "repeated_keys": """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY ALL HAVING count(*) > 1""",
    "approx_distinct": f"SELECT *, true AS within_tenth FROM ({distinct_of('lineitem')})",
    "sketched_profile": f"SELECT *, true AS approx, true AS within_tenth FROM ({distinct_of('lineitem')})",
    "min_max_mean": per_column(
        "lineitem",
        LINEITEM_NUMBERS,
        "CAST(min({c} + 0.0) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
        "round(CAST(avg({c}) AS DOUBLE), 4) AS mean_value",
    ),
    "value_types_string": f"SELECT {lexical('v')} AS value_type, count(*) AS value_count FROM {derived('mixed_values')} GROUP BY 1",
    "value_types_documents": f"SELECT {lexical('text')} AS value_type, count(*) AS value_count FROM documents GROUP BY 1",
    "value_types_json": """SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
  WHEN 'DOUBLE' THEN 'real' WHEN 'VARCHAR' THEN 'text' ELSE lower(json_type(props, '$.k')) END AS value_type,
  count(*) AS value_count FROM events WHERE json_type(props, '$.k') IS NOT NULL GROUP BY 1""",
    "top_values_text": top_values("part", dict.fromkeys(["p_name", "p_brand", "p_type"], "text"), numbers=False),
    "top_values_documents": top_values("documents", dict.fromkeys(["text", "lang", "source"], "text"), numbers=False),
    "top_values_numeric": top_values(
        "lineitem", {"l_quantity": "number", "l_linenumber": "number", "l_discount": "number", "l_suppkey": "number"}
    ),
    "top_values_summaries": top_values(
        "lineitem",
        {"l_quantity": "number", "l_linenumber": "text", "l_discount": "number", "l_suppkey": "text", "l_returnflag": "text", "l_shipdate": "text", "l_orderkey": "text"},
        numbers=False,
    ),
    "top_values_long": top_values("documents", dict.fromkeys(["text", "lang", "source"], "text"), numbers=False),
    "top_values_unique": top_values("customer", {"c_custkey": "number", "c_name": "text"}),
    "text_date_kind": profile_of(
        ["text_dates"],
        f"""SELECT col AS "column", kind, chart, {SHOWN_MIN} AS min, {SHOWN_MAX} AS max, dist AS distinct_count FROM prof""",
        relation_of=derived,
    ),
    "boolean_kind": profile_of(["labels"], 'SELECT col AS "column", kind, chart, dist AS distinct_count FROM prof'),
    "untyped_kind": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN bool_and({lexical(c)} = 'integer') THEN 'integer'
  WHEN bool_and({lexical(c)} IN ('integer', 'real')) THEN 'real'
  WHEN bool_and({lexical(c)} = 'date') THEN 'date' ELSE 'text' END AS kind FROM {derived('untyped_orders')}"""
        for c in ("whole", "number", "word", "day_text", "mixture")
    ),
    "untyped_profile": untyped_profile(),
    "numeric_histogram": f"WITH {numeric_bins('lineitem', 'l_extendedprice')} "
    "SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, count FROM bins",
    "values_per_bin": values_per_bin(),
    "histogram_integer": f"WITH {numeric_bins('documents', 'n_chars')} "
    f"SELECT bin, count, {label_number('lo')} || ' – ' || {label_number('hi')} AS label FROM bins",
    "histogram_labels": f"WITH {numeric_bins('events', 'value')} "
    f"SELECT bin, {label_number('lo')} || ' – ' || {label_number('hi')} AS label, count FROM bins",
    "date_histogram_year": date_bins("orders", "o_orderdate", "year", "%Y", "yyyy"),
    "date_histogram_month": date_bins(derived("orders_one_year"), "o_orderdate", "month", "%Y-%m", "yyyy-MM"),
    "date_histogram_day": date_bins("events", "ts", "day", "%Y-%m-%d", "yyyy-MM-dd"),
    "date_histogram_gapfill": date_bins(derived("orders_gap"), "o_orderdate", "year", "%Y", "yyyy"),
    "date_histogram_text": date_bins(
        f"(SELECT TRY_CAST(almost_day AS DATE) AS d0 FROM {derived('text_dates')})", "d0", "year", "%Y", "yyyy"
    ),
    "chart_choice": profile_of(
        ["customer", "documents", "events", "part"], 'SELECT tbl AS "table", col AS "column", kind, chart FROM prof'
    ),
    "text_lengths": profile_of(
        ["benchmark", "customer", "pages", "supplier"],
        f"""SELECT tbl AS "table", col AS "column", {SHOWN_MIN} AS min, {SHOWN_MAX} AS max FROM prof WHERE kind = 'text'""",
    ),
    "interest_scores": profile_of(
        ["conversations", "labels", "lineitem", "orders"],
        """SELECT tbl AS "table", col AS "column", CAST(round(interest, 6) AS DOUBLE) AS interest FROM prof""",
    ),
    "profile_histograms": all_histograms(),
    "sampled_rows": f"WITH {SAMPLE} SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM sampled GROUP BY ALL",
    "sampled_profile": scaled_top_values(),
    "calibrated_profile": calibrated(),
    "top30": """SELECT p_name AS value, count(*) AS value_count FROM part GROUP BY 1
ORDER BY value_count DESC, value LIMIT 30""",
    "quantiles_numeric": ranks("lineitem", ["l_extendedprice", "l_quantity", "l_partkey"], [0.25, 0.5, 0.75]),
    "quantiles_narrowed": ranks("lineitem", ["l_extendedprice", "l_suppkey"], [0.25, 0.5, 0.75]),
    "stddev_sum": per_column(
        "lineitem",
        LINEITEM_NUMBERS,
        "round(CAST(sum({c}) AS DOUBLE), 2) AS total, round(CAST(avg({c}) AS DOUBLE), 4) AS mean, "
        "round(stddev_pop({c}), 4) AS std_dev",
    ),
    "date_median": 'SELECT "column", rank, value FROM ('
    + ranks("orders", ["o_orderdate"], [0.5], "CAST(v AS VARCHAR) AS value")
    + " UNION ALL "
    + ranks("lineitem", ["l_shipdate"], [0.5], "CAST(v AS VARCHAR) AS value")
    + ")",
    "distinct_days": "SELECT count(DISTINCT CAST(ts AS DATE)) AS distinct_days FROM events",
    "time_span": """SELECT d AS span_days, CASE WHEN d > 730 THEN printf('%.1f years', d / 365.25)
  WHEN d > 60 THEN CAST(floor(d / 30.44 + 0.5) AS INTEGER) || ' months'
  ELSE CAST(floor(d + 0.5) AS INTEGER) || ' days' END AS span
FROM (SELECT epoch(max(o_orderdate) - min(o_orderdate)) / 86400.0 AS d FROM orders)""",
    "text_length_stats": per_column(
        "documents",
        ["text", "lang", "source"],
        "CAST(min(length({c})) AS INTEGER) AS min_length, round(avg(length({c})), 4) AS avg_length, "
        "CAST(max(length({c})) AS INTEGER) AS max_length, count(*) FILTER ({c} = '') AS empty_count",
    ),
    "empty_strings": per_column(
        derived("sparse_priorities"), ["priority", "status"], "count(*) FILTER ({c} = '') AS empty_count"
    ),
    "uniqueness": profile_of(
        ["customer", "part"],
        f"""SELECT tbl AS "table", col AS "column", round(dist / CAST(cnt AS DOUBLE), 6) AS uniqueness,
  {percent_label('(dist / CAST(cnt AS DOUBLE))')} AS label, dist = cnt AS all_distinct FROM prof WHERE cnt > 0""",
    ),
    "all_distinct": profile_of(
        ["customer", "part", "supplier"],
        """SELECT tbl AS "table", col AS "column", cnt AS count FROM prof
WHERE cnt > 0 AND dist = cnt AND col NOT IN ('c_custkey', 'p_partkey', 's_suppkey')""",
    ),
    "value_share": shares(),
    "percent_labels": f"""SELECT o_orderstatus, {percent_label('f')} AS label FROM (
  SELECT o_orderstatus, count(*) FILTER (o_orderkey < 77) / CAST(count(*) AS DOUBLE) AS f FROM orders GROUP BY 1)""",
    "details_numeric": f"""WITH q AS ({ranks('part', ['p_retailprice'], [0.5, 0.25, 0.75])})
SELECT CAST(CASE p WHEN 0.5 THEN 0 WHEN 0.25 THEN 1 ELSE 2 END AS INTEGER) AS position,
  CASE p WHEN 0.5 THEN 'median' WHEN 0.25 THEN 'p25' ELSE 'p75' END AS label, {label_number('value_num')} AS value FROM q
UNION ALL SELECT 3, 'std dev', {label_number('stddev_pop(p_retailprice)')} FROM part
UNION ALL SELECT 4, 'sum', {label_number('sum(p_retailprice)')} FROM part
UNION ALL SELECT 9, 'uniqueness', {percent_label('(count(DISTINCT p_retailprice) / CAST(count(p_retailprice) AS DOUBLE))')} FROM part""",
    "details_date": f"""SELECT 0 AS position, 'median' AS label, value
  FROM ({ranks('orders', ['o_orderdate'], [0.5], 'CAST(v AS VARCHAR) AS value')})
UNION ALL SELECT 1, 'distinct days', format('{{:,}}', count(DISTINCT CAST(o_orderdate AS DATE))) FROM orders
UNION ALL SELECT 2, 'time span', printf('%.1f years', epoch(max(o_orderdate) - min(o_orderdate)) / 86400.0 / 365.25) FROM orders
UNION ALL SELECT 9, 'uniqueness', {percent_label('(count(DISTINCT o_orderdate) / CAST(count(o_orderdate) AS DOUBLE))')} FROM orders""",
    "details_text": f"""WITH s AS (SELECT status FROM {derived('sparse_priorities')})
SELECT 0 AS position, 'min length' AS label, CAST(min(length(status)) AS VARCHAR) AS value FROM s
UNION ALL SELECT 1, 'avg length', printf('%.1f', avg(length(status))) FROM s
UNION ALL SELECT 2, 'max length', CAST(max(length(status)) AS VARCHAR) FROM s
UNION ALL SELECT 3, 'empty ''''', format('{{:,}}', count(*) FILTER (status = '')) FROM s
UNION ALL SELECT 9, 'uniqueness', {percent_label('(count(DISTINCT status) / CAST(count(status) AS DOUBLE))')} FROM s""",
    "fk_edges": " UNION ALL ".join(
        f"SELECT '{k.table}' AS from_table, '{k.parent}' AS to_table, "
        f"'{k.columns[0]} → {PRIMARY_KEYS[k.parent][0]}' AS columns, (SELECT count(*) FROM {k.table}) AS from_rows, "
        f"(SELECT count(*) FROM {k.parent}) AS to_rows"
        for k in FOREIGN_KEYS
    ),
    "edge_collapse": """SELECT 'labels' AS from_table, 'documents' AS to_table, 'doc_id → doc_id' AS label, count(*) AS row_count,
  count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans FROM labels
UNION ALL SELECT 'lineitem', 'orders', 'l_orderkey → o_orderkey, l_partkey → o_orderkey', count(*),
  count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  + count(*) FILTER (WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem""",
    "self_references": """SELECT 'orders' AS "table", count(*) AS row_count,
  count(*) FILTER (WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans FROM orders""",
    "default_profile_lineitem": profile_of(["lineitem"], keys=False),
    "date_histogram_centuries": """WITH c AS (SELECT floor(year(CASE WHEN o_orderkey = 77 THEN TIMESTAMP '0001-01-01 00:00:00'
    WHEN o_orderkey % 1000 = 3 THEN TIMESTAMP '3999-12-31 00:00:00' ELSE o_orderdate END) / 10) AS d, count(*) AS n FROM orders GROUP BY 1),
  s AS (SELECT unnest(generate_series(CAST(min(d) AS BIGINT), CAST(max(d) AS BIGINT))) AS d FROM c)
SELECT CAST(s.d - (SELECT min(d) FROM c) AS INTEGER) AS bin, printf('%04d', s.d * 10) || 's' AS label,
  coalesce(n, 0) AS count, 'yyy0s' AS date_fmt FROM s LEFT JOIN c ON s.d = c.d""",
    "rows_by_value_all": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
    "bin_rows_all": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20""",
    "calibrated_kinds": """SELECT 'almost_dates' AS "column", CASE WHEN count(*) FILTER (WHERE o_orderkey = 77) > 0 THEN 'text' ELSE 'date' END AS kind,
  CASE WHEN count(*) FILTER (WHERE o_orderkey = 77) > 0 THEN 2 ELSE 1 END AS storage_types FROM orders
UNION ALL SELECT 'almost_flag', CASE WHEN count(*) FILTER (WHERE o_orderkey = 77) > 0 THEN 'integer' ELSE 'boolean' END, 1 FROM orders""",
    "duplicate_key_findings": """SELECT 'high' AS severity, 'duplicate-key' AS kind, 'lineitem' AS "table", 'l_orderkey' AS "column",
  format('{:,}', n) || CASE WHEN n = 1 THEN ' row repeats ' ELSE ' rows repeat ' END || 'a value of lineitem.(l_orderkey, l_linenumber)' AS message,
  'declared unique' AS detail
FROM (SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE n > 0""",
    "partial_unique_key": """SELECT 'o_custkey' AS label, 'o_orderstatus = ' || chr(39) || 'P' || chr(39) AS "where", CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS repeats
FROM (SELECT count(*) AS c FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
UNION ALL SELECT 'o_orderkey', NULL, CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)""",
    "distinct_maps": """SELECT 'flags' AS "column", count(DISTINCT l_returnflag || '/' || l_linenumber) AS distinct_count, count(*) AS count FROM lineitem""",
    "variant_profile": """SELECT 'v' AS "column", count(*) AS count, CAST(NULL AS BIGINT) AS distinct_count,
  CAST(count(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'r' WHEN 2 THEN 's' ELSE 'o' END) AS INTEGER) AS storage_types FROM orders""",
    "date_median_text": """SELECT CAST(o_orderdate + INTERVAL 10 HOUR AS VARCHAR) AS value FROM orders ORDER BY o_orderdate
LIMIT 1 OFFSET (SELECT CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) FROM orders)""",
    "fk_follow_text": """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey % 5 <> 0""",
    "fk_follow_total": """SELECT least(3, count(*)) AS shown, count(*) AS row_count FROM lineitem
WHERE l_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')""",
    "bad_key_isolated": """SELECT 'orders' AS "table", count(*) AS row_count, 'o_custkey' AS "column" FROM orders""",
    "orphans_single": ORPHANS_SINGLE,
    "orphans_broadcast": ORPHANS_SINGLE,
    "orphan_values": """SELECT l_partkey, count(*) AS row_count FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1""",
    "orphans_composite": ORPHANS_COMPOSITE,
    "missing_parent": f"""SELECT 'customer_subset' AS "table", 'country' AS parent, 'c_nationkey' AS from_label,
  'id' AS to_label, true AS missing_parent, CAST(NULL AS BIGINT) AS orphans
UNION ALL SELECT 'orders_dirty', 'customer_subset', 'o_custkey', 'c_custkey', false, orphans FROM ({ORPHANS_SINGLE})
UNION ALL SELECT 'dialogs', 'turn_parent', '(conv_id, turn)', '(conv_id, turn)', false, orphans FROM ({ORPHANS_COMPOSITE})""",
    "findings_all": f"""{dirty_findings(True)}
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY r, g <> 0 OR kind <> 'unreadable', t, g, i, s) - 1 AS INTEGER) AS position,
  severity, kind, tbl AS "table", col AS "column", message, CASE WHEN kind <> 'unreadable' THEN detail END AS detail FROM found)""",
    "findings_by_severity": f"{dirty_findings(True)} SELECT severity, count(*) AS finding_count FROM found GROUP BY 1",
    "findings_for_column": f"""{dirty_findings(True)} SELECT severity, kind, message FROM found
WHERE tbl = 'orders_dirty' AND col = 'sparse_col'""",
    "dataset_rollup": f"""SELECT CAST({len(SCHEMAS)} AS BIGINT) AS table_count, CAST(0 AS BIGINT) AS view_count,
  CAST({" + ".join(f"(SELECT count(*) FROM {t})" for t in SCHEMAS)} AS BIGINT) AS total_rows,
  CAST({sum(len(fields(s)) for s in SCHEMAS.values())} AS BIGINT) AS total_columns,
  CAST({len(FOREIGN_KEYS)} AS BIGINT) AS relationship_count""",
    "highlights": highlight_rows(),
    "table_ranking": ranking(),
    "rows_by_value": "SELECT * FROM orders WHERE o_custkey = 42",
    "value_count": "SELECT count(*) AS row_count FROM lineitem WHERE l_returnflag = 'R'",
    "sample_values": f"""SELECT count(*) AS value_count FROM (
  SELECT priority FROM {derived('sparse_priorities')} WHERE priority IS NOT NULL LIMIT 25)""",
    "view_rows": """SELECT least(100, count(*)) AS shown, count(*) AS row_count FROM lineitem WHERE l_linestatus = 'F'""",
    "value_counts_of_rows": """SELECT s_suppkey AS l_suppkey, s_name, s_nationkey, s_acctbal, shared_count
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS shared_count FROM lineitem GROUP BY 1) c ON s_suppkey = c.l_suppkey""",
    "group_count_with_null": f"""SELECT priority AS value, count(*) AS value_count FROM {derived('sparse_priorities')}
GROUP BY 1 ORDER BY value_count DESC, value NULLS FIRST LIMIT 50""",
    "distinct_values": f"""SELECT DISTINCT priority AS value FROM {derived('sparse_priorities')}
ORDER BY value NULLS FIRST LIMIT 200""",
    "order_top": "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 200",
    "null_rows": f"SELECT * FROM {derived('sparse_priorities')} WHERE priority IS NULL",
    "bin_rows": f"""WITH {numeric_bins('lineitem', 'l_extendedprice')}
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, bins
WHERE bin = 23 AND l_extendedprice >= lo AND l_extendedprice <= hi""",
    "date_bucket_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-02'",
    "key_lookup": "SELECT * FROM conversations WHERE conv_id = 7 AND turn = 1",
    "fk_follow": """SELECT * FROM customer WHERE c_custkey IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""",
    "text_filter": f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {contains('documents', 'the')}",
    "text_filter_literal": f"SELECT page_id, url FROM pages WHERE {contains('pages', '_')}",
    "filtered_count": f"SELECT count(*) AS row_count FROM customer WHERE {contains('customer', 'building')}",
    "sorted_page": """SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS FIRST
LIMIT 100 OFFSET 300""",
    "keyset_page": """SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS FIRST
LIMIT 100 OFFSET 300""",
    "deep_page": """SELECT * FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST
LIMIT 100 OFFSET (SELECT 100 * (count(*) // 150) FROM lineitem)""",
    "deep_pages_filtered": f"""SELECT * EXCLUDE (n), CAST((n - 1) // 20 AS INTEGER) AS page FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderpriority NULLS FIRST, o_orderkey) AS n FROM orders WHERE {contains('orders', 'urgent')})
WHERE (n - 1) // 20 IN (3, 9)""",
    "quantiles_many": f"""WITH wides AS (SELECT *, 1152921504606846976 + l_orderkey * 7 + l_linenumber AS wide FROM lineitem)
SELECT "column", p, rank, value_num FROM ({ranks('wides', ['wide', 'l_partkey', 'l_extendedprice', 'l_discount'], [i / 20 for i in range(21)])})
UNION ALL SELECT 'l_shipdate', x.p, CAST(floor(x.p * (n - 1) + 0.5) AS BIGINT), NULL
FROM (SELECT count(l_shipdate) AS n FROM lineitem), (SELECT unnest({[i / 20 for i in range(21)]})::DOUBLE AS p) x""",
    "sample_exact_size": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY md5(l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber LIMIT 1000""",
    "json_top_values": top_values("part", dict.fromkeys(["p_name", "p_brand", "p_type"], "text"), numbers=False),
    "json_bins": all_histograms(),
    "json_findings": f"""{dirty_findings(True)}
SELECT severity, kind, tbl AS "table", col AS "column", message, CASE WHEN kind <> 'unreadable' THEN detail END AS detail FROM found""",
    "json_keys": """SELECT 'lineitem' AS "table", 'orders' AS parent, CAST(0 AS INTEGER) AS seq, 'l_orderkey' AS from_column, 'o_orderkey' AS to_column,
  'l_orderkey → o_orderkey' AS columns, count(*) AS row_count FROM lineitem
UNION ALL SELECT 'orders', 'customer', 0, 'o_custkey', 'c_custkey', 'o_custkey → c_custkey', count(*) FROM orders""",
    "json_columns": profile_of(
        ["customer", "nation"],
        """SELECT tbl AS "table", CAST(ord AS INTEGER) AS position, col AS "column", cnt AS "count", n - cnt AS null_count, dist AS distinct_count FROM prof""",
    ),
}
