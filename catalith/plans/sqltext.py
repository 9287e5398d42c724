"""Shared pieces of the DuckDB SQL that states the catalog queries."""

from __future__ import annotations


def key(expr: str) -> str:
    """The table key of a text expression."""
    return f"array_to_string([lower(trim(translate(s, '\"`[]', ''))) for s in string_split({expr}, '.')], '.')"


def strings(column: str, path: str) -> str:
    return f"CAST(json_extract({column}, '$.{path}') AS VARCHAR[])"


CATALOG = f"""
    WITH RECURSIVE last_build AS (SELECT * FROM (SELECT DISTINCT snap_id, source, replace(lower(trim(source_type)), '-', '_') AS st, built_at, payload FROM snapshots)
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY built_at DESC, snap_id DESC) = 1),
    conn AS (SELECT name, priority FROM (SELECT DISTINCT name, priority, updated_at, created_at FROM connections)
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, created_at DESC) = 1),
    src AS (SELECT b.source, b.st, b.payload, coalesce(c.priority, CASE st WHEN 'user' THEN 0 WHEN 'collibra' THEN 10 WHEN 'dbt' THEN 20 WHEN 'unity_catalog' THEN 30
        WHEN 'duckdb' THEN 40 WHEN 'ddl' THEN 50 WHEN 'aws_glue' THEN 60 ELSE 70 END) AS pr FROM last_build b LEFT JOIN conn c ON c.name = b.source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY st <> 'user', pr, source) AS rk FROM src),
    t0 AS (SELECT source, rk, unnest(CAST(json_extract(payload, '$.tables') AS JSON[])) AS t, generate_subscripts(CAST(json_extract(payload, '$.tables') AS JSON[]), 1) AS pos FROM ranked),
    ct AS (SELECT source, rk, pos, t, {key("concat_ws('.', nullif(t->>'catalog', ''), nullif(t->>'schema', ''), nullif(t->>'name', ''))")} AS table_key,
        nullif(t->>'description', '') AS description, nullif(t->>'owner', '') AS owner, CAST(t->>'row_count' AS BIGINT) AS row_count, coalesce(t->>'kind', 'table') AS kind FROM t0),
    c0 AS (SELECT source, rk, pos, table_key, unnest(CAST(json_extract(t, '$.columns') AS JSON[])) AS c, generate_subscripts(CAST(json_extract(t, '$.columns') AS JSON[]), 1) AS cpos FROM ct),
    cc AS (SELECT source, rk, pos, cpos, table_key, c, c->>'name' AS name, lower(c->>'name') AS col FROM c0 WHERE c->>'name' IS NOT NULL),
    e0 AS (SELECT source, rk, unnest(CAST(json_extract(payload, '$.edges') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(payload, '$.edges') AS JSON[]), 1) AS pos FROM ranked),
    ce AS (SELECT source, rk, pos, e->>'kind' AS kind, {key("e->>'from_table'")} AS from_key, {key("e->>'to_table'")} AS to_key,
        [lower(x) for x in {strings('e', 'from_columns')}] AS from_columns, [lower(x) for x in {strings('e', 'to_columns')}] AS to_columns FROM e0
        WHERE trim(e->>'from_table') <> '' AND trim(e->>'to_table') <> ''),
    g0 AS (SELECT source, rk, unnest(CAST(json_extract(payload, '$.terms') AS JSON[])) AS g, generate_subscripts(CAST(json_extract(payload, '$.terms') AS JSON[]), 1) AS pos FROM ranked),
    cg AS (SELECT source, rk, pos, lower(trim(g->>'name')) AS term, nullif(g->>'description', '') AS description, g FROM g0 WHERE trim(g->>'name') <> ''),
    de AS (SELECT kind, from_key, to_key, from_columns, to_columns, arg_min(source, rk * 100000 + pos) AS source, min(rk * 100000 + pos) AS ord FROM ce GROUP BY ALL),
    mc AS (SELECT table_key, col, arg_min(name, (rk * 1000 + pos) * 1000 + cpos) AS name, coalesce(bool_or(CAST(c->>'is_primary_key' AS BOOLEAN)), false) AS is_primary_key,
        arg_min(nullif(c->>'data_type', ''), (rk * 1000 + pos) * 1000 + cpos) FILTER (nullif(c->>'data_type', '') IS NOT NULL) AS data_type, min((rk * 1000 + pos) * 1000 + cpos) AS ord FROM cc GROUP BY ALL)
"""
COST = "CASE kind WHEN 'foreign_key' THEN 1.0 WHEN 'relationship_test' THEN 1.0 WHEN 'join_hint' THEN 1.0 WHEN 'catalog_relation' THEN 1.3 WHEN 'lineage' THEN 1.6 WHEN 'inferred' THEN 2.5 ELSE 2.0 END"
