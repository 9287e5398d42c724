"""Queries of the merged catalog: merge, graph lookups, inference and families, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import merge as M
from catalith.plans.link_queries import _cat
from catalith.plans.sqltext import CATALOG, COST, strings


def merge_order(spark: SparkSession, sf: str) -> DataFrame:
    s = _cat(spark, sf).sources
    return s.select("source", "source_type", "priority", F.date_format("built_at", "yyyy-MM-dd HH:mm:ss").alias("built_at"))


def merge_columns(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge_columns(_cat(spark, sf)).select("table_key", "col", "name", "data_type", "is_primary_key", F.array_join("samples", "|").alias("samples"))


def merge_properties(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge_properties(_cat(spark, sf))


def merge_keys(spark: SparkSession, sf: str) -> DataFrame:
    return M.primary_keys(_cat(spark, sf))


def merge_stubs(spark: SparkSession, sf: str) -> DataFrame:
    return M.stubs(_cat(spark, sf))


def graph_relations(spark: SparkSession, sf: str) -> DataFrame:
    return M.relations(M.distinct_edges(_cat(spark, sf))).drop("affinity")


def graph_join_tables(spark: SparkSession, sf: str) -> DataFrame:
    return M.relations(M.distinct_edges(_cat(spark, sf)), [k for k in M.JOIN_COST if k != "lineage"]).drop("affinity")


def graph_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return M.lineage(M.distinct_edges(_cat(spark, sf)))


def graph_column_links(spark: SparkSession, sf: str) -> DataFrame:
    cat = _cat(spark, sf)
    return M.column_links(M.distinct_edges(cat), M.merge_columns(cat))


def merge_terms(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge_terms(_cat(spark, sf))


def term_targets(spark: SparkSession, sf: str) -> DataFrame:
    cat = _cat(spark, sf)
    return M.term_targets(cat, M.merge_columns(cat))


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    cat = _cat(spark, sf)
    pairs = M.relations(M.distinct_edges(cat))
    nodes = cat.tables.select(F.col("table_key").alias("node")).union(pairs.select("u")).union(pairs.select("v")).distinct()
    return M.components(pairs, nodes)


def search_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose name, description or columns contain a text, by name, the first 50 (the feature's limit)."""
    cat, q = _cat(spark, sf), "order"
    t = M.merge_tables(cat)
    cols = cat.columns.groupBy("table_key").agg(F.max(F.col("col").contains(q)).alias("in_column"))
    hit = F.col("table_key").contains(q) | F.coalesce(F.lower("description").contains(q), F.lit(False)) | F.coalesce("in_column", F.lit(False))
    return t.join(cols, "table_key", "left").filter(hit).orderBy("table_key").limit(50).select("table_key", "description")


def graph_export(spark: SparkSession, sf: str) -> DataFrame:
    e = M.distinct_edges(_cat(spark, sf))
    text = F.array_join(F.zip_with("from_columns", "to_columns", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit("="), F.coalesce(b, F.lit("")))), ", ")
    return e.select("kind", "from_key", "to_key", text.alias("on"), "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "merge_order": merge_order,
    "merge_tables": lambda s, d: M.merge_tables(_cat(s, d)).withColumn("row_count", F.coalesce("row_count", F.lit(-1))),
    "merge_columns": merge_columns,
    "merge_stubs": merge_stubs,
    "merge_terms": merge_terms,
    "merge_properties": merge_properties,
    "merge_keys": merge_keys,
    "term_targets": term_targets,
    "graph_relations": graph_relations,
    "graph_join_tables": graph_join_tables,
    "graph_lineage": graph_lineage,
    "graph_column_links": graph_column_links,
    "graph_components": graph_components,
    "graph_stats": lambda s, d: M.graph_stats(_cat(s, d)),
    "graph_export": graph_export,
    "search_tables": search_tables,
}

_TABLES = """, o AS (SELECT table_key, source, rk, min(pos) AS pos FROM ct GROUP BY ALL),
    mt AS (SELECT table_key, arg_min(description, rk * 100000 + pos) FILTER (description IS NOT NULL) AS description, arg_min(owner, rk * 100000 + pos) FILTER (owner IS NOT NULL) AS owner,
      arg_min(row_count, rk * 100000 + pos) FILTER (row_count IS NOT NULL) AS row_count, coalesce(arg_min(kind, rk * 100000 + pos) FILTER (kind <> 'table'), 'table') AS kind FROM ct GROUP BY ALL)
"""
_RELATIONS = "SELECT least(from_key, to_key) AS u, greatest(from_key, to_key) AS v, CAST(min(" + COST + ") AS DOUBLE) AS weight, count(*) AS n_relations FROM de WHERE from_key <> to_key {0} GROUP BY ALL"

SQL: dict[str, str] = {
    "merge_order": CATALOG + "SELECT r.source, st AS source_type, pr AS priority, strftime(b.built_at, '%Y-%m-%d %H:%M:%S') AS built_at FROM ranked r JOIN (SELECT source, built_at FROM last_build) b USING (source)",
    "merge_tables": CATALOG + _TABLES + f""",
      tg AS (SELECT table_key, string_agg(v, ',' ORDER BY r) AS tags FROM (SELECT table_key, v, min((rk * 1000 + pos) * 1000 + tp) AS r FROM (
        SELECT table_key, rk, pos, unnest({strings('t', 'tags')}) AS v, generate_subscripts({strings('t', 'tags')}, 1) AS tp FROM ct) GROUP BY ALL) GROUP BY ALL)
      SELECT table_key, description, owner, coalesce(row_count, -1) AS row_count, kind, string_agg(source, ',' ORDER BY rk) AS source, coalesce(any_value(tags), '') AS tags FROM mt JOIN o USING (table_key) LEFT JOIN tg USING (table_key)
      GROUP BY table_key, description, owner, row_count, kind""",
    "merge_columns": CATALOG + f""", sv AS (SELECT table_key, col, v, min(((rk * 1000 + pos) * 1000 + cpos) * 100 + sp) AS r FROM (
        SELECT table_key, col, rk, pos, cpos, unnest({strings('c', 'sample_values')}) AS v, generate_subscripts({strings('c', 'sample_values')}, 1) AS sp FROM cc) WHERE v IS NOT NULL GROUP BY ALL),
      sl AS (SELECT table_key, col, array_to_string(list_slice(list(v ORDER BY r), 1, 20), '|') AS samples FROM sv GROUP BY ALL)
      SELECT table_key, col, name, data_type, is_primary_key, coalesce(samples, '') AS samples FROM mc LEFT JOIN sl USING (table_key, col)""",
    "merge_stubs": CATALOG + """, ends AS (SELECT from_key AS table_key, rk, source FROM ce UNION SELECT to_key, rk, source FROM ce)
      SELECT table_key, string_split(table_key, '.')[-1] AS name, string_agg(source, ',' ORDER BY rk) AS source FROM ends WHERE table_key NOT IN (SELECT table_key FROM ct) GROUP BY ALL""",
    "merge_terms": CATALOG + f""", sy AS (SELECT term, string_agg(v, ',' ORDER BY r) AS synonyms FROM (SELECT term, v, min((rk * 1000 + pos) * 1000 + sp) AS r FROM (
        SELECT term, rk, pos, unnest({strings('g', 'synonyms')}) AS v, generate_subscripts({strings('g', 'synonyms')}, 1) AS sp FROM cg) GROUP BY ALL) GROUP BY ALL)
      SELECT term, arg_min(description, rk * 1000 + pos) FILTER (description IS NOT NULL) AS description, coalesce(any_value(synonyms), '') AS synonyms FROM cg LEFT JOIN sy USING (term) GROUP BY term""",
    "term_targets": CATALOG + f""", said AS (SELECT DISTINCT term, array_to_string([lower(trim(translate(s, '"`[]', ''))) for s in string_split(x, '.')], '.') AS k FROM (SELECT term, unnest({strings('g', 'targets')}) AS x FROM cg)),
      tk AS (SELECT DISTINCT table_key FROM ct), parts AS (SELECT term, k, array_to_string(string_split(k, '.')[:-2], '.') AS head, string_split(k, '.')[-1] AS tail FROM said),
      bare AS (SELECT string_split(table_key, '.')[-1] AS b, min(table_key) AS one FROM tk GROUP BY ALL HAVING count(*) = 1)
      SELECT DISTINCT term, coalesce(x.table_key, h.table_key, one) AS target_table, CASE WHEN x.table_key IS NULL THEN m.col END AS target_col FROM parts p LEFT JOIN tk x ON x.table_key = k
      LEFT JOIN tk h ON h.table_key = head LEFT JOIN mc m ON m.table_key = head AND m.col = tail AND h.table_key IS NOT NULL LEFT JOIN bare ON b = k WHERE coalesce(x.table_key, h.table_key, one) IS NOT NULL""",
    "merge_properties": CATALOG + """, pp AS (SELECT table_key, rk * 100000 + pos AS o, CAST(json_extract(t, '$.properties') AS MAP(VARCHAR, JSON)) AS m FROM ct WHERE json_type(t, '$.properties') = 'OBJECT'),
      each AS (SELECT table_key, o, unnest(map_keys(m)) AS property, unnest(map_values(m)) AS v FROM pp) SELECT table_key, property, arg_min(v->>'$', o) AS value FROM each WHERE json_type(v) <> 'NULL' GROUP BY ALL""",
    "merge_keys": CATALOG + "SELECT table_key, string_agg(col, ',' ORDER BY ord) AS primary_key FROM mc WHERE is_primary_key GROUP BY ALL",
    "graph_relations": CATALOG + _RELATIONS.format(""),
    "graph_join_tables": CATALOG + _RELATIONS.format("AND kind IN ('foreign_key', 'relationship_test', 'join_hint', 'catalog_relation', 'inferred')"),
    "graph_lineage": CATALOG + """, b AS (SELECT from_key AS table_key, CAST(NULL AS VARCHAR) AS u, to_key AS d FROM de WHERE kind = 'lineage' UNION SELECT to_key, from_key, CAST(NULL AS VARCHAR) FROM de WHERE kind = 'lineage')
      SELECT table_key, coalesce(string_agg(DISTINCT u, ',' ORDER BY u), '') AS upstream, coalesce(string_agg(DISTINCT d, ',' ORDER BY d), '') AS downstream FROM b GROUP BY ALL""",
    "graph_column_links": CATALOG + """, p AS (SELECT DISTINCT from_key, to_key, from_columns[i] AS from_col, to_columns[i] AS to_col FROM (SELECT *, unnest(range(1, least(len(from_columns), len(to_columns)) + 1)) AS i FROM de))
      SELECT from_key, from_col, to_key, to_col FROM p WHERE (from_key, from_col) IN (SELECT (table_key, col) FROM mc) AND (to_key, to_col) IN (SELECT (table_key, col) FROM mc)""",
    "graph_components": CATALOG + """, pr2 AS (SELECT DISTINCT from_key AS u, to_key AS v FROM de WHERE from_key <> to_key), both_ways AS (SELECT u, v FROM pr2 UNION SELECT v, u FROM pr2),
      reach AS (SELECT node, node AS c FROM (SELECT DISTINCT table_key AS node FROM ct UNION SELECT u FROM both_ways) UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.c)
      SELECT node, min(c) AS component FROM reach GROUP BY ALL""",
    "graph_stats": CATALOG + """, ends AS (SELECT from_key AS k FROM de UNION SELECT to_key FROM de)
      SELECT 'tables' AS item, count(DISTINCT table_key) AS n FROM ct UNION ALL SELECT 'stubs', count(*) FROM ends WHERE k NOT IN (SELECT table_key FROM ct)
      UNION ALL SELECT 'columns', count(*) FROM mc UNION ALL SELECT 'terms', count(DISTINCT term) FROM cg UNION ALL SELECT 'relations', count(*) FROM de WHERE from_key <> to_key
      UNION ALL SELECT 'relation_pairs', count(DISTINCT (least(from_key, to_key), greatest(from_key, to_key))) FROM de WHERE from_key <> to_key UNION ALL SELECT 'sources', count(*) FROM ranked""",
    "graph_export": CATALOG + "SELECT kind, from_key, to_key, array_to_string([concat(coalesce(from_columns[i], ''), '=', coalesce(to_columns[i], '')) for i in range(1, greatest(len(from_columns), len(to_columns)) + 1)], ', ') AS \"on\", source FROM de",
    "search_tables": CATALOG + _TABLES + """SELECT table_key, description FROM mt WHERE contains(table_key, 'order') OR contains(lower(coalesce(description, '')), 'order')
      OR table_key IN (SELECT table_key FROM mc WHERE contains(col, 'order')) ORDER BY table_key LIMIT 50""",
}
