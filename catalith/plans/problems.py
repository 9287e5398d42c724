"""Queries of the general data problems (p1, p3, p4, p6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.drift import GENERATOR, compare_files, matches, run_files, schema_changes, unite, united_names
from catalith.operators.hierarchy import hierarchy
from catalith.operators.nested import shred
from catalith.operators.orphans import catalog_orphans, catalog_orphans_now
from catalith.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "spider2_exec_mix_candidates")
    return shred(c, "line_no", ["rubric", "missing", "findings"]).values().select("line_no", "field", "parent_path", "path")


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of all flat tables: key (line_no, field, row_path), table, foreign key (parent_table, parent_row_path), where in the parent row it hangs, and the inlined values by path."""
    rows = shred(table(spark, sf, "spider2_exec_mix_candidates"), "line_no", ["rubric", "missing", "findings"]).rows
    own = F.map_from_entries(F.transform("vals", lambda v: F.struct(F.coalesce(v["rel"], F.lit("")), v["value"])))
    return rows.select("line_no", "field", F.coalesce("row_path", F.lit("")).alias("row_path"), F.col("table").alias("table_name"), "parent_table", F.when(F.col("parent_table").isNotNull(), F.coalesce("parent_row_path", F.lit(""))).alias("parent_row_path"), "slot", "position", F.to_json(own).alias("inlined"))


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    """table_name, parent_table, n_rows, n_lost: how many rows hang on which table, and how many of their foreign keys meet no row (none may)."""
    return shred(table(spark, sf, "spider2_exec_mix_candidates"), "line_no", ["rubric", "missing", "findings"]).links()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    out = catalog_orphans(table(spark, sf, "snapshots"), table(spark, sf, "join_hints"))
    return out.select("ref_table", "ref_id", "pos", "side", "status", "ym").distinct()


def p3_by_month(spark: SparkSession, sf: str) -> DataFrame:
    out = catalog_orphans(table(spark, sf, "snapshots"), table(spark, sf, "join_hints"))
    return out.groupBy("table_key", "ym", "status").agg(F.count("*").alias("n_refs"))


def p3_current(spark: SparkSession, sf: str) -> DataFrame:
    """The orphans as of now: tables with references and no source that lists them."""
    return catalog_orphans_now(table(spark, sf, "snapshots"), table(spark, sf, "join_hints"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_files(table(spark, sf, "spider2_exec_legacy"), table(spark, sf, "spider2_exec_mix"), table(spark, sf, "spider2_exec_mix_candidates"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(_runs(spark, sf))


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    return unite(_runs(spark, sf), GENERATOR)


def p4_matches(spark: SparkSession, sf: str) -> DataFrame:
    """What flooding matched: two paths, how often, their mean similarity, and the columns of p4_runs that they are in."""
    files = cut(_runs(spark, sf))
    names = united_names(files)
    m = matches(compare_files(files, True)).withColumn("similarity", F.round("similarity", 4))
    for side in "ab":
        m = m.join(names.select(F.col("path").alias(side), F.col("name").alias(f"column_{side}")), side, "left")
    return m.select("a", "b", "n", "similarity", "column_a", "column_b")


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, complete, n_values: how many values each row of p4_runs has. SQL counts the members that are no object in the files themselves: nothing may be lost or doubled."""
    u = p4_runs(spark, sf)
    own = [c for c in u.columns if c not in ("file_id", "series", "at", "complete", GENERATOR)]
    return u.select("file_id", "complete", sum((F.col(f"`{c}`").isNotNull().cast("long") for c in own), F.lit(0).cast("long")).alias("n_values"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "spider2_exec_mix_candidates")
    out = hierarchy(c, ["run_id", "instance_id"], "id", "parent_id", "line_no")
    return out.select("run_id", "instance_id", "id", "root_id", "node_depth", "path", "n_below")


def p6_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The range of each node in the preorder of its tree: the nodes under it lie in it, the nodes above it hold it."""
    c = table(spark, sf, "spider2_exec_mix_candidates")
    return hierarchy(c, ["run_id", "instance_id"], "id", "parent_id", "line_no").filter("first is not null").select("run_id", "instance_id", "id", "first", "last")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_tables": p1_tables, "p1_links": p1_links, "p3_found": p3_found, "p3_by_month": p3_by_month, "p3_current": p3_current, "p4_found": p4_found, "p4_runs": p4_runs, "p4_matches": p4_matches, "p4_kept": p4_kept, "p6_found": p6_found, "p6_ranges": p6_ranges}

#: The key of a text column in DuckDB, and the references with their state.
_KEY = "array_to_string([lower(trim(translate(s, '\"`[]', ''))) for s in string_split({0}, '.')], '.')"
_ORPHANS = """
        WITH snap AS (SELECT DISTINCT snap_id, source, built_at, payload FROM snapshots),
        listed AS (SELECT DISTINCT snap_id, source, built_at, """ + _KEY.format(
    "concat_ws('.', nullif(t->>'catalog', ''), nullif(t->>'schema', ''), nullif(t->>'name', ''))"
) + """ AS table_key
          FROM (SELECT snap_id, source, built_at, unnest(CAST(json_extract(payload, '$.tables') AS JSON[])) AS t FROM snap)),
        span AS (SELECT DISTINCT snap_id, source, built_at, lead(built_at) OVER (PARTITION BY source ORDER BY built_at, snap_id) AS until
                 FROM (SELECT DISTINCT snap_id, source, built_at FROM snap)),
        life AS (SELECT table_key, l.built_at, until FROM listed l JOIN span USING (snap_id, source)),
        edge AS (SELECT snap_id, built_at, unnest(CAST(json_extract(payload, '$.edges') AS JSON[])) AS e,
                        generate_subscripts(CAST(json_extract(payload, '$.edges') AS JSON[]), 1) - 1 AS pos FROM snap),
        raw AS (SELECT 'join_hints' AS ref_table, id AS ref_id, 0 AS pos, 'from' AS side, from_table AS name, created_at AS t FROM join_hints
                UNION SELECT 'join_hints', id, 0, 'to', to_table, created_at FROM join_hints
                UNION SELECT 'snapshots', snap_id, pos, 'from', e->>'from_table', built_at FROM edge
                UNION SELECT 'snapshots', snap_id, pos, 'to', e->>'to_table', built_at FROM edge),
        ref AS (SELECT *, """ + _KEY.format("name") + """ AS table_key FROM raw WHERE name IS NOT NULL AND trim(name) <> ''),
        born AS (SELECT table_key, min(built_at) AS first_at FROM listed GROUP BY ALL),
        orphan AS (SELECT r.*, CASE WHEN b.first_at <= r.t THEN 'deleted' WHEN b.first_at IS NOT NULL THEN 'late' ELSE 'missing' END AS status,
                          strftime(r.t, '%Y-%m') AS ym
                   FROM ref r LEFT JOIN born b USING (table_key)
                   WHERE NOT EXISTS (SELECT 1 FROM life l WHERE l.table_key = r.table_key AND l.built_at <= r.t AND (l.until IS NULL OR l.until > r.t)))
"""

#: The trees with what is above and under each node.
_TREES = """
        WITH RECURSIVE lines AS (
          SELECT run_id, instance_id, lower(trim(id)) AS id, nullif(lower(trim(parent_id)), '') AS parent, line_no
          FROM spider2_exec_mix_candidates WHERE run_id IS NOT NULL AND instance_id IS NOT NULL AND trim(id) <> ''),
        node AS (SELECT run_id, instance_id, id, max(line_no) AS line_no FROM lines GROUP BY ALL),
        held AS (SELECT l.run_id, l.instance_id, l.id, l.parent FROM lines l JOIN node USING (run_id, instance_id, id, line_no)),
        tree AS (SELECT DISTINCT h.run_id, h.instance_id, h.id, p.id AS parent FROM held h
                 LEFT JOIN held p ON p.run_id = h.run_id AND p.instance_id = h.instance_id AND p.id = h.parent),
        up AS (SELECT run_id, instance_id, id, parent AS anc FROM tree WHERE parent IS NOT NULL
               UNION SELECT u.run_id, u.instance_id, u.id, t.parent FROM up u
               JOIN tree t ON t.run_id = u.run_id AND t.instance_id = u.instance_id AND t.id = u.anc WHERE t.parent IS NOT NULL),
        onloop AS (SELECT run_id, instance_id, id FROM up WHERE id = anc),
        under AS (SELECT DISTINCT u.run_id, u.instance_id, u.id FROM up u
                  JOIN onloop o ON o.run_id = u.run_id AND o.instance_id = u.instance_id AND o.id = u.anc),
        deep AS (SELECT t.run_id, t.instance_id, t.id, count(u.anc) AS d FROM tree t LEFT JOIN up u USING (run_id, instance_id, id) GROUP BY ALL),
        way AS (SELECT u.run_id, u.instance_id, u.id, string_agg(u.anc, '/' ORDER BY d.d) AS way, arg_min(u.anc, d.d) AS top
                FROM up u JOIN deep d ON d.run_id = u.run_id AND d.instance_id = u.instance_id AND d.id = u.anc GROUP BY ALL),
        below AS (SELECT run_id, instance_id, anc AS id, count(*) AS n FROM up WHERE id <> anc GROUP BY ALL)
"""

SQL: dict[str, str] = {
    "p4_found": """
        WITH RECURSIVE files AS (
          SELECT file_id, run_id, series, written_at, config FROM spider2_exec_legacy UNION SELECT file_id, run_id, series, written_at, config FROM spider2_exec_mix),
        ok AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY written_at, file_id) AS seq FROM files WHERE config IS NOT NULL AND json_valid(config)),
        m AS (
          SELECT series, seq, CAST('' AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS path, CAST(config AS JSON) AS v FROM ok
          UNION ALL SELECT series, seq, coalesce(path, ''), concat_ws('/', path, k), c FROM (
            SELECT series, seq, path, unnest(map_keys(o)) AS k, unnest(map_values(o)) AS c FROM (SELECT series, seq, path, CAST(v AS MAP(VARCHAR, JSON)) AS o FROM m WHERE json_type(v) = 'OBJECT'))),
        gen AS (SELECT run_id, arg_min(CASE WHEN json_valid(generator) THEN CASE json_type(generator) WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'text' END ELSE 'text' END, line_no) AS ty
                FROM spider2_exec_mix_candidates WHERE generator IS NOT NULL GROUP BY ALL),
        mem AS (SELECT series, seq, parent, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' END AS ty,
                  CASE WHEN json_type(v) = 'ARRAY' AND json_array_length(v) = 1 THEN json_extract(v, '$[0]') ELSE v END AS one FROM m WHERE path IS NOT NULL
                UNION ALL SELECT series, seq, NULL, 'candidates.generator', ty, NULL FROM ok JOIN gen USING (run_id)),
        val AS (SELECT *, CASE WHEN one IS NOT NULL AND json_type(one) NOT IN ('NULL', 'BOOLEAN', 'OBJECT') THEN CAST(one AS VARCHAR) END AS k FROM mem),
        went AS (SELECT a.series, a.seq + 1 AS seq, a.parent, a.path, a.k FROM val a JOIN ok n ON n.series = a.series AND n.seq = a.seq + 1
                 WHERE NOT EXISTS (SELECT 1 FROM val b WHERE b.series = a.series AND b.seq = a.seq + 1 AND b.path = a.path)),
        came AS (SELECT a.series, a.seq, a.parent, a.path, a.k FROM val a WHERE a.seq > 1 AND NOT EXISTS (SELECT 1 FROM val b WHERE b.series = a.series AND b.seq = a.seq - 1 AND b.path = a.path)),
        w1 AS (SELECT series, seq, parent, k, min(path) AS path FROM went WHERE k IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
        c1 AS (SELECT series, seq, parent, k, min(path) AS path FROM came WHERE k IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
        ren AS (SELECT series, seq, w1.path AS a, c1.path AS b FROM w1 JOIN c1 USING (series, seq, parent, k)),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY series, path ORDER BY seq) AS run FROM (
                  SELECT series, seq, path, ty, CASE WHEN lag(seq) OVER (PARTITION BY series, path ORDER BY seq) = seq - 1 THEN 0 ELSE 1 END AS fresh FROM val)),
        last AS (SELECT *, last_value(ty IGNORE NULLS) OVER (PARTITION BY series, path, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM runs),
        cases AS (
          SELECT series, seq, 'renamed' AS change_kind, a AS old_path, b AS new_path FROM ren
          UNION ALL SELECT series, seq, 'removed', path, '' FROM went WHERE (series, seq, path) NOT IN (SELECT (series, seq, a) FROM ren)
          UNION ALL SELECT series, seq, 'added', '', path FROM came WHERE (series, seq, path) NOT IN (SELECT (series, seq, b) FROM ren)
          UNION ALL SELECT series, seq, 'type', path, path FROM last WHERE ty IS NOT NULL AND was IS NOT NULL AND ty <> was)
        SELECT file_id, change_kind, old_path, new_path FROM cases JOIN ok USING (series, seq)""",
    "p4_kept": """
        WITH RECURSIVE files AS (SELECT file_id, arg_max(config, (received_at, written_at)) AS config FROM (
            SELECT file_id, received_at, written_at, coalesce(config, '') AS config FROM spider2_exec_legacy UNION ALL SELECT file_id, received_at, written_at, coalesce(config, '') FROM spider2_exec_mix) WHERE file_id IS NOT NULL GROUP BY file_id),
        m AS (
          SELECT file_id, false AS inner_, CAST(CASE WHEN json_valid(config) THEN config END AS JSON) AS v FROM files
          UNION ALL SELECT file_id, true, CASE WHEN json_type(c) = 'VARCHAR' AND regexp_matches(c->>'$', '^\\s*[{\\[]') AND json_valid(c->>'$') THEN CAST(c->>'$' AS JSON) ELSE c END
            FROM (SELECT file_id, unnest(map_values(CAST(v AS MAP(VARCHAR, JSON)))) AS c FROM m WHERE json_type(v) = 'OBJECT'))
        SELECT f.file_id, json_valid(any_value(f.config)) AS complete, count(*) FILTER (inner_ AND json_type(v) NOT IN ('OBJECT', 'NULL')) AS n_values FROM files f JOIN m USING (file_id) GROUP BY f.file_id""",
    "p1_found": """
        WITH RECURSIVE raw AS (
          SELECT line_no, 'rubric' AS field, rubric AS x FROM spider2_exec_mix_candidates UNION ALL SELECT line_no, 'missing', missing FROM spider2_exec_mix_candidates
          UNION ALL SELECT line_no, 'findings', findings FROM spider2_exec_mix_candidates),
        n AS (
          SELECT line_no, field, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS path, CAST(x AS JSON) AS v FROM raw WHERE x IS NOT NULL AND json_valid(x)
          UNION ALL
          SELECT line_no, field, CASE WHEN step IS NULL THEN parent ELSE coalesce(path, '') END, CASE WHEN step IS NULL THEN path ELSE concat_ws('/', path, step) END, c FROM (
            SELECT line_no, field, parent, path, unnest(map_keys(m)) AS step, unnest(map_values(m)) AS c FROM (
              SELECT line_no, field, parent, path, CASE json_type(v)
                WHEN 'OBJECT' THEN CAST(v AS MAP(VARCHAR, JSON))
                WHEN 'ARRAY' THEN map_from_entries([(CAST(i - 1 AS VARCHAR), CAST(v AS JSON[])[i]) for i in range(1, CAST(json_array_length(v) AS BIGINT) + 1)]) END AS m FROM n WHERE json_type(v) IN ('OBJECT', 'ARRAY'))
            UNION ALL SELECT line_no, field, parent, path, NULL, CAST(v->>'$' AS JSON) FROM n
              WHERE json_type(v) = 'VARCHAR' AND regexp_matches(v->>'$', '^\\s*["{\\[]') AND json_valid(v->>'$')))
        SELECT DISTINCT line_no, field, coalesce(parent, '') AS parent_path, coalesce(path, '') AS path FROM n
        WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND NOT (json_type(v) = 'VARCHAR' AND regexp_matches(v->>'$', '^\\s*[{\\[]') AND json_valid(v->>'$'))""",
    "p3_found": _ORPHANS + "SELECT DISTINCT ref_table, CAST(ref_id AS BIGINT) AS ref_id, CAST(pos AS INTEGER) AS pos, side, status, ym FROM orphan",
    "p3_by_month": _ORPHANS + "SELECT table_key, ym, status, count(*) AS n_refs FROM (SELECT DISTINCT table_key, ref_table, ref_id, pos, side, status, ym FROM orphan) GROUP BY ALL",
    "p3_current": _ORPHANS + """, last_build AS (SELECT snap_id, source, built_at FROM span WHERE until IS NULL),
        live AS (SELECT DISTINCT l.table_key FROM listed l JOIN last_build b USING (snap_id, source)),
        held AS (SELECT r.* FROM ref r WHERE r.t IS NOT NULL AND (r.ref_table = 'join_hints' OR r.ref_id IN (SELECT snap_id FROM last_build)))
        SELECT table_key, count(*) AS n_refs, CASE WHEN b.first_at IS NULL THEN 'missing' ELSE 'deleted' END AS status
        FROM held h LEFT JOIN born b USING (table_key) WHERE table_key NOT IN (SELECT table_key FROM live) GROUP BY table_key, b.first_at""",
    "p6_found": _TREES + """
        SELECT d.run_id, d.instance_id, d.id,
          CASE WHEN n.id IS NOT NULL THEN '' ELSE coalesce(w.top, d.id) END AS root_id,
          CAST(CASE WHEN o.id IS NOT NULL THEN -1 WHEN n.id IS NOT NULL THEN -2 ELSE d.d END AS INTEGER) AS node_depth,
          CASE WHEN n.id IS NOT NULL THEN '' ELSE concat_ws('/', w.way, d.id) END AS path,
          CAST(coalesce(b.n, 0) AS INTEGER) AS n_below
        FROM deep d LEFT JOIN way w USING (run_id, instance_id, id) LEFT JOIN below b USING (run_id, instance_id, id)
        LEFT JOIN onloop o USING (run_id, instance_id, id) LEFT JOIN under n USING (run_id, instance_id, id)""",
    "p6_ranges": _TREES + """,
        steps AS (SELECT run_id, instance_id, id, list(anc ORDER BY dd) AS l FROM (SELECT u.run_id, u.instance_id, u.id, u.anc, d.d AS dd FROM up u JOIN deep d ON d.run_id = u.run_id AND d.instance_id = u.instance_id AND d.id = u.anc) GROUP BY ALL),
        good AS (SELECT d.run_id, d.instance_id, d.id, list_append(coalesce(l, []), d.id) AS l, coalesce(b.n, 0) AS n FROM deep d LEFT JOIN steps s USING (run_id, instance_id, id) LEFT JOIN below b USING (run_id, instance_id, id)
          WHERE NOT EXISTS (SELECT 1 FROM under x WHERE x.run_id = d.run_id AND x.instance_id = d.instance_id AND x.id = d.id))
        SELECT run_id, instance_id, id, row_number() OVER w - 1 AS first, row_number() OVER w - 1 + n AS last FROM good WINDOW w AS (PARTITION BY run_id, instance_id ORDER BY l)""",
}
