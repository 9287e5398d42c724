"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.llm.leakage import leaks
from catalith.llm.lookalike import STAND, consistent_forms, lookalike_classes, lookalike_pairs
from catalith.llm.mixing import mix, mix_report, shares
from catalith.llm.survivors import described_tables, survivors, trust_order
from catalith.llm.topn import top_n
from catalith.session import table

#: p5: how many lines of each question.
TOP = 5


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = described_tables(table(spark, sf, "snapshots"), table(spark, sf, "connections"))
    return survivors(rows, "table_key", "source", trust_order(), [["description"], ["owner"], ["row_count"]]).select("table_key", "field", "source")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving record with the owner and the row count bound together, and the description fixed by the owner."""
    rows = described_tables(table(spark, sf, "snapshots"), table(spark, sf, "connections"))
    return survivors(rows, "table_key", "source", trust_order(), [["owner", "row_count"], ["description"], ["kind"]], [("owner", "description")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "spider2_exec_mix_candidates")
    return top_n(c, "instance_id", "score", "line_no", TOP).select("instance_id", "rank_no", "line_no")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id").select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id", near=True)


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).select("doc_id", "source", "tokens", "uses")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return shares(mix(table(spark, sf, "documents"), targets), targets)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_classes(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, sf: str) -> DataFrame:
    return consistent_forms(table(spark, sf, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_records": p2_records, "p5_found": p5_found, "p7_found": p7_found, "p7_near": p7_near, "p8_uses": p8_uses, "p8_shares": p8_shares, "p8_report": p8_report, "p9_found": p9_found, "p9_forms": p9_forms, "p9_classes": p9_classes}

# Looks of texts in SQL: not the consistent form, but equal for the same texts.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_BLANK = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_ALIKE = [(c, s) for c, s in STAND.items() if c != s] + list(zip("ёЁїЇ", "ëËïÏ"))
_LOOK = (
    "nfc_normalize(translate(regexp_replace({0}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), '"
    + _WIDE.replace("'", "''") + _BLANK + "".join(c for c, _ in _ALIKE) + "', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''").replace("{", "{{").replace("}", "}}") + " " * len(_BLANK) + "".join(s for _, s in _ALIKE) + "'))"
)


def _look(column: str) -> str:
    return _LOOK.format(column)


# The records of all tables with their trust.
_RECORDS = """
        WITH latest AS (SELECT source, source_type, built_at, payload FROM (SELECT DISTINCT snap_id, source, source_type, built_at, payload FROM snapshots)
                        QUALIFY row_number() OVER (PARTITION BY source ORDER BY built_at DESC, snap_id DESC) = 1),
        conn AS (SELECT name, priority FROM (SELECT DISTINCT name, priority, updated_at, created_at FROM connections)
                 QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, created_at DESC) = 1),
        t AS (SELECT source, replace(lower(trim(source_type)), '-', '_') AS st, built_at, unnest(CAST(json_extract(payload, '$.tables') AS JSON[])) AS t, generate_subscripts(CAST(json_extract(payload, '$.tables') AS JSON[]), 1) AS pos FROM latest),
        r AS (SELECT array_to_string([lower(trim(translate(s, '"`[]', ''))) for s in string_split(
                concat_ws('.', nullif(t->>'catalog', ''), nullif(t->>'schema', ''), nullif(t->>'name', '')), '.')], '.') AS table_key,
                source, st, built_at, pos, t->>'description' AS description, t->>'owner' AS owner, t->>'row_count' AS row_count, t->>'kind' AS kind FROM t),
        p AS (SELECT r.*, coalesce(c.priority, CASE st WHEN 'user' THEN 0 WHEN 'collibra' THEN 10 WHEN 'dbt' THEN 20 WHEN 'unity_catalog' THEN 30
                WHEN 'duckdb' THEN 40 WHEN 'ddl' THEN 50 WHEN 'aws_glue' THEN 60 ELSE 70 END) AS pr FROM r LEFT JOIN conn c ON c.name = r.source),
"""
# A value that says something, else null.
_SAID = "CASE WHEN lower(trim({0})) NOT IN ('', '-', '?', 'n/a', 'none', 'null', 'unknown', 'tbd', 'todo') THEN {0} END"

SQL: dict[str, str] = {
    "p2_records": _RECORDS + f"""
        v AS (SELECT table_key, source, [CAST(st <> 'user' AS BIGINT), pr, -epoch_us(built_at)] AS tr, pos, {_SAID.format('owner')} AS owner, {_SAID.format('row_count')} AS row_count, {_SAID.format('description')} AS description, {_SAID.format('kind')} AS kind
              FROM p WHERE table_key IN (SELECT table_key FROM p GROUP BY ALL HAVING count(DISTINCT source) > 1)),
        oc AS (SELECT table_key, owner, row_count, min((CAST(owner IS NULL AS INT) + CAST(row_count IS NULL AS INT), tr, source, pos)) AS o FROM v WHERE owner IS NOT NULL OR row_count IS NOT NULL GROUP BY ALL),
        dc AS (SELECT table_key, description, min((tr, source, pos)) AS o FROM v WHERE description IS NOT NULL GROUP BY ALL),
        kc AS (SELECT table_key, kind, min((tr, source, pos)) AS o FROM v WHERE kind IS NOT NULL GROUP BY ALL),
        a AS (SELECT table_key, owner, row_count, struct_extract(o, 3) AS src, row_number() OVER (PARTITION BY table_key ORDER BY o) AS r FROM oc UNION ALL SELECT DISTINCT table_key, NULL, NULL, NULL, NULL FROM v),
        d AS (SELECT table_key, description, struct_extract(o, 2) AS src, row_number() OVER (PARTITION BY table_key ORDER BY o) AS r FROM dc UNION ALL SELECT DISTINCT table_key, NULL, NULL, NULL FROM v),
        best AS (SELECT a.table_key, a.owner, a.row_count, a.src AS a_src, d.description, d.src AS d_src FROM a JOIN d USING (table_key)
                 WHERE a.owner IS NULL OR d.description IS NULL OR EXISTS (SELECT 1 FROM v WHERE v.table_key = a.table_key AND v.owner = a.owner AND v.description = d.description)
                 QUALIFY row_number() OVER (PARTITION BY a.table_key ORDER BY round(coalesce(1.0::DOUBLE / a.r, 0) + coalesce(1.0::DOUBLE / d.r, 0), 11) DESC, a.r NULLS LAST, d.r NULLS LAST) = 1)
        SELECT table_key, 'owner' AS field, owner AS value, a_src AS source FROM best WHERE owner IS NOT NULL
        UNION ALL SELECT table_key, 'row_count', row_count, a_src FROM best WHERE row_count IS NOT NULL
        UNION ALL SELECT table_key, 'description', description, d_src FROM best WHERE description IS NOT NULL
        UNION ALL SELECT table_key, 'kind', arg_min(kind, o), arg_min(struct_extract(o, 2), o) FROM kc GROUP BY table_key""",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower({_look('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower({_look('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)]) AS run FROM d WHERE len(w) >= 12),
        iw AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)]) AS run FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)""",
    "p9_found": f"""
        WITH f AS (SELECT doc_id, text, md5({_look('text')}) AS look FROM documents WHERE text <> '')
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_classes": f"""
        WITH f AS (SELECT doc_id, md5(text) AS t, md5({_look('text')}) AS look FROM documents WHERE text <> ''),
        x AS (SELECT look, t, min(doc_id) AS text_id, count(DISTINCT doc_id) AS n FROM f GROUP BY ALL),
        c AS (SELECT look, min(text_id) AS class_id, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_docs FROM x GROUP BY ALL HAVING count(*) > 1)
        SELECT DISTINCT doc_id, class_id, text_id, n_texts, n_docs FROM f JOIN x USING (look, t) JOIN c USING (look)""",
    "p2_found": _RECORDS + """
        f AS (SELECT table_key, source, st, built_at, pr, unnest(['description', 'owner', 'row_count']) AS field, unnest([description, owner, row_count]) AS value FROM p
              WHERE table_key IN (SELECT table_key FROM p GROUP BY ALL HAVING count(DISTINCT source) > 1))
        SELECT table_key, field, source FROM f
        WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', '-', '?', 'n/a', 'none', 'null', 'unknown', 'tbd', 'todo')
        QUALIFY row_number() OVER (PARTITION BY table_key, field ORDER BY st <> 'user', pr, built_at DESC, source) = 1""",
    "p5_found": """
        SELECT instance_id, CAST(rank_no AS INTEGER) AS rank_no, line_no FROM (
          SELECT instance_id, line_no, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, line_no) AS rank_no
          FROM spider2_exec_mix_candidates WHERE instance_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
        ) WHERE rank_no <= 5""",
}
