"""Connectors as queries: the merged catalog written in the form of each source and read back through its connector, with SQL that says what must come out.

The pages, texts and files that a connector reads describe one catalog, so they are made and read on the driver like any source's metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import merge as M
from catalith.plans.link_queries import _cat
from catalith.plans.sqltext import CATALOG
from catalith.session import ensure_checkpoint_dir
from catalith.sources.base import connect

Columns = dict[str, list[tuple[str, str | None, bool]]]
Keys = list[tuple[str, str, list[str], list[str]]]


def _recorded(spark: SparkSession, sf: str) -> tuple[Columns, Keys]:
    """table -> (column, type, primary) and the foreign keys between these tables that name as many columns on both sides; dots in names become two underscores."""
    cat = _cat(spark, sf)
    flat = lambda k: k.replace(".", "__")
    columns: Columns = {}
    for r in M.merge_columns(cat).orderBy("table_key", "ord").toLocalIterator():
        columns.setdefault(flat(r.table_key), []).append((r.col, r.data_type, r.is_primary_key))
    edges = M.distinct_edges(cat).filter("kind = 'foreign_key' and size(from_columns) > 0 and size(from_columns) = size(to_columns)").select("from_key", "to_key", "from_columns", "to_columns").distinct()
    keys = [(flat(r.from_key), flat(r.to_key), list(r.from_columns), list(r.to_columns)) for r in edges.orderBy("from_key", "to_key", "from_columns", "to_columns").toLocalIterator()]
    return columns, [k for k in keys if k[0] in columns and k[1] in columns]


def _rows(spark: SparkSession, payload: dict, flag: Callable[[dict], bool], typed: bool = True) -> DataFrame:
    """kind (column, edge), a, b, c, d: table, column, flag and type, or both tables and their columns."""
    name = lambda t: ".".join(p for p in (t.get("catalog"), t.get("schema"), t["name"]) if p)
    rows = [("column", name(t), c["name"], str(flag(c)).lower(), (c.get("data_type") or "").upper() if typed else "") for t in payload["tables"] for c in t["columns"]]
    rows += [("edge", e["from_table"], e["to_table"], ",".join(e["from_columns"]), ",".join(e["to_columns"])) for e in payload["edges"]]
    return spark.createDataFrame(rows, "kind string, a string, b string, c string, d string").distinct()


def _primary(c: dict) -> bool:
    return bool(c.get("is_primary_key"))


def _file(spark: SparkSession, value) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/pages/{uuid.uuid4().hex}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    return path.toString()


def src_ddl(spark: SparkSession, sf: str) -> DataFrame:
    columns, keys = _recorded(spark, sf)
    said = lambda cols: ", ".join(f'"{c}"' for c in cols)
    text = []
    for t, cols in columns.items():
        body = [f'"{c}" {kind or "TEXT"}' for c, kind, _ in cols]
        if any(pk for *_, pk in cols):
            body.append(f"PRIMARY KEY ({said(c for c, _, pk in cols if pk)})")
        text.append(f'CREATE TABLE main."{t}" ({", ".join(body)});')
    text += [f'ALTER TABLE main."{a}" ADD CONSTRAINT k{i} FOREIGN KEY ({said(x)}) REFERENCES main."{b}" ({said(y)});' for i, (a, b, x, y) in enumerate(keys)]
    return _rows(spark, connect(spark, "ddl", "s", text="\n".join(text)).introspect(), _primary)


def src_unity(spark: SparkSession, sf: str) -> DataFrame:
    columns, keys = _recorded(spark, sf)
    tables = []
    for t, cols in columns.items():
        constraints = [{"primary_key_constraint": {"child_columns": [c for c, _, pk in cols if pk]}}] + [{"foreign_key_constraint": {"child_columns": x, "parent_table": f"u.main.{b}", "parent_columns": y}} for a, b, x, y in keys if a == t]
        tables.append({"name": t, "columns": [{"name": c, "type_text": kind, "position": i} for i, (c, kind, _) in enumerate(cols)], "table_constraints": constraints})
    routes = {"catalogs": [{"catalogs": [{"name": "u"}, {"name": "system"}]}], "schemas": [{"schemas": [{"name": "main"}]}], "tables": [{"tables": tables[:50]}, {"tables": tables[50:]}]}
    return _rows(spark, connect(spark, "unity_catalog", "s", pages=lambda request, **p: iter(routes.get(request, []))).introspect(), _primary)


def src_glue(spark: SparkSession, sf: str) -> DataFrame:
    """Key columns stand as partition keys; this source has no foreign keys."""
    columns, _ = _recorded(spark, sf)
    field = lambda c, kind: {"Name": c, "Type": kind}
    tables = [{"Name": t, "StorageDescriptor": {"Columns": [field(c, k) for c, k, pk in cols if not pk]}, "PartitionKeys": [field(c, k) for c, k, pk in cols if pk]} for t, cols in columns.items()]
    routes = {"databases": [{"DatabaseList": [{"Name": "main"}]}], "tables": [{"TableList": tables}]}
    return _rows(spark, connect(spark, "aws_glue", "s", pages=lambda request, **p: iter(routes.get(request, []))).introspect(), lambda c: "partition_key" in c.get("tags", []))


def src_collibra(spark: SparkSession, sf: str) -> DataFrame:
    """Columns as assets held by their tables, each pair of key columns as a relation; primary keys aren't told."""
    columns, keys = _recorded(spark, sf)
    kinds = {"Table": "T", "Column": "C", "Schema": "S", "Business Term": "B"}
    assets = {"S": [{"id": "s", "name": "main"}], "T": [{"id": f"t:{t}", "name": t} for t in columns], "C": [{"id": f"c:{t}:{c}", "name": f"{t} > {c}"} for t, cols in columns.items() for c, *_ in cols], "B": []}
    types = {f"c:{t}:{c}": kind for t, cols in columns.items() for c, kind, _ in cols}
    one = lambda a, b, k: {"source": {"id": a}, "target": {"id": b}, "type": {"id": k}}
    relations = [one("s", f"t:{t}", "h") for t in columns] + [one(f"t:{t}", f"c:{t}:{c}", "h") for t, cols in columns.items() for c, *_ in cols]
    known = set(types)
    relations += [one(f"c:{a}:{p}", f"c:{b}:{q}", "r") for a, b, x, y in keys for p, q in zip(x, y) if f"c:{a}:{p}" in known and f"c:{b}:{q}" in known]

    def pages(request: str, **p):
        if request == "assetTypes":
            yield {"results": [{"id": kinds[p["name"]]}]}
        elif request == "assets":
            yield {"results": assets[p["typeIds"]]}
        elif request == "relationTypes":
            yield {"results": [{"id": "h", "role": "contains"}, {"id": "r", "role": "references"}]}
        elif request == "relations":
            yield {"results": relations}
        elif request == "attributes" and types.get(p["assetId"]):
            yield {"results": [{"type": {"name": "Data Type"}, "value": types[p["assetId"]]}]}

    return _rows(spark, connect(spark, "collibra", "s", pages=pages).introspect(), lambda c: False)


def src_tables_json(spark: SparkSession, sf: str) -> DataFrame:
    """Keys are told column by column."""
    columns, keys = _recorded(spark, sf)
    names, flat = list(columns), [(-1, "*", None, False)]
    for i, cols in enumerate(columns.values()):
        flat += [(i, c, kind, pk) for c, kind, pk in cols]
    at = {(names[i], c): n for n, (i, c, *_) in enumerate(flat) if i >= 0}
    doc = {
        "db_id": "main", "table_names_original": names, "table_names": names, "column_names_original": [[i, c] for i, c, *_ in flat], "column_names": [[i, c] for i, c, *_ in flat], "column_types": [k for _, _, k, _ in flat],
        "primary_keys": [n for n, (*_, pk) in enumerate(flat) if pk], "foreign_keys": [[at[a, p], at[b, q]] for a, b, x, y in keys for p, q in zip(x, y) if (a, p) in at and (b, q) in at],
    }
    return _rows(spark, connect(spark, "tables_json", "s", path=_file(spark, [doc])).introspect(), _primary)


def src_manifest(spark: SparkSession, sf: str) -> DataFrame:
    columns, keys = _recorded(spark, sf)
    nodes = {}
    for t, cols in columns.items():
        nodes[f"model.p.{t}"] = {
            "resource_type": "model", "package_name": "p", "name": t, "schema": "main", "columns": {c: {"data_type": k, "constraints": [{"type": "primary_key"}] if pk else []} for c, k, pk in cols},
            "constraints": [{"type": "foreign_key", "columns": x, "to": f"ref('p', '{b}')", "to_columns": y} for a, b, x, y in keys if a == t],
        }
    return _rows(spark, connect(spark, "dbt", "s", path=_file(spark, {"nodes": nodes})).introspect(), _primary)


def src_warehouse(spark: SparkSession, sf: str) -> DataFrame:
    """Columns and row counts of the tables of the star schema, read from their files."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    p = connect(spark, "duckdb", "s", path=sf, tables=names, samples=0).introspect()
    rows = [(t["name"], c["name"], i, t["row_count"]) for t in p["tables"] for i, c in enumerate(t["columns"])]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int, row_count long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"src_ddl": src_ddl, "src_unity": src_unity, "src_glue": src_glue, "src_collibra": src_collibra, "src_tables_json": src_tables_json, "src_manifest": src_manifest, "src_warehouse": src_warehouse}

_READ = CATALOG + """, rc AS (SELECT {0} || replace(table_key, '.', '__') AS a, col AS b, is_primary_key AS pk, upper(coalesce(data_type, '{1}')) AS d FROM mc),
    rk AS (SELECT DISTINCT {0} || replace(from_key, '.', '__') AS a, {0} || replace(to_key, '.', '__') AS b, from_columns AS x, to_columns AS y FROM de WHERE kind = 'foreign_key' AND len(from_columns) > 0 AND len(from_columns) = len(to_columns)
      AND from_key IN (SELECT table_key FROM mc) AND to_key IN (SELECT table_key FROM mc))
    SELECT DISTINCT 'column' AS kind, a, b, {2} AS c, d FROM rc"""
_WHOLE = " UNION SELECT 'edge', a, b, array_to_string(x, ','), array_to_string(y, ',') FROM rk"
_PAIRS = " UNION SELECT 'edge', a, b, p, q FROM (SELECT a, b, unnest(x) AS p, unnest(y) AS q FROM rk) WHERE (a, p) IN (SELECT (a, b) FROM rc) AND (b, q) IN (SELECT (a, b) FROM rc)"
_PK = "CAST(pk AS VARCHAR)"
_STAR = "region nation customer supplier part orders lineitem events".split()

SQL: dict[str, str] = {
    "src_ddl": _READ.format("'main.'", "TEXT", _PK) + _WHOLE,
    "src_unity": _READ.format("'u.main.'", "", _PK) + _WHOLE,
    "src_glue": _READ.format("'main.'", "", _PK),
    "src_collibra": _READ.format("'main.'", "", "'false'") + _PAIRS,
    "src_tables_json": _READ.format("'main.'", "", _PK) + _PAIRS,
    "src_manifest": _READ.format("'main.'", "", _PK) + _WHOLE,
    "src_warehouse": " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CAST(row_number() OVER () - 1 AS INTEGER) AS place, (SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE {t})" for t in _STAR),
}
