"""The lookups that an assistant calls, as plain functions over an engine, and a small command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from catalith.engine import Engine
from catalith.plans.link import LinkOptions


def link_schema(e: Engine, question: str, max_tables: int = 20) -> str:
    return e.ddl(question, LinkOptions(max_tables=max_tables))


def link_schema_json(e: Engine, question: str, max_tables: int = 20) -> dict:
    got = e.link([question], LinkOptions(max_tables=max_tables))
    cols: dict[str, list[dict]] = {}
    for r in got.columns.orderBy("table_key", "ord").collect():
        cols.setdefault(r.table_key, []).append({"name": r.col, "score": r.score, "reason": r.reason})
    tables = [{"table": r.table_key, "score": round(r.score, 6), "anchor": r.anchor, "columns": cols.get(r.table_key, [])} for r in got.tables.orderBy(F.desc("score"), "table_key").collect()]
    return {"question": question, "tables": tables, "join_paths": [{"tables": r.tables, "reliability": r.reliability} for r in got.paths.orderBy("place").collect()]}


def search_tables(e: Engine, text: str, limit: int = 20) -> list[dict]:
    """Tables whose name, description or columns contain a text, by name."""
    q = text.lower()
    cols = e.objects.columns.groupBy("table_key").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    t = e.tables().join(cols, "table_key", "left")
    hit = F.col("table_key").contains(q) | F.coalesce(F.lower("description").contains(q), F.lit(False)) | F.coalesce(F.exists("cols", lambda c: c.contains(q)), F.lit(False))
    return [{"table": r.table_key, "description": r.description, "columns": (r.cols or [])[:50]} for r in t.filter(hit).orderBy("table_key").limit(limit).collect()]


def get_table(e: Engine, name: str) -> dict:
    key = e.find_table(name)
    if key is None:
        return {"error": f"no table {name}"}
    t = e.tables().filter(F.col("table_key") == key).first().asDict()
    t["columns"] = [{"name": c.name, "type": c.data_type, "primary_key": c.is_primary_key, "samples": c.samples} for c in e.objects.columns.filter(F.col("table_key") == key).orderBy("ord").collect()]
    t["relations"] = [{"kind": r.kind, "from": r.from_key, "to": r.to_key, "on": [f"{a}={b}" for a, b in zip(r.from_columns, r.to_columns)]} for r in e.objects.edges.filter((F.col("from_key") == key) | (F.col("to_key") == key)).collect()]
    return t


def find_join_path(e: Engine, a: str, b: str) -> dict:
    try:
        paths = e.join_path(a, b)
    except KeyError as x:
        return {"error": f"no table {x.args[0]}"}
    return {"paths": [{"tables": p, "steps": [[r.kind for r in e.relations(u, v).collect()] for u, v in zip(p, p[1:])]} for p in paths]}


def list_glossary(e: Engine) -> list[dict]:
    return [r.asDict() for r in e.glossary().orderBy("term").collect()]


def graph_stats(e: Engine) -> dict:
    return e.stats()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("catalith")
    p.add_argument("--ddl", action="append", default=[], metavar="SOURCE=PATH")
    p.add_argument("--manifest", action="append", default=[], metavar="SOURCE=PATH")
    p.add_argument("--project", action="append", default=[], metavar="SOURCE=PATH")
    sub = p.add_subparsers(dest="do", required=True)
    for name, *words in (("link", "question"), ("explain", "question"), ("search", "text"), ("table", "name"), ("path", "a", "b"), ("stats",), ("glossary",)):
        s = sub.add_parser(name)
        for w in words:
            s.add_argument(w)
    a = p.parse_args(args)
    from catalith.session import build_session

    e = Engine(build_session("local[*]"))
    for kind, given in (("ddl", a.ddl), ("dbt", a.manifest), ("dbt_project", a.project)):
        for x in given:
            source, _, path = x.partition("=")
            e.add(kind, source, path=path)
    out = {
        "link": lambda: link_schema(e, a.question), "explain": lambda: link_schema_json(e, a.question), "search": lambda: search_tables(e, a.text), "table": lambda: get_table(e, a.name),
        "path": lambda: find_join_path(e, a.a, a.b), "stats": lambda: graph_stats(e), "glossary": lambda: list_glossary(e),
    }[a.do]()
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))


if __name__ == "__main__":
    main()
