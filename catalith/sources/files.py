"""Schema files: one JSON for each table with DDL.csv, and tables.json with one database for each entry."""

from __future__ import annotations

import csv
import io
import json

from catalith.operators.families import family_name
from catalith.sources.base import Connector, column, edge, fqn, register, table
from catalith.sources.ddl import parse_ddl

JACCARD = 0.8


def _texts(spark, path: str, pattern: str) -> list[str]:
    return [r.value for r in spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).toLocalIterator()]


def sample_texts(rows: list[dict], name: str, limit: int = 5) -> list[str]:
    """Distinct short texts of a member, in the order of the rows."""
    out: list[str] = []
    for r in rows:
        v = r.get(name)
        if isinstance(v, str) and 0 < len(v) <= 80 and v not in out:
            out.append(v)
        if len(out) == limit:
            break
    return out


def split_name(full: str) -> tuple[str | None, str | None, str]:
    """(catalog, schema, name): all before the schema is the catalog."""
    *head, name = full.split(".")
    schema = head.pop() if head else None
    return ".".join(head) or None, schema, name


def collapse(tables: list[dict]) -> list[dict]:
    """Families of tables that differ in runs of digits only become their first member, with the columns of all and a note on the members; other tables keep their place."""
    groups: dict[tuple, list[dict]] = {}
    import re

    for t in tables:
        groups.setdefault((t["catalog"], t["schema"], re.sub(r"\d+", "*", t["name"].lower().strip())), []).append(t)
    merged, gone = [], set()
    for members in groups.values():
        clusters: list[list[dict]] = []
        for t in sorted(members, key=lambda t: t["name"]):
            own = {c["name"].lower() for c in t["columns"]}
            for c in clusters:
                first = {x["name"].lower() for x in c[0]["columns"]}
                if len(own & first) >= JACCARD * max(1, len(own | first)):
                    c.append(t)
                    break
            else:
                clusters.append([t])
        for c in clusters:
            if len(c) > 1:
                names = [t["name"] for t in c]
                columns = {x["name"].lower(): x for t in reversed(c) for x in t["columns"]}
                order = list(dict.fromkeys(x["name"].lower() for t in c for x in t["columns"]))
                note = f"(date-sharded family of {len(c)} tables, {names[0]} … {names[-1]})"
                merged.append({**c[0], "name": family_name(names), "columns": [columns[k] for k in order], "description": " ".join(filter(None, [c[0].get("description"), note])), "properties": {**c[0].get("properties", {}), "members": ",".join(names), "family": "true"}})
                gone.update(id(t) for t in c)
    return [t for t in tables if id(t) not in gone] + merged


@register
class SchemaFilesConnector(Connector):
    """config: path of a folder with table JSON files and, optionally, DDL.csv (keys and types that the files lack)."""

    type = "schema_files"
    required = ("path",)

    def introspect(self) -> dict:
        tables = []
        for text in sorted(_texts(self.spark, self.config["path"], "*.json")):
            try:
                d = json.loads(text)
            except ValueError:
                self.warnings.append("a file isn't JSON")
                continue
            catalog, schema, name = split_name(d.get("table_fullname") or d["table_name"])
            notes = d.get("description") or []
            rows = d.get("sample_rows") or []
            columns = [column(c, t, description=(notes[i] if i < len(notes) else None), sample_values=sample_texts(rows, c)) for i, (c, t) in enumerate(zip(d.get("column_names", []), d.get("column_types", [])))]
            have = {c["name"] for c in columns}
            columns += [column(c, t, tags=["nested"]) for c, t in zip(d.get("nested_column_names") or [], d.get("nested_column_types") or []) if c not in have]
            tables.append(table(name, schema, catalog, columns=columns))
        tables = collapse(tables)
        edges: list[dict] = []
        for text in _texts(self.spark, self.config["path"], "DDL.csv"):
            edges += self._overlay(tables, ";\n".join(r.get("DDL") or r.get("ddl") or "" for r in csv.DictReader(io.StringIO(text))))
        return self.payload(tables, edges)

    @staticmethod
    def _overlay(tables: list[dict], ddl: str) -> list[dict]:
        by = {t["name"].lower(): t for t in tables}
        found, edges, _ = parse_ddl(ddl)
        for f in found:
            if t := by.get(f["name"].lower()):
                own = {c["name"].lower(): c for c in t["columns"]}
                for c in f["columns"]:
                    if o := own.get(c["name"].lower()):
                        o["data_type"] = o.get("data_type") or c["data_type"]
                        o["is_primary_key"] = bool(o.get("is_primary_key") or c["is_primary_key"])
        name = lambda x: x.rpartition(".")[2].lower()
        return [{**e, "from_table": fqn(by[name(e["from_table"])]), "to_table": fqn(by[name(e["to_table"])])} for e in edges if name(e["from_table"]) in by and name(e["to_table"]) in by]


@register
class TablesJsonConnector(Connector):
    """config: path of a tables.json; db_id to read one database only. Readable names become the business name, each database a schema."""

    type = "tables_json"
    required = ("path",)

    def introspect(self) -> dict:
        tables, edges = [], []
        for text in _texts(self.spark, self.config["path"], "*.json"):
            for d in json.loads(text):
                if self.config.get("db_id") not in (None, d["db_id"]):
                    continue
                own = [table(n, d["db_id"], properties={"business_name": r} if r.lower() != n.lower() else {}) for n, r in zip(d["table_names_original"], d["table_names"])]
                at: dict[int, tuple[dict, str]] = {}
                for i, ((k, name), (_, readable), kind) in enumerate(zip(d["column_names_original"], d["column_names"], d["column_types"])):
                    if k >= 0:
                        own[k]["columns"].append(column(name, kind, is_primary_key=i in d["primary_keys"], properties={"business_name": readable} if readable.lower() != name.lower() else {}))
                        at[i] = (own[k], name)
                tables += own
                edges += [edge("foreign_key", fqn(at[a][0]), fqn(at[b][0]), [at[a][1]], [at[b][1]]) for a, b in d["foreign_keys"]]
        return self.payload(tables, edges)
