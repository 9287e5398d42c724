"""Connectors: each reads one source's metadata into a payload of tables, edges and terms."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SNAPSHOT = "snap_id long, source string, source_type string, payload string, n_tables int, n_edges int, n_terms int, warnings string, built_at timestamp"
_SECRET = re.compile(r"token|secret|password|key", re.I)


def table(name: str, schema: str | None = None, catalog: str | None = None, kind: str = "table", columns: list[dict] | None = None, **more: Any) -> dict:
    return {"name": name, "schema": schema, "catalog": catalog, "kind": kind, "columns": columns or [], **more}


def column(name: str, data_type: str | None = None, **more: Any) -> dict:
    return {"name": name, "data_type": data_type, **more}


def edge(kind: str, a: str, b: str, from_columns: list[str] = (), to_columns: list[str] = (), **more: Any) -> dict:
    return {"kind": kind, "from_table": a, "to_table": b, "from_columns": list(from_columns), "to_columns": list(to_columns), **more}


def fqn(t: dict) -> str:
    return ".".join(p for p in (t.get("catalog"), t.get("schema"), t["name"]) if p)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that are outside parentheses and quotes."""
    out, depth, quote, cur = [], 0, "", []
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and depth == 0:
            out.append("".join(cur))
            cur = []
            continue
        cur.append(c)
    out.append("".join(cur))
    return [p.strip() for p in out if p.strip()]


class Connector:
    """config: what the source needs. introspect gives a payload, check a line about the source."""

    type = ""
    required: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, source: str, **config: Any):
        missing = [k for k in self.required if config.get(k) is None]
        if missing:
            raise ValueError(f"{self.type}: {', '.join(missing)} is missing")
        self.spark, self.source, self.config = spark, source, expand(config)
        self.warnings: list[str] = []

    def introspect(self) -> dict:
        raise NotImplementedError

    def check(self) -> str:
        p = self.introspect()
        return f"{len(p['tables'])} tables"

    def payload(self, tables: list[dict], edges: list[dict] = (), terms: list[dict] = ()) -> dict:
        return {"source": self.source, "source_type": self.type, "tables": tables, "edges": list(edges), "terms": list(terms), "warnings": self.warnings}


REGISTRY: dict[str, type[Connector]] = {}


def register(cls: type[Connector]) -> type[Connector]:
    REGISTRY[cls.type] = cls
    return cls


def connect(spark: SparkSession, kind: str, source: str, **config: Any) -> Connector:
    """KeyError for an unknown kind, ValueError for a config that lacks something."""
    from catalith.sources import ddl, files, projects, rest, warehouse  # noqa: F401  (they register themselves)

    return REGISTRY[kind](spark, source, **config)


def expand(value: Any) -> Any:
    """${NAME} from the environment; names that aren't set stay as written."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m.group(1), m.group(0)), value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def redact(config: Any) -> Any:
    """Values of keys that name secrets as ``***``."""
    if isinstance(config, dict):
        return {k: "***" if _SECRET.search(k) and v else redact(v) for k, v in config.items()}
    return [redact(v) for v in config] if isinstance(config, list) else config


def snapshot_rows(spark: SparkSession, payloads: list[dict], built_at: datetime | None = None) -> DataFrame:
    """Payloads as a snapshots table, one build for each source."""
    at = built_at or datetime.now(timezone.utc)
    rows = [(i, p["source"], p["source_type"], json.dumps(p), len(p["tables"]), len(p["edges"]), len(p["terms"]), json.dumps(p.get("warnings", [])), at) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SNAPSHOT)


def curated(terms: list[dict], hints: list[dict]) -> dict:
    """The user's glossary and join hints as a source of their own, which comes first in every merge."""
    return {"source": "user", "source_type": "user", "tables": [], "edges": [edge("join_hint", h["from_table"], h["to_table"], h.get("from_columns", []), h.get("to_columns", []), description=h.get("description")) for h in hints], "terms": terms, "warnings": []}
