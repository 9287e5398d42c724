"""Rows of the tables and edges that snapshot payloads list."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from catalith.functions.jsontext import Incomplete, parse
from catalith.functions.names import table_key

TABLE_FIELDS = ("description", "owner", "row_count", "kind")


def _objects(payload, name: str) -> list:
    found = payload.get(name) if isinstance(payload, dict) else None
    return found if isinstance(found, list) else []


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def listed_tables(snapshots: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, pos, table_key, description, owner, row_count, kind (texts) of each table that a payload lists.

    Payloads that are null or not complete JSON, and tables without a name, list nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, text in enumerate(b.column("payload").to_pylist()):
                try:
                    payload = parse(text) if text is not None else None
                except Incomplete:
                    continue
                for pos, t in enumerate(_objects(payload, "tables")):
                    if isinstance(t, dict) and (key := table_key(t.get("catalog"), t.get("schema"), t.get("name"))):
                        take.append(i)
                        rows.append((pos, key, *[_text(t.get(f)) for f in TABLE_FIELDS]))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(take)) for c in keep], pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=[*keep, "pos", "table_key", *TABLE_FIELDS])

    types = {f.name: f.dataType.simpleString() for f in snapshots.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", pos int, table_key string, " + ", ".join(f"{f} string" for f in TABLE_FIELDS)
    return snapshots.select(*keep, "payload").mapInArrow(run, schema)


def listed_names(snapshots: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, side, pos, table_key: the tables listed (side ``table``) and the ends of edges (``from``, ``to``), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, text in enumerate(b.column("payload").to_pylist()):
                try:
                    payload = parse(text) if text is not None else None
                except Incomplete:
                    continue
                for pos, t in enumerate(_objects(payload, "tables")):
                    if isinstance(t, dict) and (key := table_key(t.get("catalog"), t.get("schema"), t.get("name"))):
                        take.append(i)
                        rows.append(("table", pos, key))
                for pos, e in enumerate(_objects(payload, "edges")):
                    for side in ("from", "to"):
                        if isinstance(e, dict) and (key := table_key(e.get(f"{side}_table"))):
                            take.append(i)
                            rows.append((side, pos, key))
            if rows:
                side, pos, key = zip(*rows)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(take)) for c in keep], pa.array(side), pa.array(pos, pa.int32()), pa.array(key)], names=[*keep, "side", "pos", "table_key"])

    types = {f.name: f.dataType.simpleString() for f in snapshots.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", side string, pos int, table_key string"
    return snapshots.select(*keep, "payload").mapInArrow(run, schema)
