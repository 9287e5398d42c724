"""Nested JSON to flat, linked tables by shared inlining.

A first pass over all texts builds the schema graph: element types, their members and how often they
occur. Types that are roots, repeated (list items, entries of a map-like object), shared (held by more
than one type) or recursive get a table; all others are inlined into the table of their holder. A
second pass writes the rows with their foreign keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.jsontext import Incomplete, opened, parse
from catalith.functions.worker import no_cycle_search
from catalith.session import cut

#: An object type with more different keys than this is a map: its keys are data and its entries are repeated.
MAX_MEMBERS = 64
#: Groups in which the tasks' schema graphs are merged before they reach the driver.
MERGE_GROUPS = 32
#: From this depth on all types are one, so that the graph stays shallow for texts of any depth.
MAX_DEPTH = 100
ITEM, ENTRY = "[]", "{}"


class Node:
    """A type in the schema graph. kids: members, ITEM or ENTRY. plain: it has values of its own."""

    __slots__ = ("kids", "plain", "back", "deep", "table")

    def __init__(self, deep: int = 0):
        self.deep = deep
        self.table: str | None = None
        self.kids: dict[str, Node] = {}
        self.plain = False
        self.back: set[str] = set()  # names of members that are an element further up: recursion

    def kid(self, name: str) -> Node:
        if self.deep >= MAX_DEPTH:
            return self
        node = self.kids.get(name)
        if node is None:
            node = self.kids[name] = Node(self.deep + 1)
        return node

    def seen(self, name: str) -> Node:
        """The type of a member in the finished graph."""
        return self if self.deep >= MAX_DEPTH else self.kids.get(name) or Node(self.deep + 1)

    def fold(self, limit: int) -> None:
        """Too many keys: they become data, and their types one. Folding early or late gives the same: keys only ever add up."""
        names = [k for k in self.kids if k not in (ITEM, ENTRY)]
        if ENTRY in self.kids or len(self.back.union(names)) > limit:
            into = self.kid(ENTRY)
            for k in names:
                into.merge(self.kids.pop(k), limit)
            self.back.clear()  # keys that are data name no types

    def merge(self, other: Node, limit: int) -> None:
        self.plain |= other.plain
        self.back |= other.back
        for k, o in other.kids.items():
            self.kid(k).merge(o, limit)
        self.fold(limit)

    def dump(self):
        return [int(self.plain), sorted(self.back), {k: n.dump() for k, n in self.kids.items()}]

    @classmethod
    def load(cls, x, deep: int = 0) -> Node:
        n = cls(deep)
        n.plain, n.back = bool(x[0]), set(x[1])
        n.kids = {k: cls.load(v, deep + 1) for k, v in x[2].items()}
        return n


#: First characters of texts that may be JSON of an object or list.
_OPENING = frozenset('{[" \t\r\n')
_KIND = {bool: "boolean", str: "text", int: "number", float: "number"}


def _observe(value, top: Node, field: str, limit: int) -> None:
    """Adds a value's types to the graph. A member with the name of an element above it is that element again, also among the entries of a map, so that it doesn't matter when an object is found to be one."""
    todo = [(value, top, ((field, top),))]
    while todo:
        v, node, above = todo.pop()
        kids = node.kids
        if type(v) is dict:
            deeper = []
            for k, c in v.items():
                if type(c) is str and c[:1] in _OPENING and c:
                    c = opened(c)
                if type(c) is dict or type(c) is list:
                    i = next((i for i, (name, _) in enumerate(above) if name == k), None)
                    if i is None:
                        deeper.append((c, k))
                    else:
                        if ENTRY not in kids:
                            node.back.add(k)
                        todo.append((c, above[i][1], above[: i + 1]))
                        continue
                kid = kids.get(ENTRY) or node.kid(k)
                if type(c) is not dict and type(c) is not list:
                    kid.plain = True
            if len(kids) + len(node.back) > limit:
                node.fold(limit)
            entry = kids.get(ENTRY)  # only now is it known for this object
            for c, k in deeper:
                kid = entry or kids[k]
                todo.append((c, kid, (*above, (k, kid))))
        elif type(v) is list:
            item = node.kid(ITEM)
            for c in v:
                if type(c) is str and c[:1] in _OPENING and c:
                    c = opened(c)
                if type(c) is dict or type(c) is list:
                    todo.append((c, item, above))
                else:
                    item.plain = True
        else:
            node.plain = True


@dataclass
class Plan:
    """graph: field -> type graph. tables: node id -> table name, for the types that have one of their own."""

    graph: dict[str, Node]
    tables: dict[int, str]

    @property
    def names(self) -> list[str]:
        return sorted(set(self.tables.values()))


def inlining(graph: dict[str, Node]) -> Plan:
    """Which element types get a table, by shared inlining over names."""
    holders: dict[str, set[str]] = {}
    looped: set[str] = set()
    at: list[tuple[Node, str, bool]] = []
    for field, top in graph.items():
        at.append((top, field, True))
        todo = [(top, field)]
        while todo:
            node, label = todo.pop()
            looped.update(f"{field}:{k}" for k in node.back)
            for k in node.back:
                holders.setdefault(f"{field}:{k}", set()).add(label)
            for k, kid in node.kids.items():
                name = label + k if k in (ITEM, ENTRY) else f"{field}:{k}"
                if k in (ITEM, ENTRY):
                    at.append((kid, name, True))
                elif kid.kids:  # an element; a member with only plain values is a column
                    holders.setdefault(name, set()).add(label)
                    at.append((kid, name, False))
                todo.append((kid, name))
    tables = {}
    for n, name, must in at:
        n.table = name if must or name in looped or len(holders.get(name, ())) > 1 else None
        if n.table:
            tables[id(n)] = name
    return Plan(graph, tables)


class Shredder:
    """Rows of one text: (table, path, parent table, parent path, slot, position, [(relative path, last step's length, kind, value)]).

    The parent table and path are the foreign key; slot is the path, inside the parent row, of the object or list that
    holds the row (None: the parent row's own), position the key or index in it: path = parent path / slot / position."""

    def __init__(self, plan: Plan):
        self.plan = plan

    def rows(self, value, field: str) -> list[list]:
        top = self.plan.graph.get(field) or Node()
        first = [top.table or field, None, None, None, None, None, []]
        out = [first]
        slash = False
        todo = [(value, top, first, None, None, ((field, top),), 0)]
        while todo:
            v, node, row, path, rel, above, last = todo.pop()
            kind = type(v)
            if kind is dict:
                entry = node.seen(ENTRY) if ENTRY in node.kids else None
                held = row[6]
                for k, c in v.items():
                    if not k or "/" in k:
                        slash = True
                    if type(c) is str and c[:1] in _OPENING and c:
                        c = opened(c)
                    kind = _KIND.get(type(c))
                    if kind is None:
                        if c is None:
                            continue
                        i = next((i for i, (name, _) in enumerate(above) if name == k), None)
                        kid = above[i][1] if i is not None else node.seen(k) if entry is None else entry
                        self._open(c, kid, row, _join(path, k), _join(rel, k), rel, k, (*above, (k, kid)) if i is None else above[: i + 1], entry is not None, out, todo)
                    elif entry is not None:
                        out.append([entry.table or row[0] + ENTRY, _join(path, k), row[0], row[1], rel, k, [(None, len(k), kind, _text(c))]])
                    else:
                        held.append((k if rel is None else f"{rel}/{k}", len(k), kind, c if kind == "text" else _text(c)))
            elif kind is list:
                kid = node.seen(ITEM)
                name = kid.table or row[0] + ENTRY
                for i, c in enumerate(v):
                    if type(c) is str and c[:1] in _OPENING and c:
                        c = opened(c)
                    if c is not None:
                        k = str(i)
                        kind = _KIND.get(type(c))
                        if kind is None:
                            self._open(c, kid, row, _join(path, k), None, rel, k, above, True, out, todo)
                        else:
                            out.append([name, _join(path, k), row[0], row[1], rel, k, [(None, len(k), kind, _text(c))]])
            elif v is not None:
                row[6].append((rel, last, _KIND[kind], _text(v)))
        return _once(out) if slash else out

    @staticmethod
    def _open(c, kid: Node, row: list, path, rel, slot, k: str, above: tuple, repeated: bool, out: list, todo: list) -> None:
        """An object or list: a row of its own where its type has a table or it is repeated, else part of its holder's row."""
        name = kid.table or (row[0] + ENTRY if repeated else None)
        if name is not None:
            row = [name, path, row[0], row[1], slot, k, []]
            out.append(row)
            rel = None
        todo.append((c, kid, row, path, rel, above, 0))


def _join(path: str | None, more: str | None) -> str | None:
    """Paths without a step are None: a key may be empty."""
    return more if path is None else path if more is None else f"{path}/{more}"


def _text(v) -> str:
    return v if type(v) is str else "true" if v is True else "false" if v is False else repr(v)


def _once(rows: list[list]) -> list[list]:
    """Keys with a slash can make two values meet in one path: the first stays."""
    seen = set()
    for r in rows:
        kept = []
        for rel, last, kind, value in r[6]:
            mark = (_join(r[1], rel), last)
            if mark not in seen:
                seen.add(mark)
                kept.append((rel, last, kind, value))
        r[6] = kept
    return rows


@dataclass
class Shredded:
    """rows: the rows of all tables, each with its key (id, field, row_path) and the foreign key of its holder's row (id, field,
    parent_row_path in parent_table). plan: which types have tables, and their members. Texts are read again wherever
    ``rows`` are used: take ``kept`` or ``write`` for more than one table."""

    rows: DataFrame
    plan: Plan
    id_col: str

    def kept(self) -> Shredded:
        """The same with its rows written once."""
        return Shredded(cut(self.rows), self.plan, self.id_col)

    def write(self, folder: str) -> None:
        """All tables in one pass: Parquet, one folder a table, so that a reader of one table opens its files only."""
        self.rows.write.partitionBy("table").mode("overwrite").parquet(folder)

    def links(self) -> DataFrame:
        """table_name, parent_table, n_rows, n_lost: how many rows hang on which table, and how many of their foreign keys meet no row (none may).

        The rows of a text come one after the other, a holder before what it holds, so the keys of one text at a time are enough and nothing is shuffled but the counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple, list[int]] = {}
            at, keys = None, set()
            for b in batches:
                for text, own, up, path, held in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), *[b.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                    if text != at:
                        at, keys = text, set()
                    n = counts.setdefault((own, up), [0, 0])
                    n[0] += 1
                    n[1] += up is not None and (up, held) not in keys
                    keys.add((own, path))
            if counts:
                names, up = zip(*counts)
                rows, lost = zip(*counts.values())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(up, pa.string()), pa.array(rows, pa.int64()), pa.array(lost, pa.int64())], names=["table_name", "parent_table", "n_rows", "n_lost"])

        each = self.rows.select(self.id_col, "field", "table", "parent_table", "row_path", "parent_row_path").mapInArrow(run, "table_name string, parent_table string, n_rows long, n_lost long")
        return each.groupBy("table_name", "parent_table").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_lost").alias("n_lost"))

    def table(self, name: str) -> DataFrame:
        """One flat table: line, field, row_path, the foreign key (parent_table, parent_row_path), slot and position in it, and its inlined columns, named v:path."""
        cols = sorted(self._columns(name))
        base = self.rows.filter(F.col("table") == name)
        value = lambda c: F.get(F.filter("vals", lambda v: F.coalesce(v["rel"], F.lit("")) == c), 0)["value"]
        return base.select(self.id_col, "field", "row_path", "parent_table", "parent_row_path", "slot", "position", *[value(c).alias(f"v:{c}") for c in cols])

    def _columns(self, name: str) -> set[str]:
        out: set[str] = set()

        def walk(node: Node, rel: str) -> None:
            if node.plain:
                out.add(rel)
            for k, kid in node.kids.items():
                if k not in (ITEM, ENTRY) and id(kid) not in self.plan.tables:
                    walk(kid, f"{rel}/{k}" if rel else k)
                elif k not in (ITEM, ENTRY) and kid.plain:
                    out.add(f"{rel}/{k}" if rel else k)

        def find(node: Node) -> None:
            if self.plan.tables.get(id(node)) == name:
                walk(node, "")
            for kid in node.kids.values():
                find(kid)

        for top in self.plan.graph.values():
            find(top)
        return out

    def values(self) -> DataFrame:
        """Every scalar: line, field, table, row_path, parent_path (of the object or list that holds it), path, kind, value.

        A scalar that is a row of its own hangs where its foreign key and slot say; an inlined one under the rest of its path in its row."""
        v = self.rows.filter(F.size("vals") > 0).select(self.id_col, "field", "table", "row_path", "parent_row_path", "slot", F.explode("vals").alias("v"))
        path = F.concat_ws("/", "row_path", F.col("v.rel"))
        holder = F.when(F.col("v.rel").isNull(), F.concat_ws("/", "parent_row_path", "slot")).otherwise(F.concat_ws("/", "row_path", F.expr("CASE WHEN length(v.rel) > v.last THEN substring(v.rel, 1, length(v.rel) - v.last - 1) END")))
        return v.select(self.id_col, "field", "table", "row_path", holder.alias("parent_path"), path.alias("path"), F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))


def schema_graph(df: DataFrame, fields: list[str], max_members: int = MAX_MEMBERS) -> dict[str, Node]:
    """The types of all complete JSON texts of all rows, built in each task, merged in groups and then on the driver.

    What a task or group sends is bounded by ``max_members``: larger objects are folded to maps. The graph
    is the same however the rows lie in tasks."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {f: Node() for f in fields}
        for b in batches:
            with no_cycle_search():
                for f in fields:
                    for text in b.column(f).to_pylist():
                        if text is not None:
                            try:
                                value = opened(parse(text))
                            except Incomplete:
                                continue
                            _observe(value, tops[f], f, max_members)
        yield pa.RecordBatch.from_pydict({"graph": [json.dumps({f: t.dump() for f, t in tops.items()})]})

    def merged(texts) -> dict[str, Node]:
        tops = {f: Node() for f in fields}
        for text in texts:
            for f, x in json.loads(text).items():
                tops[f].merge(Node.load(x), max_members)
        return tops

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"graph": [json.dumps({f: t.dump() for f, t in merged(pdf["graph"]).items()})]})

    parts = df.select(*fields).mapInArrow(observe, "graph string").withColumn("g", F.spark_partition_id() % MERGE_GROUPS)
    return merged(r.graph for r in parts.groupBy("g").applyInPandas(group, "graph string").collect())


def shred(df: DataFrame, id_col: str, fields: list[str], max_members: int = MAX_MEMBERS) -> Shredded:
    """Flat, linked rows of the JSON texts in ``fields``.

    A text that is null or not complete JSON yields nothing. A text that is itself complete JSON of an
    object or list, at the top or further in, is read as that and adds no step. null members yield no
    value; empty objects and lists yield rows without values where they have a table. A top scalar has
    the path ''. Keys keep their spelling; where a key with a slash makes two values meet in one path,
    one stays. Of a key repeated in one object the last holds. ``id_col`` should be unique; rows
    that repeat yield their values again. Other columns are not read.
    """
    plan = inlining(schema_graph(df, fields, max_members))
    spark = df.sparkSession
    wire = spark.sparkContext.broadcast(json.dumps({f: t.dump() for f, t in plan.graph.items()}))  # bounded by max_members
    id_type = df.schema[id_col].dataType.simpleString()
    vals = pa.list_(pa.struct([("rel", pa.string()), ("last", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = {f: Node.load(x) for f, x in json.loads(wire.value).items()}
        shredder = Shredder(inlining(graph))
        for b in batches:
            with no_cycle_search():
                out = batch(b, shredder)
            if out is not None:
                yield out

    def batch(b: pa.RecordBatch, shredder: Shredder) -> pa.RecordBatch | None:
        take, field, rows, bounds, flat = [], [], [], [0], []
        for f in fields:
            for i, text in enumerate(b.column(f).to_pylist()):
                if text is None:
                    continue
                try:
                    value = opened(parse(text))
                except Incomplete:
                    continue
                for r in shredder.rows(value, f):
                    take.append(i)
                    field.append(f)
                    rows.append(r)
                    flat.extend(r[6])
                    bounds.append(len(flat))
        if not rows:
            return None
        cols = list(zip(*[r[:6] for r in rows]))
        rel, last, kind, value = zip(*flat) if flat else ((), (), (), ())
        items = pa.StructArray.from_arrays([pa.array(rel, pa.string()), pa.array(last, pa.int32()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=["rel", "last", "kind", "value"])
        return pa.RecordBatch.from_arrays(
            [b.column(id_col).take(pa.array(take)), pa.array(field), *[pa.array(c, pa.string()) for c in cols], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items).cast(vals)],
            names=[id_col, "field", "table", "row_path", "parent_table", "parent_row_path", "slot", "position", "vals"],
        )

    schema = f"`{id_col}` {id_type}, field string, `table` string, row_path string, parent_table string, parent_row_path string, slot string, position string, vals array<struct<rel: string, last: int, kind: string, value: string>>"
    return Shredded(df.select(id_col, *fields).mapInArrow(run, schema), plan, id_col)
