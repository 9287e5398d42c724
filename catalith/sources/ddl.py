"""Tables, keys and comments from DDL text, statement by statement; what isn't understood is skipped."""

from __future__ import annotations

import re

from catalith.sources.base import Connector, column, edge, fqn, register, split_top, table

_NAME = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$]+)(?:\s*\.\s*(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[\w$]+))*'
_CREATE = re.compile(rf"create\s+(?:or\s+replace\s+)?(?:(?:global\s+|local\s+)?temp(?:orary)?\s+|external\s+|materialized\s+)*(table|view)\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*(.*)", re.I | re.S)
_STOP = re.compile(r"\b(primary\s+key|not\s+null|null|references|unique|default|check|constraint|comment|generated|collate|auto_increment|autoincrement|identity)\b", re.I)
_REF = re.compile(rf"references\s+({_NAME})\s*(?:\(([^)]*)\))?", re.I)
_FK = re.compile(rf"foreign\s+key\s*\(([^)]*)\)\s*references\s+({_NAME})\s*(?:\(([^)]*)\))?", re.I)
_PK = re.compile(r"primary\s+key\s*\(([^)]*)\)", re.I)
_QUOTED = r"'((?:[^']|'')*)'"


def clean(name: str) -> str:
    return re.sub(r'["`\[\]]', "", name).strip()


def _list(text: str | None) -> list[str]:
    return [clean(c) for c in (text or "").split(",") if c.strip()]


def statements(text: str) -> list[str]:
    return split_top(re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S), ";")


def _inner(text: str) -> tuple[str, str]:
    """The content of the parenthesis that a text starts with, and what follows."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return text[1:i], text[i + 1 :]
    return text[1:], ""


def parse_ddl(text: str, default_schema: str | None = None, default_catalog: str | None = None) -> tuple[list[dict], list[dict], list[str]]:
    """(tables, edges, warnings). Foreign keys are resolved last, so that a table may be named before it is created."""
    tables: dict[str, dict] = {}
    keys: list[tuple[dict, list[str], str, list[str]]] = []

    def place(name: str) -> tuple[str | None, str | None, str]:
        parts = [clean(p) for p in re.split(r"\.", name)]
        return (parts[-3] if len(parts) > 2 else default_catalog, parts[-2] if len(parts) > 1 else default_schema, parts[-1])

    def find(name: str) -> dict | None:
        cat, sch, bare = place(name)
        exact = tables.get(".".join(p for p in (cat, sch, bare) if p).lower())
        if exact:
            return exact
        same = [t for t in tables.values() if t["name"].lower() == bare.lower()]
        return same[0] if len(same) == 1 else None

    def mark(t: dict, cols: list[str]) -> None:
        for c in cols:
            if c not in t["primary_key"]:
                t["primary_key"].append(c)
        for c in t["columns"]:
            c["is_primary_key"] = c["is_primary_key"] or c["name"].lower() in {k.lower() for k in t["primary_key"]}

    for s in statements(text):
        if m := _CREATE.match(s):
            kind, name, rest = m.group(1).lower(), m.group(2), m.group(3)
            cat, sch, bare = place(name)
            t = table(bare, sch, cat, kind, primary_key=[])
            body, after = _inner(rest) if rest.startswith("(") else ("", rest)
            if kind == "view":
                t["columns"] = [column(clean(c.split()[0]), None, is_primary_key=False) for c in split_top(body)] if body and not re.match(r"\s*(select|with)\b", body, re.I) else []
                body = ""
            pk: list[str] = []
            for part in split_top(body):
                bare_part = re.sub(rf"^constraint\s+{_NAME}\s+", "", part, flags=re.I)
                if fk := _FK.match(bare_part):
                    keys.append((t, _list(fk.group(1)), fk.group(2), _list(fk.group(3))))
                elif re.match(r"primary\s+key", bare_part, re.I):
                    pk += _list(_PK.match(bare_part).group(1))
                elif re.match(r"(unique|check|index|key|exclude|foreign)\b", bare_part, re.I):
                    continue
                elif c := re.match(rf"({_NAME})\s*(.*)", part, re.S):
                    stop = _STOP.search(c.group(2))
                    kind_text = (c.group(2)[: stop.start()] if stop else c.group(2)).strip()
                    tail = c.group(2)[stop.start() :] if stop else ""
                    own = column(clean(c.group(1)), re.sub(r"\s+", " ", kind_text).upper() or None, is_primary_key=False, nullable=not re.search(r"not\s+null|primary\s+key", tail, re.I))
                    if note := re.search(rf"comment\s+{_QUOTED}", tail, re.I):
                        own["description"] = note.group(1).replace("''", "'")
                    if re.search(r"primary\s+key", tail, re.I):
                        pk.append(own["name"])
                    if ref := _REF.search(tail):
                        keys.append((t, [own["name"]], ref.group(1), _list(ref.group(2))))
                    t["columns"].append(own)
            if note := re.search(rf"comment\s*=?\s*{_QUOTED}", after, re.I):
                t["description"] = note.group(1).replace("''", "'")
            mark(t, pk)
            tables[fqn(t).lower()] = t
        elif m := re.match(rf"alter\s+table\s+(?:only\s+|if\s+exists\s+)*({_NAME})\s+add\s+(?:constraint\s+{_NAME}\s+)?(.*)", s, re.I | re.S):
            t = find(m.group(1))
            if t and (fk := _FK.match(m.group(2))):
                keys.append((t, _list(fk.group(1)), fk.group(2), _list(fk.group(3))))
            elif t and (p := _PK.match(m.group(2))):
                mark(t, _list(p.group(1)))
        elif m := re.match(rf"comment\s+on\s+(table|view|column)\s+({_NAME})\s+is\s+{_QUOTED}", s, re.I):
            note = m.group(3).replace("''", "'")
            if m.group(1).lower() != "column":
                if t := find(m.group(2)):
                    t["description"] = note
            else:
                *head, col = [clean(p) for p in m.group(2).split(".")]
                for t in tables.values():
                    if head and t["name"].lower() == head[-1].lower():
                        for c in t["columns"]:
                            if c["name"].lower() == col.lower():
                                c["description"] = note
    edges = []
    for t, own, target, theirs in keys:
        to = find(target)
        theirs = theirs or (to["primary_key"] if to else [])
        edges.append(edge("foreign_key", fqn(t), fqn(to) if to else clean(target), own, theirs))
    return list(tables.values()), edges, [] if tables else ["no table found"]


@register
class DdlConnector(Connector):
    """config: text or path; schema and catalog for names without."""

    type = "ddl"

    def introspect(self) -> dict:
        c = self.config
        if c.get("text") is None and c.get("path") is None:
            raise ValueError("ddl: text or path is missing")
        texts = [c["text"]] if c.get("text") is not None else [r.value for r in self.spark.read.text(c["path"], wholetext=True).toLocalIterator()]
        tables, edges, self.warnings = parse_ddl(";\n".join(texts), c.get("schema", "public"), c.get("catalog"))
        return self.payload(tables, edges)
