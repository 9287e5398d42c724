"""Similarity flooding between two schema graphs.

Nodes are the members of two nested objects. Pairs of members form a graph with an edge from the pair
of their holders to the pair of the members; each pair starts with a similarity from value, name and
type, and gives part of it to its neighbours until nothing changes. Then consistent one-to-one
correspondences are chosen.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from difflib import SequenceMatcher

#: Shares of an equal value, the name and the type in a pair's first similarity. An equal value outweighs the other two.
VALUE, NAME, TYPE = 0.6, 0.25, 0.15
#: Residual at which the flow has converged, and the most rounds.
RESIDUAL, ROUNDS = 1e-4, 100


def kind_of(v) -> str | None:
    if v is None:
        return None
    return "boolean" if isinstance(v, bool) else "text" if isinstance(v, str) else "list" if isinstance(v, list) else "object" if isinstance(v, dict) else "number"


def members(config) -> dict[str, tuple[str, object]]:
    """path -> (parent path, value) of every member at any depth inside objects, not inside lists."""
    out: dict[str, tuple[str, object]] = {}
    todo = [("", config)]
    while todo:
        at, obj = todo.pop()
        if isinstance(obj, dict):
            for k, v in obj.items():
                path = f"{at}/{k}" if at else k
                out[path] = (at, v)
                if isinstance(v, dict):
                    todo.append((path, v))
    return out


def value_key(v):
    """What tells values apart: a list of one element equals its element; null, booleans and objects have none."""
    while isinstance(v, list) and len(v) == 1:
        v = v[0]
    if v is None or isinstance(v, (bool, dict)):
        return None
    return ("list", json.dumps(v, sort_keys=True)) if isinstance(v, list) else (kind_of(v), v)


def _name(path: str) -> str:
    return re.sub(r"[^a-z0-9]", "", path.rpartition("/")[2].lower()).rstrip("s")


def pairs_to_flood(old: dict, new: dict) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """The pair graph: holder pair -> pairs below it. Members of the same path are a pair; of the others, those gone with those come under the same pair of holders."""
    below_old, below_new = defaultdict(list), defaultdict(list)
    for p, (at, _) in old.items():
        below_old[at].append(p)
    for p, (at, _) in new.items():
        below_new[at].append(p)
    graph: dict[tuple[str, str], list[tuple[str, str]]] = {}
    todo = [("", "")]
    while todo:
        a, b = todo.pop()
        names_a = {p.rpartition("/")[2] if a else p: p for p in below_old[a]}
        names_b = {p.rpartition("/")[2] if b else p: p for p in below_new[b]}
        gone = [p for k, p in names_a.items() if k not in names_b]
        come = [p for k, p in names_b.items() if k not in names_a]
        kids = [(p, names_b[k]) for k, p in names_a.items() if k in names_b]
        kids += [(p, q) for p in gone for q in come]
        graph[a, b] = kids
        todo += [(p, q) for p, q in kids if isinstance(old[p][1], dict) and isinstance(new[q][1], dict)]
    return graph


def flood(old: dict, new: dict) -> dict[tuple[str, str], float]:
    """Converged similarity of each pair."""
    graph = pairs_to_flood(old, new)
    first: dict[tuple[str, str], float] = {("", ""): 1.0}
    for kids in graph.values():
        for p, q in kids:
            if p == q:
                first[p, q] = 1.0
            else:
                v, w = old[p][1], new[q][1]
                a, b = value_key(v), value_key(w)
                name = SequenceMatcher(None, _name(p), _name(q), autojunk=False).ratio()
                first[p, q] = VALUE * (a is not None and a == b) + NAME * name + TYPE * (kind_of(v) == kind_of(w))
    edges = [(up, kid, 1 / len(kids)) for up, kids in graph.items() for kid in kids]
    sim = first
    for _ in range(ROUNDS):
        flow = {p: s + first[p] for p, s in sim.items()}
        gain = dict(flow)
        for up, kid, share in edges:  # down by a share of each, up by the same share
            gain[kid] += share * flow[up]
            gain[up] += share * flow[kid]
        most = max(gain.values())
        nxt = {p: g / most for p, g in gain.items()}
        done = max(abs(nxt[p] - sim[p]) for p in nxt) < RESIDUAL
        sim = nxt
        if done:
            break
    del sim["", ""]
    return sim


def correspondences(old: dict, new: dict, sim: dict[tuple[str, str], float] | None = None) -> dict[str, str]:
    """old path -> new path, one to one: the most similar pairs first, members only under holders that correspond; equal paths always correspond. sim: the flooded similarities, if they are at hand."""
    sim = flood(old, new) if sim is None else sim
    out, taken = {p: p for p in old if p in new}, {p for p in new if p in old}
    for (p, q), _ in sorted(sim.items(), key=lambda x: (old[x[0][0]][0].count("/"), -x[1], x[0])):
        at, to = old[p][0], new[q][0]
        if p not in out and q not in taken and (at == to or out.get(at) == to):
            out[p] = q
            taken.add(q)
    return out


def changes(old_config, new_config) -> list[tuple[str, str, str]]:
    """(kind, old path, new path): renamed, added and removed members from one object to the next.

    A correspondence is a rename if the members have the same holder and the same value, and no other
    member that went from or came to that holder has that value."""
    old, new = members(old_config), members(new_config)
    gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
    renamed = {}
    if gone and come:
        held = [defaultdict(int), defaultdict(int)]
        for side, paths, m in ((0, gone, old), (1, come, new)):
            for p in paths:
                if (k := value_key(m[p][1])) is not None:
                    held[side][m[p][0], k] += 1
        for p, q in correspondences(old, new).items():
            k = value_key(old[p][1])
            if p != q and k is not None and old[p][0] == new[q][0] and k == value_key(new[q][1]) and held[0][old[p][0], k] == held[1][old[p][0], k] == 1:
                renamed[p] = q
    back = set(renamed.values())
    return [("renamed", p, q) for p, q in renamed.items()] + [("removed", p, "") for p in gone if p not in renamed] + [("added", "", q) for q in come if q not in back]
