"""Join paths between tables: shortest simple paths, flow over them, and pruning."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.worker import kept, read_stored
from catalith.operators.merge import components
from catalith.session import cut, store

# Hops of an alternative path, paths looked at for a pair, and the flow.
CUTOFF, MOST, EPSILON = 6, 64, 1e-9
FLOW, LEAST_FLOW, LENGTH_PENALTY, TOP_PATHS = 0.8, 0.05, 0.1, 8
#: Related pairs that the tasks read whole; blocks of questions beyond; and ends whose distances a task remembers.
LOCAL_PAIRS, QUESTION_BLOCKS, MEMO = 500_000, 64, 2000


def neighbours(pairs: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    g: dict[str, dict[str, float]] = defaultdict(dict)
    for u, v, w in pairs:
        g[u][v] = g[v][u] = min(w, g[u].get(v, w))
    return g


def remaining(g: dict[str, dict[str, float]], b: str) -> dict[str, float]:
    """The least cost from each node to b."""
    rest = {b: 0.0}
    heap: list = [(0.0, b)]
    while heap:
        d, u = heappop(heap)
        if d > rest[u]:
            continue
        for v, w in g[u].items():
            if d + w < rest.get(v, float("inf")):
                rest[v] = d + w
                heappush(heap, (d + w, v))
    return rest


def shortest_paths(g: dict[str, dict[str, float]], a: str, b: str, extra: float = 0.0, cutoff: int = CUTOFF, memo: dict | None = None) -> list[list[str]]:
    """Simple paths from a to b by cost, then names: the cheapest, and those that cost at most ``extra`` more and have at most ``cutoff`` hops.

    Best-first over partial paths, with the exact remaining cost as bound, so that only partial paths of wanted paths are opened. memo: remaining costs by end, for more than one search."""
    if a not in g or b not in g:
        return []
    memo = {} if memo is None else memo
    if b not in memo:
        if len(memo) >= MEMO:
            memo.clear()
        memo[b] = remaining(g, b)
    rest = memo[b]
    if a not in rest:
        return []
    best, found, ends = rest[a], [], 0
    open_: list = [(rest[a], [a], 0.0)]
    while open_ and ends < MOST:
        bound, path, cost = heappop(open_)
        if bound > best + extra + EPSILON:
            break
        if path[-1] == b:
            ends += 1
            if not found or len(path) - 1 <= cutoff:
                found.append(path)
            continue
        for v, w in sorted(g[path[-1]].items()):
            if v in rest and v not in path and cost + w + rest[v] <= best + extra + EPSILON:
                heappush(open_, (cost + w + rest[v], [*path, v], cost + w))
    return found


def flow(g: dict[str, dict[str, float]], nodes: set[str], anchors: list[str], prior: dict[str, float], decay: float = FLOW, least: float = LEAST_FLOW) -> dict[str, float]:
    """What reaches each node when every anchor sends out one unit, level by level, over the paths' tables."""
    got = dict.fromkeys(nodes, 0.0)
    for a in anchors:
        if a not in nodes:
            continue
        level, seen = {a: 1.0}, {a}
        while level:
            nxt: dict[str, float] = {}
            for n, amount in level.items():
                got[n] += amount * (1 + prior.get(n, 0.0))
                to = [m for m in g[n] if m in nodes and m not in seen]
                for m in to:
                    share = decay * amount / len(to) / g[n][m]
                    if share >= least:
                        nxt[m] = nxt.get(m, 0.0) + share
            seen |= set(nxt)
            level = nxt
    return got


def maximal(paths: list[list[str]]) -> list[list[str]]:
    """Paths that are no part of a longer one, read either way."""
    mark = lambda p: "\0" + "\0".join(p) + "\0"
    long = [mark(p) for p in paths]
    return [p for p in paths if not any(len(q) > len(p) and (mark(p) in t or mark(p[::-1]) in t) for q, t in zip(paths, long))]


def question_paths(nets: list[dict[str, dict[str, float]]], anchors: list[str], prior: dict[str, float], extra: float = 0.0, cutoff: int = CUTOFF, decay: float = FLOW, least: float = LEAST_FLOW, memo: list[dict] | None = None) -> list[tuple[float, list[str]]]:
    """(reliability, path) of the paths between all pairs of anchors; a path and its reverse are one. nets: the graph, then those for pairs that it doesn't connect."""
    paths, seen = [], set()
    memo = memo or [{} for _ in nets]
    for i, a in enumerate(anchors):
        for b in anchors[i + 1 :]:
            for g, known in zip(nets, memo):
                found = shortest_paths(g, a, b, extra, cutoff, known)
                for p in found:
                    k = min(tuple(p), tuple(reversed(p)))
                    if k not in seen:
                        seen.add(k)
                        paths.append(p)
                if found:
                    break
    got = flow(nets[-1], {n for p in paths for n in p}, anchors, prior, decay, least)
    return [(sum(got[n] for n in p) / len(p) / (1 + LENGTH_PENALTY * (len(p) - 2)), p) for p in maximal(paths)]


def join_paths(pairs: DataFrame, ranked: DataFrame, extra: float = 0.0, cutoff: int = CUTOFF, decay: float = FLOW, least: float = LEAST_FLOW, top: int = TOP_PATHS, fallback: DataFrame | None = None, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """qid, tables, reliability, place: the best ``top`` paths of each question.

    pairs: u, v, weight of related tables; ranked: qid, table_key, evidence, pos, anchor. fallback: pairs with more relations, for pairs of anchors
    that ``pairs`` don't connect. Up to ``local_pairs`` pairs are read by the tasks whole; of more, each connected part goes to its questions in blocks. Each question's rows (anchors and ranked tables) are solved together."""
    qid = ranked.schema["qid"].dataType.simpleString()
    schema = f"qid {qid}, tables array<string>, reliability double"
    anchors = F.count_if("anchor").over(Window.partitionBy("qid"))  # a window, as in ranking._shares: it keeps a question's rows together
    asked = ranked.filter("qid is not null").withColumn("n", anchors).filter("n > 1").select("qid", "table_key", "evidence", "pos", "anchor")
    every = pairs.select("u", "v", "weight", F.lit(True).alias("own"))
    if fallback is not None:
        every = every.unionByName(fallback.select("u", "v", "weight", F.lit(False).alias("own")))
    every = store(every)

    def solver(edges):
        nets = [neighbours([(u, v, w) for u, v, w, own in edges if own]), neighbours([e[:3] for e in edges])]
        memo: list[dict] = [{}, {}]

        def solve(rows: pd.DataFrame) -> list[tuple[float, list[str]]]:
            rows = rows.sort_values("pos")
            prior = dict(zip(rows["table_key"], rows["evidence"]))
            return question_paths(nets, rows.loc[rows["anchor"], "table_key"].tolist(), prior, extra, cutoff, decay, least, memo)

        return solve

    if every.count() <= local_pairs:
        files = tuple(every.inputFiles())  # at most local_pairs rows, which the tasks read from the shared folder

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            solve, held = solver(list(zip(*[c.to_pylist() for c in kept(files, lambda: read_stored(files)).columns]))), None
            for b in batches:
                held = b if held is None else pd.concat([held, b])
                last = held["qid"].iloc[-1]
                whole = held[held["qid"] != last]  # the last question may go on
                held = held[held["qid"] == last]
                yield frame(solve, whole)
            if held is not None:
                yield frame(solve, held)

        def frame(solve, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(q, p, r) for q, own in rows.groupby("qid", sort=False) for r, p in solve(own)], columns=["qid", "tables", "reliability"])

        out = asked.repartition("qid").sortWithinPartitions("qid", "pos").mapInPandas(run, schema)
    else:
        parts = store(components(every, every.select(F.col("u").alias("node")).unionByName(every.select(F.col("v").alias("node"))).distinct()))
        edges = every.join(parts, every["u"] == parts["node"]).select("component", "u", "v", "weight", "own")
        asked = asked.join(parts, asked["table_key"] == parts["node"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(QUESTION_BLOCKS)))
        graphs = edges.join(asked.select("component", "block").distinct(), "component")

        def part(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            solve = solver(list(zip(e["u"], e["v"], e["weight"], e["own"])))
            return pd.DataFrame([(i, p, r) for i, own in q.groupby("qid") for r, p in solve(own)], columns=["qid", "tables", "reliability"])

        out = graphs.groupBy("component", "block").cogroup(asked.withColumnsRenamed({"component": "part", "block": "nth"}).groupBy("part", "nth")).applyInPandas(part, schema)
    w = Window.partitionBy("qid").orderBy(F.desc("reliability"), F.size("tables"), F.array_join("tables", ","))
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).withColumn("reliability", F.round("reliability", 4))


def paths_within(pairs: DataFrame, source: str | None = None, hops: int = CUTOFF) -> DataFrame:
    """path, cost of all simple paths from a table (from every table, if none is given) of at most ``hops`` joins, by one round of joins for each hop."""
    both = pairs.select("u", "v", "weight").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    if source is None:
        at = both.select("u").distinct().select("u", F.array("u").alias("path"), F.lit(0.0).alias("cost"))
    else:
        at = pairs.sparkSession.createDataFrame([(source, [source], 0.0)], "u string, path array<string>, cost double")
    out = None
    for _ in range(hops):
        at = at.join(both, "u").filter(~F.array_contains("path", F.col("v"))).select(F.col("v").alias("u"), F.array_append("path", F.col("v")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost"))
        at = cut(at)  # else each hop runs all hops before it again
        out = at if out is None else out.unionByName(at)
    return out.select("path", "cost")
