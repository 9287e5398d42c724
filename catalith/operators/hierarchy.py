"""Parent-child rows to full hierarchies by nested-set ranges.

Subtree sizes are summed upward from the leaves, siblings get preorder ranges by prefix sums
downward from the roots, and ancestors and descendants follow from the ranges. A node that the
upward pass cannot finish lies on a loop; one that only the downward pass misses lies under one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.operators.rangescan import range_scan
from catalith.session import cut

#: Nodes of a tree that one task solves in memory; a larger tree is solved by joins over the cluster.
LOCAL_NODES = 200_000
#: Rows of whole trees that a task solves at a time.
CHUNK_ROWS = 100_000


def solve(tree: np.ndarray, ids: list[str], parents: list[str | None]) -> dict[str, list]:
    """Nested sets of nodes that are sorted by (tree, id), ids being unique within a tree."""
    n = len(ids)
    at = {(t, i): k for k, (t, i) in enumerate(zip(tree.tolist(), ids))}
    par = np.fromiter((at.get((t, p), -1) if p is not None else -1 for t, p in zip(tree.tolist(), parents)), np.int64, n)
    has = par >= 0
    left = np.bincount(par[has], minlength=n)
    size, up = np.ones(n, np.int64), np.zeros(n, bool)
    front = np.flatnonzero(left == 0)
    while len(front):  # upward: a node is done once all its children are
        up[front] = True
        kids = front[par[front] >= 0]
        p = par[kids]
        np.add.at(size, p, size[kids])
        np.subtract.at(left, p, 1)
        front = np.unique(p)
        front = front[left[front] == 0]
    # siblings in the order of their ids: rows are sorted by id, so a stable sort on the parent does
    by = np.argsort(par, kind="stable")
    psort = par[by]
    total = np.cumsum(size[by]) - size[by]
    first = np.ones(n, bool)
    first[1:] = psort[1:] != psort[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    offset = np.empty(n, np.int64)
    offset[by] = total - total[begin] if n else total
    count = np.bincount(par[has], minlength=n)
    roots = np.flatnonzero(~has)
    start = np.searchsorted(psort, np.arange(n))
    pre, depth, root = np.full(n, -1, np.int64), np.full(n, -2, np.int64), np.full(n, -1, np.int64)
    pre[roots], depth[roots], root[roots] = offset[roots], 0, roots
    front = roots
    while len(front):  # downward: a child's range starts after its parent and its earlier siblings
        c = count[front]
        front = front[c > 0]
        c = count[front]
        if not len(front):
            break
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        kids = by[np.repeat(start[front], c) + step]
        p = par[kids]
        pre[kids] = pre[p] + 1 + offset[kids]
        depth[kids], root[kids] = depth[p] + 1, root[p]
        front = kids
    base = np.full(int(tree.max()) + 1 if n else 0, total[-1] + size[by[-1]] if n else 0, np.int64)
    np.minimum.at(base, tree[roots], pre[roots])  # preorder starts at 0 in each tree
    own = np.where(pre >= 0, pre - base[tree], -1) if n else pre
    below = size - 1
    depth[~up] = -1
    seen: set[int] = set()
    for v in np.flatnonzero(~up).tolist():
        if v not in seen:
            loop, w = [], v
            while w not in seen:
                seen.add(w)
                loop.append(w)
                w = int(par[w])
            below[loop] = size[loop].sum() - 1
    path = [""] * n
    for v in np.argsort(pre, kind="stable")[n - int((pre >= 0).sum()) :].tolist():
        path[v] = path[par[v]] + "/" + ids[v] if par[v] >= 0 else ids[v]
    return {"root_id": [ids[r] if r >= 0 else "" for r in root.tolist()], "node_depth": depth, "path": path, "n_below": below, "first": own}


def descendants(nodes: DataFrame, tree: list[str], of: DataFrame) -> DataFrame:
    """tree columns, ancestor, id, distance: all nodes under those in of(tree columns, id), from the ranges of ``nodes``. The result has as many rows as there are such nodes; give the nodes that are asked for, not all of them."""
    top = of.join(nodes.select(*tree, "id", F.col("first").alias("_from"), F.col("last").alias("_to"), F.col("node_depth").alias("_depth")), [*tree, "id"]).withColumnRenamed("id", "ancestor")
    under = nodes.select(*tree, "id", "first", "node_depth").join(top, tree).filter("first > _from and first <= _to")
    return under.select(*tree, "ancestor", "id", (F.col("node_depth") - F.col("_depth")).alias("distance"))


def _last_lines(keys: list[list], ids: list) -> np.ndarray:
    """Of rows sorted by (tree, id, line) the last of each (tree, id)."""
    n = len(ids)
    return np.fromiter((i for i in range(n) if i + 1 == n or ids[i] != ids[i + 1] or any(k[i] != k[i + 1] for k in keys)), np.int64)


def hierarchy(df: DataFrame, tree: list[str], id_col: str, parent_col: str, order_col: str, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """Every node of every tree: tree columns, id, root_id, node_depth, path, n_below, first, last.

    A tree is one tuple of the ``tree`` columns; rows with a null in it, or with a null or blank id,
    are no nodes. ids compare without case and outer blanks and come out in lower case. Of rows with
    the same id in a tree the one with the largest ``order_col`` holds (equal rows are one). A blank
    parent is none; a node whose parent is none or not in the tree is a root. On a loop: node_depth
    -1, root_id and path empty; under a loop -2. n_below counts all other nodes under a node.
    first and last are the node's range in the preorder of its tree (roots and siblings by id, from 0; null on or under a loop): the nodes
    under it are those with a larger first up to its last, those above it the ones whose ranges hold its own. Trees of
    up to ``local_nodes`` rows are solved whole in a task, larger ones by rounds of joins.
    """
    clean = lambda c: F.lower(F.btrim(F.col(c), F.lit(" \t\r\n\f\x0b ")))
    rows = (
        df.select(*[F.col(t).cast("string").alias(t) for t in tree], clean(id_col).alias("id"), F.nullif(clean(parent_col), F.lit("")).alias("parent"), F.col(order_col).cast("long").alias("ord"))
        .dropna(subset=[*tree, "id"]).filter("id != ''")
    )
    large = rows.groupBy(*tree).count().filter(F.col("count") > local_nodes).select(*tree)
    some = not large.isEmpty()
    small = rows.join(large, tree, "left_anti") if some else rows
    schema = ", ".join(f"`{t}` string" for t in tree) + ", id string, root_id string, node_depth int, path string, n_below int, first long, last long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solved(t: pa.Table) -> pa.RecordBatch:
            keys = [t.column(c).to_pylist() for c in tree]
            ids = t.column("id").to_pylist()
            keep = _last_lines(keys, ids)
            t = t.take(pa.array(keep))
            keys = [t.column(c).to_pylist() for c in tree]
            code, tid, last = np.empty(t.num_rows, np.int64), -1, None
            for i, k in enumerate(zip(*keys)):
                if k != last:
                    tid, last = tid + 1, k
                code[i] = tid
            out = solve(code, t.column("id").to_pylist(), t.column("parent").to_pylist())
            cols = [*[t.column(c).combine_chunks() for c in tree], t.column("id").combine_chunks(), pa.array(out["root_id"]), pa.array(out["node_depth"], pa.int32()), pa.array(out["path"]), pa.array(out["n_below"], pa.int32()), pa.array(out["first"], mask=out["first"] < 0), pa.array(out["first"] + out["n_below"], mask=out["first"] < 0)]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[*tree, "id", "root_id", "node_depth", "path", "n_below", "first", "last"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= CHUNK_ROWS:  # all trees but the last are complete
                cols = [held.column(c).to_pylist() for c in tree]
                end, i = [c[-1] for c in cols], held.num_rows
                while i and all(c[i - 1] == e for c, e in zip(cols, end)):
                    i -= 1
                if i:
                    yield solved(held.slice(0, i))
                    held = held.slice(i)
        if held is not None and held.num_rows:
            yield solved(held)

    out = small.repartition(*tree).sortWithinPartitions(*tree, "id", "ord", "parent").mapInArrow(local, schema)
    return out.unionByName(_by_joins(rows.join(large, tree, "left_semi"), tree)) if some else out


def _by_joins(rows: DataFrame, tree: list[str]) -> DataFrame:
    """The same for trees of any size: one round of joins for each level, cut after each."""
    key = [*tree, "id"]
    nodes = rows.groupBy(*key).agg(F.max(F.struct("ord", "parent")).getField("parent").alias("parent"))
    names = nodes.select(*tree, F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = nodes.join(names, [*tree, "parent"], "left").select(*key, F.when(F.col("there"), F.col("parent")).alias("parent"))
    kids = nodes.filter("parent is not null").groupBy(*tree, F.col("parent").alias("id")).agg(F.count("*").alias("left"))
    state = cut(nodes.join(kids, key, "left").select(*key, "parent", F.coalesce("left", F.lit(0)).alias("left"), F.lit(1).cast("long").alias("size")))
    ready, finished = state.filter("left = 0"), None
    while not ready.isEmpty():  # a level: its nodes are finished and leave the state, their parents have fewer left
        finished = ready if finished is None else finished.unionByName(ready)
        gain = ready.filter("parent is not null").groupBy(*tree, F.col("parent").alias("id")).agg(F.sum("size").alias("gain"), F.count("*").alias("fewer"))
        state = cut(state.filter("left > 0").join(gain, key, "left").select(*key, "parent", (F.col("left") - F.coalesce("fewer", F.lit(0))).alias("left"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")))
        ready = state.filter("left = 0")
    left = state.filter("left > 0").withColumn("up", F.lit(False))
    state = left if finished is None else finished.withColumn("up", F.lit(True)).unionByName(left)
    ranged = range_scan(state, [*tree, "parent"], [F.col("id")], {"upto": ("sum", "size")}).withColumn("offset", F.col("upto") - F.col("size"))
    ranged = cut(ranged.select(*key, "parent", "size", "up", "offset"))
    level = cut(ranged.filter("parent is null").select(*key, "size", F.col("offset").alias("pre"), F.lit(0).alias("node_depth"), F.col("id").alias("root_id"), F.col("id").alias("path")))
    done = level
    while not level.isEmpty():
        up = level.select(*tree, F.col("id").alias("parent"), F.col("pre").alias("ppre"), F.col("node_depth").alias("pdepth"), "root_id", F.col("path").alias("ppath"))
        level = cut(ranged.join(up, [*tree, "parent"]).select(*key, "size", (F.col("ppre") + 1 + F.col("offset")).alias("pre"), (F.col("pdepth") + 1).alias("node_depth"), "root_id", F.concat("ppath", F.lit("/"), "id").alias("path")))
        done = done.unionByName(level)
    good = done.select(*key, "root_id", F.col("node_depth").cast("int").alias("node_depth"), "path", (F.col("size") - 1).cast("int").alias("n_below"), F.col("pre").alias("first"), (F.col("pre") + F.col("size") - 1).alias("last"))
    nowhere = [F.lit(None).cast("long").alias(c) for c in ("first", "last")]
    rest = ranged.join(done.select(*key), key, "left_anti")
    under = rest.filter("up").select(*key, F.lit("").alias("root_id"), F.lit(-2).alias("node_depth"), F.lit("").alias("path"), (F.col("size") - 1).cast("int").alias("n_below"), *nowhere)
    loops = _loop_sizes(rest.filter("not up"), tree)
    on = loops.select(*key, F.lit("").alias("root_id"), F.lit(-1).alias("node_depth"), F.lit("").alias("path"), (F.col("total") - 1).cast("int").alias("n_below"), *nowhere)
    return good.unionByName(under).unionByName(on)


def _loop_sizes(on: DataFrame, tree: list[str]) -> DataFrame:
    """For nodes on loops the number of nodes of their whole component, by pointer doubling on the least id."""
    key = [*tree, "id"]
    state = cut(on.select(*key, "size", F.col("parent").alias("jump"), F.least("id", "parent").alias("low")))
    while not state.isEmpty():
        other = state.select(*tree, F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        nxt = cut(state.join(other, [*tree, "jump"]).select(*key, "size", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        stop = nxt.filter("moved").isEmpty()
        state = nxt.drop("moved")
        if stop:
            break
    return state.join(state.groupBy(*tree, "low").agg(F.sum("size").alias("total")), [*tree, "low"])
