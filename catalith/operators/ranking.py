"""Personalized PageRank over the catalog graph, for many questions at once, and table scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from catalith.functions import text as X
from catalith.functions.worker import kept, read_stored
from catalith.operators import lexical as L
from catalith.operators import merge as M
from catalith.session import store

# Edge weights of the graph, the damping, and the bonuses of direct evidence.
CONTAINS, FK_COLUMN, GLOSSARY = 0.5, 0.8, 0.7
ALPHA, TOLERANCE = 0.85, 1e-12
TABLE_BONUS, COLUMN_BONUS, BONUS_CAP = 0.35, 0.10, 2.0
#: Directed edges of a graph that a task reads whole, and the questions that one solves at a time: at most BLOCK, or BLOCK_CELLS scores. A larger graph goes by joins.
LOCAL_EDGES, BLOCK, BLOCK_CELLS = 2_000_000, 32, 1_000_000
#: Bytes of the names of such a graph's nodes, and the rows that a task hands over at a time.
LOCAL_NAMES, BATCH = 128_000_000, 50_000


def graph_edges(o: L.Objects, post: DataFrame, by: str = "weight") -> DataFrame:
    """u, v, etype, weight: each undirected edge once, u < v. by: what relations weigh, their join cost (``weight``) or ``affinity``."""
    contains = o.columns.select(F.concat(F.lit("t:"), "table_key").alias("u"), F.col("node").alias("v"), F.lit("contains").alias("etype"), F.lit(CONTAINS).alias("weight"))
    rel = M.relations(o.edges).select(F.concat(F.lit("t:"), "u").alias("u"), F.concat(F.lit("t:"), "v").alias("v"), F.lit("relation").alias("etype"), F.col(by).alias("weight"))
    links = M.column_links(o.edges, o.columns)
    fk = links.select(F.concat(F.lit("c:"), "from_key", F.lit("."), "from_col").alias("u"), F.concat(F.lit("c:"), "to_key", F.lit("."), "to_col").alias("v"), F.lit("fk_col").alias("etype"), F.lit(FK_COLUMN).alias("weight"))
    gloss = o.targets.select(F.col("node").alias("u"), F.col("target").alias("v"), F.lit("glossary").alias("etype"), F.lit(GLOSSARY).alias("weight"))
    hubs = post.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") <= X.HUB_POSTINGS).select("token")
    mention = post.join(hubs, "token").select(F.concat(F.lit("w:"), "token").alias("u"), F.col("node").alias("v"), F.lit("mention").alias("etype"), (F.col("weight") * X.MENTION_SCALE).alias("weight"))
    every = contains.unionByName(rel).unionByName(fk).unionByName(gloss).unionByName(mention).filter("u <> v")
    return every.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("etype").alias("etype"), F.max("weight").alias("weight"))


def specificity(o: L.Objects) -> DataFrame:
    """node, spec: how little a table's or column's name is shared; terms have 1 (no row)."""
    n = o.tables.select("node", F.col("bare").alias("name")).unionByName(o.columns.select("node", F.col("col").alias("name")))
    c = n.groupBy("name").agg(F.count("*").alias("n"))
    return n.join(c, "name").select("node", F.when(F.col("n") > 1, 1.0 / F.log(1.0 + F.col("n"))).otherwise(1.0).alias("spec"))


def transition(edges: DataFrame) -> DataFrame:
    """u, v, p: both directions of each edge, each node's edges adding up to 1."""
    both = edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).filter("weight > 0")
    mass = both.groupBy("u").agg(F.sum("weight").alias("mass"))
    return both.join(mass, "u").select("u", "v", (F.col("weight") / F.col("mass")).alias("p"))


def _layers(src: np.ndarray, dst: np.ndarray, p: np.ndarray, wide: int = 512) -> tuple:
    """Edges into each node in layers: the k-th edge of every node that has so many. Edges into nodes with more than ``wide`` come apart."""
    order = np.argsort(dst, kind="stable")
    src, dst, p = src[order], dst[order], p[order][:, None]
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(dst)])
    few = np.flatnonzero(count <= wide)
    few = few[np.argsort(-count[few], kind="stable")]
    at, left = first[few], count[few]
    layers = []
    for k in range(int(left[0]) if len(left) else 0):
        e = at[: np.searchsorted(-left, -k, "left")] + k
        layers.append((src[e], p[e]))
    many = [(dst[first[j]], src[first[j] : first[j] + count[j]], p[first[j] : first[j] + count[j]]) for j in np.flatnonzero(count > wide)]
    return dst[first[few]] if len(few) else np.zeros(0, np.int64), layers, many


def _step(layout: tuple, x: np.ndarray) -> np.ndarray:
    """What each node gets from its neighbours, for all columns of x."""
    nodes, layers, many = layout
    y = np.zeros_like(x)
    got = np.zeros((len(nodes), x.shape[1]))
    for src, p in layers:
        part = x.take(src, axis=0)
        part *= p
        got[: len(src)] += part
    y[nodes] = got
    for node, src, p in many:
        y[node] = (x.take(src, axis=0) * p).sum(axis=0)
    return y


def walk(layout: tuple, start: np.ndarray, n: int, alpha: float = ALPHA) -> np.ndarray:
    """Columns of stationary scores for the columns of ``start`` (teleports that add up to 1), by Chebyshev's iteration.

    The score that nodes without edges give back to the teleport only scales a column, so columns are scaled to 1 at the end. The
    rounds end when a column changes by less than n * TOLERANCE in all; two plain rounds close, so that every score is a sum of shares."""
    home = (1 - alpha) * start
    del start  # a task's memory goes to the arrays of a block, so none stays longer than it is needed
    was, x, omega = None, home.copy(), 1.0
    while True:
        omega = next_weight(omega, was is None, alpha)
        y = _home(layout, x, alpha, home)
        if was is not None:
            y -= was
            y *= omega
            y += was
        moved = np.subtract(y, x, out=was)
        done = np.abs(moved, out=moved).sum(axis=0).max() < n * TOLERANCE
        was, x = x, y
        if done:
            break
    del was, moved, y
    for _ in range(2):
        x = _home(layout, np.clip(x, 0, None, out=x), alpha, home)
    x /= x.sum(axis=0)
    return x


def _home(layout: tuple, x: np.ndarray, alpha: float, home: np.ndarray) -> np.ndarray:
    """Shares of neighbours and of the teleport."""
    y = _step(layout, x)
    y *= alpha
    y += home
    return y


def next_weight(omega: float, first: bool, alpha: float) -> float:
    """Chebyshev's weights for a step matrix with eigenvalues between -alpha and alpha (that of an undirected graph has such)."""
    return 1.0 if first else 1 / (1 - alpha**2 / 2) if omega == 1.0 else 1 / (1 - alpha**2 * omega / 4)


def pagerank(edges: DataFrame | None, seeds: DataFrame, alpha: float = ALPHA, local_edges: int = LOCAL_EDGES, step: DataFrame | None = None, kinds: str = "", least: float = 0.0) -> DataFrame:
    """qid, node, score for teleports seeds(qid, node, weight > 0), normalised by question.

    A graph of up to ``local_edges`` edges is read by the tasks whole, each of which solves blocks of its questions; a larger one
    stays distributed and all questions move by rounds of joins. Both go the same rounds to the same tolerance. A seed outside the graph has no edge to give its score along.
    step: the transition, if it is at hand. kinds: only nodes whose names begin with one of these letters come out. least: only scores above it come out (of walks over all nodes all the same)."""
    step = store(transition(edges)) if step is None else step
    start = _shares(seeds)
    nodes = _numbered(step, local_edges)
    if nodes is None:
        out = pagerank_by_joins(step, store(start), alpha).filter(F.col("score") > least)
        return out.filter(F.substring("node", 1, 1).isin(*kinds)) if kinds else out
    q_arrow = to_arrow_type(seeds.schema["qid"].dataType)

    def shown(qids: pa.Array, own: dict, extra: list[str], x: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([own["node"], pa.array(extra, pa.string())]) if extra else own["node"]
        wanted = pc.is_in(pc.utf8_slice_codeunits(names, 0, 1), value_set=pa.array([*kinds])).to_numpy(zero_copy_only=False) if kinds else True
        for j in range(len(qids)):
            i = np.flatnonzero((x[:, j] > least) & wanted)
            for k in range(0, len(i), BATCH):
                at = i[k : k + BATCH]
                yield pa.RecordBatch.from_arrays([pa.repeat(qids[j], len(at)).cast(q_arrow), names.take(pa.array(at)), pa.array(x[at, j])], names=["qid", "node", "score"])

    return _walked(step, nodes, start, alpha, shown, f"qid {seeds.schema['qid'].dataType.simpleString()}, node string, score double")


def _numbered(step: DataFrame, local_edges: int) -> DataFrame | None:
    """node, id (its place among the names) of a graph that the tasks may read whole; none of a larger one."""
    if step.count() > local_edges:
        return None
    nodes = store(step.select(F.col("u").alias("node")).distinct().select("node", (F.row_number().over(Window.orderBy("node")) - 1).alias("id")))  # at most local_edges rows
    return nodes if (nodes.agg(F.sum(F.octet_length("node"))).first()[0] or 0) <= LOCAL_NAMES else None


def _walked(step: DataFrame, nodes: DataFrame, start: DataFrame, alpha: float, shown, schema: str) -> DataFrame:
    """The tasks read the graph from the shared folder; shown(question ids, columns of nodes, names of seeds outside the graph, scores: both x questions) makes the rows of each block of questions.

    nodes: node, id, and what else ``shown`` needs, texts as dictionaries. Nothing of the graph passes the driver, which only names the files."""
    of = lambda c, i: nodes.select(F.col("node").alias(c), F.col("id").alias(i))
    edges = store(step.join(of("u", "src"), "u").join(of("v", "dst"), "v").select("src", "dst", "p"))  # at most local_edges rows
    files = tuple(store(nodes).inputFiles()), tuple(edges.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, layout = kept(files, lambda: _graph(*files))
        names = own["node"]

        def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            node, w = rows["node"].combine_chunks(), rows["w"].to_numpy()
            qids = rows["qid"].combine_chunks().unique()
            col, at = pc.index_in(rows["qid"], value_set=qids).to_numpy(), _found(node, names)
            lost = node.filter(pa.array(at < 0)).to_pylist()
            extra = sorted(set(lost))
            place = {v: len(names) + i for i, v in enumerate(extra)}
            at[at < 0] = [place[v] for v in lost]
            n = len(names) + len(extra)
            del rows, node
            yield from shown(qids, own, extra, walk(layout, _laid(at, col, w, (n, len(qids))), n, alpha))

        held, last, n = [], None, 0
        most = max(1, min(BLOCK, BLOCK_CELLS // max(1, len(names))))
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("qid")
            cuts = [0, *(np.flatnonzero(pc.not_equal(q[1:], q[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(q)]
            for i, j in zip(cuts, cuts[1:]):
                if q[i].as_py() != last:
                    n, last = n + 1, q[i].as_py()
                    if n > most:
                        yield from solved(held)
                        n = 1
                held.append(b.slice(i, j - i))
        if held:
            yield from solved(held)

    return start.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, schema)


def _graph(nodes: tuple[str, ...], edges: tuple[str, ...]) -> tuple[dict, tuple]:
    """Columns of nodes in the order of their ids, and the layout of the edges, from the files of both; edges in one order whatever file they are in."""
    n = read_stored(nodes)
    n = n.take(pa.array(np.argsort(n["id"].to_numpy())))
    own = {c: n[c].combine_chunks() if c == "node" else n[c].combine_chunks().dictionary_encode() for c in n.column_names if c != "id"}
    del n
    e = read_stored(edges)
    src, dst, p = e["src"].to_numpy().astype(np.intp), e["dst"].to_numpy().astype(np.intp), e["p"].to_numpy()
    del e
    at = np.argsort(src, kind="stable")
    return own, _layers(src[at], dst[at], p[at])


def _found(wanted: pa.Array, names: pa.Array, part: int = 131_072) -> np.ndarray:
    """The place of each among the names, -1 for none, by parts of them: Arrow copies what it looks up in."""
    at = np.full(len(wanted), -1)
    for k in range(0, len(names), part):
        i = pc.fill_null(pc.index_in(wanted, value_set=names[k : k + part]), -1).to_numpy()
        at[i >= 0] = i[i >= 0] + k
    return at


def _laid(at: np.ndarray, col: np.ndarray, w: np.ndarray, shape: tuple) -> np.ndarray:
    """The teleports of a block, each seed of a question once."""
    out = np.zeros(shape)
    out[at, col] = w
    return out


def _shares(seeds: DataFrame) -> DataFrame:
    """qid, node, w: teleports that add up to 1 for each question.

    The window makes Spark keep a question's rows together: a mere repartition, after a join by question, it takes for done, and drops with the join's own shuffle where the other side turns out small."""
    good = seeds.filter("weight > 0 and qid is not null").groupBy("qid", "node").agg(F.sum("weight").alias("weight"))
    return good.select("qid", "node", (F.col("weight") / F.sum("weight").over(Window.partitionBy("qid"))).alias("w"))


#: What a table's best columns add to its score, and every other one.
TOP_COLUMNS, OTHER_COLUMNS = (1.0, 0.5, 0.25), 0.02


def table_walk(step: DataFrame, seeds: DataFrame, columns: DataFrame, alpha: float = ALPHA, agg: str = "top3", local_edges: int = LOCAL_EDGES, parts: bool = True) -> DataFrame:
    """qid, table_key, own, score, cols(col, score): pagerank by table: its own score (null if 0), that of ``table_scores``, and those of its columns.

    One row a table instead of one a node; a graph that stays distributed is collected to this form at the end. columns: node, table_key, col. parts: else only qid, table_key, score come out."""
    q = seeds.schema["qid"].dataType
    schema = f"qid {q.simpleString()}, table_key string, " + ("own double, score double, cols array<struct<col: string, score: double>>" if parts else "score double")
    start = _shares(seeds)
    graph = _numbered(step, local_edges)
    if graph is None:
        nodes = store(pagerank_by_joins(step, store(start), alpha))
        if not parts:
            return table_scores(nodes, columns, agg).select("qid", "table_key", "score")
        own = nodes.filter("node like 't:%'").select("qid", F.expr("substring(node, 3)").alias("table_key"), F.col("score").alias("own"))
        cols = nodes.join(columns.select("node", "table_key", "col"), "node").groupBy("qid", "table_key").agg(F.collect_list(F.struct("col", "score")).alias("cols"))
        every = own.join(cols, ["qid", "table_key"], "full").join(table_scores(nodes, columns, agg), ["qid", "table_key"])
        return every.select("qid", "table_key", "own", "score", F.coalesce("cols", F.array().cast("array<struct<col: string, score: double>>")).alias("cols"))
    q_arrow = to_arrow_type(q)

    def shown(qids: pa.Array, own: dict, extra: list[str], x: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, cols = own["table_key"], own["col"]
        row, is_col = pc.fill_null(known.indices, -1).to_numpy(), pc.is_valid(cols).to_numpy(zero_copy_only=False)
        ti, ci = np.flatnonzero((row >= 0) & ~is_col), np.flatnonzero(is_col)
        trow, crow, keys, cols = row[ti], row[ci], known.dictionary, cols.dictionary_decode().filter(pa.array(is_col))
        # seeds outside the graph: their names say where the table's ends
        more = [(len(row) + k, v[0], *((v[2:], "") if v[0] == "t" else v[2:].rpartition(".")[::2])) for k, v in enumerate(extra) if v[:2] in ("t:", "c:")]
        if more:
            at = {v: k for k, v in enumerate(keys.to_pylist())}
            for i, kind, table, col in more:
                k = at.setdefault(table, len(at))
                if kind == "t":
                    ti, trow = np.r_[ti, i], np.r_[trow, k]
                else:
                    ci, crow, cols = np.r_[ci, i], np.r_[crow, k], pa.concat_arrays([cols, pa.array([col], pa.string())])
            keys = pa.array(at, pa.string())
        share = np.r_[np.array(TOP_COLUMNS), OTHER_COLUMNS]
        for j in range(len(qids)):
            mine = np.zeros(len(keys))
            mine[trow] = x[ti, j]
            s = x[ci, j]
            hit = np.flatnonzero(s > 0)
            hit = hit[np.lexsort((-s[hit], crow[hit]))]
            r, v = crow[hit], s[hit]
            first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else np.zeros(0, np.int64)
            weight = np.ones(len(r)) if agg == "sum" else share[np.minimum(np.arange(len(r)) - begin, len(TOP_COLUMNS))]
            total = mine + np.bincount(r, v * weight, len(keys))
            some = np.flatnonzero(total > 0)
            ends = np.r_[0, np.cumsum(np.bincount(r, minlength=len(keys))[some])]
            for k in range(0, len(some), BATCH):
                t, lo, hi = some[k : k + BATCH], ends[k], ends[min(k + BATCH, len(some))]
                if not parts:
                    yield pa.RecordBatch.from_arrays([pa.repeat(qids[j], len(t)).cast(q_arrow), keys.take(pa.array(t)), pa.array(total[t])], names=["qid", "table_key", "score"])
                    continue
                items = pa.StructArray.from_arrays([cols.take(pa.array(hit[lo:hi])), pa.array(v[lo:hi])], names=["col", "score"])
                lists = pa.ListArray.from_arrays(pa.array(ends[k : k + len(t) + 1] - lo, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([pa.repeat(qids[j], len(t)).cast(q_arrow), keys.take(pa.array(t)), pa.array(mine[t], mask=mine[t] <= 0), pa.array(total[t]), lists], names=["qid", "table_key", "own", "score", "cols"])

    # a column's name may have dots, so its node's name doesn't say where the table's ends
    held = columns.groupBy("node").agg(F.min(F.struct("table_key", "col")).alias("m"))
    rest, is_col = F.expr("substring(node, 3)"), F.col("node").startswith("c:")
    table_key = F.when(F.col("node").startswith("t:"), rest).when(is_col, F.coalesce("m.table_key", F.regexp_extract(rest, "(?s)^(.*)[.][^.]*$", 1)))
    col = F.when(is_col, F.coalesce("m.col", F.substring_index(rest, ".", -1)))
    return _walked(step, graph.join(held, "node", "left").select("node", "id", table_key.alias("table_key"), col.alias("col")), start, alpha, shown, schema)


def node_scores(by_table: DataFrame) -> DataFrame:
    """qid, node, score of tables and columns, from table_walk."""
    own = by_table.filter("own is not null").select("qid", F.concat(F.lit("t:"), "table_key").alias("node"), F.col("own").alias("score"))
    return own.unionByName(by_table.select("qid", "table_key", F.explode("cols").alias("c")).select("qid", F.concat(F.lit("c:"), "table_key", F.lit("."), "c.col").alias("node"), F.col("c.score").alias("score")))


def pagerank_by_joins(step: DataFrame, start: DataFrame, alpha: float = ALPHA, cut_every: int = 4) -> DataFrame:
    """The same by rounds of joins over the cluster, written every few rounds, until no question changes by more than the tolerance."""
    n = step.select("u").union(start.select("node")).distinct().count()
    home = start.select("qid", "node", ((1 - alpha) * F.col("w")).alias("home"))

    def moved(x: DataFrame, keep: list[str]) -> DataFrame:
        """qid, node, new: shares of neighbours and of the teleport; keep: columns of x that stay at their node, 0 where there was none."""
        over = x.withColumnRenamed("node", "u").join(step, "u").select("qid", F.col("v").alias("node"), (alpha * F.col("score") * F.col("p")).alias("new"), *[F.lit(0.0).alias(c) for c in keep])
        stay = x.select("qid", "node", F.lit(0.0).alias("new"), *keep)
        back = home.select("qid", "node", F.col("home").alias("new"), *[F.lit(0.0).alias(c) for c in keep])
        return over.unionByName(stay).unionByName(back).groupBy("qid", "node").agg(F.sum("new").alias("new"), *[F.sum(c).alias(c) for c in keep])

    x, omega, k = home.select("qid", "node", F.col("home").alias("score"), F.lit(0.0).alias("was")), 1.0, 0
    while True:
        omega = next_weight(omega, k == 0, alpha)
        y = moved(x, ["score", "was"])
        x = y.select("qid", "node", (F.col("new") if k == 0 else omega * (F.col("new") - F.col("was")) + F.col("was")).alias("score"), F.col("score").alias("was"))
        k += 1
        if k % cut_every == 0:
            x = store(x)
            worst = x.groupBy("qid").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("d")).agg(F.max("d")).first()[0]
            if worst is None or worst < n * TOLERANCE:
                break
    for _ in range(2):
        x = moved(x.select("qid", "node", F.greatest("score", F.lit(0.0)).alias("score")), []).select("qid", "node", F.col("new").alias("score"))
    x = store(x.filter("score > 0"))
    return x.join(x.groupBy("qid").agg(F.sum("score").alias("all")), "qid").select("qid", "node", (F.col("score") / F.col("all")).alias("score"))


def table_scores(nodes: DataFrame, columns: DataFrame, agg: str = "top3") -> DataFrame:
    """qid, table_key, score: a table's own score, its best three columns by 1, 1/2, 1/4 and the rest by 0.02; with ``sum`` all columns in full."""
    own = nodes.filter("node like 't:%'").select("qid", F.expr("substring(node, 3)").alias("table_key"), "score")
    c = nodes.join(columns.select("node", "table_key"), "node").select("qid", "table_key", "node", "score")
    if agg == "sum":
        return own.unionByName(c.drop("node")).groupBy("qid", "table_key").agg(F.sum("score").alias("score"))
    n = F.row_number().over(Window.partitionBy("qid", "table_key").orderBy(F.desc("score"), "node"))
    weight = F.coalesce(*[F.when(F.col("n") == i, w) for i, w in enumerate(TOP_COLUMNS, 1)], F.lit(OTHER_COLUMNS))
    part = c.withColumn("n", n).select("qid", "table_key", (F.col("score") * weight).alias("score"))
    return own.unionByName(part).groupBy("qid", "table_key").agg(F.sum("score").alias("score"))


def direct_evidence(scores: DataFrame, seeds: DataFrame, columns: DataFrame) -> DataFrame:
    """Table scores with a bonus for tables and columns that the question names, in parts of its best score."""
    best = scores.groupBy("qid").agg(F.max("score").alias("best"))
    capped = F.least("weight", F.lit(BONUS_CAP))
    own = seeds.filter("node like 't:%'").select("qid", F.expr("substring(node, 3)").alias("table_key"), (TABLE_BONUS * capped).alias("b"))
    col = seeds.join(columns.select("node", "table_key"), "node").select("qid", "table_key", (COLUMN_BONUS * capped).alias("b"))
    bonus = own.unionByName(col).join(best, "qid", "left").select("qid", "table_key", (F.col("b") * F.coalesce("best", F.lit(1.0))).alias("score"))
    return scores.unionByName(bonus).groupBy("qid", "table_key").agg(F.sum("score").alias("score"))


def relative(scores: DataFrame) -> DataFrame:
    """qid, table_key, evidence: scores as parts of the question's best."""
    best = scores.groupBy("qid").agg(F.max("score").alias("best"))
    return scores.join(best, "qid").select("qid", "table_key", (F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("evidence"))


def route_by_schema(scores: DataFrame, share: float) -> DataFrame:
    """Scores blended with the mass of the best three tables of their schema, in parts of the best schema's."""
    schema = F.regexp_replace("table_key", "\\.?[^.]*$", "")
    s = scores.withColumn("s", schema)
    n = F.row_number().over(Window.partitionBy("qid", "s").orderBy(F.desc("score"), "table_key"))
    mass = s.withColumn("n", n).filter("n <= 3").groupBy("qid", "s").agg(F.sum("score").alias("mass"))
    best = mass.groupBy("qid").agg(F.max("mass").alias("best"))
    return s.join(mass, ["qid", "s"]).join(best, "qid").select("qid", "table_key", (F.col("score") * (1 - share + share * F.col("mass") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0))).alias("score"))


def sparse_seeds(sparse: DataFrame, k: int = 5, weight: float = 1.0) -> DataFrame:
    """qid, node, weight: the best ``k`` tables of a sparse ranking as teleports, by weight / rank."""
    r = L.ranks(sparse)
    return sparse.withColumn("r", r).filter(F.col("r") <= k).select("qid", F.concat(F.lit("t:"), "table_key").alias("node"), (weight / F.col("r")).alias("weight"))
