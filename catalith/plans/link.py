"""Linking questions to the tables and columns that answer them, for all questions in one program."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import text as X
from catalith.operators import embedding as E
from catalith.operators import lexical as L
from catalith.operators import merge as M
from catalith.operators import paths as P
from catalith.operators import ranking as R
from catalith.session import store


@dataclass
class LinkOptions:
    """max_tables, anchor_k: tables and anchors of a question, at least max_tables_large and anchor_k_large where the catalog has more
    than large_threshold tables and adaptive_budget is on. small_schema_bypass: a catalog of up to so many tables is returned whole, unranked.
    bypass_if_fits: one of up to max_tables tables is kept whole. columns: ``relevant`` or ``all``. picker: what chooses anchors among the
    candidates instead of their order, from rows (qid, text, table_key, description, pos) of one question to the keys that it picks. vectors:
    phrases(pid, qid, phrase, vector) and objects(node, vector) for embedding seeds. lineage: anchors that no other relation joins are joined over lineage."""

    max_tables: int = 20
    anchor_k: int = 6
    min_anchor_ratio: float = 0.15
    fill_ratio: float = 0.06
    bypass_if_fits: bool = True
    small_schema_bypass: int = 0
    adaptive_budget: bool = True
    large_threshold: int = 30
    max_tables_large: int = 20
    anchor_k_large: int = 6
    prior_window: int = 50
    paths: bool = True
    path_extra: float = 0.0
    path_cutoff: int = P.CUTOFF
    path_decay: float = P.FLOW
    path_least: float = P.LEAST_FLOW
    path_top: int = P.TOP_PATHS
    lineage: bool = False
    columns: str = "relevant"
    max_columns: int = 40
    uncapped_rank: int = 1
    rarity: bool = True
    fuzzy: bool = True
    names_with_stopwords: bool = True
    min_numeric: int = X.MIN_NUMERIC
    agg: str = "top3"  # top3, sum
    edge_weight: str = "weight"  # weight, affinity
    rrf_k: int = 60
    alpha: float = 0.85
    ranker: str = "rrf"  # rrf, ppr, bm25
    bm25: str = "bm25f"  # bm25f, lucene, bm25+
    schema_routing: float = 0.0
    seed_sparse: bool = False
    seed_k: int = 5
    seed_weight: float = 1.0
    vectors: tuple[DataFrame, DataFrame] | None = None
    embed_threshold: float = E.THRESHOLD
    embed_top_k: int = E.TOP_K
    embed_weight: float = E.WEIGHT
    picker: Callable[[list[dict]], list[str]] | None = None
    render_samples: bool = True
    ranking_limit: int = 0  # 0: the whole ranking
    source: str | None = None  # only tables that this source lists

    def effective(self, n_tables: int) -> LinkOptions:
        if not self.adaptive_budget or n_tables <= self.large_threshold:
            return self
        return replace(self, max_tables=max(self.max_tables, self.max_tables_large), anchor_k=max(self.anchor_k, self.anchor_k_large))


@dataclass
class Linked:
    """seeds(qid, node, weight, reasons), nodes(qid, node, score; tables and columns), ranked(qid, table_key, score, evidence, pos, anchor), paths(qid, tables, reliability, place), tables(qid, table_key, score, anchor, pos), columns(qid, table_key, col, score, reason, ord), glossary(qid, term, target). Where only tables were asked for, seeds have no reasons and nodes and columns are None."""

    seeds: DataFrame
    nodes: DataFrame | None
    ranked: DataFrame
    paths: DataFrame
    tables: DataFrame
    columns: DataFrame | None
    glossary: DataFrame


#: Candidates for anchors: so many times anchor_k, and at least so many.
CANDIDATES, LEAST_CANDIDATES = 3, 8


def _picked(ranked: DataFrame, questions: DataFrame, o: L.Objects, opts: LinkOptions) -> DataFrame:
    """qid, table_key that the picker chooses for each question; nothing for a question that it fails on or picks nothing known for."""
    qid = ranked.schema["qid"].dataType.simpleString()
    rows = ranked.filter(F.col("nth") <= max(opts.anchor_k * CANDIDATES, LEAST_CANDIDATES)).filter("fit").join(questions.select("qid", "text"), "qid").join(o.tables.select("table_key", "description"), "table_key").select("qid", "text", "table_key", "description", "pos")
    picker = opts.picker

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("pos").to_dict("records")
        try:
            chosen = set(picker(own))
        except Exception:  # a picker's failure must not break linking
            chosen = set()
        kept = [r["table_key"] for r in own if r["table_key"] in chosen]
        return pd.DataFrame({"qid": pd.Series([own[0]["qid"]] * len(kept), dtype=object), "table_key": pd.Series(kept, dtype=object)})

    return rows.groupBy("qid").applyInPandas(pick, f"qid {qid}, table_key string")  # bounded by the candidates


def _keys(o: L.Objects) -> Column:
    """The tables of a catalog that was found to have few of them, as one array."""
    return F.array(*[F.lit(k) for k in sorted(r.table_key for r in o.tables.select("table_key").collect())]).cast("array<string>")


def _everything(questions: DataFrame, o: L.Objects) -> Linked:
    """The bypass for small catalogs: every table with every column for every question."""
    spark = questions.sparkSession
    qid = questions.schema["qid"].dataType.simpleString()
    empty = lambda s: spark.createDataFrame([], f"qid {qid}, {s}")
    t = questions.select("qid", F.posexplode(_keys(o)).alias("p", "table_key"))
    tables = t.select("qid", "table_key", F.lit(0.0).alias("score"), F.lit(False).alias("anchor"), (F.col("p") + 1).alias("pos"))
    columns = tables.join(o.columns, "table_key").select("qid", "table_key", "col", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("reason"), "ord")
    return Linked(empty("node string, weight double, reasons array<string>"), empty("node string, score double"), empty("table_key string, score double, evidence double, pos int, anchor boolean"), empty("tables array<string>, reliability double, place int"), tables, columns, empty("term string, target string"))


def link(questions: DataFrame, o: L.Objects, opts: LinkOptions | None = None, only_tables: bool = False) -> Linked:
    """questions: qid, text. Activation, PageRank, fusion with BM25F, anchors, join paths, tables and columns.

    only_tables: the same tables, ranking and paths, without what only columns and explanations need: reasons, and a score of every node."""
    opts = opts or LinkOptions()
    if opts.source is not None:
        o = L.scoped(o, opts.source)
    n_tables = o.count("tables", o.tables)
    if n_tables <= opts.small_schema_bypass:
        return _everything(questions, o)
    opts = opts.effective(n_tables)
    whole = opts.bypass_if_fits and n_tables <= opts.max_tables
    columns = o.columns
    post = o.keep("post", lambda: L.postings(o))
    rows = L.activate(questions, o, opts.fuzzy, post, opts.rarity, opts.names_with_stopwords, opts.min_numeric, why=not only_tables)
    if opts.vectors is not None:
        near = E.embedding_seeds(*opts.vectors, opts.embed_threshold, opts.embed_top_k, opts.embed_weight)
        if only_tables:
            rows = rows.unionByName(near.select("qid", "node", "weight")).groupBy("qid", "node").agg(F.sum("weight").alias("weight"))
        else:
            both = rows.select("qid", "node", "weight", "reasons", F.lit(0).alias("o")).unionByName(near.select("qid", "node", "weight", F.array("reason").alias("reasons"), F.lit(1).alias("o")))
            rows = both.groupBy("qid", "node").agg(F.sum("weight").alias("weight"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "reasons"))), lambda x: x["reasons"])).alias("reasons"))
    score = L.bm25f(questions, o) if opts.bm25 == "bm25f" else L.bm25_single(questions, o, opts.bm25)
    step = o.keep(f"step {opts.edge_weight}", lambda: R.transition(R.graph_edges(o, post, opts.edge_weight)))
    pairs, spec = o.keep("pairs", lambda: M.relations(o.edges, JOIN_KINDS)), o.keep("spec", lambda: R.specificity(o))
    seeds, sparse = store(rows), store(score)  # one after the other: both plans at once are what the driver needs most memory for
    start = seeds.select("qid", "node", "weight")
    if opts.seed_sparse:
        start = start.unionByName(R.sparse_seeds(sparse, opts.seed_k, opts.seed_weight)).groupBy("qid", "node").agg(F.sum("weight").alias("weight"))
    weighted = start.join(spec, "node", "left").select("qid", "node", (F.col("weight") * F.coalesce("spec", F.lit(1.0))).alias("weight"))
    reached = store(R.table_walk(step, weighted, columns, opts.alpha, opts.agg, parts=not only_tables))
    scored = R.direct_evidence(reached.select("qid", "table_key", "score"), seeds, columns).filter("score > 0")
    dense = store(R.route_by_schema(scored, opts.schema_routing) if opts.schema_routing else scored)
    both = R.relative(dense).unionByName(R.relative(sparse)) if opts.ranker == "rrf" else R.relative(dense if opts.ranker == "ppr" else sparse)
    both = both.groupBy("qid", "table_key").agg(F.max("evidence").alias("evidence"))
    final = {"rrf": lambda: L.fuse([dense, sparse], opts.rrf_k), "ppr": lambda: dense, "bm25": lambda: sparse.filter("score > 0")}[opts.ranker]()
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "table_key")
    fit = F.col("evidence") >= opts.min_anchor_ratio
    ranked = final.join(both, ["qid", "table_key"]).withColumn("pos", F.row_number().over(order)).withColumn("fit", fit).withColumn("nth", F.sum(fit.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("anchor", F.col("fit") & (F.col("nth") <= opts.anchor_k))
    if opts.picker is not None:
        ranked = store(ranked)
        picked = store(_picked(ranked, questions, o, opts))
        chose = picked.select("qid").distinct().withColumn("chose", F.lit(True))
        ranked = ranked.join(picked.withColumn("took", F.lit(True)), ["qid", "table_key"], "left").join(chose, "qid", "left").withColumn("anchor", F.when(F.col("chose"), F.coalesce("took", F.lit(False))).otherwise(F.col("anchor")))
    ranked = store(ranked.select("qid", "table_key", "score", "evidence", "pos", "anchor"))
    prior = ranked.withColumn("evidence", F.when(F.col("pos") <= opts.prior_window, F.col("evidence")).otherwise(0.0)).filter(F.col("anchor") | (F.col("pos") <= opts.prior_window))
    wide = M.relations(o.edges) if opts.lineage else None
    paths = store(P.join_paths(pairs, prior if opts.paths else prior.limit(0), opts.path_extra, opts.path_cutoff, opts.path_decay, opts.path_least, opts.path_top, wide))
    tables = store(_chosen(questions, o, ranked, paths, opts, whole))
    if only_tables:
        return Linked(seeds, None, ranked, paths, tables, None, L.matched_terms(questions, o))
    near = R.node_scores(reached.join(tables.select("qid", "table_key"), ["qid", "table_key"], "left_semi"))
    return Linked(seeds, R.node_scores(reached), ranked, paths, tables, select_columns(tables, paths, seeds, near, columns, o.edges, opts), L.matched_terms(questions, o))


JOIN_KINDS = [k for k in M.JOIN_COST if k != "lineage"]


def _chosen(questions: DataFrame, o: L.Objects, ranked: DataFrame, paths: DataFrame, opts: LinkOptions, whole: bool) -> DataFrame:
    """Anchors and tables on paths, filled up with the best of the others (with all, where the catalog fits), cut to the budget by score."""
    must = ranked.filter("anchor").select("qid", "table_key").unionByName(paths.select("qid", F.explode("tables").alias("table_key"))).distinct().withColumn("must", F.lit(True))
    rows = ranked
    if whole:
        must = must.unionByName(questions.select("qid", F.explode(_keys(o)).alias("table_key")).withColumn("must", F.lit(True))).distinct()
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    all_ = rows.join(must, ["qid", "table_key"], "full").select("qid", "table_key", zero("score", 0.0), zero("evidence", 0.0), "pos", zero("anchor", False), zero("must", False))
    by_q = Window.partitionBy("qid")
    fill = by_q.orderBy(F.desc(~F.col("must") & (F.col("evidence") >= opts.fill_ratio)), F.col("pos").asc_nulls_last())
    kept = all_.withColumn("n_must", F.sum(F.col("must").cast("int")).over(by_q)).withColumn("nth", F.row_number().over(fill))
    kept = kept.filter(F.col("must") | ((F.col("evidence") >= opts.fill_ratio) & (F.col("nth") <= opts.max_tables - F.col("n_must"))))
    most = F.greatest(F.lit(opts.max_tables), F.sum(F.col("anchor").cast("int")).over(by_q))
    placed = kept.withColumn("place", F.row_number().over(by_q.orderBy(F.desc("score"), "table_key"))).withColumn("most", most)
    return placed.filter("place <= most").select("qid", "table_key", "score", "anchor", "pos")


def select_columns(tables: DataFrame, paths: DataFrame, seeds: DataFrame, nodes: DataFrame, columns: DataFrame, edges: DataFrame, opts: LinkOptions) -> DataFrame:
    """Keys first, then what the question names, then what the walk reaches; all of an anchor's columns, and all where a question names nothing. Tables below the first rank are capped, keys exempt; a table without any of these shows its first columns."""
    hop = paths.select("qid", F.explode(F.arrays_zip(F.slice("tables", 1, F.size("tables") - 1).alias("a"), F.slice("tables", 2, F.size("tables")).alias("b"))).alias("h")).select("qid", F.least("h.a", "h.b").alias("u"), F.greatest("h.a", "h.b").alias("v")).distinct()
    e = edges.select(F.least("from_key", "to_key").alias("u"), F.greatest("from_key", "to_key").alias("v"), "from_key", "to_key", "from_columns", "to_columns")
    on = hop.join(e, ["u", "v"])
    keys = on.select("qid", F.col("from_key").alias("table_key"), F.explode("from_columns").alias("col")).unionByName(on.select("qid", F.col("to_key").alias("table_key"), F.explode("to_columns").alias("col"))).distinct().withColumn("key", F.lit(True))
    asked = seeds.select("qid").distinct().withColumn("asked", F.lit(True))
    c = tables.join(asked, "qid", "left").join(columns.select("table_key", "col", "node", "is_primary_key", "ord"), "table_key").join(keys, ["qid", "table_key", "col"], "left")
    c = c.join(seeds.select("qid", "node", "weight", "reasons"), ["qid", "node"], "left").join(nodes.select("qid", "node", F.col("score").alias("ppr")), ["qid", "node"], "left")
    reason = F.when(F.col("is_primary_key"), "primary key").when(F.col("key"), "join key").when(F.col("weight").isNotNull(), F.array_join(F.slice("reasons", 1, 2), "; "))
    linked = F.lit(opts.columns == "all") | F.col("reason").isNotNull() | F.col("anchor") | F.col("asked").isNull() | F.coalesce(F.col("ppr") > 0, F.lit(False))
    by_t = Window.partitionBy("qid", "table_key")
    c = c.withColumn("reason", reason).withColumn("linked", linked).withColumn("some", F.max("linked").over(by_t))
    c = c.withColumn("col_score", F.round(1000 * F.coalesce("ppr", F.lit(0.0)) + F.coalesce("weight", F.lit(0.0)), 4)).withColumn("is_key", F.coalesce(F.col("reason").isin("primary key", "join key"), F.lit(False)))
    c = c.filter(F.col("linked") | ~F.col("some")).withColumn("n", F.row_number().over(by_t.orderBy(F.desc("is_key"), F.when(F.col("some"), -F.col("col_score")), "ord")))
    c = c.filter((F.col("some") & (F.col("pos") <= opts.uncapped_rank)) | F.col("is_key") | (F.col("n") <= opts.max_columns))
    return c.select("qid", "table_key", "col", F.when(F.col("some"), F.col("col_score")).otherwise(0.0).alias("score"), "reason", "ord")


#: How many seeds, nodes and tables an explanation shows.
EXPLAIN_TOP, EXPLAIN_TABLES = 40, 20


def explain(linked: Linked) -> DataFrame:
    """qid, what (seed, node, table), place, name, score, why: the best of each for each question, as linking computed them."""

    def best(df: DataFrame, what: str, name: str, score: str, why, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), name))
        return df.select("qid", F.lit(what).alias("what"), place.alias("place"), F.col(name).alias("name"), F.col(score).alias("score"), why.alias("why")).filter(F.col("place") <= n)

    none = F.lit(None).cast("string")
    return best(linked.seeds, "seed", "node", "weight", F.array_join("reasons", "; "), EXPLAIN_TOP).unionByName(best(linked.nodes, "node", "node", "score", none, EXPLAIN_TOP)).unionByName(best(linked.ranked, "table", "table_key", "score", none, EXPLAIN_TABLES))


def render(linked: Linked, questions: DataFrame, o: L.Objects, tables: DataFrame, samples: bool = True) -> DataFrame:
    """qid, ddl: the terms that matched, the linked tables as annotated DDL, join paths last, the most reliable at the end. tables: the merged tables with description, row_count, kind, source."""
    c = linked.columns.join(o.columns.select("table_key", "col", "name", "data_type", F.col("description").alias("about"), "samples"), ["table_key", "col"])
    line = F.concat(F.lit("  "), "name", F.coalesce(F.concat(F.lit(" "), "data_type"), F.lit("")))
    keys = o.columns.filter("is_primary_key").groupBy("table_key").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("k")).select("table_key", F.array_join(F.transform("k", lambda x: x["name"]), ", ").alias("pk"))
    cols = c.groupBy("qid", "table_key").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line"), F.coalesce("about", F.lit("")).alias("about"), "name", "samples"))).alias("c"))
    n = F.size("c")
    body = F.array_join(F.transform("c", lambda x, i: F.concat(x["line"], F.when(i < n - 1, F.lit(",")).otherwise(F.lit("")), F.when(x["about"] != "", F.concat(F.lit("  -- "), x["about"])).otherwise(F.lit("")))), "\n")
    six = lambda c: F.concat(F.array_join(F.slice(F.split(c, ","), 1, 6), ", "), F.when(F.size(F.split(c, ",")) > 6, F.lit(", ...")).otherwise(F.lit("")))
    named = lambda word, c: F.when(F.col(c) != "", F.concat(F.lit(word), six(c)))
    notes = F.array_join(F.array_compact(F.array(F.col("description"), F.concat(F.format_number("row_count", 0), F.lit(" rows")), F.when(F.col("kind") != "table", F.col("kind")), named("built from ", "upstream"), named("feeds ", "downstream"), F.concat(F.lit("from "), "source"))), "; ")
    quoted = lambda s: F.array_join(F.transform(F.slice(s, 1, 5), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    values = F.array_join(F.transform(F.filter("c", lambda x: F.size(x["samples"]) > 0), lambda x: F.concat(F.lit("--   "), x["name"], F.lit(": "), quoted(x["samples"]))), "\n")
    t = linked.tables.join(tables, "table_key").join(cols, ["qid", "table_key"], "left").join(keys, "table_key", "left").join(M.lineage(o.edges), "table_key", "left")
    block = F.concat(F.lit("\nCREATE TABLE "), "table_key", F.lit(" (\n"), F.coalesce(body, F.lit("")), F.coalesce(F.concat(F.lit(",\n  PRIMARY KEY ("), "pk", F.lit(")")), F.lit("")), F.lit("\n);"), F.when(notes != "", F.concat(F.lit("  -- "), notes)).otherwise(F.lit("")))
    sample = F.when(values != "", F.concat(F.lit("-- Sample values for "), "table_key", F.lit(":\n"), values))
    doc = t.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "table_key", block.alias("b"), sample.alias("v"), "anchor"))).alias("t"))  # at most max_tables
    p = linked.paths.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("reliability", (-F.col("place")).alias("z"), F.concat(F.lit("-- path ["), F.format_string("%.2f", "reliability"), F.lit("]: "), F.array_join("tables", " -> ")).alias("l")))).alias("p"))
    terms = linked.glossary.groupBy("qid", "term").agg(F.array_join(F.sort_array(F.collect_set("target")), ", ").alias("targets"))
    terms = terms.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("-- Term '"), "term", F.lit("'"), F.when(F.col("targets") != "", F.concat(F.lit(": "), "targets")).otherwise(F.lit(""))))), "\n").alias("glossary"))
    d = doc.join(p, "qid", "left").join(questions, "qid").join(terms, "qid", "left")
    anchors = F.array_join(F.transform(F.filter("t", lambda x: x["anchor"]), lambda x: x["table_key"]), ", ")
    parts = F.array(
        F.concat(F.lit("-- Question: "), "text"), F.concat(F.lit("-- Linked tables: "), F.size("t").cast("string"), F.lit(" (anchors: "), F.when(anchors != "", anchors).otherwise("none"), F.lit(")")),
        F.col("glossary"),
        F.array_join(F.transform("t", lambda x: x["b"]), "\n"),
        F.concat(F.lit("\n-- === Join paths (most reliable last) ===\n"), F.array_join(F.transform("p", lambda x: x["l"]), "\n")),
        F.lit(None) if not samples else F.concat(F.lit("\n-- === Sample Values ===\n"), F.nullif(F.array_join(F.transform("t", lambda x: x["v"]), "\n"), F.lit(""))),
    )
    return d.select("qid", F.concat(F.array_join(F.array_compact(parts), "\n"), F.lit("\n")).alias("ddl"))
