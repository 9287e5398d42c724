import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.engine import Engine
from catalith.operators import candidates as C
from catalith.operators import lexical as L
from catalith.operators import paths as P
from catalith.operators import merge as M
from catalith.operators import orphans as O
from catalith.operators import ranking as R
from catalith.operators import embedding as E
from catalith.plans import link as K
from catalith.plans.link import LinkOptions
from catalith.streaming import feed
import json
import sys

sys.path.insert(0, __file__.rpartition("/")[0])
from test_sources import HARBOUR  # noqa: E402

MORE = "CREATE TABLE tug_job (job_no INT PRIMARY KEY, landing_no INT REFERENCES landing(landing_no), pilot VARCHAR); CREATE TABLE tide_log (reading_no INT PRIMARY KEY, cm INT);"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.add("ddl", "harbour", text=HARBOUR + MORE)
    samples = {("vessel", "flag"): ["Portugal", "Norway", "10%", "A++"], ("tug_job", "pilot"): ["Mendes", "a rather long value of seven words"]}
    for t in e.payloads["harbour"]["tables"]:
        for c in t["columns"]:
            c["sample_values"] = samples.get((t["name"], c["name"]), [])
    e.add_term("harbour fee", "money", ["toll"], ["public.landing.dues"])
    return e


def test_activation(engine, spark):
    q = spark.createDataFrame([(0, "toll paid by vessels from Norway"), (1, "a rather long value of seven words today"), (2, "landign of hazrd"), (3, None), (4, "")], "qid int, text string")
    a = {(r.qid, r.node): r for r in L.activate(q, engine.objects).collect()}
    assert a[0, "c:public.vessel.flag"].weight > 1 and a[0, "c:public.landing.dues"].weight > 1
    assert a[0, "k:harbour fee"].reasons[0] == "glossary phrase 'toll'"
    assert a[1, "c:public.tug_job.pilot"].weight >= 1.5
    assert any(r.startswith("fuzzy 'hazrd'~'hazard'") for r in a[2, "c:public.ware.hazard"].reasons)
    assert not any(k[0] in (3, 4) for k in a)


def test_link(engine):
    got = engine.link(["tonnes by ware hazard for vessels with flag Norway", "pilot for each quay basin", "zzzz qqqq"], LinkOptions(max_tables=5, anchor_k=4, adaptive_budget=False))
    tables = {}
    for r in got.tables.collect():
        tables.setdefault(r.qid, {})[r.table_key] = r.anchor
    assert {"public.vessel", "public.landing", "public.crate", "public.ware"} <= set(tables[0]) and "public.tide_log" not in tables[0]
    assert max(len(r.tables) for r in got.paths.filter("qid = 0").collect()) == 4
    cols = {r.col for r in got.columns.filter("qid = 1 and table_key = 'public.landing'").collect()}
    assert {"landing_no", "quay_no"} <= cols and 2 not in tables
    text = engine.ddl("pilot for each quay basin, and the toll")
    assert "CREATE TABLE public.tug_job (" in text and "PRIMARY KEY (job_no)" in text and "-- path [" in text and "'Mendes'" in text
    assert "-- Term 'toll': public.landing.dues" in text


def test_budgets_and_bypasses(engine, spark):
    """A catalog that fits is kept whole, also for a question that names nothing; a small one may come unranked; large ones have a budget of their own."""
    q = ["pilot", "zzzz qqqq"]
    count = lambda o: {r.qid: r["count"] for r in engine.link(q, o).tables.groupBy("qid").count().collect()}
    assert count(LinkOptions()) == {0: 7, 1: 7}
    whole = engine.link(q, LinkOptions(small_schema_bypass=7))
    assert whole.tables.count() == 14 and whole.ranked.count() == 0 and whole.columns.count() == 2 * engine.objects.columns.count()
    small = LinkOptions(max_tables=1, anchor_k=1, bypass_if_fits=False, fill_ratio=0.0)
    assert small.effective(30) == small and (small.effective(31).max_tables, small.effective(31).anchor_k) == (20, 6)
    assert count(small) == {0: 1}
    got = engine.link(["zzzz"], LinkOptions(max_columns=2))  # nothing to select by: all columns, capped, keys exempt
    assert {r.table_key: r["count"] for r in got.columns.groupBy("table_key").count().collect()}["public.crate"] == 2


def test_picker_affinity_and_explanation(engine):
    seen = []
    o = LinkOptions(max_tables=4, anchor_k=2, picker=lambda rows: [r["table_key"] for r in rows if r["table_key"].endswith(("quay", "ware"))], edge_weight="affinity", agg="sum", rarity=False, fuzzy=False)
    got = engine.link(["pilot for each quay basin and ware"], o)
    assert {r.table_key for r in got.tables.filter("anchor").collect()} == {"public.quay", "public.ware"} and not seen
    failing = engine.link(["pilot for each quay basin"], LinkOptions(picker=lambda rows: 1 / 0))
    assert failing.tables.filter("anchor").count() > 0
    why = engine.explain(["pilot for each quay basin"]).collect()
    assert {r.what for r in why} == {"seed", "node", "table"} and next(r for r in why if r.what == "table" and r.place == 1).name in ("public.quay", "public.tug_job")
    none = engine.link(["pilot for each quay basin"], LinkOptions(paths=False))
    assert none.paths.count() == 0


def test_embedding_texts(engine, spark):
    q = spark.createDataFrame([(1, "mean depth of quays"), (2, "x" * 500 + "\n\nlong appendix about cranes"), (3, None)], "qid int, text string")
    p = [(r.qid, r.phrase) for r in E.question_phrases(q).collect()]
    assert (1, "mean depth") in p and (1, "quays") in p and not any("cranes" in x for _, x in p)
    text = {r.node: r.text for r in E.object_texts(engine.objects).collect()}
    assert text["c:public.crate.tonnes"] == "crate tonnes gross weight" and text["t:public.crate"] == "crate what was unloaded" and text["k:harbour fee"] == "harbour fee toll money"
    vectors = spark.createDataFrame([("1:000", 1, "mean depth", [1.0, 0.0])], "pid string, qid int, phrase string, vector array<double>"), spark.createDataFrame([("c:public.quay.depth_m", [1.0, 0.1])], "node string, vector array<double>")
    seeds = K.link(q.filter("qid = 1"), engine.objects, LinkOptions(vectors=vectors, fuzzy=False)).seeds.filter("node = 'c:public.quay.depth_m'").first()
    assert seeds.reasons[-1] == "embedding 'mean depth' (1.00)" and seeds.weight > 0.79


def test_lookups(engine):
    assert engine.join_path("quay", "ware") == [["public.quay", "public.landing", "public.crate", "public.ware"]]
    with pytest.raises(KeyError):
        engine.join_path("quay", "nothing")
    assert engine.stats()["tables"] == 7 and engine.relations("public.landing", "public.vessel").count() == 1
    assert engine.glossary().first().term == "harbour fee"
    assert engine.find_table("PUBLIC.Quay") == engine.find_table("quay") == "public.quay"


def test_exact_name_before_endings(spark):
    """A table found by its full name, however many others end with it."""
    e = Engine(spark)
    payload = lambda s, names: {"source": s, "source_type": "ddl", "tables": [{"name": n.split(".")[-1], "schema": ".".join(n.split(".")[:-1]) or None, "columns": [{"name": "id"}]} for n in names], "edges": [], "terms": []}
    e.payloads["p"] = payload("p", ["a.pier", "b.pier", "c.pier", "pier", "d.mole"])
    assert e.find_table("pier") == "pier" and e.find_table("a.pier") == "a.pier" and e.find_table("mole") == "d.mole" and e.find_table("crane") is None


def test_pagerank(spark, engine):
    """Against the solution of the linear system, in one task and by joins."""
    o = engine.objects
    edges = R.graph_edges(o, L.postings(o)).cache()
    seeds = spark.createDataFrame([(1, "t:public.tug_job", 2.0), (1, "t:public.tide_log", 1.0), (2, "c:public.landing.dues", 1.0), (3, "t:elsewhere", 1.0)], "qid int, node string, weight double")
    rows = edges.collect()
    nodes = sorted({r.u for r in rows} | {r.v for r in rows})
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        w[at[r.u], at[r.v]] += r.weight
        w[at[r.v], at[r.u]] += r.weight
    p = w / w.sum(axis=1, keepdims=True)
    for limit in (R.LOCAL_EDGES, 0):
        got = {(r.qid, r.node): r.score for r in R.pagerank(edges, seeds, local_edges=limit).collect()}
        assert abs(got[3, "t:elsewhere"] - 1) < 1e-9
        for q in (1, 2):
            t = np.zeros(len(nodes))
            for s in seeds.filter(f"qid = {q}").collect():
                t[at[s.node]] += s.weight
            t /= t.sum()
            want = np.linalg.solve(np.eye(len(nodes)) - R.ALPHA * p.T, (1 - R.ALPHA) * t)
            assert max(abs(want[i] - got.get((q, n), 0)) for n, i in at.items()) < 1e-9
        by = R.table_walk(R.transition(edges), seeds, o.columns, local_edges=limit)
        assert {(r.qid, r.node): round(r.score, 9) for r in R.node_scores(by).collect()} == {k: round(v, 9) for k, v in got.items() if k[1][0] in "tc"}
        plain = R.table_scores(R.pagerank(edges, seeds), o.columns)
        assert {(r.qid, r.table_key): round(r.score, 9) for r in by.collect()} == {(r.qid, r.table_key): round(r.score, 9) for r in plain.collect()}


def test_walk_of_a_mixed_graph():
    """Teleports in several parts and on nodes without edges, hubs with many edges: as the plain iteration has it."""
    rnd = np.random.default_rng(1)
    u, v = np.r_[np.zeros(700, int), rnd.integers(1, 600, 900)], np.r_[np.arange(1, 701), rnd.integers(600, 800, 900)]
    src, dst = np.r_[u, v], np.r_[v, u]
    n = 810
    w = rnd.random(len(u)).repeat(1)
    w = np.r_[w, w]
    p = w / np.bincount(src, w, n)[src]
    start = np.zeros((n, 3))
    start[[3, 805], 0], start[809, 1], start[[0, 5, 700], 2] = (0.5, 0.5), 1, 1 / 3
    got = R.walk(R._layers(src, dst, p, 100), start, n)
    x, dangling = start.copy(), np.bincount(src, minlength=n) == 0
    for _ in range(400):
        y = np.zeros_like(x)
        np.add.at(y, dst, x[src] * p[:, None])
        x = R.ALPHA * (y + start * x[dangling].sum(axis=0)) + (1 - R.ALPHA) * start
    assert np.abs(got - x).max() < 1e-9 and ((got > 0) == (x > 0)).all()


def test_components_both_ways(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z")]
    df = spark.createDataFrame(pairs, "u string, v string")
    nodes = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p} | {"alone"})], "node string")
    a, b = ({tuple(r) for r in M.components(df, nodes, limit).collect()} for limit in (M.LOCAL_PAIRS, 0))
    assert a == b and ("n30", "n0") in a and ("y", "x") in a and ("alone", "alone") in a and len(a) == 35


def test_join_paths_both_ways(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "e", 2.5), ("d", "e", 1.0), ("x", "y", 1.0)], "u string, v string, weight double")
    lineage = spark.createDataFrame([("y", "a", 1.6)], "u string, v string, weight double")
    ranked = spark.createDataFrame([(q, t, 1.0 / (i + 1), i + 1, i < 3) for q in range(5) for i, t in enumerate(["a", "d", "xy"[q % 2], "c"])], "qid int, table_key string, evidence double, pos int, anchor boolean")
    for more in (None, lineage):
        a, b = ({(r.qid, tuple(r.tables), r.reliability, r.place) for r in P.join_paths(pairs, ranked, fallback=more, local_pairs=limit).collect()} for limit in (P.LOCAL_PAIRS, 0))
        assert a == b and any({"a", "b", "c", "d"} <= set(t) for _, t, _, _ in a)
        assert any("x" in t or "y" in t for _, t, _, _ in a) == (more is not None)


def test_paths():
    g = P.neighbours([("a", "b", 1), ("b", "c", 1), ("a", "d", 1), ("d", "c", 1), ("a", "c", 2.5), ("x", "y", 1)])
    assert P.shortest_paths(g, "a", "c") == [["a", "b", "c"], ["a", "d", "c"]] and P.shortest_paths(g, "a", "c", extra=0.5)[-1] == ["a", "c"]
    assert P.shortest_paths(g, "a", "x") == [] and P.shortest_paths(g, "a", "zz") == []
    chain = P.neighbours([(str(i), str(i + 1), 1) for i in range(9)])
    assert len(P.shortest_paths(chain, "0", "9")[0]) == 10  # the best stays even beyond the cutoff
    assert P.maximal([["a", "b"], ["c", "b", "a"], ["x"]]) == [["c", "b", "a"], ["x"]]
    got = P.flow(chain, {"0", "1", "2"}, ["0"], {})
    assert got["0"] == 1 and abs(got["1"] - 0.8) < 1e-9 and abs(got["2"] - 0.64) < 1e-9


def test_merge_order_and_stubs(spark):
    e = Engine(spark)
    e.add("ddl", "b", text="create table t (id int, x varchar); comment on table t is 'from b'", priority=5)
    e.add("ddl", "a", text="create table t (id bigint primary key, y int, g_id int references gone(id)); comment on table t is 'from a'")
    row = e.tables().first()
    assert row.description == "from b" and row.source == "b,a"
    cols = {r.col: (r.data_type, r.is_primary_key) for r in e.objects.columns.collect()}
    assert cols["id"] == ("INT", True) and set(cols) == {"id", "x", "y", "g_id"}
    assert e.stats()["stubs"] == 1
    e.remove("b")
    assert e.tables().first().description == "from a"


def test_inferred(spark):
    e = Engine(spark)
    e.add("ddl", "s", infer=True, text="create table orders (order_id int primary key, customer_id int, id int); create table customers (id int primary key, name text); create table order_items (order_id int, product_id int); create table products (product_id int primary key); create table other.unrelated (customer_id int)")
    got = {(x["from_table"], x["from_columns"][0], x["to_table"], x["to_columns"][0]) for x in e.payloads["s"]["edges"]}
    assert got == {("public.orders", "customer_id", "public.customers", "id"), ("public.order_items", "order_id", "public.orders", "order_id"), ("public.order_items", "product_id", "public.products", "product_id")}


def test_fuzzy_prefilter_is_lossless():
    """Two words of five letters or more above the cutoff share a pair of letters."""
    words = ["customer", "custmer", "order", "ordre", "carrier", "career", "status", "statue", "address", "adress", "abcde", "badce"]
    for a in words:
        for b in words:
            if difflib.SequenceMatcher(None, a, b).ratio() >= 0.86:
                assert {a[i : i + 2] for i in range(len(a) - 1)} & {b[i : i + 2] for i in range(len(b) - 1)}


def test_selection(spark):
    picks = spark.createDataFrame([("t", 1, 2, 0.9), ("t", 2, 1, 0.3), ("t", 1, 3, 0.4), ("t", 3, 1, 0.6), ("t", 2, 3, 0.5), ("t", 3, 2, 0.5)], "task string, a int, b int, p double")
    wins = {r.told: round(r.wins, 6) for r in C.preferences(picks).collect()}
    assert wins == {1: 1.2, 2: 0.7, 3: 1.1}
    c = spark.createDataFrame([("t", 1, 0.9, "r"), ("t", 2, 0.95, "q"), ("t", 3, 0.9, "q"), ("t", 4, float("nan"), "z"), ("t", 5, None, "z")], "task string, told int, score double, res string")
    reps = C.representatives(c, ["task"], "score", "told", F.col("res"), F.lit(True))
    assert {(r.told, r.votes, r.place) for r in reps.collect()} == {(2, 2, 1), (1, 1, 2)}
    assert C.select_final(reps, ["task"], "score", "told").first().told == 2
    assert C.select_final(reps, ["task"], "score", "told", C.preferences(picks)).first().told == 1
    assert C.average_ranks_auroc(c.withColumn("ok", F.col("told") < 3), ["task"], "score", "ok").first().auroc == 0.75


def test_snapshot_feed(spark, tmp_path):
    rows = [(1, "s", "2030-01-01 00:00:00", "a"), (2, "s", "2030-01-03 00:00:00", "b"), (3, "t", "2030-01-02 00:00:00", "c")]
    df = spark.createDataFrame(rows, "snap_id long, source string, built_at string, payload string").withColumn("built_at", F.to_timestamp("built_at"))
    src = f"{tmp_path}/in"
    df.filter("snap_id <> 1").write.parquet(src)
    run = lambda: feed.follow(spark, spark.readStream.schema(df.schema).parquet(src), f"{tmp_path}/out").awaitTermination(120)
    run()
    df.filter("snap_id = 1").write.mode("append").parquet(src)  # late: an older build changes nothing
    run()
    assert {(r.source, r.snap_id) for r in feed.current(spark, f"{tmp_path}/out").collect()} == {("s", 2), ("t", 3)}


def test_feed_counts(spark, tmp_path):
    """The counts that batches move on are those that a full count gives."""
    snap = lambda i, s, day, tables, edges: (i, s, f"2030-01-{day:02} 00:00:00", json.dumps({"tables": [{"name": t} for t in tables], "edges": [{"from_table": a, "to_table": b} for a, b in edges]}))
    rows = [snap(1, "s", 1, "ab", ["ab", "az"]), snap(2, "s", 3, "bc", ["by", "bc"]), snap(3, "t", 2, "a", ["ax"]), snap(4, "t", 4, "", []), snap(5, "u", 1, "y", ["yy"])]
    df = spark.createDataFrame(rows, "snap_id long, source string, built_at string, payload string").withColumn("built_at", F.to_timestamp("built_at"))
    none = spark.createDataFrame([], "id int, from_table string, to_table string, created_at timestamp")
    for n, ids in enumerate(([1, 3], [2], [1], [4, 5])):
        batch = df.filter(F.col("snap_id").isin(ids))
        for _ in range(2):  # a batch that is run again changes nothing
            feed.merge_into(spark, batch, str(tmp_path), n)
    whole = O.key_counts(*O.catalog_references(df, none))
    got = feed.counts(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in O.orphans_now(got).collect()} == set()
    assert {r.table_key: (r.n_refs, r.status) for r in O.catalog_orphans_now(df.filter("snap_id < 4"), none).collect()} == {"x": (1, "missing"), "y": (1, "missing")}


def test_saved_scoped_and_other_rankers(spark, tmp_path):
    e = Engine(spark)
    e.add("ddl", "one", text="create table orders (id int primary key, customer_id int references customer(id)); create table customer (id int primary key, colour text)", priority=3)
    e.add("ddl", "two", text="create table paint (id int primary key, colour text, customer_id int references customer(id))")
    e.add_term("hue", None, ["tint"], ["public.paint.colour"])
    e.save(str(tmp_path))
    f = Engine.load(spark, str(tmp_path))
    assert f.stats() == e.stats() and f.priorities == {"one": 3} and [r.term for r in f.glossary().collect()] == ["hue"]
    only = f.link(["colour of each customer, by tint"], LinkOptions(source="one"))
    assert {r.table_key for r in only.tables.collect()} <= {"public.orders", "public.customer"}
    for o in (LinkOptions(ranker="bm25", bm25="bm25+"), LinkOptions(ranker="ppr", schema_routing=0.3), LinkOptions(bm25="lucene", seed_sparse=True)):
        got = [r.table_key for r in f.link(["colour of each customer"], o).tables.orderBy(F.desc("score")).collect()]
        assert "public.customer" in got[:2]


def test_paths_from_every_table(spark):
    """All simple paths of up to CUTOFF hops, against plain search: a ring of eight with a chord and a part of its own."""
    ring = [(f"t{i}", f"t{(i + 1) % 8}", 1.0 + i / 8) for i in range(8)] + [("t0", "t4", 2.5), ("x", "y", 1.3)]
    g = P.neighbours(ring)
    want, todo = {}, [((n,), 0.0) for n in g]
    while todo:
        path, cost = todo.pop()
        for v, w in g[path[-1]].items():
            if v not in path and len(path) <= P.CUTOFF:
                want[*path, v] = cost + w
                todo.append(((*path, v), cost + w))
    rows = P.paths_within(spark.createDataFrame(ring, "u string, v string, weight double")).collect()
    got = {tuple(r.path): r.cost for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[p] - c) < 1e-9 for p, c in want.items())
    assert max(map(len, got)) == P.CUTOFF + 1 and {p[0] for p in got} == set(g)
