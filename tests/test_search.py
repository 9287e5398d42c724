import pytest

from catalith.engine import Engine
from catalith.operators.embedding import embedding_seeds, nearest
from catalith.plans.search import Search, SearchOptions
from catalith import tools


def scripted(scores):
    it = iter(scores)

    def draft(parent, action):
        return f"select {parent.id if parent else 'root'} /* {action} */"

    def score(sql):
        s = next(it)
        if isinstance(s, Exception):
            raise s
        return s, f"r{s}", ["unknown_table x"] if s < 0.3 else []

    return draft, score


def test_strategies():
    assert len(Search(*scripted([0.5]), SearchOptions("single")).run()) == 1
    best = Search(*scripted([0.1, ValueError("slow"), 0.3, 0.4]), SearchOptions("best_of_n", budget=4)).run()
    assert [n.action for n in best] == ["tight", "wide", "tight", "wide"] and best[1].score == 0 and best[1].findings == ["slow"]
    chain = Search(*scripted([0.2, 0.5, 0.95, 1.0]), SearchOptions("refine", budget=4)).run()
    assert [(n.parent, n.action) for n in chain] == [(None, "wide"), (0, "wide"), (1, "tight")]
    tree = Search(*scripted([0.3, 0.8, 0.5, 0.7, 0.6, 0.4, 0.2, 0.8]), SearchOptions("abmcts", budget=8, seed=1)).run()
    assert len(tree) == 8 and all(n.parent is None or n.depth == tree[n.parent].depth + 1 for n in tree) and any(n.parent is not None for n in tree)


def test_early_stop_needs_different_texts():
    same = Search(lambda p, a: "select 1", lambda s: (0.95, "r", []), SearchOptions("best_of_n", budget=6, min_nodes=2))
    assert len(same.run()) == 6
    texts = iter(["select 1", "select  1", "select 2", "select 3"])
    assert len(Search(lambda p, a: next(texts), lambda s: (0.95, "r", []), SearchOptions("best_of_n", budget=4, min_nodes=2)).run()) == 3


def test_nearest(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(90, None), (91, []), (92, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {}
    for block in (3, 1000):
        for r in nearest(df.filter("id % 20 = 0"), df.repartition(5), "id", "id", "v", 4, block=block).collect():
            got.setdefault((block, r.qid), []).append((r.place, r.oid))
    assert got[3, 20] == got[1000, 20] and sorted(got[3, 20])[0][1] == 20
    assert nearest(df.limit(0), df, "id", "id", "v").count() == 0
    seeds = embedding_seeds(spark.createDataFrame([(1, 9, "x", [1.0, 0.0]), (2, 9, "y", [0.9, 0.1]), (3, 9, "z", [1.0, 0.0, 0.0])], "pid int, qid int, phrase string, vector array<double>"), spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0])], "node string, vector array<double>"))
    assert sorted((r.qid, r.node, r.weight, r.reason[:13]) for r in seeds.collect()) == [(9, "a", 0.8, "embedding 'x'"), (9, "c", 0.8, "embedding 'z'")]  # each against those of its length


def test_tools(spark):
    e = Engine(spark)
    e.add("ddl", "s", text="create table a (id int primary key, b_id int references b(id)); create table b (id int primary key, colour varchar); create table lone (x int)")
    assert [t["table"] for t in tools.search_tables(e, "COLOUR")] == ["public.b"]
    assert tools.get_table(e, "a")["relations"][0]["on"] == ["b_id=id"] and "error" in tools.get_table(e, "zz")
    assert tools.find_join_path(e, "a", "b")["paths"][0]["steps"] == [["foreign_key"]] and tools.find_join_path(e, "a", "lone") == {"paths": []} and "error" in tools.find_join_path(e, "a", "q")
    assert {t["table"] for t in tools.link_schema_json(e, "colour of each b", 2)["tables"]} >= {"public.b"}
    assert tools.graph_stats(e)["tables"] == 3 and tools.list_glossary(e) == []
    with pytest.raises(SystemExit):
        tools.main(["nothing"])
