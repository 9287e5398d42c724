import random

from catalith.operators import evaluation as EV
from catalith.plans.execution import infer_kind, same_table
from pyspark.sql import functions as F


def test_link_scores(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, "z"), (4, None)], "qid int, name string")
    linked = spark.createDataFrame([(1, "a", True), (1, "x", False), (1, "b", False), (2, "a", True), (5, "q", True)], "qid int, name string, anchor boolean")
    ranking = spark.createDataFrame([(1, "a", 1), (1, "a", 9), (1, "b", 12), (2, "a", 1)], "qid int, name string, pos int")
    r = {x.qid: x for x in EV.link_scores(gold, linked, ranking).collect()}
    assert set(r) == {1, 2, 3}
    assert (r[1].n_gold, r[1].n_pred, r[1].hit, r[1].recall, r[1].strict, r[1].anchor_hit, r[1].n_bridge, r[1].bridge_recovered, r[1].missed) == (2, 3, 2, 1.0, 1, 0, 1, 1, "")
    assert (r[1].max_gold_rank, r[1].gold_in_top10, r[1].gold_in_top20) == (12, 0, 1)
    assert (r[2].hit, r[2].missed, r[2].max_gold_rank, r[2].gold_in_top20) == (0, "c", None, 0) and r[3].n_pred == 0 and r[3].precision == 0
    s = EV.summarize(EV.link_scores(gold, linked, ranking), F.array(F.lit("all")), ["strict"], ["max_gold_rank"]).first()
    assert (s.n, s.strict, s.max_gold_rank) == (3, 33.3333, 12.0)
    assert EV.link_scores(gold.limit(0), linked, ranking).count() == 0


def test_names_and_columns(spark):
    names = spark.createDataFrame([(" Log_20240131 ",), ("m1",), ("s.Ev_2019",)], "name string")
    members = spark.createDataFrame([("M1", "m_*")], "member string, family string")
    assert [r.name for r in EV.canon(names, "name", members).collect()] == ["log_*", "m_*", "s.ev_*"]
    known = spark.createDataFrame([("c.s.t",), ("d.s.t",), ("c.s.u",), ("only",)], "table_key string")
    gold = spark.createDataFrame([("c.s.t",), ("s.u",), ("x.s.u",), ("t",), ("s.t",), ("u",), ("only",), ("none",)], "name string")
    assert {r.name: r.table_key for r in EV.resolved(gold, known).collect()} == {"c.s.t": "c.s.t", "s.u": "c.s.u", "x.s.u": "c.s.u", "t": None, "s.t": None, "u": "c.s.u", "only": "only", "none": None}
    g = spark.createDataFrame([(1, "s.t", "A"), (1, "s.t", "b")], "qid int, name string, col string")
    r = EV.column_scores(g, spark.createDataFrame([(1, "s.t", "a"), (1, "s.t", "c"), (2, "s.t", "a")], "qid int, name string, col string")).collect()
    assert len(r) == 1 and (r[0].col_hit, r[0].col_recall, r[0].col_precision, r[0].col_strict, r[0].missed_cols) == (1, 0.5, 0.5, 0, "t.b")


def test_results_against_the_plain_comparison(spark):
    rnd = random.Random(6)
    pools = [["1", "2", "3", ""], ["1.5", "1.504", "2", "nan"], ["a", "b", "NULL", "a "], ["True", "false", "True"], ["1_0", "2"]]
    pred, gold, want, tasks = [], [], {}, 250
    for t in range(tasks):
        n = rnd.choice([0, 1, 3])
        table = [[rnd.choice(pool) for _ in range(n)] for pool in rnd.choices(pools, k=3)]
        own = [c[:] for c in table]
        rnd.shuffle(own)
        if rnd.random() < 0.4 and n:
            own[0][0] = rnd.choice(rnd.choice(pools))
        if rnd.random() < 0.2 and n:
            own = [c[:-1] for c in own]

        def typed(col):
            kind = infer_kind(col)
            some = lambda c: None if kind != "object" and infer_kind([c]) == "na" or infer_kind([c]) == "na" else c
            cast = {"int": float, "float": float, "na": lambda v: 0.0, "bool": lambda v: v.capitalize(), "object": lambda v: v.capitalize() if set(filter(None, map(some, col))) <= {"True", "false"} else v}[kind]
            return [0 if some(c) is None else cast(c) for c in col]

        for rows, cols in ((pred, own), (gold, table)):
            rows += [(t, i, k, v) if rows is pred else (t, 0, i, k, v) for k, c in enumerate(cols) for i, v in enumerate(c)]
        if n:
            want[t] = same_table({str(k): typed(c) for k, c in enumerate(own)}, {str(k): typed(c) for k, c in enumerate(table)})
    p = spark.createDataFrame(pred, "task int, row int, col int, value string")
    g = spark.createDataFrame(gold, "task int, gold_no int, row int, col int, value string")
    got = {r.task: r.same for r in EV.compare_results(p, g).collect()}
    assert got == want and 20 < sum(want.values()) < len(want)
    one = spark.createDataFrame([(t, 1) for t in range(tasks)], "task int, col int")
    some = EV.compare_results(p, g, wanted=one).collect()
    assert all(r.n_gold_cols == 1 for r in some) and all(r.same for r in some if want[r.task])
    assert EV.any_gold(EV.compare_results(p, g.unionByName(g.filter("col = 0").withColumn("gold_no", F.lit(1))))).filter("right").count() >= sum(want.values())


def test_order_of_rows(spark):
    p = spark.createDataFrame([(t, i, 0, v) for t in (1, 2) for i, v in enumerate(["b", "a"])], "task int, row int, col int, value string")
    g = spark.createDataFrame([(t, 0, i, 0, v) for t in (1, 2) for i, v in enumerate(["a", "b"])], "task int, gold_no int, row int, col int, value string")
    assert {r.task: r.same for r in EV.compare_results(p, g, ignore_order=spark.createDataFrame([(2,)], "task int")).collect()} == {1: False, 2: True}
