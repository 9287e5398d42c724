"""What the driver holds of a graph or of related pairs: arrays, whatever the names look like, and no Python object for each row."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from catalith.operators import paths as P
from catalith.operators import ranking as R


def _never(*_):
    raise AssertionError("rows came to the driver as Python objects")


def test_graph_passes_the_driver_as_arrays(spark, monkeypatch):
    """One long name must not widen all others, and a seed outside the graph or under a column with a dot keeps its table."""
    long = "t:" + "x" * 20_000
    rows = [("t:hub", f"c:hub.c{i:04}", 0.5) for i in range(1500)] + [("t:hub", long, 1.0), ("t:hub", "c:hub.a.b", 0.5)]
    edges = R.store(spark.createDataFrame(rows, "u string, v string, weight double"))
    seeds = spark.createDataFrame([(1, "t:hub", 1.0), (2, long, 1.0), (2, "c:gone.z", 1.0), (2, "k:gone", 1.0)], "qid int, node string, weight double")
    columns = R.store(spark.createDataFrame([(v, "hub", v[6:]) for _, v, _ in rows if v[0] == "c"], "node string, table_key string, col string"))
    step = R.store(R.transition(edges))
    monkeypatch.setattr(Classic, "toPandas", _never)
    tracemalloc.start()
    try:
        ranked, walked = R.pagerank(None, seeds, step=step), R.table_walk(step, seeds, columns)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()
    got = {(r.qid, r.node): r.score for r in ranked.collect()}
    assert all(abs(sum(s for (q, _), s in got.items() if q == n) - 1) < 1e-9 for n in (1, 2)) and len(got) == 2 * 1503 + 2
    by = {(r.qid, r.table_key): r for r in walked.collect()}
    assert set(by) == {(1, "hub"), (2, "hub"), (1, long[2:]), (2, long[2:]), (2, "gone")}
    assert {c.col for c in by[1, "hub"].cols} == {v[6:] for _, v, _ in rows if v[0] == "c"} and [c.col for c in by[2, "gone"].cols] == ["z"]
    assert abs(by[2, "gone"].cols[0].score - got[2, "c:gone.z"]) < 1e-12 and abs(by[1, "hub"].own - got[1, "t:hub"]) < 1e-12


def test_names_are_found_by_parts():
    names = pa.array([f"n{i:03}" for i in range(100)])
    assert R._found(pa.array(["n000", "n099", "n", "n064", "n063"]), names, 64).tolist() == [0, 99, -1, 64, 63]


def test_pairs_pass_the_driver_as_arrays(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "d", 5.0), ("c", "d", 5.0)], "u string, v string, weight double")
    ranked = spark.createDataFrame([(1, "a", 1.0, 1, True), (1, "c", 0.5, 2, True)], "qid int, table_key string, evidence double, pos int, anchor boolean")
    with monkeypatch.context() as m:
        m.setattr(Classic, "collect", _never)
        out = P.join_paths(pairs, ranked)
    assert [(r.qid, r.tables) for r in out.collect()] == [(1, ["a", "b", "c"])]
    assert np.isfinite(out.first().reliability)


def test_graph_and_pairs_never_enter_the_driver(spark, monkeypatch):
    """The tasks read both from the shared folder; what a question reaches is the same as by joins, and only scores above ``least`` come out."""
    edges = R.store(spark.createDataFrame([("t:hub", f"c:hub.c{i:03}", 0.5 + i) for i in range(300)], "u string, v string, weight double"))
    seeds = spark.createDataFrame([(1, "t:hub", 1.0), (2, "c:hub.c001", 1.0), (2, "c:gone.z", 1.0)], "qid int, node string, weight double")
    columns = R.store(spark.createDataFrame([(f"c:hub.c{i:03}", "hub", f"c{i:03}") for i in range(300)], "node string, table_key string, col string"))
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "u string, v string, weight double")
    asked = spark.createDataFrame([(1, "a", 1.0, 1, True), (1, "c", 0.5, 2, True)], "qid int, table_key string, evidence double, pos int, anchor boolean")
    step = R.store(R.transition(edges))
    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas"):
            m.setattr(Classic, name, _never)
        m.setattr(type(spark.sparkContext), "broadcast", _never)
        ranked, high = R.pagerank(None, seeds, step=step), R.pagerank(None, seeds, step=step, least=1e-3)
        walked, paths = R.table_walk(step, seeds, columns), P.join_paths(pairs, asked)
    got = {(r.qid, r.node): r.score for r in ranked.collect()}
    by_joins = {(r.qid, r.node): r.score for r in R.pagerank(None, seeds, step=step, local_edges=0).collect()}
    assert got.keys() == by_joins.keys() and all(abs(got[k] - by_joins[k]) < 1e-9 for k in got)
    assert {(r.qid, r.node): r.score for r in high.collect()} == {k: v for k, v in got.items() if v > 1e-3} and min(got.values()) < 1e-3
    assert {(r.qid, r.table_key) for r in walked.collect()} == {(1, "hub"), (2, "hub"), (2, "gone")}
    assert [r.tables for r in paths.collect()] == [["a", "b", "c"]]


def test_a_question_stays_in_one_task(spark):
    """Where Spark finds a small side of a join only as it runs, it must not spread a question over tasks: each task would walk it again, from a part of its seeds."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "3k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "16k"}  # 3k: more than what is sent of the totals, less than Spark expects
    before = {k: spark.conf.get(k, None) for k in confs}
    step = R.store(R.transition(spark.createDataFrame([("t:hub", f"c:hub.c{i:03}", 0.5 + i) for i in range(200)], "u string, v string, weight double")))
    columns = R.store(spark.createDataFrame([(f"c:hub.c{i:03}", "hub", f"c{i:03}") for i in range(200)], "node string, table_key string, col string"))
    said = R.store(spark.createDataFrame([(q, f"c:hub.c{i:03}", 1.0 + q) for q in range(6) for i in range(200)], "qid int, node string, w double").repartition(8))
    spec = R.store(spark.createDataFrame([(f"c:hub.c{i:03}", 1.0 + i) for i in range(200)], "node string, spec double"))
    seeds = said.join(spec, "node").select("qid", "node", (F.col("w") * F.col("spec")).alias("weight"))
    pairs = spark.createDataFrame([(f"t{i}", f"t{i + 1}", 1.0) for i in range(9)], "u string, v string, weight double")
    asked = R.store(spark.createDataFrame([(q, f"t{i}", 1.0, i, i % 3 == 0 and i < 10) for q in range(6) for i in range(300)], "qid int, table_key string, evidence double, pos int, anchor boolean").repartition(8))
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        paths = P.join_paths(pairs, asked).collect()
        assert sorted((r.qid, r.tables) for r in paths) == [(q, [f"t{i}" for i in range(10)]) for q in range(6)]
        ranked = R.pagerank(None, seeds, step=step).collect()
        assert len(ranked) == len({(r.qid, r.node) for r in ranked}) == 6 * 201
        walked, scores = R.table_walk(step, seeds, columns).collect(), R.table_walk(step, seeds, columns, parts=False).collect()
        assert {(r.qid, r.table_key): r.score for r in walked} == {(r.qid, r.table_key): r.score for r in scores} and len(walked) == len(scores) == 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
