import json
import random
from datetime import datetime, timedelta

from catalith.functions.names import table_key
from catalith.operators import rangescan
from catalith.operators.orphans import catalog_orphans
from pyspark.sql import functions as F

T0 = datetime(2030, 1, 1)


def at(n):
    return T0 + timedelta(days=n)


def snap(i, source, day, tables, edges=()):
    return (i, source, json.dumps({"tables": [{"name": t} for t in tables], "edges": [{"from_table": a, "to_table": b} for a, b in edges]}), at(day), "x")


SNAPS = "snap_id long, source string, payload string, built_at timestamp, status string"
HINTS = "id int, from_table string, to_table string, created_at timestamp"


def brute(snaps, hints):
    """(ref_table, ref_id, pos, side, status) by walking all builds for each reference."""
    builds = sorted({(s[1] or "", s[3], s[0], s[2]) for s in snaps if s[3]})
    body = lambda p: json.loads(p)
    refs = {("join_hints", h[0], 0, side, n, h[3]) for h in hints for side, n in (("from", h[1]), ("to", h[2]))}
    for _, t, i, p in builds:
        for k, e in enumerate(body(p)["edges"]):
            refs |= {("snapshots", i, k, "from", e["from_table"], t), ("snapshots", i, k, "to", e["to_table"], t)}
    out = set()
    for rt, rid, pos, side, name, t in refs:
        key = table_key(name)
        if key is None or t is None:
            continue
        lists = [(b[1], key in {table_key(x["name"]) for x in body(b[3])["tables"]}) for b in builds]
        latest = {}
        for b in builds:
            if b[1] <= t:
                latest[b[0]] = key in {table_key(x["name"]) for x in body(b[3])["tables"]}
        if not any(latest.values()):
            status = "deleted" if any(y and u <= t for u, y in lists) else "late" if any(y for _, y in lists) else "missing"
            out.add((rt, rid, pos, side, status))
    return out


def test_random_histories(spark):
    rnd = random.Random(5)
    names = ["a.b", " A.B", '"c"', "d", "", "  ", "e..f"]
    snaps = [snap(i, rnd.choice(["s1", "s2", None]), rnd.randrange(12), rnd.sample(names, 3), [(rnd.choice(names), rnd.choice(names)) for _ in range(2)]) for i in range(40)]
    snaps += snaps[:5]
    hints = [(i, rnd.choice(names), rnd.choice([*names, "z"]), at(rnd.randrange(-2, 14))) for i in range(60)] + [(99, None, "a.b", None)]
    got = catalog_orphans(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame([*hints, *hints[:7]], HINTS)).collect()
    rows = [(r.ref_table, r.ref_id, r.pos, r.side, r.status) for r in got]
    assert set(rows) == brute(snaps, hints) and len(rows) == len(set(rows))
    assert {r.ym for r in got} <= {"2029-12", "2030-01"}


def test_cut_payload_replaces_the_build_before(spark):
    snaps = [snap(1, "s", 0, ["a"]), (2, "s", '{"tables": [', at(2), "x"), (3, "t", None, at(3), "x")]
    hints = [(1, "a", "a", at(1)), (2, "a", "b", at(2))]
    got = {(r.ref_id, r.side, r.status) for r in catalog_orphans(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(hints, HINTS)).collect()}
    assert got == {(2, "from", "deleted"), (2, "to", "missing")}


def test_empty(spark):
    assert catalog_orphans(spark.createDataFrame([], SNAPS), spark.createDataFrame([], HINTS)).count() == 0


def test_scan_against_brute_force(spark):
    """One group holds most rows, groups cross partitions, values and keys are null."""
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.choice([None, 1, 2, -3]), rnd.choice([None, "x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, n int, s string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = rangescan.range_scan(df, ["g"], [F.col("i")], {"no": ("row_number", None), "sum": ("sum", "n"), "last": ("last", "s"), "before": ("prev_last", "s"), "lag": ("lag", "s")}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, want = {}, {}
    for g, i, n, s in rows:
        no, total, last, lag = state.get(g, (0, 0, None, None))
        want[i] = (no + 1, total + (n or 0), s if s is not None else last, last, lag)
        state[g] = (no + 1, total + (n or 0), s if s is not None else last, s)
    assert {r.i: (r.no, r["sum"], r["last"], r.before, r.lag) for r in got} == want
