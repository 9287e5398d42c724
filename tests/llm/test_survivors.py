import itertools
import json
import random

from pyspark.sql import functions as F

from catalith.llm.survivors import branch_and_bound, survivors


def brute(rows, bundles, fds, weights):
    """The best total over all choices for one key; rows: dicts with ``t`` (trust, small is best)."""
    options = []
    for b in bundles:
        best = {}
        for r in rows:
            v = tuple(r[f] for f in b)
            empty = sum(x is None for x in v)
            if empty < len(b):
                o = (empty, r["t"], r["src"])
                best[v] = min(best.get(v, o), o)
        options.append([v for v, _ in sorted(best.items(), key=lambda x: (x[1], json.dumps(x[0])))])
    top = -1
    for pick in itertools.product(*[[None, *range(len(o))] for o in options]):
        chosen = {f: None if p is None else options[i][p][bundles[i].index(f)] for i, p in enumerate(pick) for f in bundles[i]}
        ok = all(chosen[x] is None or chosen[y] is None or any(r[x] == chosen[x] and r[y] == chosen[y] for r in rows) for x, y in fds)
        if ok:
            top = max(top, sum(w / (p + 1) for w, p in zip(weights, pick) if p is not None))
    return top, options


def test_search_is_exact(spark):
    rnd = random.Random(2)
    bundles, fds, weights = [["a", "b"], ["c"], ["d"]], [("a", "c"), ("d", "b")], [1.0, 0.7, 0.5]
    rows = []
    for k in range(25):
        for t in range(rnd.choice([1, 3, 9])):
            pick = lambda: rnd.choice([None, "x", "y", "z", "w", " N/A"])
            rows.append((f"k{k}", f"s{t}", t, pick(), pick(), pick(), pick(), "clash"))
    df = spark.createDataFrame([*rows, *rows[:9], (None, "s", 0, "x", "x", "x", "x", "")], "key string, src string, t int, a string, b string, c string, d string, k string")
    for depth in (1, 2, 20):
        got = {}
        for r in survivors(df, "key", "src", [F.col("t")], bundles, fds, weights, depth).collect():
            got.setdefault(r.key, {})[r.field] = r.value
        for key, group in itertools.groupby(rows, key=lambda r: r[0]):
            clean = [dict(zip(("src", "t", "a", "b", "c", "d"), (r[1], r[2], *[None if v in (None, " N/A") else v for v in r[3:7]]))) for r in group]
            top, options = brute(clean, bundles, fds, weights)
            mine = got.get(key, {})
            total = 0
            for i, b in enumerate(bundles):
                v = tuple(mine.get(f) for f in b)
                if any(x is not None for x in v):
                    total += weights[i] / (options[i].index(v) + 1)
            assert abs(total - top) < 1e-9, (depth, key)
            assert all(mine.get(x) is None or mine.get(y) is None or any(r[x] == mine[x] and r[y] == mine[y] for r in clean) for x, y in fds)


def test_bound_and_ties():
    assert branch_and_bound([2, 2], [1, 1], lambda b, p, picks: b == 0 or p != picks[0]) == (1.5, [0, 1])
    assert branch_and_bound([0, 1], [1, 1], lambda *a: True) == (1.0, [None, 0])


def test_fields_of_their_own_and_empty(spark):
    df = spark.createDataFrame([("k", "b", 1, "TBD", None), ("k", "a", 1, "v", "?"), ("k", "c", 0, None, "w"), ("q", "a", 1, "-", "")], "key string, src string, t int, x string, y string")
    got = {tuple(r) for r in survivors(df, "key", "src", [F.col("t"), F.col("src")], [["x"], ["y"]]).collect()}
    assert got == {("k", "x", "v", "a"), ("k", "y", "w", "c")}
    assert survivors(df.limit(0), "key", "src", [F.col("t")], [["x"], ["y"]]).count() == 0
    assert survivors(df.limit(0), "key", "src", [F.col("t")], [["x"], ["y"]], [("x", "y")]).count() == 0
