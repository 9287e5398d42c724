import random

from catalith.operators.hierarchy import descendants, hierarchy

COLS = "run string, q string, id string, parent string, n long, depth int, path string"


def brute(rows):
    trees = {}
    for run, q, i, p, n, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] and r[2].strip()), key=lambda r: r[4]):
        trees.setdefault((run, q), {})[i.strip().lower()] = (p or "").strip().lower() or None
    out = set()
    for key, t in trees.items():
        for i in t:
            way, v, loop = [i], i, None
            while t[v] in t:
                v = t[v]
                if v in way:
                    loop = way[way.index(v) :]
                    break
                way.append(v)
            below = 0
            for j in t:
                v, seen = j, set()
                while j != i and t[v] in t and t[v] not in seen:
                    v = t[v]
                    seen.add(v)
                    if v == i:
                        below += 1
                        break
            if loop:
                out.add((*key, i, "", -1 if i in loop else -2, "", below))
            else:
                out.add((*key, i, way[-1], len(way) - 1, "/".join(reversed(way)), below))
    return out


def ranges(rows):
    """A node's range holds just the nodes whose paths go on from its own; others have none."""
    trees = {}
    for r in rows:
        trees.setdefault((r.run, r.q), []).append(r)
    for t in trees.values():
        good = [r for r in t if r.node_depth >= 0]
        assert sorted(r.first for r in good) == list(range(len(good))) and all(r.first is None and r.last is None for r in t if r.node_depth < 0)
        for a in good:
            assert {b.id for b in good if a.first < b.first <= a.last} == {b.id for b in good if b.path.startswith(a.path + "/")}


def test_random_forests(spark):
    rnd = random.Random(8)
    rows = []
    for tree in range(12):
        size = rnd.choice([1, 2, 5, 30])
        for n in range(size):
            parent = rnd.choice([None, "", " ", f"n{rnd.randrange(size)}", f" N{rnd.randrange(size)} ", f"n{max(0, n - 1)}", "gone"])
            rows.append((f"r{tree % 3}", f"q{tree}", rnd.choice([f"n{n}", f"N{n} "]), parent, len(rows), 7, "x"))
    rows += [(f"r{t % 3}", f"q{t}", "n0", rnd.choice([None, "n1"]), 1000 + t, 0, "x") for t in range(6)]
    rows += [rows[3], (None, "q", "a", None, 1, 0, "x"), ("r", None, "a", None, 1, 0, "x"), ("r", "q", None, None, 1, 0, "x"), ("r", "q", " ", None, 1, 0, "x"), ("r", "q", "self", "self", 1, 0, "x"), ("r", "q", "kid", "self", 1, 0, "x")]
    rows += [("deep", "q", f"d{i}", f"d{i - 1}" if i else None, i, 0, "x") for i in range(400)]
    df = spark.createDataFrame(rows, COLS)
    want = brute(rows)
    h = hierarchy(df, ["run", "q"], "id", "parent", "n").cache()
    got = [tuple(r)[:7] for r in h.collect()]
    assert set(got) == want and len(got) == len(want)
    ranges(h.collect())


def test_large_trees_by_joins(spark):
    rnd = random.Random(2)
    rows = [("r", "q", f"n{i}", None if i == 0 else f"n{rnd.randrange(max(0, i - 4), i)}", i, 0, "x") for i in range(30)]
    rows += [("r", "q", "l1", "l3", 50, 0, "x"), ("r", "q", "l2", "l1", 51, 0, "x"), ("r", "q", "l3", "l2", 52, 0, "x"), ("r", "q", "u", "l2", 53, 0, "x"), ("r", "q", "v", "u", 54, 0, "x"), ("s", "q", "a", None, 1, 0, "x")]
    df = spark.createDataFrame(rows, COLS)
    h = hierarchy(df, ["run", "q"], "id", "parent", "n", local_nodes=5).cache()
    assert {tuple(r)[:7] for r in h.collect()} == brute(rows) and h.count() == len(rows)
    ranges(h.collect())
    assert {tuple(r) for r in h.collect()} == {tuple(r) for r in hierarchy(df, ["run", "q"], "id", "parent", "n").collect()}
    asked = spark.createDataFrame([("r", "q", "n0"), ("r", "q", "l1"), ("s", "q", "a")], "run string, q string, id string")
    under = {(r.id, r.distance) for r in descendants(h, ["run", "q"], asked).collect()}
    assert under == {(r.id, r.node_depth) for r in h.collect() if r.node_depth > 0}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], COLS), ["run", "q"], "id", "parent", "n").count() == 0
