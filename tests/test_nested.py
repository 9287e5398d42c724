import json
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.functions.jsontext import Incomplete, _deep, opened, parse
from catalith.operators import nested


def brute(value):
    out = set()

    def walk(v, steps):
        v = opened(v)
        if isinstance(v, dict):
            for k, c in v.items():
                walk(c, [*steps, k])
        elif isinstance(v, list):
            for i, c in enumerate(v):
                walk(c, [*steps, str(i)])
        elif v is not None:
            out.add(("/".join(steps[:-1]), "/".join(steps)))

    walk(value, [])
    return out


def local(values, limit=nested.MAX_MEMBERS):
    top = nested.Node()
    for v in values:
        nested._observe(opened(v), top, "f", limit)
    sh = nested.Shredder(nested.inlining({"f": top}))
    out = []
    for v in values:
        got = []
        for r in sh.rows(opened(v), "f"):
            if r[2] is not None:  # the foreign key, slot and position give the path
                assert r[1] == nested._join(nested._join(r[3], r[4]), r[5])
            for rel, last, _, _ in r[6]:
                up = nested._join(r[3], r[4]) if rel is None else nested._join(r[1], rel[: len(rel) - last - 1] if len(rel) > last else None)
                got.append((up or "", nested._join(r[1], rel) or ""))
        out.append(got)
    return out


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "c/d", "", "é"]), c, max_size=4) | c.map(json.dumps), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, max_size=4), st.sampled_from([1, 2, 64]))
def test_every_scalar_once(vs, limit):
    for v, got in zip(vs, local(vs, limit)):
        assert set(got) == brute(v)
        assert len(got) == len(set(got))


names = st.recursive(st.none() | st.integers(), lambda c: st.lists(c, max_size=2) | st.dictionaries(st.sampled_from("abcdefgh"), c, max_size=6), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(names, min_size=1, max_size=6), st.sampled_from([1, 3, 5]), st.randoms())
def test_schema_does_not_depend_on_the_tasks(vs, limit, rnd):
    """One task, or any split of the values over tasks merged in any order, with objects at, below and above the limit of a map."""

    def graph(tasks):
        tops = []
        for t in tasks:
            tops.append(nested.Node())
            for v in t:
                nested._observe(v, tops[-1], "f", limit)
        whole = nested.Node()
        for t in tops:
            whole.merge(nested.Node.load(t.dump()), limit)
        return json.dumps(whole.dump(), sort_keys=True), nested.inlining({"f": whole}).names

    want = graph([vs])
    for _ in range(3):
        some = vs[:]
        rnd.shuffle(some)
        at = sorted(rnd.randrange(len(some) + 1) for _ in range(2))
        assert graph([some[: at[0]], some[at[0] : at[1]], some[at[1] :]]) == want


@settings(max_examples=200, deadline=None)
@given(values.map(json.dumps) | st.text(alphabet='{}[]",:1a \\n', max_size=12))
def test_deep_parser_agrees(text):
    def run(f):
        try:
            return f(text)
        except Incomplete:
            return "incomplete"
        except ValueError:
            return "incomplete"

    a, b = run(parse), run(_deep)
    assert a == b or a != a


def test_depth_is_no_limit():
    assert len(local([json.loads("[" * 900 + "1" + "]" * 900)])[0]) == 1
    v = parse("[" * 30000 + "7" + "]" * 30000)
    (got,) = local([v])[0]
    assert got[1].count("/") == 29999


def test_tables_and_links(spark, tmp_path):
    rows = [
        (1, '{"at": {"x": 1}, "list": [{"at": {"x": 2}, "n": null}, {"kids": [{"kids": []}, {"at": {"x": 3}}]}]}', "drop"),
        (2, '"{\\"at\\": {\\"x\\": 4}}"', "drop"), (3, '{"cut": ', None), (4, None, None), (5, "", None), (6, "[]", None), (7, "5", None), (8, "null", None),
    ]
    df = spark.createDataFrame(rows, "line_no long, doc string, `table` string")
    s = nested.shred(df, "line_no", ["doc"])
    got = {(r.line_no, r.parent_path, r.path, r.value) for r in s.values().collect()}
    assert got == {(1, "at", "at/x", "1"), (1, "list/0/at", "list/0/at/x", "2"), (1, "list/1/kids/1/at", "list/1/kids/1/at/x", "3"), (2, "at", "at/x", "4"), (7, "", "", "5")}
    assert "doc:at" in s.plan.names  # shared by three types
    at = {(r.line_no, r.row_path, r.parent_row_path, r["v:x"]) for r in s.table("doc:at").collect()}
    assert (1, "list/1/kids/1/at", "list/1/kids/1", "3") in at
    keys = {(r.line_no, r.row_path) for r in s.rows.collect()}
    assert all((r.line_no, r.parent_row_path) in keys for r in s.rows.collect() if r.parent_row_path is not None)
    links = {(r.table_name, r.parent_table): (r.n_rows, r.n_lost) for r in s.links().collect()}
    assert links == {k: (n, 0) for k, n in Counter((r["table"], r.parent_table) for r in s.rows.collect()).items()} and len(links) > 4
    once = s.kept()
    assert {r.parent_path for r in once.values().collect()} == {"", "at", "list/0/at", "list/1/kids/1/at"}
    once.write(f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/table=doc%3Aat").count() == 4
    assert nested.shred(df.filter("line_no < 0"), "line_no", ["doc"]).values().count() == 0
