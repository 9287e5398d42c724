import json
from collections import defaultdict
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.operators import flooding
from catalith.operators.drift import GENERATOR, file_members, run_files, schema_changes, unite

T0 = datetime(2031, 1, 1)
FILES = "file_id long, series string, at timestamp, config string, extra string, extra_name string"


def plain(old, new):
    """The definition, read off directly."""
    a, b = flooding.members(old), flooding.members(new)
    gone, come = [p for p in a if p not in b], [p for p in b if p not in a]
    left, right = defaultdict(list), defaultdict(list)
    for paths, m, into in ((gone, a, left), (come, b, right)):
        for p in paths:
            if (k := flooding.value_key(m[p][1])) is not None:
                into[m[p][0], k].append(p)
    pairs = {(x[0], right[k][0]) for k, x in left.items() if len(x) == 1 and len(right.get(k, [])) == 1}
    out = {("renamed", *p) for p in pairs}
    out |= {("removed", p, "") for p in gone if p not in {x for x, _ in pairs}} | {("added", "", q) for q in come if q not in {y for _, y in pairs}}
    return out


scalars = st.none() | st.booleans() | st.integers(0, 3) | st.sampled_from(["x", "y", "1"]) | st.lists(st.sampled_from(["x", 1, None, True]), max_size=2)
configs = st.recursive(st.dictionaries(st.sampled_from("abcdefg"), scalars, max_size=5), lambda c: st.dictionaries(st.sampled_from("abcdefg"), c | scalars, max_size=5), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(configs, configs)
def test_renames_are_those_of_the_definition(old, new):
    assert set(flooding.changes(old, new)) == plain(old, new)


def test_as_many_correspondences_as_members():
    """However many members go and come under one holder, without an equal value or name among them."""
    for n in (31, 33, 40):
        old, new = flooding.members({f"old_{i}": i for i in range(n)}), flooding.members({f"fresh_{i}": f"v{i}" for i in range(n)})
        assert len(flooding.correspondences(old, new)) == n


def test_correspondences_follow_holders():
    old = flooding.members({"budget": {"max_nodes": 5, "sec": 9}, "m": "k"})
    new = flooding.members({"budgets": {"max_nodes": 5, "seconds": 9}, "m": "k"})
    assert flooding.correspondences(old, new) == {"m": "m", "budget": "budgets", "budget/max_nodes": "budgets/max_nodes", "budget/sec": "budgets/seconds"}


def files(spark, *configs, series="s", extras=None):
    rows = [(i + 1, series, T0 + timedelta(days=i), c, (extras or {}).get(i), "candidates.generator") for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, FILES)


def test_types_and_reappearance(spark):
    df = files(spark, '{"a": 1, "b": null}', '{"a": null, "b": 2}', '{"a": "x", "b": "y"}', '{"b": null}', '{"a": 3, "b": "z"}', '{"cut', None, '{"a": 3.5, "b": []}', "[]", extras={0: "text", 1: "list", 4: "object"})
    got = {tuple(r) for r in schema_changes(df).collect()}
    gen = "candidates.generator"
    assert got == {
        (3, "type", "a", "a"), (3, "type", "b", "b"), (4, "removed", "a", ""), (5, "added", "", "a"), (8, "type", "b", "b"), (9, "removed", "a", ""), (9, "removed", "b", ""),
        (2, "type", gen, gen), (3, "removed", gen, ""), (5, "added", "", gen), (8, "removed", gen, ""),
    }


def test_united_table(spark):
    df = files(spark, '{"n": 1, "o": {"x": "p"}}', '{"n": 2, "o": {"y": "p"}}', '{"n": 2.5, "o": {"y": ["q"]}}', "5")
    rows = {r.file_id: r.asDict() for r in unite(df).collect()}
    assert [rows[i]["n"] for i in (1, 2, 3, 4)] == [1.0, 2.0, 2.5, None]
    assert [rows[i]["o/y"] for i in (1, 2, 3)] == ['["p"]', '["p"]', '["q"]']
    assert "o/x" not in rows[1]
    case = unite(files(spark, '{"k": 1, "K": "x", "at": "y", "a.b": 5, "`q`": true}')).first().asDict()
    assert case["k~2"] == 1.0 and case["K"] == "x" and case["at~2"] == "y" and case["a.b"] == 5.0 and case["`q`"] is True


def test_flooding_decides_the_columns(spark):
    """No value is equal, so only names, types and neighbours can tell: the renamed holder takes its members along."""
    df = files(spark, '{"agent": {"gen_model": "m1", "steps": 4, "early": "0.5"}}', '{"agent_config": {"gen_models": ["m2", "m3"], "steps": 5, "early": 0.7}}', '{"agent_config": "{\\"gen_models\\": 7, \\"steps\\": 6}", "note": "[cut"}')
    rows = {r.file_id: r.asDict() for r in unite(df).collect()}
    head = lambda end: next(k for k in rows[1] if k.endswith(end))
    gen = head("gen_model") if any(k.endswith("gen_model") for k in rows[1]) else head("gen_models")
    assert [rows[i][gen] for i in (1, 2, 3)] == ['["m1"]', '["m2","m3"]', "[7]"]
    assert [rows[i][head("steps")] for i in (1, 2, 3)] == [4.0, 5.0, 6.0] and [rows[i][head("early")] for i in (1, 2, 3)] == [0.5, 0.7, None]
    assert rows[3]["note"] == "[cut" and len(rows[1]) == 4 + 4
    long = {(r.file_id, r.path): r.value for r in file_members(df).collect()}
    assert long[3, "agent_config/steps"] == "6" and len(long) == 9


def test_empty_and_repeated(spark):
    assert schema_changes(files(spark, "{}").filter("file_id < 0")).count() == 0
    assert unite(files(spark, "{}").filter("file_id < 0")).count() == 0
    run = "file_id long, run_id string, series string, written_at timestamp, received_at timestamp, config string"
    a = spark.createDataFrame([(1, "r1", None, T0, T0, "{}"), (1, "r1", None, T0, T0, "{}"), (2, "r2", None, T0 + timedelta(1), None, '{"k": 1}')], run)
    c = spark.createDataFrame([("r2", 5, '["m"]'), ("r2", 1, None), ("r1", 2, None), (None, 3, "m")], "run_id string, line_no long, generator string")
    got = {tuple(r) for r in schema_changes(run_files(a, a.limit(0), c)).collect()}
    assert got == {(2, "added", "", "k"), (2, "added", "", "candidates.generator")}


def test_linked_paths_in_one_file_lose_nothing(spark):
    """A rename in one series must not unite paths that stand side by side in a file of another."""
    run = [(1, "s", T0, '{"top": 7, "m": {"critic": "x"}}'), (2, "s", T0 + timedelta(1), '{"k": 7, "m": {"judge": "x"}}'), (3, "t", T0, '{"top": 1, "k": 2, "m": {"critic": "p", "judge": "q"}}'), (4, "t", T0 + timedelta(1), '{"k": null, "kk": "5"}')]
    run += [(5, "u", T0, '{"a": "z1"}'), (6, "u", T0 + timedelta(1), '{"b": "z1"}'), (7, "u", T0 + timedelta(2), '{"c": "z1"}'), (8, "v", T0, '{"a": "left", "c": "right"}')]
    df = spark.createDataFrame([(*r, None, "candidates.generator") for r in run], FILES)
    rows = {r.file_id: r.asDict() for r in unite(df).collect()}
    for file_id, _, _, config in run:
        want = sorted(str(float(v)) if isinstance(v, int) else v for at, v in flooding.members(json.loads(config)).values() if v is not None and not isinstance(v, dict))
        assert sorted(str(v) for k, v in rows[file_id].items() if v is not None and k not in ("file_id", "series", "at", "complete")) == want
    assert rows[3]["m/critic"] == "p" and rows[3]["m/judge"] == "q" and rows[3]["top"] == 1.0 and rows[3]["k"] == 2.0
    assert ("a" in rows[8]) + ("b" in rows[8]) + ("c" in rows[8]) == 2  # one of the two renames still unites


def test_all_runs_and_their_generators(spark):
    run = "file_id long, run_id string, series string, written_at timestamp, received_at timestamp, config string"
    a = spark.createDataFrame([(1, "r1", "s", T0, T0, '{"k": 1, "complete": "x"}'), (2, "r2", "s", T0 + timedelta(1), T0, '{"k": '), (3, "r3", "s", T0, T0, None), (4, "r4", "s", T0, T0, "{}")], run)
    c = spark.createDataFrame([("r1", 9, '["m", "n"]'), ("r1", 3, "n"), ("r1", 4, '{"b": 1, "a": [2]}'), ("r1", 5, '["cut'), ("r2", 1, '["m"]'), ("r4", 7, "[]")], "run_id string, line_no long, generator string")
    rows = {r.file_id: r.asDict() for r in unite(run_files(a, a.limit(0), c), GENERATOR).collect()}
    assert {i: r["complete"] for i, r in rows.items()} == {1: True, 2: False, 3: False, 4: True}
    got = {i: r["candidates.generator"] for i, r in rows.items()}
    assert json.loads(got[1]) == ["n", {"a": [2], "b": 1}, '["cut', "m"] and got[2] == '["m"]' and got[3] is None and got[4] == "[]"
    assert rows[1]["k"] == 1.0 and rows[1]["complete~2"] == "x" and rows[2]["k"] is None
