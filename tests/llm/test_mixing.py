import random
from datetime import datetime

import numpy as np
import pytest

from catalith.llm import mixing
from catalith.llm.mixing import Targets, current_targets, fit_classifier, mix, mix_report, shares, solve_rates

DOCS = "doc_id long, text string, source string, repo string, author string, uses string"
TARGETS = "source string, target_share double, max_repeats int, set_at timestamp"
T0, T1 = datetime(2030, 1, 1), datetime(2031, 1, 1)
STYLE = {"a": "alpha anchor apple", "b": "bravo bridge butter", "c": "candle copper crane"}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(3000):
        s = rnd.choice("aaaaaabbc")
        text = " ".join(rnd.choices(STYLE[s].split() + ["the", "of"], k=rnd.randrange(1, 60)))
        rows.append((i, text, {0: None, 1: " " + s.upper(), 2: "stray"}.get(i % 50, s), f"r{i % 5}", None, "x"))
    rows += [(9000, None, "a", None, None, "x"), (9001, "", None, None, None, "x"), (9002, "word " * 20000, "a", "r", "u", "x")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("A", 0.5, 1, T1), ("a", 0.9, 9, T0), ("b", 0.3, 2, T1), ("c", 0.15, 3, T1), ("nowhere", 0.05, 2, T1), (None, 0.1, 1, T1)], TARGETS)


def test_targets(targets):
    t = current_targets(targets)
    assert t.names == ["a", "b", "c", "nowhere", mixing.OTHER] and t.share.tolist() == [0.5, 0.3, 0.15, 0.05, 0] and t.cap.tolist() == [1, 2, 3, 2, 0]


def test_mix_meets_its_targets(docs, targets):
    m = mix(docs, targets).cache()
    rows = {r.doc_id: r for r in m.collect()}
    assert len(rows) == docs.count()
    cap = {"a": 1, "b": 2, "c": 3}
    assert all(0 <= r.uses <= cap.get(r.source, 0) for r in rows.values())
    assert rows[9000].uses == rows[9001].uses == 0 and rows[9002].tokens >= 20000
    assert all(r.source == mixing.OTHER and r.uses == 0 for i, r in rows.items() if i % 50 == 2 and i < 3000)
    got = {r.source: r for r in shares(m, targets).collect()}
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    for s, goal in (("a", 0.5 + 0.05 / 3), ("b", 0.3 + 0.05 / 3), ("c", 0.15 + 0.05 / 3)):  # nearest shares without the source that has none
        assert abs(got[s].actual_share - goal) < 0.02
    again = {r.doc_id: r.uses for r in mix(docs.repartition(7), targets).collect()}
    assert again == {i: r.uses for i, r in rows.items()}


def test_classifier_on_held_out(docs, targets):
    names = current_targets(targets).names
    known = docs.filter("source is not null and source <> 'stray'").selectExpr("doc_id as doc", "text", "repo", "author", f"array_position(array({','.join(map(repr, names))}), lower(trim(source))) - 1 as k")
    model = fit_classifier(known.withColumn("k", known.k.cast("int")), len(names))
    assert model.accuracy > 0.85
    p = model.posterior(mixing._features("copper crane candle", "r1", None, {}))
    assert abs(p.sum() - 1) < 1e-9 and p.argmax() == 2


def test_rates_against_a_plain_solver(spark):
    rnd = np.random.default_rng(3)
    t = Targets(["a", "b", "c", mixing.OTHER], np.array([0.4, 0.4, 0.2, 0]), np.array([1, 2, 2, 0]))
    rows = [(i, int(rnd.integers(1, 90)), int(rnd.integers(0, 4)), None) for i in range(60)]
    for i in range(60, 140):
        post = rnd.dirichlet([0.4] * 4)
        rows.append((i, int(rnd.integers(1, 90)), int(post.argmax()), post.tolist()))
    df = spark.createDataFrame(rows, "doc long, tokens long, k int, post array<double>")
    post = np.array([r[3] if r[3] else np.eye(4)[r[2]] for r in rows])
    k, tokens = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    cap = t.cap[k].astype(float)
    for total in (None, 20000.0):
        rates = solve_rates(df, t, total)
        have = tokens @ post
        off = (tokens * rates.of(post, k)) @ post / rates.total - t.share
        cost = (off**2 / (have / rates.total)).sum()
        r = np.zeros(len(rows))  # plain projected gradient from another start, many rounds
        for _ in range(4000):
            e = (tokens * r) @ post / rates.total - t.share
            r = np.clip(r - post @ (e / (have / rates.total)), 0, cap)
        plain = (((tokens * r) @ post / rates.total - t.share) ** 2 / (have / rates.total)).sum()
        assert cost < plain + 1e-5, total


def test_state_and_convergence(spark, monkeypatch):
    """However often the rates are written, the same rounds come out; a bound on the rounds is reported."""
    rnd = np.random.default_rng(5)
    t = Targets(["a", "b", mixing.OTHER], np.array([0.9, 0.1, 0]), np.array([1, 3, 0]))
    posts = [rnd.dirichlet([0.5] * 3) for _ in range(200)]
    df = spark.createDataFrame([(i, 10 + i % 7, int(p[:2].argmax()), p.tolist()) for i, p in enumerate(posts)], "doc long, tokens long, k int, post array<double>")
    runs = []
    for n in (9, 1000):
        monkeypatch.setattr(mixing, "STATE", n)
        runs.append(solve_rates(df, t))
    assert len(runs[0].steps) == len(runs[1].steps) and runs[0].converged and all(np.allclose(a, b, atol=1e-12) for x, y in zip(runs[0].steps, runs[1].steps) for a, b in zip(x, y))
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    assert not solve_rates(df, t, 10_000.0).converged


def test_report(docs, targets):
    r = mix_report(docs, targets).first()
    assert r.accuracy > 0.85 and r.held_out > 300 and r.converged and r.deviation < 0.02 and r.total_tokens > 0


def test_empty(spark, docs, targets):
    assert mix(docs.limit(0), targets).count() == 0
    none = mix(docs, targets.limit(0))
    assert none.filter("uses > 0").count() == 0 and none.count() == docs.count()
    assert {r.source: r.actual_share for r in shares(none, targets).collect()} == dict.fromkeys(["a", "b", "c", "nowhere", mixing.OTHER], 0.0)
