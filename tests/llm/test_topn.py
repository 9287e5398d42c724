import random

from catalith.llm.topn import top_n


def test_hot_group_ties_and_nulls(spark):
    rnd = random.Random(1)
    special = [None, float("nan"), float("inf"), -0.0, 0.0]
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b", None]), rnd.choice([*special, 1.0, 2.0]), i, "x") for i in range(4000)] + [("a", 2.0, 1, "y")] * 3
    df = spark.createDataFrame(rows, "g string, s double, i long, rank_no string")
    got = sorted((r.g, r.rank_no, r.i) for r in top_n(df, "g", "s", "i", 7).collect())
    want = []
    for g in ("hot", "a", "b"):
        own = sorted(((-(s + 0.0), i) for h, s, i, _ in rows if h == g and s is not None and s == s))[:7]
        want += [(g, k + 1, i) for k, (_, i) in enumerate(own)]
    assert got == sorted(want)
    assert top_n(df.limit(0), "g", "s", "i", 7).count() == 0
