import random

import numpy as np

from catalith.llm import leakage
from catalith.llm.leakage import common_words, leaks, words

VOCAB = [f"w{i}" for i in range(30)]


def test_runs_against_brute_force(spark):
    rnd = random.Random(4)
    sent = lambda n: [rnd.choice(VOCAB) for _ in range(n)]
    items = [(i, " ".join(sent(rnd.choice([5, 11, 12, 30])))) for i in range(30)]
    items += [(90, None), (91, ""), (1, items[1][1]), (92, items[4][1] + " tail of its own")]
    docs = []
    for d in range(200):
        body = sent(rnd.choice([0, 3, 40]))
        src = (rnd.choice(items)[1] or "").split()
        cut = src[rnd.randrange(3) :][: rnd.choice([11, 12, 13, 30])]
        docs.append((d, ("-".join(body) + "\n" + ", ".join(cut) + " " + " ".join(sent(4))).upper(), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, " ".join(VOCAB * 2000) + " " + items[2][1], "x"), (503, items[3][1].replace("w", "ｗ").replace("1", "1​"), "x")]
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t, _ in docs:
        w = words((t or "").replace("ｗ", "w").replace("​", ""))
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    dd = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    for block in (10, 10**6):
        got = [(r.doc_id, r.item_id) for r in leaks(dd, ii, "doc_id", "item_id", block_passages=block).collect()]
        assert set(got) == want and len(got) == len(want) and want
    assert leaks(dd.limit(0), ii, "doc_id", "item_id").count() == 0
    assert leaks(dd, ii.limit(0), "doc_id", "item_id").count() == 0


def test_paraphrase(spark):
    text = "please list the twelve oldest harbour towns that ship more than 4711 barrels of salted herring each year"
    docs = [(1, "note: " + text.replace("oldest ", "").replace("each", "every")), (2, "please list the towns"), (3, text[::-1])] + [(10 + i, " ".join(random.Random(i).choices(text.split(), k=30)) + f" q{i}") for i in range(40)]
    got = {(r.doc_id, r.item_id): r.n_words for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, text)], "item_id long, text string"), "doc_id", "item_id", near=True).collect()}
    assert (1, 7) in got and (2, 7) not in got and (3, 7) not in got


def test_latent_space(spark):
    """The subspace of the distributed randomised SVD against numpy's SVD of the whole matrix."""
    rnd = np.random.default_rng(1)
    topics = rnd.integers(0, 4, 300)
    docs = [([int(x) for x in (topics[i] * 6 + rnd.integers(0, 6, 36))],) for i in range(300)]
    df = spark.createDataFrame(docs, "ids array<int>")
    count, n = leakage.passage_counts(df, 24, 12)
    assert n == 900
    idf = np.log((n + 1) / (count + 1)) + 1
    a = np.zeros((900, 24))
    for i, (ids,) in enumerate(docs):
        for k, w in enumerate(ids):
            a[i * 3 + k // 12, w] += idf[w]
    assert (count == (a > 0).sum(axis=0)).all()
    right = np.linalg.svd(a, full_matrices=False)[2][:4].T
    latent = leakage.latent_words(df, idf, 12, rank=4, extra=4, power=6)
    assert np.linalg.norm(right - latent @ (latent.T @ right)) < 1e-2


def test_common_words():
    assert common_words("abcbdab", "bdcaba") == 4 and common_words("", "a") == 0


def test_near_at_every_position(spark):
    """Runs of a passage's length at every offset of items and documents."""
    rnd = random.Random(9)
    vocab = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(90)]
    items = [(i, " ".join(rnd.sample(vocab, 14))) for i in range(60)]
    docs, want = [], set()
    for i, t in items:
        for k in range(3):
            d = 3 * i + k
            docs.append((d, " ".join([f"lead{d}"] * (d % 4) + t.split()[k : k + 12] + [f"tail{d}"] * 4)))
            want.add((d, i))
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id"
    assert want <= {(r.doc_id, r.item_id) for r in leaks(*args, near=True).collect()}


def test_close_groups():
    """The grouped search finds the pairs of the whole product."""
    rnd = np.random.default_rng(3)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rnd.standard_normal((n, 4)).astype(np.float32))
    x, y = unit(3000), unit(1500)
    got = [(a, b) for i, j in leakage._close_groups(x, y, leakage._groups(y, 0.92), 0.92) for a, b in zip(i.tolist(), j.tolist())]
    cosine = x @ y.T
    assert len(got) == len(set(got)) and {*zip(*map(np.ndarray.tolist, np.nonzero(cosine >= 0.9201)))} <= set(got) <= {*zip(*map(np.ndarray.tolist, np.nonzero(cosine >= 0.9199)))}


def test_common_lengths():
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 6, (200, 12)), rnd.integers(0, 6, (200, 12))
    assert leakage.common_lengths(a, b).tolist() == [common_words(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_part_of_an_item(spark):
    """A passage copied from a long item, word by word or with a word changed, whose telling words are elsewhere; but not one without its own number and rare words."""
    common = "please count all of the open orders that were sent last week".split()
    item = " ".join(common) + " " + " ".join(f"rare{i} {4000 + i}" for i in range(20))
    docs = [(1, "so " + " ".join(common)), (2, " ".join(common).replace("open", "late")), (3, "unrelated text about the weather of last week and the orders of the day")]
    docs += [(10 + i, " ".join(random.Random(i).choices(common, k=20))) for i in range(40)]
    got = {r.doc_id: r.n_words for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), "doc_id", "item_id", near=True).collect()}
    assert 1 in got and 2 in got and 3 not in got
    rank = np.array([1.0, 5, 4, 3, 2, 6, 7, 8])
    assert leakage._telling(np.array([[0, 1, 1, 2, 3, 4, 5, 6], [0, 0, 0, 7, 7, 7, 1, 1]]), rank, np.arange(8) == 0).tolist() == [[True, True, True, True, True, False, True, True], [True] * 8]


def test_n_words_is_the_longest(spark):
    """A whole copy after poorer ones counts in full, however the documents lie in partitions."""
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.sample([f"{a}{b}q" for a in "bcdfg" for b in "aeiouy"], 13))) for i in range(20)]
    docs = []
    for i, t in items:
        w = t.split()
        poor = [x for k, x in enumerate(w) if k not in (3, 6, 9)]
        docs.append((i, " ".join(poor + ["stop"] * 4 + w + ["stop"] * 4 + poor)))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 5):
        got = {(r.doc_id, r.item_id): r.n_words for r in leaks(dd.repartition(n, "doc_id"), ii, "doc_id", "item_id", near=True).collect()}
        assert [got.get((i, i)) for i, _ in items] == [12] * len(items)


def test_recall_of_changed_passages(spark):
    """Parts of items with every fifth, sixth or eighth word replaced, or with two neighbours swapped, among unrelated documents."""
    rnd = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in "kmnrt"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(30, 70)))) for i in range(60)]
    docs, want = [(10_000 + i, " ".join(rnd.choices(vocab, k=60))) for i in range(100)], set()
    for i, t in items:
        for n, step in enumerate((5, 6, 8, 0)):
            w = t.split()[:26]
            w = [f"zq{rnd.randrange(10**6)}" if step and k % step == step - 1 else x for k, x in enumerate(w)]
            if not step:
                w[3], w[4], w[15], w[16] = w[4], w[3], w[16], w[15]
            d = 4 * i + n
            docs.append((d, " ".join(["before"] * (d % 3) + w)))
            a, b = words(docs[-1][1]), words(t)
            if any(common_words(a[x : x + 12], b[y : y + 12]) >= 9 for x in range(len(a) - 11) for y in range(len(b) - 11)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", near=True).collect()}
    assert len(want) > 200 and len(want & got) >= 0.9 * len(want)
