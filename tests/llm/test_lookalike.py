import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm import lookalike
from catalith.llm.lookalike import SPELLINGS, Speller, bigram_counts, consistent_forms, lookalike_classes, lookalike_pairs, plain


def counts(text):
    out = {}
    ids = [lookalike.letter_id(c) for c in text]
    for a, b in zip(ids, ids[1:]):
        out[a * lookalike.SIZE + b] = out.get(a * lookalike.SIZE + b, 0) + 1
    return out


SAMPLE = counts("the cat has a cope and expects peace\nскоро море хор хорошо рос\nκαι το νερο\n")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="copeax" + "th" + "м" + "ж" + "π", min_size=1, max_size=5))
def test_viterbi_is_the_best_path(shape):
    """Against all paths of the lattice."""
    s = Speller(SAMPLE)
    options = [SPELLINGS.get(c) or [(c, "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic")] for c in shape]

    def cost(path):
        ids = [0, *[lookalike.letter_id(c) for c, _ in path], 0]
        return sum(a[1] != b[1] for a, b in zip(path, path[1:])), sum(-s.score(a, b) for a, b in zip(ids, ids[1:]))

    best = min(cost(p) for p in itertools.product(*options))
    got = [(c, next(k for x, k in o if x == c)) for c, o in zip(s.spell(shape), options)]
    n, score = cost(got)
    assert n == best[0] and abs(score - best[1]) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="сope хоржthμ Aе́é​\xa0　ａ１ \n\tΑ²fÉ", max_size=12), st.randoms())
def test_same_look_same_form(text, rnd):
    s = Speller(SAMPLE)
    form = s.form(text)
    assert s.form(form) == form and unicodedata.is_normalized("NFC", form)
    other = []
    for c in unicodedata.normalize("NFD", text):
        twins = [x for o in SPELLINGS.values() if c in [y for y, _ in o] for x, _ in o]
        if " " <= c <= "~" and c != " ":
            twins += [c, chr(ord(c) + 0xFEE0)]
        if unicodedata.category(c) == "Zs":
            twins += [" ", "\xa0", "　"]
        other.append(rnd.choice(["", "", "​", "\xad"]) + rnd.choice(twins or [c]))
    assert s.form("".join(other)) == form


def test_what_one_sees_stays():
    s = Speller(SAMPLE)
    assert len({s.form(t) for t in ("x2", "x²", "X2", "x 2", "x  2", "x\n2", "x\t2", "é2", "e2", "x\r\n2")}) == 10
    assert plain("\U0001f469‍\U0001f527") == "\U0001f469‍\U0001f527" and plain("a‍b") == "ab"
    assert s.form("хорошо сat") == "хорошо cat"


def test_pairs_and_counts(spark):
    long = "peace and quiet " * 3000
    rows = [(1, "cat", 0), (2, "сat", 0), (3, "cat", 0), (4, "c​at", 0), (5, None, 0), (6, "", 0), (7, "Cat", 0), (8, " ", 0), (9, "\xa0", 0), (10, long, 0), (11, long.replace("a", "а"), 0), (12, "other", 0)]
    df = spark.createDataFrame([*rows, *[(100 + i, "cat", 0) for i in range(40)]], "doc_id long, text string, form int")
    text = {r[0]: r[1] for r in [*rows, *[(100 + i, "cat") for i in range(40)]]}
    same = [{1, 2, 3, 4, *range(100, 140)}, {8, 9}, {10, 11}]
    want = {(a, b) for g in same for a in g for b in g if a < b and text[a] != text[b]}
    got = [tuple(r) for r in lookalike_pairs(df, "doc_id", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    cls = {r.doc_id: (r.class_id, r.text_id, r.n_texts, r.n_docs) for r in lookalike_classes(df, "doc_id", "text").collect()}
    assert {(a, b) for a in cls for b in cls if a < b and cls[a][0] == cls[b][0] and cls[a][1] != cls[b][1]} == want
    assert cls[3] == (1, 1, 3, 44) and cls[2] == (1, 2, 3, 44) and cls[11] == (10, 11, 2, 2) and len(cls) == 48
    assert lookalike_classes(df.limit(0), "doc_id", "text").count() == 0
    forms = {r.doc_id: r.form for r in consistent_forms(df, "doc_id", "text").collect()}
    assert forms[5] is None and forms[6] == "" and forms[2] == "cat" and forms[11] == long
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    joined = "\n".join(t for t in text.values() if t)
    got = bigram_counts(df, "text")
    want = counts(lookalike.plain(joined))
    assert {k: v for k, v in got.items() if k // lookalike.SIZE and k % lookalike.SIZE} == {k: v for k, v in want.items() if k // lookalike.SIZE and k % lookalike.SIZE}
