"""Text that looks the same brought to one consistent form.

Width forms, blanks and ignorable characters are normalized first. Then each token that has letters with
look-alikes in another script spans a lattice of spellings; Viterbi finds the one with the fewest
changes of script and, of those, the best character bigram score, counted over all texts. The lattice
depends only on how the token looks, so tokens that look the same come out the same.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import cut

# Letters of the same shape, each column one shape; a blank where the script has none.
LATIN = "aceijopsvxyhdqwABCEHIJKMNOPSTXYZQW"
CYRILLIC = "асеіјорѕѵхуһԁԛԝАВСЕНІЈКМ ОРЅТХУ ԚԜ"
GREEK = "    ϳο  ν      ΑΒ ΕΗΙͿΚΜΝΟΡ ΤΧΥΖ  "
# Characters without a look of their own outside the format category, and format characters that are seen.
IGNORABLE = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)]
SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
JOINER = "‍"

ORDER = ("latin", "cyrillic", "greek")
_SHAPES = [dict(zip(ORDER, column)) for column in zip(LATIN, CYRILLIC, GREEK)]
#: Each letter with look-alikes -> the letter that stands for its shape, and that letter -> all spellings.
STAND = {c: s["latin"] for s in _SHAPES for k, c in s.items() if c != " "}
SPELLINGS = {s["latin"]: [(c, k) for k, c in s.items() if c != " "] for s in _SHAPES}
_TO_STAND = str.maketrans({c: s for c, s in STAND.items() if c != s})
_LETTER = "A-Za-z̀-ͯͰ-ԯ"
_FOREIGN = re.compile(f"[{_LETTER}]*[Ͱ-ԯ][{_LETTER}]*")
_ANY_FOREIGN = re.compile("[Ͱ-ԯ]")
_OPEN = re.compile(f"(?<![{_LETTER}])[{''.join(SPELLINGS)}̀-ͯ]+(?![{_LETTER}])")
_JOINED = re.compile(f"(?<=[\U0001f000-\U0001faff☀-➿️]){JOINER}(?=[\U0001f000-\U0001faff☀-➿])")
_KEPT_JOINER = "\U000f0000"


def _table() -> dict[str, str]:
    """What becomes of characters that don't stay: nothing, a space, or their ordinary form."""
    out: dict[str, str] = {}
    for cp in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)):  # no such characters elsewhere
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" and cp not in SEEN:
            out[c] = ""
        elif kind == "Zs" and cp != 0x1680:
            out[c] = " "
        else:
            d = unicodedata.decomposition(c) if 0x3000 <= cp <= 0xFFFF else ""
            if d.startswith(("<wide>", "<narrow>")):
                out[c] = "".join(chr(int(x, 16)) for x in d.split()[1:])
    out.update(dict.fromkeys(map(chr, IGNORABLE), ""))
    return out


@cache
def _changes() -> tuple[re.Pattern, dict[str, str]]:
    table = _table()
    cps = sorted(map(ord, table))
    runs, start = [], cps[0]
    for a, b in zip(cps, [*cps[1:], -1]):
        if b != a + 1:
            runs.append(f"\\U{start:08x}-\\U{a:08x}")
            start = b
    return re.compile(f"[{''.join(runs)}]"), table


def plain(text: str) -> str:
    """Width forms and blanks as ordinary ones, without ignorable characters, accents apart from their letters. A joiner between emoji is seen and stays."""
    if text.isascii():
        return text
    pattern, table = _changes()
    if JOINER in text:
        text = _JOINED.sub(_KEPT_JOINER, text)
    text = unicodedata.normalize("NFD", pattern.sub(lambda m: table[m.group()], text))
    return text.replace(_KEPT_JOINER, JOINER)


# The alphabet of the bigrams: 0 is anything else, then a-z, A-Z and the Greek and Cyrillic blocks.
_FIRST, _END = 0x370, 0x530
SIZE = 1 + 52 + _END - _FIRST
_IDS = np.zeros(_END + 1, np.int64)
_IDS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_IDS[ord("A") : ord("Z") + 1] = np.arange(27, 53)
_IDS[_FIRST:_END] = np.arange(53, SIZE)


def letter_id(c: str) -> int:
    cp = ord(c)
    return int(_IDS[cp]) if cp < _END else 0


def bigram_counts(texts: DataFrame, column: str) -> dict[int, int]:
    """Counts of neighbouring letters over all texts. What reaches the driver is bounded by the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, np.int64)
        for b in batches:
            ascii_, other = [], []
            for t in b.column(column).to_pylist():
                if t:
                    (ascii_ if t.isascii() else other).append(t)
            for joined, kind in (("\n".join(ascii_).encode("ascii"), np.uint8), ("\n".join(map(plain, other)).encode("utf-32-le"), np.uint32)):
                for at in range(0, len(joined), 1 << 22):  # pieces meet in one character
                    cps = np.frombuffer(joined[at : at + (1 << 22) + kind().itemsize], kind)
                    ids = _IDS[cps] if kind is np.uint8 else _IDS[np.minimum(cps, _END)]
                    total += np.bincount(ids[:-1] * SIZE + ids[1:], minlength=SIZE * SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": at, "n": total[at]})

    rows = texts.select(column).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r.code: r.n for r in rows}


class Speller:
    """Viterbi over look-alike lattices; each token that looks different is searched once."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.sums: dict[int, int] = {}
        for code, n in counts.items():
            self.sums[code // SIZE] = self.sums.get(code // SIZE, 0) + n
        self.known: dict[str, str] = {}

    def score(self, a: int, b: int) -> float:
        return log((self.counts.get(a * SIZE + b, 0) + 0.5) / (self.sums.get(a, 0) + 0.5 * SIZE))

    def spell(self, token: str) -> str:
        """The consistent spelling of a token given by the letters that stand for its shapes."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[token] = self._viterbi(token)
        return got

    def _viterbi(self, token: str) -> str:
        # state: (changes of script, -score, spelling as a linked list) for each script and letter
        states: list[tuple[int, float, str | None, int, tuple | None]] = [(0, 0.0, None, 0, None)]
        for c in token:
            if "̀" <= c <= "ͯ":
                states = [(n, s, script, last, (c, back)) for n, s, script, last, back in states]
                continue
            options = SPELLINGS.get(c) or [(c, "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic")]
            new = []
            for letter, script in options:
                i = letter_id(letter)
                best = min(((n + (was not in (None, script)), s - self.score(last, i), k) for k, (n, s, was, last, _) in enumerate(states)))
                new.append((best[0], best[1], script, i, (letter, states[best[2]][4])))
            states = new
        n, s, k = min((n, s - self.score(last, 0), k) for k, (n, s, _, last, _) in enumerate(states))
        out, back = [], states[k][4]
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def form(self, text: str) -> str:
        """The text in its consistent form."""
        text = plain(text)
        # A token with an unambiguous Latin letter and no foreign one has no path with as few changes of script as its own.
        odd = {t for t in set(_OPEN.findall(text)) if self.spell(t) != t}
        if odd:
            text = _OPEN.sub(lambda m: self.spell(m.group()), text)
        if text.isascii():
            return text
        if _ANY_FOREIGN.search(text):
            text = _FOREIGN.sub(lambda m: self.spell(m.group().translate(_TO_STAND)), text)
        return unicodedata.normalize("NFC", text)


def speller_for(*texts: tuple[DataFrame, str]) -> Broadcast:
    """Bigram counts of all texts given, for the tasks."""
    counts: dict[int, int] = {}
    for df, column in texts:
        for code, n in bigram_counts(df, column).items():
            counts[code] = counts.get(code, 0) + n
    return texts[0][0].sparkSession.sparkContext.broadcast(counts)


def consistent_forms(df: DataFrame, id_col: str, text_col: str, counts: Broadcast | None = None) -> DataFrame:
    """(id_col, form) of every row; a null text has a null form, an empty one an empty form.

    One form has: ordinary instead of full- and half-width characters; plain spaces instead of the other blanks on the line; no
    invisible characters (a joiner between emoji is seen and stays); composed accents; and letters with look-alikes in Latin, Greek and
    Cyrillic spelled in one script as far as the token allows. Case, accents, raised digits, layout and the number of blanks stay."""
    counts = counts or speller_for((df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(counts.value)
        for b in batches:
            forms = [None if t is None else speller.form(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(forms, pa.string())], names=[id_col, "form"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, form string")


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, f, t of the rows whose text is not null or empty and whose form other texts share: 128-bit digests of form and text. Written once."""
    counts = speller_for((df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(counts.value)
        digest = lambda s: hashlib.blake2b(s.encode(), digest_size=16).digest()
        for b in batches:
            take, form, text = [], [], []
            for i, t in enumerate(b.column(text_col).to_pylist()):
                if t:
                    take.append(i)
                    text.append(digest(t))
                    f = speller.form(t)
                    form.append(text[-1] if f == t else digest(f))
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(take, pa.int64())), pa.array(form, pa.binary()), pa.array(text, pa.binary())], names=["id", "f", "t"])

    rows = cut(df.select(id_col, text_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, f binary, t binary"))
    several = rows.groupBy("f").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a <> b").select("f")
    return cut(rows.join(several, "f", "left_semi"))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: rows whose texts are not equal but have one form. Null and empty texts make none.

    Only forms with different texts are paired, class by class of equal texts; then the classes' members are joined on. This
    gives every pair: a form with many copies of several texts has many; ``lookalike_classes`` says the same in one row for each row."""
    some = _digests(df, id_col, text_col)
    classes = some.select("f", "t").distinct()
    pairs = classes.select("f", F.col("t").alias("t1")).join(classes.select("f", F.col("t").alias("t2")), "f").filter("t1 < t2")
    left = some.select("f", F.col("t").alias("t1"), F.col("id").alias("x"))
    right = some.select("f", F.col("t").alias("t2"), F.col("id").alias("y"))
    out = pairs.join(left, ["f", "t1"]).join(right, ["f", "t2"]).filter("x <> y")
    return out.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, text_id, n_texts, n_docs) of each row whose text looks like another, different one: the least id of all rows that
    look so, the least id of those with just this text, and how many texts and rows look so. Grows with the rows, not with the pairs;
    two rows are a pair if class_id is the same and text_id is not. Null and empty texts are in no class; a repeated id has one row for each text."""
    some = _digests(df, id_col, text_col)
    texts = some.groupBy("f", "t").agg(F.min("id").alias("text_id"), F.countDistinct("id").alias("n"))
    forms = texts.groupBy("f").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_docs"))
    return some.distinct().join(texts.select("f", "t", "text_id"), ["f", "t"]).join(forms, "f").select(F.col("id").alias(id_col), "class_id", "text_id", "n_texts", "n_docs")
