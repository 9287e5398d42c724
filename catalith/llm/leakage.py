"""Evaluation passages in a corpus, by latent semantic retrieval.

Passages are windows of a fixed number of words. A distributed randomised SVD of the corpus passages'
TF-IDF matrix gives a latent space; passages of documents and items that are close there are
candidates, and each candidate is checked on its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catalith.functions.worker import no_cycle_search
from catalith.llm.lookalike import Speller, speller_for
from catalith.session import cut

#: Words of a passage; also the run of words that a leak shares.
PASSAGE = 12
#: Dimensions of the latent space, extra columns of the random start, and passes over the corpus after the first.
RANK, EXTRA, POWER = 16, 8, 1
SEED = 7
#: Items are searched in blocks of at most so many passages, which bounds what is broadcast.
BLOCK_PASSAGES = 200_000
#: Cosine from which two passages are candidates. Equal passages have 1 whatever the rank, so that a run of PASSAGE words can't be missed.
SAME, NEAR = 0.999, 0.92
#: For paraphrases: passages of items in a group of close ones, and the most groups.
GROUP, MOST_GROUPS = 64, 1024
#: For paraphrases: the share of a passage that the longest common subsequence holds, and of the telling words (numbers and the RARE rarest words), of the passage or of the item, that the document has.
COMMON, ANSWER, RARE = 0.75, 0.6, 5

_WORD = re.compile(r"[^\W_]+")


def words(form: str) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall(form.lower())


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of a batch's documents one after the other, and the documents' offsets."""
    a = b.column("ids")
    off = a.offsets.to_numpy()
    return a.values.to_numpy()[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def _passages(off: np.ndarray, size: int) -> np.ndarray:
    """For each word the number of its passage, documents being cut into passages side by side."""
    n = np.diff(off)
    per = -(-n // size)
    start = np.cumsum(per) - per
    pos = np.arange(off[-1]) - np.repeat(off[:-1], n)
    return np.repeat(start, n) + pos // size


def _sums(df: DataFrame, f, cells: int) -> np.ndarray:
    """Adds up the vectors that f makes of each batch, over all tasks. cells bounds what a task sends and the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for b in batches:
            if b.num_rows:
                f(b, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "x": pa.array(total[at])})

    t = df.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(cells)
    out[t["cell"].to_numpy()] = t["x"].to_numpy()
    return out


def passage_counts(docs: DataFrame, vocab: int, size: int) -> tuple[np.ndarray, float]:
    """In how many passages of all documents each word occurs, and the number of passages."""

    def f(b: pa.RecordBatch, total: np.ndarray) -> None:
        ids, off = _flat(b)
        p = _passages(off, size)
        total[vocab] += (-(-np.diff(off) // size)).sum()
        in_ = ids >= 0
        pairs = np.unique(p[in_] * vocab + ids[in_])
        total[:vocab] += np.bincount(pairs % vocab, minlength=vocab)

    out = _sums(docs, f, vocab + 1)
    return out[:vocab], out[vocab]


def latent_words(docs: DataFrame, idf: np.ndarray, size: int, rank: int = RANK, extra: int = EXTRA, power: int = POWER) -> np.ndarray:
    """The words' coordinates in the latent space: right singular vectors of the passages' TF-IDF matrix, by randomised subspace iteration. Each round is one pass over all passages; the basis (words x columns) is all that moves."""
    vocab, cols = len(idf), rank + extra
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((vocab, min(cols, vocab))))[0]
    for _ in range(power + 1):
        width = basis.shape[1]
        wire = docs.sparkSession.sparkContext.broadcast((basis * idf[:, None]).astype(np.float32))

        def f(b: pa.RecordBatch, total: np.ndarray, wire=wire, width=width) -> None:
            ids, off = _flat(b)
            p = _passages(off, size)
            in_ = ids >= 0
            ids, p = ids[in_], p[in_]
            if len(ids):
                new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                row = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(p)]))
                y = np.add.reduceat(wire.value[ids], new, axis=0)  # A x basis
                z = total.reshape(vocab, width)
                for j in range(width):  # transposed A x y
                    z[:, j] += np.bincount(ids, weights=y[row, j], minlength=vocab)

        z = _sums(docs, f, vocab * width).reshape(vocab, width) * idf[:, None]
        small = basis.T @ z
        value, vector = np.linalg.eigh((small + small.T) / 2)
        best = vector[:, np.argsort(-value)[:rank]]
        latent = basis @ best
        basis = np.linalg.qr(z)[0]
    return latent


def _windows(ids: np.ndarray, off: np.ndarray, size: int, unknown: int) -> np.ndarray:
    """Starts of the windows that lie in one document and have at most so many unknown words."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    bad = np.cumsum(np.r_[0, ids < 0])
    start = np.arange(len(ids) - size + 1)
    last = np.repeat(off[1:], np.diff(off))[: len(start)]
    return start[(start + size <= last) & (bad[start + size] - bad[start] <= unknown)]


def _vectors(ids: np.ndarray, start: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word windows and their latent unit vectors. The last row of word is for unknown words."""
    w = ids[start[:, None] + np.arange(size)]
    v = word[w[:, 0]].copy()
    for k in range(1, size):
        v += word[w[:, k]]
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return w, v / np.where(n > 0, n, 1)


def _close(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with a cosine of ``least`` or more. y is sorted by its first coordinate; close rows differ by little in any coordinate, so most of y is never looked at."""
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-4
    order = np.argsort(x[:, 0], kind="stable")
    for at in range(0, len(order), 256):
        o = order[at : at + 256]
        lo = np.searchsorted(y[:, 0], x[o[0], 0] - reach)
        hi = np.searchsorted(y[:, 0], x[o[-1], 0] + reach)
        for s in range(lo, hi, 4096):
            i, j = np.nonzero(x[o] @ y[s : min(s + 4096, hi)].T >= least)
            if len(i):
                yield o[i], j + s


def _groups(y: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Groups of close rows: (centre, rows, the least cosine with the centre of a row that is close to any of the group)."""
    if not len(y):
        return []
    c = y[np.linspace(0, len(y) - 1, max(1, min(len(y) // GROUP, MOST_GROUPS))).astype(int)]
    for _ in range(5):
        near = np.concatenate([np.argmax(y[at : at + 8192] @ c.T, axis=1) for at in range(0, len(y), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, y)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.where(n > 0, n, 1), c)
    out = []
    for g in np.unique(near):
        rows = np.flatnonzero(near == g)
        wide = np.arccos(np.clip((y[rows] @ c[g]).min(), -1, 1)) + np.arccos(least)
        out.append((c[g], rows, float(np.cos(min(np.pi, wide))) - 1e-3))
    return out


def _close_groups(x: np.ndarray, y: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, float]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with a cosine of ``least`` or more, for one too low for a sorted coordinate to rule out much: angles add up, so a row too far from a group's centre is close to none of the group."""
    if not groups:
        return
    centres, bound = np.vstack([c for c, _, _ in groups]), np.array([b for _, _, b in groups], np.float32)
    for at in range(0, len(x), 8192):
        near = x[at : at + 8192] @ centres.T >= bound
        for g in np.flatnonzero(near.any(axis=0)):
            o, rows = at + np.flatnonzero(near[:, g]), groups[g][1]
            for s in range(0, len(rows), 1024):
                part = rows[s : s + 1024]
                k = np.flatnonzero((x[o] @ y[part].T >= least).ravel())
                if len(k):
                    yield o[k // len(part)], part[k % len(part)]


def _telling(w: np.ndarray, idf: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which words of each window are numbers or among its RARE rarest."""
    place = np.empty(len(idf), np.int64)
    place[np.lexsort((np.arange(len(idf)), -idf))] = np.arange(len(idf))
    r = place[w]
    low = np.sort(r, axis=1)
    nth = np.cumsum(np.c_[np.ones(len(w), bool), low[:, 1:] != low[:, :-1]], axis=1)
    return number[w] | (r <= np.where(nth <= RARE, low, -1).max(axis=1, keepdims=True))


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in arrays of ``least`` rows or more, but for the last."""
    held, n = [], 0
    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _marks(w: np.ndarray) -> np.ndarray:
    """The words of each window as bits; words may share a bit, unknown ones have none."""
    bits = np.where(w >= 0, np.uint64(1) << (w.astype(np.int64) % 64).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """common_words of each row of a and the same row of b."""
    row = np.zeros((b.shape[1] + 1, len(a)), np.int16)
    for x in a.T:
        corner = row[0]
        for k in range(b.shape[1]):
            up = row[k + 1].copy()
            row[k + 1] = np.where(x == b[:, k], corner + 1, np.maximum(up, row[k]))
            corner = up
    return row[-1]


def common_words(a, b) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for k, y in enumerate(b):
            up = row[k + 1]
            row[k + 1] = left + 1 if x == y else max(up, row[k])
            left = up
    return row[-1]


def _blocks(items: DataFrame, id_col: str, text_col: str, counts, size: int, limit: int) -> Iterator[list[tuple]]:
    """Items with their words, in blocks of a bounded number of passages."""
    speller, block, n = Speller(counts.value), [], 0
    for r in items.select(id_col, text_col).toLocalIterator():
        w = words(speller.form(r[text_col] or ""))
        if len(w) >= size:
            block.append((r[id_col], w))
            n += len(w) - size + 1
            if n >= limit:
                yield block
                block, n = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", size: int = PASSAGE, near: bool = False, block_passages: int = BLOCK_PASSAGES) -> DataFrame:
    """(doc_id, item_id, n_words) of each document with a passage of an item.

    Words are runs of letters and digits of the texts' consistent form. Passages are all windows of ``size`` words, of items
    and documents alike. Candidates are pairs of passages that are close in the latent space. Without ``near``: pairs that share
    a run of ``size`` words (n_words = size); equal passages have the cosine 1, so the search misses none. With ``near``: pairs whose longest common
    subsequence has COMMON of a passage's words or more (n_words is the longest of the passages that pass), where the document also has ANSWER of the numbers and rare words of
    the passage or of the whole item; equal passages need no more.
    Null and short texts leak nothing; repeated ids give one row; an empty table gives none. Word statistics and the latent space
    come from all documents. Items are searched in blocks, each with one pass over the documents' words.
    """
    counts = speller_for((docs, text), (items, text))
    d_type, i_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"d {d_type}, i {i_type}, n int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id, text, counts, size, block_passages):
        out = out.unionByName(_search(docs, block, counts, doc_id, text, size, near, schema, d_type, to_arrow_type(items.schema[item_id].dataType)))
    return out.groupBy("d", "i").agg(F.max("n").alias("n_words")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "n_words")


def _search(docs: DataFrame, block: list[tuple], counts, doc_id: str, text: str, size: int, near: bool, schema: str, d_type: str, i_arrow: pa.DataType) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    names = sorted({w for _, ws in block for w in ws})
    vocab = sc.broadcast({w: k for k, w in enumerate(names)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, get = Speller(counts.value), vocab.value.get
        for b in batches:
            off, ids = [0], []
            with no_cycle_search():
                for t in b.column(text).to_pylist():
                    if t:
                        ids += [get(w, -1) for w in words(speller.form(t))]
                    off.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], names=["d", "ids"])

    known = cut(docs.select(doc_id, text).mapInArrow(read, f"d {d_type}, ids array<int>"))
    light = known.select("ids")
    df, passages = passage_counts(light, len(names), size)
    idf = np.log((passages + 1) / (df + 1)) + 1
    latent = latent_words(light, idf, size)
    word = np.vstack([latent * idf[:, None], np.zeros((1, latent.shape[1]))]).astype(np.float32)
    ids = np.concatenate([np.array([vocab.value[w] for w in ws]) for _, ws in block])
    off = np.cumsum([0, *[len(ws) for _, ws in block]])
    start = _windows(ids, off, size, 0)
    owner = np.searchsorted(off, start, "right") - 1
    win, vec = _vectors(ids, start, word, size)
    order = np.argsort(vec[:, 0], kind="stable")
    telling = [{vocab.value[w] for w in ws if w.isdigit()} | set(sorted({vocab.value[w] for w in ws}, key=lambda k: (-idf[k], k))[:RARE]) for _, ws in block] if near else None
    tells = _telling(win[order], idf, np.array([w.isdigit() for w in names], bool)) if near else None
    least = NEAR if near else SAME
    wire = sc.broadcast((word, win[order], vec[order], owner[order], [i for i, _ in block], telling, tells, _groups(vec[order], least) if near else None))
    unknown = size - int(np.ceil(COMMON * size)) if near else 0  # with more, the passage can't have enough words in common

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, win, vec, owner, item, telling, tells, groups = wire.value
        marks = _marks(win) if near else None
        for b in batches:
            ids, off = _flat(b)
            start = _windows(ids, off, size, unknown)
            found: dict[tuple[int, int], int] = {}
            for at in range(0, len(start), 65_536):
                s = start[at : at + 65_536]
                w, v = _vectors(ids, s, word, size)
                doc = np.searchsorted(off, s, "right") - 1
                if not near:
                    for i, j in _close(v, vec, least):
                        ok = (w[i] == win[j]).all(axis=1)
                        for d, o in set(zip(doc[i[ok]].tolist(), owner[j[ok]].tolist())):
                            found[d, o] = size
                    continue
                missing = ~_marks(w)
                likely = ((i[ok], j[ok]) for i, j in _close_groups(v, vec, groups, least) if (ok := np.bitwise_count(marks[j] & missing[i]) <= unknown).any())
                for i, j in _gathered(likely, 65_536):
                    shared = np.zeros(len(i), np.int64)  # bounds the common subsequence
                    for k in range(size):
                        shared += (w[i] == win[j, k][:, None]).any(axis=1)
                    ok = shared >= COMMON * size
                    i, j = i[ok], j[ok]
                    common = common_lengths(w[i], win[j])
                    ok = common >= COMMON * size
                    i, j, common = i[ok], j[ok], common[ok]
                    at_doc, have = -1, set()
                    for k in np.lexsort((-common, doc[i])).tolist():
                        d, o, n = int(doc[i[k]]), int(owner[j[k]]), int(common[k])
                        if found.get((d, o), 0) >= n:
                            continue
                        if d != at_doc:
                            at_doc, have = d, set(ids[off[d] : off[d + 1]].tolist())
                        if n == size or any(len(x & have) >= ANSWER * len(x) for x in (set(win[j[k], tells[j[k]]].tolist()), telling[o])):
                            found[d, o] = n
            if found:
                d, o = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(d)), pa.array([item[k] for k in o], i_arrow), pa.array(found.values(), pa.int32())], names=["d", "i", "n"])

    return known.mapInArrow(find, schema)
