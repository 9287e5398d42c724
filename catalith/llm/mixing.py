"""Mixing sources to target weights, with soft membership of documents without a source.

A classifier trained on the labelled documents gives the others a distribution over the sources. Projected
gradient least squares then finds rates of use for which the expected tokens of each source meet its target,
and the rates are rounded to whole uses along the documents' sizes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.names import BLANKS
from catalith.operators.rangescan import range_scan
from catalith.session import cut

#: The classifier: labelled documents that it is fitted on at most, hashed features, smoothing, and the part held out for its temperature.
SAMPLE, FEATURES, SMOOTH, HELD_OUT = 20_000, 1 << 14, 0.1, 5
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
#: Projected gradient with momentum: the largest deviation of a share, or change of all deviations, that ends it, and the most rounds.
CLOSE, STILL, ROUNDS = 1e-6, 1e-7, 2000
#: Rounds after which the documents' rates are written, so that no round repeats more than these.
STATE = 25
#: Sources with a target at most; they are held on the driver.
MAX_SOURCES = 1000
#: Parts of a use in the exact sums of rates.
UNIT = 1_000_000
OTHER = "(no target)"

_WORD = re.compile(r"\w+|[^\w\s]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_tokenizer(path: str, pattern: str | None = None):
    """A byte-level BPE from a file of ranks. pattern: how it splits words; without one, that of the folder of public vocabularies."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_name(c: Column) -> Column:
    """Sources compare without case and outer blanks, hyphens and blanks as underscores; a blank one is none."""
    name = F.translate(F.lower(F.btrim(c, F.lit(BLANKS))), "- ", "__")
    return F.when(name != "", name)


@dataclass
class Targets:
    """names: the sources with a target and, last, OTHER; share and cap in their order."""

    names: list[str]
    share: np.ndarray
    cap: np.ndarray


def current_targets(targets: DataFrame) -> Targets:
    """Of each source the row set last. A null share counts as 0, null repeats as 1."""
    rows = (
        targets.select(source_name(F.col("source")).alias("s"), F.struct("set_at", "target_share", "max_repeats").alias("t")).filter("s is not null")
        .groupBy("s").agg(F.max("t").alias("t")).orderBy("s").limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    share = [max(0.0, r.t.target_share or 0.0) for r in rows]
    cap = [max(0, 1 if r.t.max_repeats is None else r.t.max_repeats) for r in rows]
    return Targets([*[r.s for r in rows], OTHER], np.array([*share, 0.0]), np.array([*cap, 0]))


def _features(text: str | None, repo: str | None, author: str | None, memo: dict[str, int]) -> list[int]:
    marks = [*_WORD.findall(text or ""), f"\0repo {repo}", f"\0author {author}"]
    out = []
    for w in marks:
        h = memo.get(w)
        if h is None:
            if len(memo) > 1_000_000:
                memo.clear()
            h = memo[w] = crc32(w.encode("utf-8", "replace")) % FEATURES
        out.append(h)
    return list(set(out))


@dataclass
class Classifier:
    """Naive Bayes over hashed words, repository and author; scores are tempered on held-out documents."""

    prior: np.ndarray
    weight: np.ndarray  # features x classes
    temperature: float = 1.0
    accuracy: float = 0.0
    held_out: int = 0

    def logits(self, features: list[int]) -> np.ndarray:
        return self.weight[features].sum(axis=0) * self.temperature + self.prior

    def posterior(self, features: list[int]) -> np.ndarray:
        x = self.logits(features)
        e = np.exp(x - x.max())
        return e / e.sum()


def fit_classifier(labelled: DataFrame, classes: int, sample: int = SAMPLE) -> Classifier:
    """labelled: doc, text, repo, author, k (class number). Fitted on a sample of at most about ``sample`` documents, drawn by a hash of doc; a fifth of them sets the temperature."""
    n = labelled.count()
    draw = labelled.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(min(1.0, sample / max(n, 1)) * 1_000_000)).withColumn("held", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(HELD_OUT)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros((FEATURES + 1) * classes, np.int64), {}
        for b in batches:
            for text, repo, author, k in zip(*[b.column(c).to_pylist() for c in ("text", "repo", "author", "k")]):
                total[np.array([*_features(text, repo, author, memo), FEATURES]) * classes + k] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": total[at]})

    t = draw.filter("not held").select("text", "repo", "author", "k").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # bounded by the features
    cells = np.zeros((FEATURES + 1) * classes)
    cells[t["cell"].to_numpy()] = t["n"].to_numpy()
    cells = cells.reshape(FEATURES + 1, classes)
    docs = cells[FEATURES]
    present = np.log((cells[:FEATURES] + SMOOTH) / (docs + 2 * SMOOTH))
    seen_by = np.where(docs > 0, docs, 0.0) if docs.any() else np.eye(classes)[-1]  # a source without samples gets nothing
    with np.errstate(divide="ignore"):
        prior = np.log(seen_by / seen_by.sum())
    model = Classifier(prior, (present - present.mean(axis=1, keepdims=True)).astype(np.float32))
    wire = labelled.sparkSession.sparkContext.broadcast(model)
    tries = len(TEMPERATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo, m = np.zeros(2 * tries + 1), {}, wire.value
        for b in batches:
            for text, repo, author, k in zip(*[b.column(c).to_pylist() for c in ("text", "repo", "author", "k")]):
                s = m.weight[_features(text, repo, author, memo)].sum(axis=0)
                for i, temp in enumerate(TEMPERATURES):
                    x = s * temp + m.prior
                    total[i] += min(50.0, np.log(np.exp(x - x.max()).sum()) + x.max() - x[k])  # a source without samples costs much, not all
                    total[tries + i] += int(np.argmax(x) == k)
                total[-1] += 1
        yield pa.RecordBatch.from_pydict({"i": np.arange(2 * tries + 1), "x": total})

    rows = draw.filter("held").select("text", "repo", "author", "k").mapInArrow(score, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    got = np.zeros(2 * tries + 1)
    for r in rows:
        got[r.i] = r.x
    best = int(np.argmin(got[:tries]))
    model.temperature = TEMPERATURES[best] if got[-1] else 1.0
    model.accuracy, model.held_out = float(got[tries + best] / got[-1] if got[-1] else 0.0), int(got[-1])
    return model


def memberships(docs: DataFrame, targets: Targets, doc_id: str, tokenizer: str) -> tuple[Classifier, DataFrame]:
    """The classifier, and doc, tokens, k (the source, or the likeliest) and post (null where the source is known) of each document."""
    names = {s: k for k, s in enumerate(targets.names)}
    classes = len(names)
    known = F.create_map(*[x for s, k in names.items() for x in (F.lit(s), F.lit(k))])
    name = source_name(F.col("source"))
    rows = docs.select(F.col(doc_id).alias("doc"), "text", "repo", "author", F.when(name.isNotNull(), F.coalesce(F.try_element_at(known, name), F.lit(classes - 1))).alias("k"))
    fitted = fit_classifier(rows.filter("k is not null"), classes)
    model = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, memo = load_tokenizer(tokenizer).encode_ordinary, {}
        for b in batches:
            text, repo, author, k = (b.column(c).to_pylist() for c in ("text", "repo", "author", "k"))
            tokens = [len(encode(t)) if t else 0 for t in text]
            post: list = [None] * len(k)
            for i, known in enumerate(k):
                if known is None:
                    post[i] = model.value.posterior(_features(text[i], repo[i], author[i], memo))
                    k[i] = int(np.argmax(post[i]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(tokens, pa.int64()), pa.array(k, pa.int32()), pa.array(post, pa.list_(pa.float64()))], names=["doc", "tokens", "k", "post"])

    return fitted, rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, tokens long, k int, post array<double>")


@dataclass
class Rates:
    """steps: momentum and scaled deviations of all rounds; a document's rate follows from them, its distribution and its cap. total: tokens of the whole mix. converged: whether the rounds ended by themselves; deviation: the largest of a share from its goal then."""

    start: np.ndarray
    steps: list[tuple[float, np.ndarray]]
    cap: np.ndarray
    total: float
    converged: bool = True
    deviation: float = 0.0

    def of(self, post: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rates of rows with distributions post and (likeliest) sources k."""
        cap = self.cap[k]
        r = np.minimum(post @ self.start, cap)
        return advance(post, r, r, cap, self.steps)[0]


def advance(post: np.ndarray, r: np.ndarray, was: np.ndarray, cap: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates now and one round before after these rounds, from those before them."""
    for momentum, s in steps:
        r, was = np.clip(r + (r - was) * momentum - post @ s, 0.0, cap), r
    return r, was


def _posts(b: pa.RecordBatch, rows: np.ndarray | None = None) -> np.ndarray:
    """The distributions of a batch (of some of its rows) as a matrix, without a Python object for each number."""
    a = b.column("post") if rows is None else b.column("post").take(pa.array(rows))
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def solve_rates(members: DataFrame, targets: Targets, total_tokens: float | None = None) -> Rates:
    """Projected gradient least squares for the rates.

    Minimises the squared deviations of the sources' expected tokens from their targets, each relative to what the source has, over rates
    between 0 and the cap of a document's source. Documents of one known source share a rate, so they are summed first; documents with a distribution are summed where it
    is the same and stay distributed with the rates of this round and the one before: a round sends each task the deviations since those rates were
    written (every STATE rounds) and gets one number for each source back.

    Without ``total_tokens`` the whole mix is as large as the caps allow with all shares met; a larger one leaves sources at their caps short of their shares. The share of sources without tokens is spread evenly over the others,
    which is the nearest that shares adding up to 1 can be. The rounds end when the deviations are small or stand still; ``converged`` says whether they did within ROUNDS."""
    classes = len(targets.names)
    fixed = np.zeros(classes)
    for r in members.filter("post is null").groupBy("k").agg(F.sum("tokens").alias("n")).collect():
        fixed[r.k] = r.n
    soft = cut(members.filter("post is not null").groupBy("post", "k").agg(F.sum("tokens").alias("n")))
    sc = members.sparkSession.sparkContext

    def add(f) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(classes)
            for b in batches:
                if b.num_rows:
                    total += f(b)
            yield pa.RecordBatch.from_pydict({"k": np.arange(classes), "x": total})

        out = np.zeros(classes)
        for r in soft.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[r.k] = r.x
        return out

    have = fixed + add(lambda b: b.column("n").to_numpy() @ _posts(b))
    usable = (have > 0) & (targets.cap > 0) & (targets.share > 0)
    if not usable.any():
        return Rates(np.zeros(classes), [], np.zeros(classes), 0.0)
    goal = np.where(usable, targets.share, 0.0)
    goal = np.where(usable, goal + (1 - goal.sum()) / usable.sum(), 0.0)
    goal = np.clip(goal, 0, None) / np.clip(goal, 0, None).sum()
    cap = np.where(usable, targets.cap, 0).astype(float)
    hard = usable & (goal > 0)
    total = float(total_tokens or (cap[hard] * have[hard] / goal[hard]).min())
    scale = np.where(have > 0, have / total, 1.0)
    rates, before = Rates(np.minimum(goal / scale, cap), [], cap, total, False), None
    one = np.eye(classes)
    kept = (np.minimum(one @ rates.start, cap), np.minimum(one @ rates.start, cap))
    held = 0  # rounds that the written state has

    def state(b: pa.RecordBatch, wire) -> tuple[np.ndarray, ...]:
        start, steps, cap, at = wire.value
        post, k = _posts(b), b.column("k").to_numpy()
        if at:
            r, was = b.column("r").to_numpy(), b.column("was").to_numpy()
        else:
            r = was = np.minimum(post @ start, cap[k])
        return post, *advance(post, r, was, cap[k], steps)

    t, cost = 0, np.inf  # rounds since the momentum was last taken away, and the squared deviations
    for _ in range(ROUNDS):
        momentum = t / (t + 3)
        wire = sc.broadcast((rates.start, rates.steps[held:], cap, held))

        def expected(b: pa.RecordBatch, wire=wire, momentum=momentum) -> np.ndarray:
            post, r, was = state(b, wire)
            return (b.column("n").to_numpy() * (r + (r - was) * momentum)) @ post

        if rates.steps:
            kept = advance(one, *kept, cap, rates.steps[-1:])
        now = (fixed * (kept[0] + (kept[0] - kept[1]) * momentum) + add(expected)) / total
        off = np.where(have > 0, now - goal, 0.0)
        rates.deviation = float(np.abs(off).max())
        if rates.deviation < CLOSE or before is not None and np.abs(off - before).max() < STILL:
            rates.converged = True
            break
        before = off
        rates.steps.append((momentum, off / scale))
        worse = (off**2 / scale).sum() > cost
        t, cost = 0 if worse else t + 1, (off**2 / scale).sum()
        if len(rates.steps) - held == STATE:
            wire = sc.broadcast((rates.start, rates.steps[held:], cap, held))

            def write(batches: Iterator[pa.RecordBatch], wire=wire) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        _, r, was = state(b, wire)
                        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("post", "k", "n")], pa.array(r), pa.array(was)], names=["post", "k", "n", "r", "was"])

            soft, held = cut(soft.mapInArrow(write, "post array<double>, k int, n long, r double, was double")), len(rates.steps)
    return rates


def _solved(docs: DataFrame, targets: DataFrame, doc_id: str, tokenizer: str | None, total_tokens: float | None) -> tuple[Targets, Classifier, DataFrame, Rates]:
    wanted = current_targets(targets)
    model, rows = memberships(docs, wanted, doc_id, tokenizer or default_tokenizer())
    members = cut(rows)
    return wanted, model, members, solve_rates(members, wanted, total_tokens)


def mix_report(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", tokenizer: str | None = None, total_tokens: float | None = None) -> DataFrame:
    """One row on how a mix came about: accuracy of the classifier on held-out documents (null if there are none), its temperature, rounds, converged, the largest deviation of an expected share, and the tokens of the mix."""
    _, model, _, rates = _solved(docs, targets, doc_id, tokenizer, total_tokens)
    row = (model.accuracy if model.held_out else None, model.held_out, model.temperature, len(rates.steps), rates.converged, rates.deviation, rates.total)
    return docs.sparkSession.createDataFrame([row], "accuracy double, held_out long, temperature double, rounds int, converged boolean, deviation double, total_tokens double")


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", tokenizer: str | None = None, total_tokens: float | None = None) -> DataFrame:
    """doc_id, source, tokens, uses, post: how often each document is used.

    docs: doc_id, text, source, repo, author; other columns are not read. source is the (spelled alike) source of a document, or the likeliest where it has
    none; (no target) where no target names it, which is never used. Of equal rows each counts. A document is used at most max_repeats times of its (likeliest) source; one without tokens, as with a
    null or empty text, not at all. Uses are the rates rounded along the documents of a source in order of size, so that its tokens come out within about one document. Empty tables give no rows, no targets no uses.
    """
    wanted, _, members, solved = _solved(docs, targets, doc_id, tokenizer, total_tokens)
    rates = members.sparkSession.sparkContext.broadcast(solved)
    classes = len(wanted.names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.eye(classes)
        single = rates.value.of(one, np.arange(classes))
        for b in batches:
            k, tokens = b.column("k").to_numpy(), b.column("tokens").to_numpy()
            r = single[k]
            post = b.column("post")
            soft = np.flatnonzero(post.is_valid().to_numpy(zero_copy_only=False))
            if len(soft):
                r = r.copy()
                r[soft] = rates.value.of(_posts(b, soft), k[soft])
            part = np.where(tokens > 0, np.round(r * UNIT), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    fields = f"doc {members.schema['doc'].dataType.simpleString()}, tokens long, k int, post array<double>, part long"
    run = range_scan(members.mapInArrow(rate, fields), ["k"], [F.col("tokens"), F.xxhash64("doc"), F.col("doc")], {"upto": ("sum", "part")})
    half = UNIT // 2
    uses = F.floor((F.col("upto") + half) / UNIT) - F.floor((F.col("upto") - F.col("part") + half) / UNIT)
    names = F.array(*[F.lit(s) for s in wanted.names])
    return run.select(F.col("doc").alias(doc_id), F.get(names, F.col("k")).alias("source"), "tokens", uses.cast("int").alias("uses"), "post")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, n_docs of a mix: its tokens by source, those of documents without one by their distribution; n_docs by the likeliest."""
    wanted = current_targets(targets)
    used = mixed.filter("uses > 0").withColumn("n", F.col("tokens") * F.col("uses"))
    known = used.groupBy("source").agg(F.sum(F.when(F.col("post").isNull(), F.col("n"))).cast("double").alias("tokens"), F.count("*").alias("n_docs"))
    parts = F.array(*[F.struct(F.lit(s).alias("source"), F.get("post", F.lit(k)).alias("p")) for k, s in enumerate(wanted.names)])
    soft = used.filter("post is not null").groupBy("post").agg(F.sum("n").alias("n")).select("n", F.explode(parts).alias("e")).groupBy("e.source").agg(F.sum(F.col("n") * F.col("e.p")).alias("tokens"), F.lit(0).cast("long").alias("n_docs"))
    by = known.unionByName(soft).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs"))
    spark = mixed.sparkSession
    goal = spark.createDataFrame([(s, float(x)) for s, x in zip(wanted.names, wanted.share)], "source string, target_share double")
    total = used.agg(F.sum("n")).first()[0] or 1
    return goal.join(by, "source", "left").select("source", "target_share", F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0.0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
