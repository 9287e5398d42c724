"""The best representative of each group of records, built from consistent bundles.

Fields that depend on each other form a bundle, which is taken whole from one record. For each group,
branch and bound chooses one candidate of each bundle so that the total trust is largest and the
functional dependencies between chosen values hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.names import BLANKS, EMPTY_PHRASES
from catalith.operators.payloads import listed_tables
from catalith.session import cut

#: Candidates of each bundle that the first search looks at; a group whose optimum they don't prove is searched again with four times as many.
FIRST_DEPTH = 4


def branch_and_bound(options: list[int], weights: list[float], allowed) -> tuple[float, list[int | None]]:
    """The choice of one of ``options[b]`` ranked candidates (or none) for each bundle with the largest total trust, weights[b] / rank.

    allowed(b, pick, picks): whether candidate ``pick`` of bundle ``b`` fits the picks of earlier bundles.
    Of equal totals the one with better ranks in earlier bundles comes out."""
    n = len(options)
    best_rest = [0.0] * (n + 1)
    for b in range(n - 1, -1, -1):
        best_rest[b] = best_rest[b + 1] + (weights[b] if options[b] else 0)
    top: list = [-1.0, []]
    picks: list[int | None] = []

    def go(b: int, total: float) -> None:
        if b == n:
            if total > top[0] + 1e-12:
                top[0], top[1] = total, list(picks)
            return
        for pick in [*range(options[b]), None]:
            gain = weights[b] / (pick + 1) if pick is not None else 0.0
            if total + gain + best_rest[b + 1] <= top[0] + 1e-12:
                break  # later candidates are trusted less
            if pick is None or allowed(b, pick, picks):
                picks.append(pick)
                go(b + 1, total + gain)
                picks.pop()

    go(0, 0.0)
    return top[0], top[1]


def filled(c: Column) -> Column:
    """Whether a value says something."""
    return c.isNotNull() & ~F.lower(F.btrim(c.cast("string"), F.lit(BLANKS))).isin(*EMPTY_PHRASES)


def survivors(records: DataFrame, key: str, source: str, trust: list[Column], bundles: list[list[str]], fds: list[tuple[str, str]] = (), weights: list[float] | None = None, depth: int = FIRST_DEPTH) -> DataFrame:
    """(key, field, value, source): the surviving record of each key, field by field.

    records: one row for each record, with texts in the bundles' fields. Bundles are in the order of their importance; ``weights`` (default 1 each) is what
    the best candidate of each is worth, the one of rank r a part of 1/r. Candidates of a bundle rank by the number of filled fields (null and
    empty phrases aren't filled), then by ``trust`` (columns in order, best first), then by source and value; a value that several
    records give has its best rank. A dependency (x, y) says that a chosen x fixes y: a chosen pair of filled
    values must occur together in a record of the key. A bundle without a fitting candidate gives no row, nor does a
    field that isn't filled. Rows with a null key are left out; repeated rows change nothing; an empty table gives no rows.

    Equal candidates are pre-aggregated and only the best few of each bundle reach a task, so a key may hold any
    share of the rows. The search proves its optimum with a bound on all candidates that it has not seen; keys for
    which it can't are searched again, deeper, until it can.
    """
    fields = [f for b in bundles for f in b]
    of = {f: i for i, b in enumerate(bundles) for f in b}
    if len(of) != len(fields):
        raise ValueError("a field is in two bundles")
    weights = list(weights or [1.0] * len(bundles))
    base = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(source).alias("src"), F.struct(*trust).alias("t"), *[F.when(filled(F.col(f)), F.col(f).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)])
    column = {f: f"f{i}" for i, f in enumerate(fields)}
    parts = [
        F.struct(F.lit(i).alias("b"), sum(F.col(column[f]).isNull().cast("int") for f in b).alias("empty"), F.to_json(F.array(*[F.col(column[f]) for f in b]), {"ignoreNullFields": "false"}).alias("value"))
        for i, b in enumerate(bundles)
    ]
    each = base.select("k", "src", "t", F.explode(F.array(*parts)).alias("p")).select("k", "src", "t", "p.*")
    sizes = F.array(*[F.lit(len(b)) for b in bundles])
    each = each.filter(F.col("empty") < F.get(sizes, F.col("b")))
    ranked = cut(each.groupBy("k", "b", "value").agg(F.min(F.struct("empty", "t", "src")).alias("o")))
    order = Window.partitionBy("k", "b").orderBy("o", "value")
    pairs = None
    for n, (x, y) in enumerate(fds):
        p = base.filter(F.col(column[x]).isNotNull() & F.col(column[y]).isNotNull()).select("k", F.lit(-1 - n).alias("b"), F.col(column[x]).alias("value"), F.col(column[y]).alias("src")).distinct()
        pairs = p if pairs is None else pairs.unionByName(p)
    pairs = cut(pairs) if pairs is not None else None
    out, left = None, None
    while True:
        seen = ranked if left is None else ranked.join(left, "k", "left_semi")
        cand = seen.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= depth + 1).select("k", "b", "pos", "value", F.col("o.src").alias("src"))
        if pairs is not None:
            held = cut(cand)
            for n, (x, y) in enumerate(fds):
                pick = lambda f, name: held.filter(F.col("b") == of[f]).select("k", F.get(F.from_json("value", "array<string>"), bundles[of[f]].index(f)).alias(name)).distinct()
                fit = pairs.filter(F.col("b") == -1 - n).join(pick(x, "value"), ["k", "value"], "left_semi").join(pick(y, "src"), ["k", "src"], "left_semi")
                cand = (held if n == 0 else cand).unionByName(fit.select("k", "b", F.lit(0).alias("pos"), "value", "src"))
        found = cand.repartition("k").sortWithinPartitions("k", "b", "pos").mapInArrow(_search(bundles, list(fds), of, weights, depth), "k string, field string, value string, source string, proved boolean")
        if not fds:
            return found.select(F.col("k").alias(key), "field", "value", "source")  # without dependencies the best of each bundle is the optimum
        found = cut(found)
        good = found.filter("proved and field is not null")
        out = good if out is None else out.unionByName(good)
        left = found.filter("not proved").select("k").distinct()
        if left.isEmpty():
            return out.select(F.col("k").alias(key), "field", "value", "source")
        depth *= 4


def _search(bundles: list[list[str]], fds: list[tuple[str, str]], of: dict[str, int], weights: list[float], depth: int):
    def solve(key: str, rows: list[tuple]) -> Iterator[tuple]:
        options: list[list[tuple]] = [[] for _ in bundles]
        fits: dict[int, set] = {n: set() for n in range(len(fds))}
        for b, value, src in rows:
            if b < 0:
                fits[-1 - b].add((value, src))
            else:
                options[b].append((json.loads(value), src))
        more = [b for b, o in enumerate(options) if len(o) > depth]
        options = [o[:depth] for o in options]

        def value(f: str, picks: list) -> str | None:
            pick = picks[of[f]]
            return None if pick is None else options[of[f]][pick][0][bundles[of[f]].index(f)]

        def allowed(b: int, pick: int, picks: list) -> bool:
            all_picks = [*picks, pick]
            for n, (x, y) in enumerate(fds):
                if max(of[x], of[y]) == b:
                    v, w = value(x, all_picks), value(y, all_picks)
                    if v is not None and w is not None and (v, w) not in fits[n]:
                        return False
            return True

        total, picks = branch_and_bound([len(o) for o in options], weights, allowed)
        best = sum(w for w, o in zip(weights, options) if o)
        proved = all(best - weights[b] + weights[b] / (depth + 1) <= total + 1e-12 for b in more)
        if not proved:
            yield key, None, None, None, False
            return
        for b, pick in enumerate(picks):
            if pick is not None:
                values, src = options[b][pick]
                for f, v in zip(bundles[b], values):
                    if v is not None:
                        yield key, f, v, src, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("k", "b", "value", "src")])

        out: list[tuple] = []
        types = [pa.string()] * 4 + [pa.bool_()]
        names = ["k", "field", "value", "source", "proved"]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        for key, group in groupby(rows(), key=lambda r: r[0]):
            out.extend(solve(key, [r[1:] for r in group]))  # at most depth + 1 rows of each bundle
            if len(out) >= 10_000:
                yield pack()
                out = []
        if out:
            yield pack()

    return run


# The priority that a source type has where its connection has none.
PRIORITIES = {"user": 0, "collibra": 10, "dbt": 20, "unity_catalog": 30, "duckdb": 40, "ddl": 50, "aws_glue": 60}
OTHER_PRIORITY = 70


def described_tables(snapshots: DataFrame, connections: DataFrame) -> DataFrame:
    """One row for each table that the latest build of a source lists, if two or more sources list it: table_key, source, not_user, priority, built_at and the fields.

    A latest build whose payload is null or cut lists nothing. Snapshots without a source are left out."""
    light = snapshots.filter("source is not null").groupBy("source").agg(F.max(F.struct("built_at", "snap_id")).alias("m")).select("source", F.col("m.built_at").alias("built_at"), F.col("m.snap_id").alias("snap_id"))
    same = (snapshots["source"] == light["source"]) & snapshots["built_at"].eqNullSafe(light["built_at"]) & snapshots["snap_id"].eqNullSafe(light["snap_id"])
    last = snapshots.join(light, same, "left_semi")
    listed = listed_tables(last, ["source", "source_type", "built_at"])
    kind = F.translate(F.lower(F.btrim(F.coalesce("source_type", F.lit("")), F.lit(BLANKS))), "-", "_")
    named = connections.filter("name is not null").groupBy("name").agg(F.max(F.struct("updated_at", "created_at", "priority"))["priority"].alias("own"))
    default = F.coalesce(*[F.when(kind == k, F.lit(p)) for k, p in PRIORITIES.items()], F.lit(OTHER_PRIORITY))
    rows = listed.join(named, listed["source"] == named["name"], "left").select("table_key", "source", (kind != "user").alias("not_user"), F.coalesce("own", default).alias("priority"), "built_at", "pos", "description", "owner", "row_count", "kind")
    rows = cut(rows)
    shared = rows.groupBy("table_key").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a <> b").select("table_key")
    return rows.join(shared, "table_key", "left_semi")


def trust_order() -> list[Column]:
    """Sources from the most to the least trusted: user first, then the lower priority, the later build, the name."""
    later = F.coalesce(-F.unix_micros("built_at"), F.lit(2**62))
    return [F.col("not_user"), F.col("priority"), later.alias("later"), F.col("source"), F.col("pos")]
