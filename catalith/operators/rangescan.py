"""Exact running results over groups of any size.

A window per group puts the whole group into one task. Here the rows are range-partitioned on
(group, order), so that a group of any size is spread over many tasks; each task leaves the state
of its last group (one row a task), the states are folded on the driver in partition order, and a
second pass over the same sorted rows adds what came before.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.session import cut

KINDS = ("row_number", "sum", "last", "prev_last", "lag")


def group_key(*cols: str) -> Column:
    """One string for several columns; different tuples give different strings, null is a value of its own."""
    if len(cols) == 1:
        return F.coalesce(F.concat(F.lit("v"), F.col(cols[0]).cast("string")), F.lit("n"))
    part = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n:")) for c in cols]
    return F.concat(*part)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each row the index of the first row of its run of equal keys."""
    n = len(keys)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


class _Scan:
    """Running state of one sorted partition, batch by batch."""

    def __init__(self, ops: dict[str, tuple[str, str | None]], key: str | None, state: dict | None):
        self.ops, self.key, self.state = ops, key, state or {}

    def batch(self, b: pa.RecordBatch, want: bool) -> dict[str, pa.Array]:
        keys = b.column("_k").to_numpy(zero_copy_only=False)
        n = len(keys)
        start = _starts(keys)
        carried = self.key is not None and keys[0] == self.key
        first = start == 0 if carried else np.zeros(n, bool)
        out, state = {}, {}
        idx = np.arange(n)
        last_start = int(start[-1])
        old = self.state if carried and last_start == 0 else {}
        for name, (kind, col) in self.ops.items():
            if kind == "row_number":
                before = self.state[name] if carried else 0
                if want:
                    out[name] = pa.array(idx - start + 1 + np.where(first, before, 0), pa.int64())
                state[name] = n - last_start + old.get(name, 0)
            elif kind == "sum":
                v = b.column(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                run = total - (total[start] - v[start])
                before = self.state[name] if carried else 0
                run = run + np.where(first, before, 0)
                if want:
                    out[name] = pa.array(run, pa.int64())
                state[name] = int(run[-1])
            else:
                arr = b.column(col)
                valid = np.ones(n, bool) if kind == "lag" else arr.is_valid().to_numpy(zero_copy_only=False)
                upto = np.maximum.accumulate(np.where(valid, idx, -1))
                upto = np.where(upto >= start, upto, -1)
                end = int(upto[-1])
                if want:
                    at = upto
                    if kind != "last":
                        at = np.empty(n, np.int64)
                        at[0] = -1
                        at[1:] = upto[:-1]
                        at = np.where(idx == start, -1, at)
                    before = self.state.get(name) if carried else None
                    pool = pa.concat_arrays([arr, pa.array([before], arr.type)])
                    take = np.where(at >= 0, at, np.where(first, n, -1))
                    out[name] = pool.take(pa.array(take, pa.int64(), mask=take < 0))
                state[name] = arr[end].as_py() if end >= 0 else old.get(name)
        self.key, self.state = keys[-1], state
        return out


def _merge(ops: dict, a: dict, b: dict) -> dict:
    out = {}
    for name, (kind, _) in ops.items():
        if kind in ("row_number", "sum"):
            out[name] = a[name] + b[name]
        elif kind == "lag":
            out[name] = b[name]
        else:
            out[name] = a[name] if b[name] is None else b[name]
    return out


def range_scan(df: DataFrame, keys: list[str], order: list[Column], ops: dict[str, tuple[str, str | None]], keep: Column | None = None) -> DataFrame:
    """Adds running columns to ``df``, computed within the groups of ``keys`` in the given ``order``.

    ops: name -> (kind, column). row_number counts from 1; sum (of whole numbers, null as 0) and last
    (the last value that is not null) include the row itself; prev_last and lag do not, and lag
    gives null as a value. ``order`` has to be total within a group for a defined result.
    keep: a filter on the result. A null key is a group like any other; an empty table gives an
    empty result. Names that start with ``_k`` or ``_pid`` are not allowed in ``df``.
    """
    assert all(kind in KINDS for kind, _ in ops.values())
    plain = df.withColumn("_k", group_key(*keys))
    sort = [F.col("_k"), *order]
    rows = cut(plain.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_pid", F.spark_partition_id()))
    need = list(dict.fromkeys(["_k", "_pid", *(c for _, c in ops.values() if c)]))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, first, pid = _Scan(ops, None, None), None, None
        for b in batches:
            if b.num_rows:
                if first is None:
                    first, pid = b.column("_k")[0].as_py(), b.column("_pid")[0].as_py()
                scan.batch(b, False)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first": [first], "last": [scan.key], "state": [pickle.dumps(scan.state)]})

    # One row for each partition: bounded by the number of partitions, not by the rows.
    ends = rows.select(*need).mapInArrow(tails, "pid int, first string, last string, state binary").collect()
    carry: dict[int, tuple[str, dict]] = {}
    key, state = None, None
    for r in sorted(ends, key=lambda r: r.pid):
        if key is not None:
            carry[r.pid] = (key, state)
        own = pickle.loads(bytes(r.state))
        state = _merge(ops, state, own) if key == r.first == r.last else own
        key = r.last
    shared = df.sparkSession.sparkContext.broadcast(carry)
    types = {f.name: f.dataType for f in rows.schema.fields}
    out_type = {n: T.LongType() if kind in ("row_number", "sum") else types[c] for n, (kind, c) in ops.items()}
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("_k", "_pid")], *[T.StructField(n, t) for n, t in out_type.items()]])
    names = [f.name for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for b in batches:
            if b.num_rows:
                if s is None:
                    s = _Scan(ops, *shared.value.get(b.column("_pid")[0].as_py(), (None, None)))
                new = s.batch(b, True)
                yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n) for n in names], names=names)

    out = rows.mapInArrow(scan, schema)
    return out if keep is None else out.filter(keep)
