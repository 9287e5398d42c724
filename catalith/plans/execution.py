"""Guarded execution of untrusted SQL: one read-only query, bounded rows, bounded cost, bounded time."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHARS, TEXT_CUT, MAX_ROWS = 50_000, 200, 1_000_000
MAX_JOIN_ROWS = 10**10
#: Plan nodes that read and compute; any other node in a parsed statement is refused.
ALLOWED = """
    Project Filter Join Aggregate Sort GlobalLimit LocalLimit LimitAll Offset Distinct Union Intersect Except Window WithWindowDefinition SubqueryAlias UnresolvedSubqueryColumnAliases
    UnresolvedRelation UnresolvedInlineTable UnresolvedWith UnresolvedWithCTERelations OneRowRelation Generate LateralJoin Pivot Unpivot UnresolvedHaving UnresolvedTableValuedFunction UnresolvedTVFAliases
    Expand GroupingSets Sample UnresolvedHint Tail LocalRelation ResolvedInlineTable UnionLoop UnionLoopRef CTERelationDef WithCTE UnresolvedOrdinal UnresolvedEventTimeWatermark AsOfJoin Deduplicate
""".split()
#: Functions that reach outside the query.
DENIED_FUNCTIONS = set("java_method reflect try_reflect read_files current_catalog current_database current_schema current_user user session_user version input_file_name input_file_block_start input_file_block_length http_request ai_query".split())
TABLE_FUNCTIONS = set("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple sequence variant_explode variant_explode_outer".split())
FILE_NAME = re.compile(r"[/\\]|://|\.(csv|tsv|parquet|json|jsonl|ndjson|orc|avro|txt|xlsx?|db|duckdb|sqlite)$", re.I)
FILE_FORMATS = set("parquet csv json orc avro text binaryfile delta jdbc xml".split())


class Refused(ValueError):
    """The guard's reason."""


@dataclass
class Result:
    ok: bool
    error: str | None = None
    error_kind: str | None = None  # guard, syntax, runtime, timeout, row_cap, cost
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    row_count: int = 0
    row_count_capped: bool = False
    elapsed_ms: float = 0.0


def normalize(text: str) -> str:
    """Without a code fence, outer blanks and one closing semicolon."""
    t = text.strip()
    m = re.fullmatch(r"```[a-zA-Z0-9]*\s*\n?(.*?)```", t, re.S)
    t = (m.group(1) if m else t).strip()
    return t[:-1].rstrip() if t.endswith(";") else t


def _nodes(plan) -> list:
    """All logical plan nodes of a parsed plan, those in subqueries too, by the plan's own traversal."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        for seq in (p.children(), p.innerChildren(), p.subqueries()):
            todo += [seq.apply(i) for i in range(seq.size()) if "plans.logical" in seq.apply(i).getClass().getName() or "catalyst.analysis" in seq.apply(i).getClass().getName()]
    return out


def guard(spark: SparkSession, text: str) -> str:
    """The statement's text if it is exactly one query that only reads tables, else Refused. Nothing is executed or analysed."""
    sql = normalize(text)
    if not sql:
        raise Refused("empty statement")
    if len(sql) > MAX_CHARS:
        raise Refused(f"longer than {MAX_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("not one parsable query: " + str(getattr(e, "getMessage", lambda: e)()).split("\n")[0][:300]) from None
    for n in _nodes(plan):
        kind = n.getClass().getSimpleName()
        if kind not in ALLOWED:
            raise Refused(f"{kind} is not part of a read-only query")
        if kind == "UnresolvedRelation":
            parts = [n.multipartIdentifier().apply(i) for i in range(n.multipartIdentifier().size())]
            if parts[0].lower() in FILE_FORMATS and len(parts) > 1 or any(FILE_NAME.search(p) for p in parts):
                raise Refused(f"{'.'.join(parts)} names a file")
        if kind == "UnresolvedTableValuedFunction":
            name = n.name().apply(n.name().size() - 1).lower()
            if name not in TABLE_FUNCTIONS:
                raise Refused(f"table function {name}")
    for name in re.findall(r'"nameParts":"\[([^\]"]*)\]"', plan.toJSON()):
        if name.split(",")[-1].strip().lower() in DENIED_FUNCTIONS:
            raise Refused(f"function {name}")
    for name in re.findall(r"([A-Za-z_][A-Za-z0-9_]*)\s*`?\s*\(", sql):
        if name.lower() in DENIED_FUNCTIONS:
            raise Refused(f"function {name}")
    return sql


def row_limit(spark: SparkSession, sql: str) -> int | None:
    """The count of a literal LIMIT at the top, else None."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(normalize(sql))
    if plan.getClass().getSimpleName() == "GlobalLimit" and re.fullmatch(r"\d+", plan.limitExpr().toString()):
        return int(plan.limitExpr().toString())
    return None


#: An equality in a join's condition, null-safe or not; bounds are none.
_EQUAL = re.compile(r"<=>| = ")


def join_cost(df: DataFrame) -> tuple[float, str]:
    """The most rows that one join of the optimised plan is estimated to make, and which; 0 where the tables have no statistics."""
    worst, what = 0.0, ""
    jvm = df.sparkSession._jvm.org.apache.spark.sql.classic.SparkSession
    jvm.setActiveSession(df.sparkSession._jsparkSession)  # its settings decide how rows are estimated
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        kids = [p.children().apply(i) for i in range(p.children().size())]
        if p.getClass().getSimpleName() == "Join":
            counts = [k.stats().rowCount() for k in kids]
            own = p.stats().rowCount()
            keyed = bool(_EQUAL.search(p.condition().get().toString() if p.condition().isDefined() else ""))
            rows = float(str(own.get())) if own.isDefined() else 0.0
            if not keyed and all(c.isDefined() for c in counts):
                rows = max(rows, float(str(counts[0].get())) * float(str(counts[1].get())))
            if rows > worst:
                worst, what = rows, p.simpleString(5)[:120]
        todo += kids
    return worst, what


def cell(v):
    """A value as it is shown: long texts cut, bytes by their size, other types as text."""
    if v is None or isinstance(v, (bool, int, float)):
        return v
    if isinstance(v, (bytes, bytearray)):
        return f"<blob {len(v)} bytes>"
    s = v if isinstance(v, str) else str(v) if not isinstance(v, Decimal) else format(v, "f")
    return s if len(s) <= TEXT_CUT else s[:TEXT_CUT] + "…"


class Executor:
    """Queries over the temporary views of a session of its own; paths can't be queried."""

    def __init__(self, spark: SparkSession, max_join_rows: float = MAX_JOIN_ROWS):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.spark.conf.set("spark.sql.cbo.enabled", "true")
        self.max_join_rows = max_join_rows
        self.plan = lru_cache(256)(self._plan)

    @classmethod
    def over_folder(cls, spark: SparkSession, folder: str, names: list[str], **kw) -> Executor:
        e = cls(spark, **kw)
        for n in names:
            e.spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
        return e

    def _plan(self, text: str) -> tuple[DataFrame | None, str | None, str | None]:
        """(query, error, kind); the query is analysed, not run."""
        try:
            return self.spark.sql(guard(self.spark, text)), None, None
        except Refused as e:
            return None, str(e), "guard"
        except (ParseException, AnalysisException) as e:
            return None, str(e).split("\n")[0], "syntax"
        except PySparkException as e:
            return None, str(e).split("\n")[0], "runtime"

    def execute(self, text: str, limit: int = 20, count_cap: int | None = None, timeout: float = 30.0) -> Result:
        """Rows up to ``limit``, counted up to ``count_cap``; never raises. One row more than the cap is fetched, which tells exactly the cap from more."""
        begin = time.time()
        df, error, kind = self.plan(text)
        if df is None:
            return Result(False, error, kind)
        try:
            cost, what = join_cost(df)
        except Exception as e:  # constants are computed while planning
            return Result(False, str(e).split("\n")[0][:300], "runtime")
        if cost > self.max_join_rows:
            return Result(False, f"a join is estimated at {cost:.3g} rows: {what}", "cost")
        cap = min(max(limit, count_cap or 0, 0), MAX_ROWS)
        tag, sc, late = f"q-{uuid.uuid4().hex}", self.spark.sparkContext, threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            rows = df.limit(cap + 1).collect()
        except Exception as e:
            return Result(False, "stopped after %g s" % timeout if late.is_set() else str(e).split("\n")[0][:300], "timeout" if late.is_set() else "runtime")
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        return Result(True, None, None, df.columns, [tuple(map(cell, r)) for r in rows[:limit]], min(len(rows), cap), len(rows) > cap, (time.time() - begin) * 1000)


def result_findings(rows: DataFrame, largest_table: int, may_explode: bool = False) -> list[tuple[str, float]]:
    """(code, penalty) of a result: empty, columns without any value, more than twice the rows of the largest table read. One pass."""
    row = rows.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(rows.columns)]).first()
    if row["_n"] == 0:
        return [("empty_result", 0.3)]
    out = [("all_null", 0.15)] * sum(row[f"c{i}"] == 0 for i in range(len(rows.columns)))
    return out + ([("row_explosion", 0.3)] if not may_explode and row["_n"] > 2 * largest_table else [])


# Spellings of a missing value in a result file.
NA = set(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])


def infer_kind(cells: list[str]) -> str:
    """int, float, bool, object or na of a column of a result file."""
    some = [c for c in cells if c not in NA]
    number = lambda c: "_" not in c and bool(re.fullmatch(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\s*", c, re.I))
    if not some:
        return "na"
    if all(re.fullmatch(r"\s*[+-]?\d+\s*", c) for c in some):
        return "int" if len(some) == len(cells) else "float"
    if all(map(number, some)):
        return "float"
    if all(c.lower() in ("true", "false") and c in ("True", "TRUE", "true", "False", "FALSE", "false") for c in some):
        return "bool" if len(some) == len(cells) else "object"
    return "object"


def same_column(a: list, b: list, ignore_order: bool = False, abs_tol: float = 1e-2) -> bool:
    """Whether two result columns agree: missing as 0, numbers within the tolerance, other values equal."""
    clean = lambda v: 0 if v is None or v != v else v
    a, b = list(map(clean, a)), list(map(clean, b))
    if len(a) != len(b):
        return False
    number = lambda v: isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
    if ignore_order:
        by = lambda v: (v is None, str(v), number(v))
        a, b = sorted(a, key=by), sorted(b, key=by)
    return all(abs(float(x) - float(y)) <= max(abs_tol, 1e-9 * max(abs(float(x)), abs(float(y)))) if number(x) and number(y) else x == y for x, y in zip(a, b))


def same_table(predicted: dict[str, list], gold: dict[str, list], condition: list[int] | None = None, ignore_order: bool = False) -> bool:
    """Whether each (wanted) gold column agrees with some predicted column; more columns and their order don't matter."""
    want = list(gold.values())
    want = [want[i] for i in condition] if condition else want
    return all(any(same_column(p, g, ignore_order) for p in predicted.values()) for g in want)
