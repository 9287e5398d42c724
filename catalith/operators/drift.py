"""One consistent table of files whose fields drift, and each change from file to file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from catalith.functions.jsontext import Incomplete, opened, parse
from catalith.operators.flooding import changes, correspondences, flood, kind_of, members
from catalith.operators.rangescan import range_scan
from catalith.session import cut

#: The most columns of the united table; ``file_members`` is the same in long form, for any number.
MAX_COLUMNS = 2000
#: The mean similarity, over all comparisons that correspondence was chosen in, from which two paths are one column.
LINK = 0.2
#: The name of the extra member of run files.
GENERATOR = "candidates.generator"


def _parsed(text: str | None):
    try:
        return True, parse(text) if text is not None else None
    except Incomplete:
        return False, None


def _marked(files: DataFrame) -> DataFrame:
    """The files and whether their config is complete JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("complete", pa.array([t is not None and _parsed(t)[0] for t in b.column("config").to_pylist()], pa.bool_()))

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("complete", BooleanType())]))


def _complete(files: DataFrame) -> DataFrame:
    """The files whose config is complete JSON."""
    return _marked(files).filter("complete").drop("complete")


def _opened(config):
    """The config with every text inside objects that is complete JSON of an object or list read as that."""
    config = opened(config)
    todo = [config]
    while todo:
        o = todo.pop()
        if isinstance(o, dict):
            for k, v in o.items():
                o[k] = opened(v)
                todo.append(o[k])
    return config


def compare_files(files: DataFrame, unite: bool = False) -> DataFrame:
    """Rows of two kinds for each file of a series and the one before it.

    files: file_id, series, at, config (JSON text), extra (a type or null: one more member named
    ``extra_name``, null if absent), extra_name. ``case`` rows: file_id, change_kind, old_path,
    new_path. ``member`` rows: series, seq, file_id, path, type, value, appeared (seq where the path
    was not in the file before). unite: texts that hold JSON are read as that, and instead of cases
    there are ``match`` rows: file_id, old_path, new_path, similarity of the correspondences that flooding chooses."""
    keep = ["file_id", "series", "config", "extra", "extra_name"]
    ordered = range_scan(_complete(files).select(*keep, "at"), ["series"], [F.col("at").asc_nulls_first(), F.col("file_id")], {"seq": ("row_number", None), "before": ("lag", "config"), "extra_before": ("lag", "extra")})
    schema = "kind string, file_id long, change_kind string, old_path string, new_path string, series string, seq long, path string, type string, value string, appeared long, similarity double"
    names = [c.split()[0] for c in schema.split(", ")]
    case = lambda fid, change, p, q, sim=None: ("match" if unite else "case", fid, change, p, q, None, None, None, None, None, None, sim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                now = parse(r["config"])
                first = r["seq"] == 1
                then = parse(r["before"]) if not first else None
                fid, series, seq, extra = r["file_id"], r["series"], r["seq"], r["extra_name"]
                if unite:
                    now, then = _opened(now), _opened(then)
                was, held = members(then), members(now)
                if not first and unite:
                    if was.keys() != held.keys():
                        sim = flood(was, held)
                        out += [case(fid, None, p, q, sim[p, q]) for p, q in correspondences(was, held, sim).items() if p != q]
                elif not first:
                    out += [case(fid, *c) for c in changes(then, now)]
                    if (r["extra"] is None) != (r["extra_before"] is None):
                        out.append(case(fid, *(("added", "", extra) if r["extra"] else ("removed", extra, ""))))
                for path, (_, v) in held.items():
                    text = None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
                    out.append(("member", fid, None, None, None, series, seq, path, kind_of(v), text, seq if first or path not in was else None, None))
                if r["extra"] is not None and not unite:
                    out.append(("member", fid, None, None, None, series, seq, extra, r["extra"], None, seq if first or r["extra_before"] is None else None, None))
            if out:
                cols = list(zip(*out))
                types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 3, pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return ordered.drop("at").mapInArrow(run, schema)


def schema_changes(files: DataFrame) -> DataFrame:
    """file_id, change_kind, old_path, new_path of each file against the one before it in its series.

    Files whose config is null or not complete JSON are left out; files of a series go by ``at``, then
    file_id, a null series is one of its own. A config that is no object has no members. change_kind
    ``type``: the type differs from the last one known since the path appeared (a null has none)."""
    rows = cut(compare_files(files))
    cases = rows.filter("kind = 'case'").select("file_id", "change_kind", "old_path", "new_path")
    typed = rows.filter("kind = 'member'").withColumn("typed", F.when(F.col("type").isNotNull(), F.col("seq"))).select("series", "path", "seq", "file_id", "type", "typed", "appeared")
    run = range_scan(typed, ["series", "path"], [F.col("seq")], {"since": ("last", "appeared"), "was": ("prev_last", "type"), "was_at": ("prev_last", "typed")})
    turned = run.filter("type is not null and was_at >= since and was <> type").select("file_id", F.lit("type").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    return cases.unionByName(turned)


def _side_by_side(values: DataFrame, paths: list[str]) -> set[tuple[str, str]]:
    """The pairs of these paths that some file holds both of; their number grows with the schemas."""
    if not paths:
        return set()
    some = values.join(F.broadcast(values.sparkSession.createDataFrame([(p,) for p in paths], "path string")), "path").groupBy("file_id").agg(F.array_sort(F.collect_set("path")).alias("paths")).select("paths").distinct()
    pairs = some.select(F.explode("paths").alias("a"), "paths").select("a", F.explode("paths").alias("b")).filter("a < b").distinct()
    return {(r["a"], r["b"]) for r in pairs.collect()}


def _linked(links: list[tuple[str, str]], used: dict[str, tuple], both: set[tuple[str, str]]) -> Callable[[str], str]:
    """The name that each path goes by: linked paths have one, unless a file holds two of those that would share it."""
    head, group = {p: p for p in used}, {p: [p] for p in used}
    for a, b in links:
        x, y = head[a], head[b]
        if x == y or any((min(p, q), max(p, q)) in both for p in group[x] for q in group[y]):
            continue
        big, small = sorted((x, y), key=lambda p: (-used[p][0], p))
        for p in group[small]:
            head[p] = big
        group[big] += group.pop(small)
    return head.__getitem__


def _kinds(values: DataFrame) -> DataFrame:
    """path, n, number, boolean, list: how many files hold it, and what its values can be cast to."""
    number = (F.col("type") == "number") | ((F.col("type") == "text") & F.expr("try_cast(value AS double) IS NOT NULL"))
    return values.filter("type is not null").groupBy("path").agg(
        F.count("*").alias("n"), (F.bool_and(number) & F.bool_or(F.col("type") == "number")).alias("number"), F.bool_and(number).alias("numeric"),
        F.bool_and(F.col("type") == "boolean").alias("boolean"), F.bool_or(F.col("type") == "list").alias("list"),
    )


def matches(rows: DataFrame) -> DataFrame:
    """a, b, n, similarity of the pairs of paths (a before b in the alphabet) that flooding matched: how often, and the mean similarity."""
    m = rows.filter("kind = 'match'")
    return m.groupBy(F.least("old_path", "new_path").alias("a"), F.greatest("old_path", "new_path").alias("b")).agg(F.count("*").alias("n"), F.avg(F.round("similarity", 6)).alias("similarity"))


def file_members(files: DataFrame) -> DataFrame:
    """file_id, path, type, value (text) of every member that is no object: the united table in long form, with each file's own paths, for any number of paths."""
    return compare_files(files, True).filter("kind = 'member' and coalesce(type, '') <> 'object'").select("file_id", "path", "type", "value")


def unite(files: DataFrame, extra: str | None = None) -> DataFrame:
    """One row for each file with one column for each member of all configs, members that correspond under one name.

    A file whose config is null or cut has a row too, with ``complete`` false and no members. The files' ``extra_value``
    comes under the name in ``extra``, if one is given. Texts that hold JSON objects or lists are read as those.
    Which paths are one column is decided by the correspondences of similarity flooding between each file and the one
    before it, those with the most similarity in all first, from a mean of LINK on; paths that some file holds
    side by side stay columns of their own, so no value is lost. A column bears the path that most files use. Casts: a column is a JSON list where any file has a list (a
    single value is a list of one), boolean where every value is one, double where some are numbers and all others read as
    numbers, else text. Objects get no column, their members do; columns are named by path, with ~2 and so on where names differ in case only.
    The matches and paths that reach the driver grow with the schemas, not with the files; more than
    ``MAX_COLUMNS`` columns are an error (see ``file_members``)."""
    return _unite(files, extra)[0]


def united_names(files: DataFrame) -> DataFrame:
    """path, name: the column that each member's path goes to."""
    return _unite(files, None)[1]


def _unite(files: DataFrame, extra: str | None) -> tuple[DataFrame, DataFrame]:
    rows = cut(compare_files(files, True))
    values = rows.filter("kind = 'member' and coalesce(type, '') <> 'object'")
    paths = values.select("path").distinct().join(_kinds(values), "path", "left").fillna({"n": 0})
    used = {r["path"]: r for r in paths.limit(MAX_COLUMNS + 1).collect()}
    if len(used) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} members: take file_members or raise MAX_COLUMNS")
    spark = files.sparkSession
    found = matches(rows).filter(F.col("similarity") >= LINK).collect()
    links = [(r["a"], r["b"]) for r in sorted(found, key=lambda r: (-r["n"] * r["similarity"], r["a"], r["b"])) if r["a"] in used and r["b"] in used]
    find = _linked(links, {p: (r["n"],) for p, r in used.items()}, _side_by_side(values, sorted({p for link in links for p in link})))
    kinds: dict[str, list] = {}
    for p, r in used.items():
        kinds.setdefault(find(p), []).append(r)
    said = lambda rs: [r for r in rs if r["n"]]
    kind = {}
    for h, rs in kinds.items():
        rs = said(rs)
        kind[h] = "list" if any(r["list"] for r in rs) else "boolean" if rs and all(r["boolean"] for r in rs) else "double" if any(r["number"] for r in rs) and all(r["numeric"] for r in rs) else "text"
    heads = sorted(kind)
    cell = {h: f"c{i}" for i, h in enumerate(heads)}
    titles, taken = {}, {"file_id", "series", "at", "complete", *([extra.lower()] if extra else [])}
    for h in heads:  # columns compare without case
        title, n = h, 1
        while title.lower() in taken:
            n += 1
            title = f"{h}~{n}"
        taken.add(title.lower())
        titles[h] = title
    told = [(p, cell[find(p)], kind[find(p)] == "list", titles[find(p)]) for p in sorted(used)]
    named = spark.createDataFrame(told, "path string, cell string, list boolean, name string")
    one = F.when(F.col("type") == "text", F.to_json(F.array("value"))).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    value = F.when(F.col("list") & (F.col("type") != "list"), one).otherwise(F.col("value"))
    wide = values.join(F.broadcast(named), "path").select("file_id", "cell", value.alias("value")).groupBy("file_id").pivot("cell", list(cell.values()) or [""]).agg(F.max("value"))
    cols = [(F.col(cell[h]).cast(kind[h]) if kind[h] in ("double", "boolean") else F.col(cell[h])).alias(titles[h]) for h in heads]
    ids = _marked(files).select("file_id", "series", "at", "complete", *([F.col("extra_value").alias(extra)] if extra else []))
    return ids.join(wide.select("file_id", *cols), "file_id", "left"), named.select("path", "name")


def run_files(legacy: DataFrame, mix: DataFrame, candidates: DataFrame) -> DataFrame:
    """The run files of both tables, one for each file_id (of rows that differ, the one received last), with the type of their candidates' generator.

    extra_value: JSON list of all generators of the run, by their first line; a text that is a list counts as its elements."""
    cols = ["file_id", "run_id", "series", "written_at", "received_at", "config"]
    both = legacy.select(*cols).unionByName(mix.select(*cols)).filter("file_id is not null")
    files = both.groupBy("file_id").agg(F.max(F.struct("received_at", "written_at", "series", "run_id", "config")).alias("f")).select("file_id", "f.*")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, each = [], []
            for t in b.column("generator").to_pylist():
                ok, v = _parsed(t)
                whole = ok and isinstance(v, (list, dict))
                kind.append(kind_of(v) if whole else "text")
                each.append([json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for x in (v if isinstance(v, list) else [v if whole else t])])
            yield pa.RecordBatch.from_arrays([b.column("run_id"), b.column("n"), pa.array(kind, pa.string()), pa.array(each, pa.list_(pa.string()))], names=["run_id", "n", "type", "each"])

    told = candidates.filter("generator is not null and run_id is not null").groupBy("run_id", "generator").agg(F.min("line_no").alias("n"))
    gens = told.select("run_id", "n", "generator").mapInArrow(kinds, "run_id string, n long, type string, each array<string>")
    every = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "each"))), lambda x: x["each"])))
    runs = gens.groupBy("run_id").agg(F.min(F.struct("n", "type"))["type"].alias("extra"), F.concat(F.lit("["), F.array_join(every, ","), F.lit("]")).alias("extra_value"))
    return files.join(runs, "run_id", "left").select("file_id", "series", F.col("written_at").alias("at"), "config", "extra", F.lit(GENERATOR).alias("extra_name"), "extra_value")
