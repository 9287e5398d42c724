"""Prioritised merge of all sources into one catalog, and its graph of tables, columns and terms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.names import table_key_col
from catalith.session import cut, store
from catalith.sources.snapshots import Catalog

MAX_SAMPLES = 20
# What a join over a relation costs, by its kind.
JOIN_COST = {"foreign_key": 1.0, "relationship_test": 1.0, "join_hint": 1.0, "catalog_relation": 1.3, "lineage": 1.6, "inferred": 2.5}
UNKNOWN_COST = 2.0
AFFINITY = 1.0


def _first(value: str, rank: Column, ok: Column) -> Column:
    """The value of the most trusted row that has one."""
    return F.min(F.when(ok, F.struct(rank.alias("r"), F.col(value).alias("v"))))["v"]


def _ordered(items: str) -> Column:
    """Distinct values of collected (rank, value) structs by their first rank; a group's rows are those of one object over the sources."""
    return F.array_distinct(F.transform(F.array_sort(items), lambda x: x["v"]))


def merge_tables(cat: Catalog) -> DataFrame:
    """table_key, description, owner, row_count, kind, source, tags: the first of each field that is not blank in the order of sources; a plain kind gives way to the first other one; sources and tags are joined in order."""
    rank = F.struct("rank", "pos")
    t = cat.tables.withColumn("r", rank)
    tags = t.select("table_key", F.posexplode("tags").alias("tpos", "v"), "r").groupBy("table_key", "v").agg(F.min(F.struct("r", "tpos")).alias("r")).groupBy("table_key").agg(F.collect_list(F.struct("r", "v")).alias("tags")).select("table_key", _ordered("tags").alias("tags"))
    out = t.groupBy("table_key").agg(
        _first("description", F.col("r"), F.col("description").isNotNull()).alias("description"),
        _first("owner", F.col("r"), F.col("owner").isNotNull()).alias("owner"),
        _first("row_count", F.col("r"), F.col("row_count").isNotNull()).alias("row_count"),
        F.coalesce(_first("kind", F.col("r"), F.col("kind") != "table"), F.lit("table")).alias("kind"),
        F.collect_set(F.struct("rank", F.col("source").alias("v"))).alias("s"),
    )
    out = out.select("table_key", "description", "owner", "row_count", "kind", F.array_join(_ordered("s"), ",").alias("source"))
    return out.join(tags, "table_key", "left").withColumn("tags", F.coalesce(F.array_join("tags", ","), F.lit("")))


def merge_properties(cat: Catalog) -> DataFrame:
    """table_key, property, value: the union of the tables' properties, each as the most trusted source that has it says."""
    p = cat.tables.select("table_key", F.struct("rank", "pos").alias("r"), F.explode("properties").alias("property", "value")).filter("value is not null")
    return p.groupBy("table_key", "property").agg(F.min(F.struct("r", "value"))["value"].alias("value"))


def primary_keys(cat: Catalog) -> DataFrame:
    """table_key, primary_key: the columns that any source names as part of the table's key, in the order of their first listing, joined with commas."""
    c = cat.columns.groupBy("table_key", "col").agg(F.bool_or("is_primary_key").alias("key"), F.min(F.struct("rank", "pos", "cpos")).alias("r")).filter("key")
    return c.groupBy("table_key").agg(F.collect_list(F.struct("r", F.col("col").alias("v"))).alias("k")).select("table_key", F.array_join(_ordered("k"), ",").alias("primary_key"))


def column_extras(cat: Catalog) -> DataFrame:
    """table_key, col, tags (joined in the order of sources), business: the other name that a property gives a column."""
    c = cat.columns.withColumn("r", F.struct("rank", "pos", "cpos"))
    tags = c.select("table_key", "col", F.posexplode("tags").alias("tpos", "v"), "r").filter("v is not null").groupBy("table_key", "col", "v").agg(F.min(F.struct("r", "tpos")).alias("r")).groupBy("table_key", "col").agg(F.array_join(_ordered(F.collect_list(F.struct("r", "v"))), ",").alias("tags"))
    name = F.nullif(F.try_element_at("properties", F.lit("business_name")), F.lit(""))
    names = c.groupBy("table_key", "col").agg(F.min(F.when(name.isNotNull(), F.struct("r", name.alias("v"))))["v"].alias("business")).filter("business is not null")
    return tags.join(names, ["table_key", "col"], "full")


def merge_columns(cat: Catalog) -> DataFrame:
    """table_key, col, name, data_type, description, nullable, is_primary_key, samples, ord of each column of the merged tables; at most 20 samples, in order of sources; ord is the place of its first listing."""
    c = cat.columns.withColumn("r", F.struct("rank", "pos", "cpos"))
    blank = lambda f: F.col(f).isNotNull() & (F.col(f) != "")
    values = c.select("table_key", "col", "r", F.posexplode("sample_values").alias("spos", "v")).filter("v is not null").groupBy("table_key", "col", "v").agg(F.min(F.struct("r", "spos")).alias("r"))
    samples = values.groupBy("table_key", "col").agg(F.collect_list(F.struct("r", "v")).alias("s")).select("table_key", "col", F.slice(_ordered("s"), 1, MAX_SAMPLES).alias("samples"))
    out = c.groupBy("table_key", "col").agg(
        F.min(F.struct("r", "name"))["name"].alias("name"),
        _first("data_type", F.col("r"), blank("data_type")).alias("data_type"),
        _first("description", F.col("r"), blank("description")).alias("description"),
        _first("nullable", F.col("r"), F.col("nullable").isNotNull()).alias("nullable"),
        F.coalesce(F.bool_or("is_primary_key"), F.lit(False)).alias("is_primary_key"),
        F.min("r").alias("ord"),
    )
    return out.join(samples, ["table_key", "col"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def stubs(cat: Catalog) -> DataFrame:
    """table_key, name, source of the tables that only edges name: the last step is the name, sources are joined in order."""
    ends = cat.edges.select(F.explode(F.array("from_key", "to_key")).alias("table_key"), "rank", "source")
    missing = ends.join(cat.tables.select("table_key").distinct(), "table_key", "left_anti")
    return missing.groupBy("table_key").agg(F.collect_set(F.struct("rank", F.col("source").alias("v"))).alias("s")).select("table_key", F.element_at(F.split("table_key", "\\."), -1).alias("name"), F.array_join(_ordered("s"), ",").alias("source"))


def distinct_edges(cat: Catalog) -> DataFrame:
    """Each relation once, as its most trusted source states it."""
    key = ["kind", "from_key", "to_key", "from_columns", "to_columns"]
    return cat.edges.groupBy(*key).agg(F.min(F.struct("rank", "pos", "confidence", "source")).alias("m")).select(*key, F.col("m.confidence").alias("confidence"), F.col("m.source").alias("source"), F.struct("m.rank", "m.pos").alias("ord"))


def cost(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(c)) for k, c in JOIN_COST.items()], F.lit(UNKNOWN_COST))


def relations(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """u, v, weight, n_relations, affinity: one row for each pair of tables with a relation, u < v; weight is the least join cost, affinity (1 for every kind) what a walk goes by instead if asked. kinds: only these."""
    e = edges.filter("from_key <> to_key")
    e = e if kinds is None else e.filter(F.col("kind").isin(kinds))
    return e.groupBy(F.least("from_key", "to_key").alias("u"), F.greatest("from_key", "to_key").alias("v")).agg(F.min(cost(F.col("kind"))).alias("weight"), F.count("*").alias("n_relations"), F.lit(AFFINITY).alias("affinity"))


def lineage(edges: DataFrame) -> DataFrame:
    """table_key, upstream, downstream: the tables one lineage step away, sorted."""
    e = edges.filter("kind = 'lineage'")
    both = e.select(F.col("from_key").alias("table_key"), F.lit(None).cast("string").alias("u"), F.col("to_key").alias("d")).unionByName(e.select(F.col("to_key").alias("table_key"), F.col("from_key").alias("u"), F.lit(None).cast("string").alias("d")))
    return both.groupBy("table_key").agg(F.array_join(F.sort_array(F.collect_set("u")), ",").alias("upstream"), F.array_join(F.sort_array(F.collect_set("d")), ",").alias("downstream"))


def column_links(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """from_key, from_col, to_key, to_col of the column pairs that edges name where both columns exist; the longer list is cut."""
    n = F.least(F.size("from_columns"), F.size("to_columns"))
    pairs = edges.select("from_key", "to_key", F.explode(F.arrays_zip(F.slice("from_columns", 1, n).alias("a"), F.slice("to_columns", 1, n).alias("b"))).alias("p")).select("from_key", F.col("p.a").alias("from_col"), "to_key", F.col("p.b").alias("to_col")).distinct()
    c = columns.select("table_key", "col")
    left = c.select(F.col("table_key").alias("from_key"), F.col("col").alias("from_col"))
    right = c.select(F.col("table_key").alias("to_key"), F.col("col").alias("to_col"))
    return pairs.join(left, ["from_key", "from_col"], "left_semi").join(right, ["to_key", "to_col"], "left_semi").select("from_key", "from_col", "to_key", "to_col")


def merge_terms(cat: Catalog) -> DataFrame:
    """term, description, synonyms: terms by trimmed lower name, first description, synonyms joined in order."""
    t = cat.terms.withColumn("r", F.struct("rank", "pos"))
    syn = t.select("term", "r", F.posexplode("synonyms").alias("p", "v")).groupBy("term", "v").agg(F.min(F.struct("r", "p")).alias("r")).groupBy("term").agg(F.collect_list(F.struct("r", "v")).alias("s")).select("term", F.array_join(_ordered("s"), ",").alias("synonyms"))
    return t.groupBy("term").agg(_first("description", F.col("r"), F.col("description").isNotNull()).alias("description")).join(syn, "term", "left").withColumn("synonyms", F.coalesce("synonyms", F.lit("")))


def term_targets(cat: Catalog, columns: DataFrame) -> DataFrame:
    """term, target_table, target_col: a target is a table's full name, else a table's column (the table where it lacks the column), else the only table of that bare name, else nothing."""
    said = cat.terms.select("term", F.explode("targets").alias("target")).select("term", table_key_col(F.col("target")).alias("k")).filter("k is not null").distinct()
    tables = cat.tables.select("table_key").distinct()
    full = said.join(tables, said["k"] == tables["table_key"], "left").withColumnRenamed("table_key", "exact")
    steps = F.split("k", "\\.")
    full = full.withColumn("head", F.array_join(F.slice(steps, 1, F.size(steps) - 1), ".")).withColumn("tail", F.element_at(steps, -1))
    owners = tables.withColumnRenamed("table_key", "owner")
    full = full.join(owners, full["head"] == owners["owner"], "left")
    cols = columns.select(F.col("table_key").alias("ct"), F.col("col").alias("cc"))
    full = full.join(cols, (full["owner"] == cols["ct"]) & (full["tail"] == cols["cc"]), "left")
    bare = tables.groupBy(F.element_at(F.split("table_key", "\\."), -1).alias("bare")).agg(F.count("*").alias("n"), F.min("table_key").alias("only")).filter("n = 1")
    full = full.join(bare, full["k"] == bare["bare"], "left")
    return full.select("term", F.coalesce("exact", "owner", "only").alias("target_table"), F.when(F.col("exact").isNull(), F.col("cc")).alias("target_col")).filter("target_table is not null").distinct()


def graph_stats(cat: Catalog) -> DataFrame:
    """item, n: tables, stubs, columns, terms, relations and related pairs of the merged graph, and its sources."""
    edges = distinct_edges(cat)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    parts = [
        one("tables", cat.tables.select("table_key").distinct()), one("stubs", stubs(cat)), one("columns", cat.columns.select("table_key", "col").distinct()), one("terms", cat.terms.select("term").distinct()),
        one("relations", edges.filter("from_key <> to_key")), one("relation_pairs", relations(edges)), one("sources", cat.sources),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Pairs that one task unites; more go by rounds of joins. The labels are the same.
LOCAL_PAIRS = 2_000_000


def components(pairs: DataFrame, nodes: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """node, component (its least node) over undirected pairs(u, v): in one task where there are few pairs, else by rounds of label joins with pointer jumping, which grow with the logarithm of the longest path."""
    few = store(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
    if few.count() <= local_pairs:

        def unite(batches):
            head: dict[str, str] = {}

            def find(x: str) -> str:
                while (y := head.setdefault(x, x)) != x:
                    head[x] = head[y]
                    x = y
                return x

            for b in batches:
                for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                    x, y = find(u), find(v)
                    if x != y:
                        head[max(x, y)] = min(x, y)
            names = list(head)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([find(x) for x in names], pa.string())], names=["node", "c"])

        held = few.coalesce(1).mapInArrow(unite, "node string, c string")
        return nodes.join(held, "node", "left").select("node", F.coalesce("c", "node").alias("component"))
    both = cut(few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut(nodes.select("node", F.col("node").alias("c")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("n"))
        step = labels.join(near, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c1"), F.col("c").alias("c0"))
        jump = step.select(F.col("node").alias("c1"), F.col("c1").alias("c2"))
        nxt = cut(step.join(jump, "c1", "left").select("node", F.least("c1", F.coalesce("c2", "c1")).alias("c"), "c0"))
        done = nxt.filter("c <> c0").isEmpty()
        labels = nxt.select("node", "c")
        if done:
            return labels.select("node", F.col("c").alias("component"))
