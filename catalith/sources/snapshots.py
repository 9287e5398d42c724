"""The merged catalog's inputs: tables, columns, edges and terms of each source's latest build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.names import BLANKS, table_key_col
from catalith.session import cut

# The rank of a source type where its connection has no priority.
SOURCE_PRIORITY = {"user": 0, "collibra": 10, "dbt": 20, "unity_catalog": 30, "duckdb": 40, "ddl": 50, "aws_glue": 60}
DEFAULT_PRIORITY = 70

_COLUMN = "struct<name: string, data_type: string, description: string, nullable: boolean, is_primary_key: boolean, sample_values: array<string>, tags: array<string>, properties: map<string, string>>"
_TABLE = f"struct<name: string, schema: string, catalog: string, kind: string, description: string, owner: string, row_count: bigint, tags: array<string>, properties: map<string, string>, columns: array<{_COLUMN}>>"
_EDGE = "struct<kind: string, from_table: string, to_table: string, from_columns: array<string>, to_columns: array<string>, description: string, confidence: double>"
_TERM = "struct<name: string, description: string, synonyms: array<string>, targets: array<string>>"
PAYLOAD = f"struct<tables: array<{_TABLE}>, edges: array<{_EDGE}>, terms: array<{_TERM}>, _cut: string>"


@dataclass
class Catalog:
    """sources: source, source_type, priority, built_at, snap_id. tables, columns, edges, terms: one row for each that a source lists, with ``rank``: what orders sources, most trusted first (a struct)."""

    sources: DataFrame
    tables: DataFrame
    columns: DataFrame
    edges: DataFrame
    terms: DataFrame


def source_type(c) -> F.Column:
    return F.translate(F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))), "-", "_")


def merge_order(snapshots: DataFrame, connections: DataFrame) -> DataFrame:
    """source, source_type, priority, built_at, snap_id, rank of each source's latest build: user curation first, then by priority (that of the connection's last version, else of the source type) and name."""
    last = snapshots.filter("source is not null").groupBy("source").agg(F.max(F.struct("built_at", "snap_id", source_type(F.col("source_type")).alias("t"))).alias("m"))
    own = connections.filter("name is not null").groupBy("name").agg(F.max(F.struct("updated_at", "created_at", "priority"))["priority"].alias("own"))
    default = F.coalesce(*[F.when(F.col("m.t") == k, F.lit(p)) for k, p in SOURCE_PRIORITY.items()], F.lit(DEFAULT_PRIORITY))
    rows = last.join(own, last["source"] == own["name"], "left").select("source", F.col("m.t").alias("source_type"), F.coalesce("own", default).alias("priority"), F.col("m.built_at").alias("built_at"), F.col("m.snap_id").alias("snap_id"))
    return rows.withColumn("rank", F.struct((F.col("source_type") != "user").alias("late"), "priority", "source"))


def catalog(snapshots: DataFrame, connections: DataFrame) -> Catalog:
    """Payloads that are null or cut list nothing; a table without a name is left out."""
    order = merge_order(snapshots, connections)
    one = snapshots.select("source", "built_at", "snap_id", "payload").distinct()
    last = order.select(F.col("source").alias("o_source"), F.col("built_at").alias("o_at"), F.col("snap_id").alias("o_id"), "rank")
    same = (F.col("source") == F.col("o_source")) & F.col("built_at").eqNullSafe(F.col("o_at")) & F.col("snap_id").eqNullSafe(F.col("o_id"))
    p = F.from_json("payload", PAYLOAD, {"columnNameOfCorruptRecord": "_cut"})
    held = cut(one.join(last, same).select("source", "rank", p.alias("p")).filter("p._cut is null"))  # payloads are parsed once
    t = held.select("source", "rank", F.posexplode("p.tables").alias("pos", "t"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    key = table_key_col(F.concat_ws(".", blank("t.catalog"), blank("t.schema"), blank("t.name")))
    t = t.withColumn("table_key", key).filter("table_key is not null")
    tables = t.select(
        "source", "rank", "pos", "table_key", blank("t.description").alias("description"), blank("t.owner").alias("owner"), F.col("t.row_count").alias("row_count"),
        F.coalesce("t.kind", F.lit("table")).alias("kind"), F.col("t.tags").alias("tags"), F.col("t.properties").alias("properties"),
    )
    c = t.select("source", "rank", "pos", "table_key", F.posexplode("t.columns").alias("cpos", "c"))
    columns = c.filter("c.name is not null").select("source", "rank", "pos", "cpos", "table_key", F.col("c.name").alias("name"), F.lower("c.name").alias("col"), *[F.col(f"c.{f}").alias(f) for f in ("data_type", "description", "nullable", "is_primary_key", "sample_values", "tags", "properties")])
    e = held.select("source", "rank", F.posexplode("p.edges").alias("pos", "e"))
    edges = e.select("source", "rank", "pos", F.coalesce("e.kind", F.lit("")).alias("kind"), table_key_col(F.col("e.from_table")).alias("from_key"), table_key_col(F.col("e.to_table")).alias("to_key"), *[F.transform(F.coalesce(f"e.{f}", F.array().cast("array<string>")), F.lower).alias(f) for f in ("from_columns", "to_columns")], F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))
    terms = held.select("source", "rank", F.posexplode("p.terms").alias("pos", "t")).select("source", "rank", "pos", F.lower(F.btrim("t.name", F.lit(BLANKS))).alias("term"), F.nullif("t.description", F.lit("")).alias("description"), F.col("t.synonyms").alias("synonyms"), F.col("t.targets").alias("targets"))
    return Catalog(order, tables, columns, edges.filter("from_key is not null and to_key is not null"), terms.filter("term <> ''"))
