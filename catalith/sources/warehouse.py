"""The session's catalog or a folder of Parquet tables: columns, row counts and sample values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.sources.base import Connector, column, edge, register, table


def flat_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool]]:
    """(dotted name, type, nested) of all fields, those inside structs too."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out.append((name, f.dataType.simpleString(), bool(prefix)))
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.StructType):
            out += flat_fields(inner, f"{name}.")
    return out


def sample_values(df: DataFrame, n: int = 5, cut_at: int = 80) -> dict[str, list[str]]:
    """The first ``n`` distinct values of each top-level text column in sorted order (the feature's limit)."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith(("string", "varchar", "char")):
            rows = df.filter(F.col(f"`{name}`").isNotNull()).select(F.substring(f"`{name}`", 1, cut_at).alias("v")).distinct().orderBy("v").limit(n).collect()
            out[name] = [r.v for r in rows]
    return out


@register
class WarehouseConnector(Connector):
    """config: path (a folder with one Parquet table for each of ``tables``) or database (of the session's catalog); keys: declared foreign keys (from_table, from_columns, to_table, to_columns); counts and samples can be switched off."""

    type = "duckdb"  # the rank of a source that was read directly

    def _frames(self) -> dict[str, DataFrame]:
        c = self.config
        if c.get("path"):
            return {n: self.spark.read.parquet(f"{c['path']}/{n}.parquet") for n in c.get("tables", [])}
        db = c.get("database", "default")
        return {t.name: self.spark.table(f"`{db}`.`{t.name}`" if not t.isTemporary else f"`{t.name}`") for t in self.spark.catalog.listTables(db)}

    def introspect(self) -> dict:
        c, tables = self.config, []
        for name, df in self._frames().items():
            more = {}
            samples: dict[str, list[str]] = {}
            try:
                if c.get("counts", True):
                    more["row_count"] = df.count()
                if c.get("samples", 5):
                    samples = sample_values(df, c.get("samples", 5))
            except Exception as e:  # one unreadable table doesn't end the scan
                self.warnings.append(f"{name}: {str(e).splitlines()[0]}")
            columns = [column(f, t, tags=["nested"] if nested else [], sample_values=samples.get(f, [])) for f, t, nested in flat_fields(df.schema)]
            tables.append(table(name, c.get("schema"), c.get("catalog"), columns=columns, **more))
        return self.payload(tables, [edge("foreign_key", k["from_table"], k["to_table"], k["from_columns"], k["to_columns"]) for k in c.get("keys", [])])
