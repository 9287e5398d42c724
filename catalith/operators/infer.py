"""Relations that no source declares, inferred from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Endings of key-looking names, names that identify nothing, and the confidence of each rule.
KEY_PATTERN = "^(.+?)_?(id|key|code|number|no|num)$"
GENERIC = "id key code number name value type date time year month day status".split()
MIN_STEM, MAX_FANOUT = 3, 12
BY_NAME, BY_PRIMARY_KEY, PAIRWISE = 0.6, 0.7, 0.4


def stem(col: Column) -> Column:
    """What a key-looking column refers to, else null."""
    s = F.regexp_extract(col, KEY_PATTERN, 1)
    return F.when((F.length(s) >= MIN_STEM) & ~s.isin(GENERIC), s)


def _placed(columns: DataFrame) -> DataFrame:
    steps = F.split("table_key", "\\.")
    return columns.select("table_key", "col", "is_primary_key", "ord", F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), ".").alias("grp"), F.element_at(steps, -1).alias("bare"))


def by_name(columns: DataFrame) -> DataFrame:
    """A column ``x_id`` refers to the table x (or its plural) of its schema: to the first column named id, like it, x_id or xid, or in the primary key."""
    c = _placed(columns)
    name = F.regexp_replace("bare", "_\\*$", "")
    forms = F.array_compact(F.array(name, F.when(name.endswith("s"), F.expr("left(regexp_replace(bare, '_\\\\*$', ''), length(regexp_replace(bare, '_\\\\*$', '')) - 1)")), F.when(name.endswith("ies"), F.concat(F.expr("left(regexp_replace(bare, '_\\\\*$', ''), length(regexp_replace(bare, '_\\\\*$', '')) - 3)"), F.lit("y")))))
    stems = c.select("table_key", "grp", "bare").distinct().select(F.col("table_key").alias("to_key"), "grp", F.explode(forms).alias("stem"))
    asked = c.withColumn("stem", stem(F.col("col"))).filter("stem is not null").select("grp", "stem", F.col("table_key").alias("from_key"), F.col("col").alias("from_col"), F.col("ord").alias("from_ord"))
    met = asked.join(stems, ["grp", "stem"]).filter("from_key <> to_key")
    target = c.select(F.col("table_key").alias("to_key"), F.col("col").alias("to_col"), "is_primary_key", F.col("ord").alias("to_ord"))
    fits = (F.col("to_col") == "id") | (F.col("to_col") == F.col("from_col")) | (F.col("to_col") == F.concat("stem", F.lit("_id"))) | (F.col("to_col") == F.concat("stem", F.lit("id"))) | F.col("is_primary_key")
    found = met.join(target, "to_key").filter(fits).groupBy("from_key", "from_col", "to_key").agg(F.min(F.struct("to_ord", "to_col"))["to_col"].alias("to_col"), F.min("from_ord").alias("ord"))
    return found.select(F.lit(1).alias("rule"), "from_key", "from_col", "to_key", "to_col", F.lit(BY_NAME).alias("confidence"))


def by_shared_key(columns: DataFrame, max_fanout: int = MAX_FANOUT) -> DataFrame:
    """Tables of a schema that share a key-looking or primary-key column: all to the first that has it as primary key, else each to each. A name held by more than ``max_fanout`` tables identifies nothing."""
    c = _placed(columns).filter(~F.col("col").isin(GENERIC) & ~F.col("col").contains(".") & (F.col("col").rlike(KEY_PATTERN) | F.col("is_primary_key")))
    sized = c.groupBy("grp", "col").agg(F.count("*").alias("n"), F.min(F.when(F.col("is_primary_key"), F.col("table_key"))).alias("holder")).filter(F.col("n").between(2, max_fanout))
    held = c.join(sized, ["grp", "col"]).select("grp", "col", "table_key", "holder")
    star = held.filter("holder is not null and table_key <> holder").select(F.lit(2).alias("rule"), F.col("table_key").alias("from_key"), F.col("col").alias("from_col"), F.col("holder").alias("to_key"), F.col("col").alias("to_col"), F.lit(BY_PRIMARY_KEY).alias("confidence"))
    a = held.filter("holder is null").select("grp", "col", F.col("table_key").alias("from_key"))
    b = held.filter("holder is null").select("grp", "col", F.col("table_key").alias("to_key"))
    pairs = a.join(b, ["grp", "col"]).filter("from_key < to_key")  # at most max_fanout tables
    return star.unionByName(pairs.select(F.lit(2).alias("rule"), "from_key", F.col("col").alias("from_col"), "to_key", F.col("col").alias("to_col"), F.lit(PAIRWISE).alias("confidence")))


def infer(columns: DataFrame, declared: DataFrame, max_fanout: int = MAX_FANOUT) -> DataFrame:
    """from_key, from_col, to_key, to_col, confidence of both rules, without pairs of tables that a declared edge(from_key, to_key) links and each pair of columns once, the name rule first."""
    every = by_name(columns).unionByName(by_shared_key(columns, max_fanout))
    both = declared.select("from_key", "to_key").unionByName(declared.select(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"))).distinct()
    new = every.join(both, ["from_key", "to_key"], "left_anti")
    a, b = (F.struct(F.col(k).alias("k"), F.col(c).alias("c")) for k, c in (("from_key", "from_col"), ("to_key", "to_col")))
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy("rule", "from_key", "from_col")
    return new.withColumn("n", F.row_number().over(w)).filter("n = 1").select("from_key", "from_col", "to_key", "to_col", "confidence")
