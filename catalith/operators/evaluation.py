"""How good links and results are: gold tables and columns against linked ones, and result tables against right ones, for all tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.operators.families import shard_name
from catalith.plans.execution import NA

#: Ranks from which a worst gold rank counts as well placed.
TOPS = (10, 20)


def canon(df: DataFrame, name: str, members: DataFrame | None = None) -> DataFrame:
    """The same rows with names in one form: lower case, a member of a family as the family (members: member, family), else a dated shard as its series."""
    own = df.withColumn(name, F.lower(F.trim(name)))
    if members is None:
        return own.withColumn(name, shard_name(F.col(name)))
    m = members.select(F.lower(F.trim("member")).alias("_member"), F.lower(F.trim("family")).alias("_family")).groupBy("_member").agg(F.min("_family").alias("_family"))
    return own.join(m, own[name] == m["_member"], "left").withColumn(name, F.coalesce("_family", shard_name(F.col(name)))).drop("_member", "_family")


def resolved(gold: DataFrame, known: DataFrame, key: list[str] = ()) -> DataFrame:
    """gold(..., name) with ``table_key``: the known table of that name, else the only one that ends with its last two steps, else the only one with its last step, else null. key: columns that known(table_key, ...) is looked up within."""
    last = lambda c, n: F.array_join(F.slice(F.split(c, "\\."), F.greatest(F.size(F.split(c, "\\.")) - (n - 1), F.lit(1)), n), ".")
    k = known.select(*key, "table_key").distinct()
    out = gold.join(k.withColumn("name", F.col("table_key")).withColumnRenamed("table_key", "exact"), [*key, "name"], "left")
    for n in (2, 1):
        ends = k.groupBy(*key, last(F.col("table_key"), n).alias(f"_end{n}")).agg(F.count("*").alias("_n"), F.min("table_key").alias(f"tail{n}"))
        out = out.withColumn(f"_end{n}", last(F.col("name"), n)).join(ends.withColumnRenamed("_n", f"_n{n}"), [*key, f"_end{n}"], "left")
    by_two, by_one = F.when(F.col("_n2") == 1, F.col("tail2")), F.when(F.col("_n2").isNull() & (F.col("_n1") == 1), F.col("tail1"))
    return out.withColumn("table_key", F.coalesce("exact", by_two, by_one)).drop("exact", "_end1", "_end2", "_n1", "_n2", "tail1", "tail2")


def link_scores(gold: DataFrame, linked: DataFrame, ranking: DataFrame, key: str = "qid") -> DataFrame:
    """One row for each task with gold tables.

    gold: key, name. linked: key, name, anchor. ranking: key, name, pos; all in one form of names. n_gold, n_pred, hit, recall, precision, strict (all
    gold tables linked), anchor_hit (all are anchors), n_bridge and bridge_recovered (gold tables that are no anchors, and those of them linked), missed,
    max_gold_rank (the worst best rank of a gold table, null if one is unranked), gold_in_top10 and 20. A task without links has zeros."""
    g = gold.filter("name is not null").select(key, "name").distinct().withColumn("gold", F.lit(1))
    p = linked.filter("name is not null").groupBy(key, "name").agg(F.max(F.col("anchor").cast("int")).alias("anchor")).withColumn("pred", F.lit(1))
    r = ranking.groupBy(key, "name").agg(F.min("pos").alias("pos"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    each = g.join(p, [key, "name"], "full").join(r, [key, "name"], "left").select(key, "name", zero("gold"), zero("pred"), zero("anchor"), "pos")
    both, own = F.col("gold") * F.col("pred"), F.col("gold") * (1 - F.col("anchor"))
    out = each.groupBy(key).agg(
        F.sum("gold").alias("n_gold"), F.sum("pred").alias("n_pred"), F.sum(both).alias("hit"), (F.sum(own) == 0).cast("int").alias("anchor_hit"), F.sum(own).alias("n_bridge"), F.sum(own * F.col("pred")).alias("bridge_recovered"),
        F.array_join(F.sort_array(F.collect_list(F.when((F.col("gold") == 1) & (F.col("pred") == 0), F.col("name")))), ",").alias("missed"),
        F.when(F.count_if((F.col("gold") == 1) & F.col("pos").isNull()) == 0, F.max(F.when(F.col("gold") == 1, F.col("pos")))).alias("max_gold_rank"),
    ).filter("n_gold > 0")
    tops = [F.coalesce((F.col("max_gold_rank") <= n).cast("int"), F.lit(0)).alias(f"gold_in_top{n}") for n in TOPS]
    return out.select(key, "n_gold", "n_pred", "hit", (F.col("hit") / F.col("n_gold")).alias("recall"), F.when(F.col("n_pred") > 0, F.col("hit") / F.col("n_pred")).otherwise(0.0).alias("precision"), (F.col("hit") == F.col("n_gold")).cast("int").alias("strict"), "anchor_hit", "n_bridge", "bridge_recovered", "missed", "max_gold_rank", *tops)


def column_scores(gold: DataFrame, linked: DataFrame, key: str = "qid") -> DataFrame:
    """key, n_gold_cols, n_pred_cols, col_hit, col_recall, col_precision, col_strict, missed_cols of gold and linked (key, name, col); tasks without gold columns have no row."""
    g = gold.select(key, "name", F.lower("col").alias("col")).distinct().withColumn("gold", F.lit(1))
    p = linked.select(key, "name", F.lower("col").alias("col")).distinct().withColumn("pred", F.lit(1))
    each = g.join(p, [key, "name", "col"], "full").fillna({"gold": 0, "pred": 0})
    last = F.element_at(F.split("name", "\\."), -1)
    out = each.groupBy(key).agg(F.sum("gold").alias("n_gold_cols"), F.sum("pred").alias("n_pred_cols"), F.sum(F.col("gold") * F.col("pred")).alias("col_hit"), F.array_join(F.sort_array(F.collect_list(F.when((F.col("gold") == 1) & (F.col("pred") == 0), F.concat(last, F.lit("."), "col")))), ",").alias("missed_cols")).filter("n_gold_cols > 0")
    return out.select(key, "n_gold_cols", "n_pred_cols", "col_hit", (F.col("col_hit") / F.col("n_gold_cols")).alias("col_recall"), F.when(F.col("n_pred_cols") > 0, F.col("col_hit") / F.col("n_pred_cols")).otherwise(0.0).alias("col_precision"), (F.col("col_hit") == F.col("n_gold_cols")).cast("int").alias("col_strict"), "missed_cols")


def summarize(scores: DataFrame, buckets: Column, percent: list[str], means: list[str]) -> DataFrame:
    """bucket, n and, over the tasks of each bucket (an array of names for a task), means of ``percent`` times 100 and of ``means``; a null doesn't count, so that a measure that only some tasks have is a mean over those."""
    each = scores.withColumn("bucket", F.explode(buckets))
    return each.groupBy("bucket").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(c), 4).alias(c) for c in percent], *[F.round(F.avg(c), 4).alias(c) for c in means])


_INTEGER, _FLOAT = r"^\s*[+-]?[0-9]+\s*$", r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def result_vectors(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells (key, row, col, value: text as in a result file) typed by column: missing ones are 0, a column of numbers is numbers, one of truth values is texts True and False, other columns are texts.

    Gives key, row, col, number, text (one of them null): what two cells are compared by."""
    none = F.col("value").isNull() | F.col("value").isin(*sorted(NA))
    some = F.when(~none, F.col("value"))
    kinds = cells.groupBy(*key, "col").agg(F.coalesce(F.bool_and(some.rlike(_FLOAT) | some.rlike(_INTEGER)), F.lit(True)).alias("_number"), F.coalesce(F.bool_and(some.isin("True", "TRUE", "true", "False", "FALSE", "false")), F.lit(False)).alias("_bool"))
    typed = cells.join(kinds, [*key, "col"])
    number = F.when(none, 0.0).when(F.col("_number"), F.expr("try_cast(trim(value) AS double)"))
    text = F.when(~none & ~F.col("_number"), F.when(F.col("_bool"), F.initcap(F.lower("value"))).otherwise(F.col("value")))
    return typed.select(*key, "row", "col", F.when(F.isnan(number), 0.0).otherwise(number).alias("number"), text.alias("text"))


def compare_results(predicted: DataFrame, gold: DataFrame, wanted: DataFrame | None = None, ignore_order: DataFrame | None = None, tolerance: float = 1e-2) -> DataFrame:
    """task, gold_no, n_gold_cols, n_found, same: whether each (wanted) column of a right result agrees with some column of the predicted one.

    predicted: task, row, col, value; gold: task, gold_no, row, col, value (rows and columns from 0, values as texts, each result with all its
    cells). wanted: task, col. ignore_order: the tasks (task) whose columns are compared as sorted values. More predicted
    columns and their order don't matter; columns of different lengths never agree; numbers agree within the tolerance (or a billionth of the larger one). Columns are compared by row, so that results of any length are spread over the tasks."""
    p, g = result_vectors(predicted, ["task"]).withColumn("gold_no", F.lit(-1)), result_vectors(gold, ["task", "gold_no"])
    if wanted is not None:
        lists = wanted.select("task").distinct().withColumn("_some", F.lit(True))
        g = g.join(wanted.withColumn("_want", F.lit(True)), ["task", "col"], "left").join(lists, "task", "left").filter("_some is null or _want").drop("_some", "_want")
    if ignore_order is not None:
        free = ignore_order.select("task").distinct().withColumn("_free", F.lit(True))
        place = F.row_number().over(Window.partitionBy("task", "gold_no", "col").orderBy(F.coalesce(F.col("text"), F.col("number").cast("string")), F.col("number").isNotNull())) - 1

        def placed(df: DataFrame) -> DataFrame:
            return df.join(free, "task", "left").withColumn("row", F.when(F.col("_free"), place).otherwise(F.col("row"))).drop("_free")

        p, g = placed(p), placed(g)
    size = lambda df: df.groupBy("task", "gold_no", "col").agg(F.count("*").alias("n"))
    a = p.select("task", "row", F.col("col").alias("pcol"), F.col("number").alias("pn"), F.col("text").alias("pt"))
    equal = F.when(F.col("number").isNotNull() & F.col("pn").isNotNull(), (F.col("number") == F.col("pn")) | (F.abs(F.col("number") - F.col("pn")) <= F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs("number"), F.abs("pn"))))).otherwise(F.col("text").eqNullSafe(F.col("pt")) & F.col("number").eqNullSafe(F.col("pn")))
    hits = g.join(a, ["task", "row"]).groupBy("task", "gold_no", "col", "pcol").agg(F.count_if(equal).alias("hits"))
    full = hits.join(size(g), ["task", "gold_no", "col"]).join(size(p).select("task", F.col("col").alias("pcol"), F.col("n").alias("pn")), ["task", "pcol"]).filter("hits = n and n = pn")
    found = full.select("task", "gold_no", "col").distinct().withColumn("found", F.lit(1))
    cols = size(g).select("task", "gold_no", "col").join(found, ["task", "gold_no", "col"], "left")
    return cols.groupBy("task", "gold_no").agg(F.count("*").alias("n_gold_cols"), F.count("found").alias("n_found")).withColumn("same", F.col("n_gold_cols") == F.col("n_found"))


def any_gold(compared: DataFrame) -> DataFrame:
    """task, right, gold_no: whether a prediction agrees with any of the task's right results, and the first that it agrees with."""
    return compared.groupBy("task").agg(F.bool_or("same").alias("right"), F.min(F.when(F.col("same"), F.col("gold_no"))).alias("gold_no"))
