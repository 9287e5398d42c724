"""Scoring, grouping and selection of SQL candidates, and evaluation over stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The candidate score, and the most that findings of one code can cost.
EXEC_FAIL, FLOOR, DET_W, JUDGE_W = 0.05, 0.15, 0.4, 0.6
PENALTY_CAP = {"unknown_table": 0.8, "unknown_column": 0.6, "ungrouped": 0.4, "all_null": 0.3}
DOUBT, MISSING, MISSING_SHOWN = 0.5, 0.5, 5
EARLY_STOP, TOP_K = 0.9, 4


def findings(df: DataFrame, *keep: str) -> DataFrame:
    """keep columns, pos, code, severity, message, penalty of each finding in the JSON column ``findings``; texts that are no list of objects have none."""
    items = F.try_variant_get(F.try_parse_json("findings"), "$", "array<variant>")
    f = df.select(*keep, F.posexplode(items).alias("pos", "f"))
    get = lambda name, kind: F.try_variant_get("f", f"$.{name}", kind)
    f = f.select(*keep, "pos", get("code", "string").alias("code"), F.coalesce(get("severity", "string"), F.lit("info")).alias("severity"), F.coalesce(get("message", "string"), F.lit("")).alias("message"), F.coalesce(get("penalty", "double"), F.lit(0.0)).alias("penalty"))
    return f.filter("code is not null")


def deterministic(found: DataFrame, key: str) -> DataFrame:
    """key, det: one minus the penalties, those of each code up to its cap, not below zero; keys without findings have no row (1)."""
    cap = F.coalesce(*[F.when(F.col("code") == c, F.lit(x)) for c, x in PENALTY_CAP.items()], F.col("p"))
    per = found.groupBy(key, "code").agg(F.sum("penalty").alias("p"))
    return per.groupBy(key).agg(F.greatest(F.lit(0.0), 1 - F.sum(F.least("p", cap))).alias("det"))


def combine(parsed: Column, guarded: Column, ok: Column, det: Column, judge: Column) -> Column:
    """The reward: 0 for unparsed or refused candidates, EXEC_FAIL for failed ones, else a blend of checks and judge above FLOOR."""
    blend = F.when(judge.isNull(), det).otherwise(DET_W * det + JUDGE_W * judge)
    return F.when(~parsed | guarded, 0.0).when(~F.coalesce(ok, F.lit(False)), EXEC_FAIL).otherwise(FLOOR + (1 - FLOOR) * blend)


def feedback(found: DataFrame, key: str) -> DataFrame:
    """key, lines: messages of findings, errors first, then warnings, then the rest, in their order."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    said = found.filter("message <> ''").groupBy(key).agg(F.collect_list(F.struct(rank.alias("r"), "pos", "message")).alias("m"))  # findings of one candidate
    return said.select(key, F.array_join(F.transform(F.array_sort("m"), lambda x: x["message"]), "\n").alias("lines"))


def representatives(c: DataFrame, task: list[str], score: str, told: str, result: Column, ok: Column) -> DataFrame:
    """The best candidate of each distinct result of a task, with votes and rank. One of equal score is the one told first; failed ones and null or NaN scores don't count."""
    good = c.filter(ok & F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_result", result)
    best = good.groupBy(*task, "_result").agg(F.max_by(told, F.struct(F.col(score).alias("s"), (-F.col(told)).alias("t"))).alias(told), F.max(score).alias(score), F.count("*").alias("votes"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*task).orderBy(F.desc(score), told)))


def select_final(reps: DataFrame, task: list[str], score: str, told: str, wins: DataFrame | None = None) -> DataFrame:
    """The answer of each task: of the first TOP_K representatives the one with most wins (task, told, wins), votes and score, the earlier one if equal."""
    top = reps.filter(F.col("place") <= TOP_K)
    top = top.join(wins, [*task, told], "left") if wins is not None else top.withColumn("wins", F.lit(None).cast("double"))
    by = F.struct(F.coalesce("wins", F.lit(0.0)).alias("w"), (F.col("votes") if wins is not None else F.lit(0)).alias("v"), F.col(score).alias("s"), (-F.col(told)).alias("t"))
    return top.groupBy(*task).agg(F.max(F.struct(by.alias("by"), told, score, "votes")).alias("m")).select(*task, f"m.{told}", f"m.{score}", "m.votes")


def preferences(picks: DataFrame) -> DataFrame:
    """task, told, wins from pairwise picks(task, a, b, p): both orders of a pair are averaged, which cancels a bias for the first."""
    back = picks.select("task", F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    p = picks.join(back, ["task", "a", "b"]).select("task", F.col("a").alias("told"), ((F.col("p") + 1 - F.col("q")) / 2).alias("p"))
    return p.groupBy("task", "told").agg(F.sum("p").alias("wins"))


def average_ranks_auroc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """group, auroc, n_pos, n_neg: the Mann-Whitney statistic with tie-averaged ranks; null with one class only. Scores are counted by value first, so that only distinct scores are ordered."""
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    by = ok.groupBy(*group, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy("s")
    ranked = by.withColumn("rank", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n") - 1) / 2)
    out = ranked.groupBy(*group).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"))
    u = F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return out.select(*group, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def usage_summary(df: DataFrame, role: str, model: str, *measures: str) -> DataFrame:
    """Sums by role, by model and in total, as one table with ``scope``."""
    out = df.groupingSets([[role], [model], []], role, model).agg(F.grouping_id().alias("g"), F.count("*").alias("calls"), *[F.sum(m).alias(m) for m in measures])
    scope = F.when(F.col("g") == 1, "role").when(F.col("g") == 2, "model").otherwise("total")
    return out.select(scope.alias("scope"), F.coalesce(role, model, F.lit("")).alias("name"), "calls", *measures)


def fingerprint(rows: DataFrame, key: list[str], cells: list[str]) -> DataFrame:
    """key, fingerprint of results given as rows: a hash that doesn't depend on the order of rows, from sums of row hashes, so that results of any size take constant memory."""
    h = F.xxhash64(*cells)
    lo, hi = F.pmod(h, F.lit(1 << 31)), F.shiftrightunsigned(h, 33)
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(lo).alias("a"), F.sum(hi).alias("b")).select(*key, F.sha1(F.concat_ws("|", "n", F.lit(str(len(cells))), "a", "b")).alias("fingerprint"))


def set_metrics(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, n_gold, n_pred, hit, recall, precision, strict from pairs(key, item, gold, pred) with one row for each item of either side."""
    g = pairs.groupBy(*key).agg(F.count_if("gold").alias("n_gold"), F.count_if("pred").alias("n_pred"), F.count_if(F.col("gold") & F.col("pred")).alias("hit"))
    return g.select(*key, "n_gold", "n_pred", "hit", F.when(F.col("n_gold") > 0, F.col("hit") / F.col("n_gold")).otherwise(0.0).alias("recall"), F.when(F.col("n_pred") > 0, F.col("hit") / F.col("n_pred")).otherwise(0.0).alias("precision"), ((F.col("n_gold") > 0) & (F.col("hit") == F.col("n_gold"))).alias("strict"))
