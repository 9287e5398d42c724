"""Queries over stored search runs, connections and evaluation metrics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import text as X
from catalith.operators import candidates as C
from catalith.operators import evaluation as EV
from catalith.operators import lexical as L
from catalith.plans import link as K
from catalith.plans import link_queries as LQ
from catalith.plans.sqltext import CATALOG
from catalith.session import store, table


def _c(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "spider2_exec_mix_candidates")


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).filter("run_id is not null and instance_id is not null")


TASK = ["run_id", "instance_id"]


def _result() -> Column:
    return F.coalesce(F.col("fingerprint"), F.concat(F.lit("#"), F.col("line_no").cast("string")))


def run_last_records(spark, sf):
    """The log as it stands: of the lines of a record the last one written."""
    last = _tasks(spark, sf).groupBy(*TASK, F.lower(F.trim("id")).alias("id")).agg(F.max("line_no").alias("line_no"))
    return _c(spark, sf).select("line_no", "parent_id", "action", "ok", "row_count", "ex", "fingerprint", "error").join(last, "line_no")


def run_done(spark, sf):
    """Tasks that a run need not do again: those whose last line has no error, by the hash of the run's configuration (blank where its file has none)."""
    last = _tasks(spark, sf).groupBy(*TASK).agg(F.max_by(F.coalesce("error", "exec_error"), "line_no").alias("error"))
    cols = ["run_id", "config", "received_at", "file_id"]
    files = table(spark, sf, "spider2_exec_legacy").select(*cols).unionByName(table(spark, sf, "spider2_exec_mix").select(*cols))
    hashes = files.filter("run_id is not null").groupBy("run_id").agg(F.max_by(F.get_json_object("config", "$.config_hash"), F.struct("received_at", "file_id")).alias("config_hash"))
    done = last.filter("error is null").join(hashes, "run_id", "left")
    return done.groupBy(F.coalesce("config_hash", F.lit("")).alias("config_hash")).agg(F.count("*").alias("n_done"), F.countDistinct("run_id").alias("n_runs"))


def run_findings(spark, sf):
    f = C.findings(_c(spark, sf), "line_no")
    return f.groupBy("code", "severity").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("n_lines"), F.round(F.sum("penalty"), 4).alias("penalty"))


def run_deterministic(spark, sf):
    d = C.deterministic(C.findings(_c(spark, sf), "line_no"), "line_no")
    return d.select("line_no", F.round("det", 6).alias("det"))


def run_combined_score(spark, sf):
    c = _c(spark, sf)
    part = lambda k: F.get_json_object("score_parts", f"$.{k}").cast("double")
    score = C.combine(F.col("sql").isNotNull(), F.coalesce(F.col("exec_error").startswith("guard"), F.lit(False)), F.col("ok"), F.coalesce(part("det"), F.lit(0.0)), part("judge"))
    return c.select("line_no", F.round(score, 6).alias("reward"))


def run_feedback(spark, sf):
    return C.feedback(C.findings(_c(spark, sf), "line_no"), "line_no")


def run_representatives(spark, sf):
    r = C.representatives(_tasks(spark, sf), TASK, "score", "line_no", _result(), F.coalesce(F.col("ok"), F.lit(False)))
    return r.select(*TASK, "line_no", "votes", F.col("place").cast("int").alias("place"))


def run_select_final(spark, sf):
    r = C.representatives(_tasks(spark, sf), TASK, "score", "line_no", _result(), F.coalesce(F.col("ok"), F.lit(False)))
    return C.select_final(r, TASK, "score", "line_no").select(*TASK, "line_no", "votes")


def run_early_stop(spark, sf):
    """Tasks whose good candidates agree: votes of the largest group of equal results with a score of EARLY_STOP or more."""
    good = _tasks(spark, sf).filter(f"ok and score >= {C.EARLY_STOP} and not isnan(score) and fingerprint is not null")
    votes = good.groupBy(*TASK, "fingerprint").agg(F.countDistinct(F.regexp_replace(F.trim("sql"), "\\s+", " ")).alias("votes"))
    return votes.groupBy(*TASK).agg(F.max("votes").alias("agree"))


def run_auroc(spark, sf):
    df = _c(spark, sf).filter("ex is not null").select("action", "score", (F.col("ex") == 1).alias("good"))
    a = C.average_ranks_auroc(df.withColumn("action", F.lower(F.trim("action"))), ["action"], "score", "good")
    return a.select("action", F.round("auroc", 6).alias("auroc"), "n_pos", "n_neg")


def run_exec_scores(spark, sf):
    """Of each task: whether the pick and any candidate are right, and the first right one."""
    t = _tasks(spark, sf).filter("ex is not null").withColumn("s", F.when(F.isnan("score"), None).otherwise(F.col("score")))
    node = F.regexp_extract(F.lower("id"), "([0-9]+)", 1)
    g = t.groupBy(*TASK).agg(F.max_by("ex", F.struct(F.coalesce("s", F.lit(-1.0)).alias("s"), (-F.col("line_no")).alias("t"))).alias("top"), F.max("ex").alias("oracle"), F.coalesce(F.min(F.when((F.col("ex") == 1) & (node != ""), node.cast("long"))), F.lit(-1)).alias("first_right"), F.count("*").alias("n"))
    return g


def run_summary_buckets(spark, sf):
    """Means over overlapping buckets of tasks: all, by kind of question, and by size."""
    g = run_exec_scores(spark, sf)
    kind = F.regexp_extract("instance_id", "^([a-z]+)", 1)
    tags = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("kind:"), kind), F.when(F.col("n") >= 10, F.lit("large")), F.when(F.col("n") < 10, F.lit("small")), F.when(F.col("oracle") == 1, F.lit("solvable"))))
    return g.select(F.explode(tags).alias("bucket"), "top", "oracle", "n").groupBy("bucket").agg(F.count("*").alias("tasks"), F.round(100 * F.avg("top"), 4).alias("top_pct"), F.round(100 * F.avg("oracle"), 4).alias("oracle_pct"), F.percentile("n", F.lit(0.5)).alias("median_n"))


def run_quantiles(spark, sf):
    """Nearest-rank quantiles of the rows that results have."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY row_count)")
    return _c(spark, sf).filter("row_count is not null").groupBy(F.lower(F.trim("action")).alias("action")).agg(q(0.5).alias("p50"), q(0.9).alias("p90"), F.max("row_count").alias("largest"))


def run_usage(spark, sf):
    """Calls and characters read and written by action, by generator (the first of a list) and in all."""
    length = lambda *cs: sum((F.coalesce(F.length(c), F.lit(0)) for c in cs), F.lit(0)).cast("long")
    model = F.coalesce(F.get_json_object("generator", "$[0]"), F.when(~F.col("generator").rlike("^\\s*\\["), F.col("generator")), F.lit("(none)"))
    c = _c(spark, sf).select(F.lower(F.trim("action")).alias("role"), model.alias("model"), length("prompt").alias("chars_in"), length("sql", "rationale", "advice").alias("chars_out"))
    return C.usage_summary(c, "role", "model", "chars_in", "chars_out")


def run_fingerprints(spark, sf):
    """Groups of questions with the same set of results, by a fingerprint over rows."""
    rows = _tasks(spark, sf).filter("fingerprint is not null").select("instance_id", "fingerprint").distinct().withColumnRenamed("fingerprint", "cell")
    fp = C.fingerprint(rows, ["instance_id"], ["cell"])
    return fp.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("instance_id").alias("first")).select("first", "n")


def run_context_keys(spark, sf):
    """Prompts stored once: the short hash that stands for each, and its uses."""
    return _c(spark, sf).filter("prompt is not null").groupBy(F.substring(F.sha2("prompt", 256), 1, 12).alias("key")).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def _gold(spark, sf):
    """qid, name of the tables that the SQL in each held-out question reads, by their last step."""
    names = F.regexp_extract_all(F.lower("text"), F.lit("\\b(?:from|join)\\s+([a-z_][a-z0-9_.]*)"), 1)
    said = table(spark, sf, "eval_items").filter("text rlike '(?i)\\\\bselect\\\\b'").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(names)).alias("name"))
    return EV.canon(said.select("qid", F.element_at(F.split("name", "\\."), -1).alias("name")), "name").join(_known(spark, sf), "name", "left_semi")


def _known(spark, sf):
    """The names that a question may mean: last steps of the catalog's tables."""
    return EV.canon(LQ.catalog_objects(spark, sf).tables.select(F.col("bare").alias("name")), "name").distinct()


def _ranked(spark, sf):
    """qid, table_key, pos, name: the sparse ranking of all tables."""
    scores = LQ.bm25f(spark, sf)
    r = scores.withColumn("pos", L.ranks(scores))
    return EV.canon(r.withColumn("name", F.element_at(F.split("table_key", "\\."), -1)), "name")


MOST, ANCHORS = 20, 6


def eval_sparse(spark, sf):
    """The sparse ranking against the tables that the questions' SQL reads: its best 20 as links, its best 6 as anchors."""
    ranked = store(_ranked(spark, sf))
    out = EV.link_scores(_gold(spark, sf), ranked.filter(f"pos <= {MOST}").withColumn("anchor", F.col("pos") <= ANCHORS), ranked)
    return out.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


def eval_columns(spark, sf):
    """The columns of the best 20 tables against those that the questions' SQL names with their table."""
    said = F.regexp_extract_all(F.lower("text"), F.lit("([a-z_][a-z0-9_]*[.][a-z_][a-z0-9_]*)"), 1)
    gold = table(spark, sf, "eval_items").filter("text rlike '(?i)\\\\bselect\\\\b'").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(said)).alias("s")).select("qid", F.split_part("s", F.lit("."), F.lit(1)).alias("name"), F.split_part("s", F.lit("."), F.lit(2)).alias("col"))
    columns = EV.canon(LQ.catalog_objects(spark, sf).columns.select("table_key", "col", F.element_at(F.split("table_key", "\\."), -1).alias("name")), "name")
    known = columns.select("name", "col").distinct()
    linked = _ranked(spark, sf).filter(f"pos <= {MOST}").select("qid", "table_key").join(columns, "table_key").select("qid", "name", "col")
    out = EV.column_scores(EV.canon(gold, "name").join(known, ["name", "col"], "left_semi"), linked.join(gold.select("qid").distinct(), "qid", "left_semi"))
    return out.withColumn("col_recall", F.round("col_recall", 6)).withColumn("col_precision", F.round("col_precision", 6))


def eval_link(spark, sf):
    """The linker itself against the tables that the questions' SQL reads, by suite and in all: shares in percent, ranks as means.

    Each question is linked by itself, so those that name no table of the catalog, which have no row in the scores, need no links."""
    gold = store(_gold(spark, sf))
    asked = LQ.questions(spark, sf).join(gold.select("qid").distinct(), "qid", "left_semi")
    linked = K.link(asked, LQ.catalog_objects(spark, sf), only_tables=True)
    named = lambda df: EV.canon(df.withColumn("name", F.element_at(F.split("table_key", "\\."), -1)), "name")
    scores = EV.link_scores(gold, named(linked.tables), named(linked.ranked)).join(table(spark, sf, "eval_items").select(F.col("item_id").alias("qid"), F.lower(F.trim("suite")).alias("suite")).distinct(), "qid", "left")
    return EV.summarize(scores, F.array_compact(F.array(F.lit("all"), F.concat(F.lit("suite:"), "suite"))), ["recall", "precision", "strict", "anchor_hit", "gold_in_top10", "gold_in_top20"], ["n_gold", "n_pred", "max_gold_rank"])


def eval_results(spark, sf):
    """Result tables against right ones, as tasks: for each region and market segment the customers and their balances, in another order, with a column more, one column off or a row short, against the right result and one that is right but for half a cent."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    by = c.groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("bal"))
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("c_mktsegment")) - 1
    back = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("c_mktsegment"))) - 1
    rows = by.withColumn("row", row).withColumn("back", back)
    text = lambda c: F.col(c).cast("string")
    cells = lambda df, at, *cols: df.select("task", F.col(at).alias("row"), *([F.col("gold_no")] if "gold_no" in df.columns else []), F.posexplode(F.array(*cols)).alias("col", "value"))
    task = lambda kind: F.concat(F.lit(f"{kind}:"), text("n_regionkey"))
    g = rows.select("*", F.explode(F.array(*[task(k) for k in ("same", "more", "off", "short", "turned", "free")])).alias("task"))
    cent = cells(g.withColumn("gold_no", F.lit(1)), "row", F.col("c_mktsegment"), (F.col("bal") + F.lit("0.005").cast("decimal(18,3)")).cast("string"))
    gold = cells(g.withColumn("gold_no", F.lit(0)), "row", F.col("c_mktsegment"), text("n"), text("bal")).unionByName(cent)
    own = lambda kind, at, *cols: cells(rows.withColumn("task", task(kind)), at, *cols)
    seg = F.col("c_mktsegment")
    pred = own("same", "row", seg, text("n"), text("bal")).unionByName(own("more", "row", text("bal"), F.lit("x"), text("n"), seg)).unionByName(own("off", "row", seg, (F.col("n") + 1).cast("string"), text("bal")))
    pred = pred.unionByName(own("short", "row", seg, text("n"), text("bal")).filter("row > 0").withColumn("row", F.col("row") - 1)).unionByName(own("turned", "back", seg, text("n"), text("bal"))).unionByName(own("free", "back", seg, text("n"), text("bal")))
    free = rows.select(task("free").alias("task")).distinct()
    return EV.compare_results(pred, gold, ignore_order=free).select("task", "gold_no", "n_gold_cols", "n_found", "same")


def store_connections(spark, sf):
    """Connections as last saved, joined to what their last build holds; secrets are redacted."""
    conn, snap = table(spark, sf, "connections"), table(spark, sf, "snapshots")
    last = conn.filter("name is not null").groupBy("name").agg(F.max(F.struct("updated_at", "created_at", "type", "priority", "config")).alias("c"), F.min("created_at").alias("since"))
    built = snap.groupBy("source").agg(F.max(F.struct("built_at", "snap_id", "n_tables", "n_edges", "n_terms")).alias("b"))
    safe = F.regexp_replace("c.config", '("[^"]*(?:token|secret|password|key)[^"]*"\\s*:\\s*)"[^"]*"', '$1"***"')
    return last.join(built, F.col("name") == F.col("source"), "left").select("name", F.translate(F.lower(F.trim("c.type")), "-", "_").alias("type"), F.coalesce("c.priority", F.lit(-1)).alias("priority"), safe.alias("config"), F.coalesce("b.n_tables", F.lit(0)).alias("n_tables"), F.coalesce("b.n_edges", F.lit(0)).alias("n_edges"), F.coalesce("b.n_terms", F.lit(0)).alias("n_terms"))


def store_upsert(spark, sf):
    """Versions of each connection in the order of saving, with the priority kept where a version has none."""
    c = table(spark, sf, "connections").filter("name is not null").select("name", "updated_at", "priority").distinct()
    w = Window.partitionBy("name").orderBy("updated_at", F.coalesce("priority", F.lit(-1)))
    kept = F.last("priority", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.select("name", F.row_number().over(w).cast("int").alias("version"), F.coalesce(kept, F.lit(-1)).alias("priority"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith(("run_", "eval_", "store_"))}

_C = "spider2_exec_mix_candidates"
_T = f"(SELECT * FROM {_C} WHERE run_id IS NOT NULL AND instance_id IS NOT NULL)"
_F = f"""WITH raw AS (SELECT line_no, CASE WHEN json_valid(findings) AND json_type(findings) = 'ARRAY' THEN CAST(findings AS JSON) END AS j FROM {_C} WHERE findings IS NOT NULL),
      one AS (SELECT line_no, unnest(CAST(j AS JSON[])) AS f, generate_subscripts(CAST(j AS JSON[]), 1) - 1 AS pos FROM raw WHERE j IS NOT NULL),
      bad AS (SELECT DISTINCT line_no FROM one WHERE json_type(f) <> 'OBJECT'),
      fnd AS (SELECT line_no, pos, f->>'code' AS code, coalesce(f->>'severity', 'info') AS severity, coalesce(f->>'message', '') AS message, coalesce(TRY_CAST(f->>'penalty' AS DOUBLE), 0) AS penalty
        FROM one WHERE json_type(f) = 'OBJECT' AND f->>'code' IS NOT NULL)"""
_REP = f"""good AS (SELECT run_id, instance_id, line_no, score, coalesce(fingerprint, '#' || line_no) AS res FROM {_T} WHERE ok AND score IS NOT NULL AND NOT isnan(score)),
      rep AS (SELECT run_id, instance_id, res, count(*) AS votes, max(score) AS score, arg_min(line_no, (-score, line_no)) AS line_no FROM good GROUP BY ALL),
      placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, instance_id ORDER BY score DESC, line_no) AS place FROM rep)"""
_EX = f"""ex AS (SELECT run_id, instance_id, arg_min(ex, (-coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, -1), line_no)) AS top, max(ex) AS oracle,
      coalesce(min(TRY_CAST(regexp_extract(lower(id), '([0-9]+)', 1) AS BIGINT)) FILTER (ex = 1), -1) AS first_right, count(*) AS n FROM {_T} WHERE ex IS NOT NULL GROUP BY ALL)"""

_GOLD = CATALOG + LQ._LEX + LQ._BM + f""", kn AS (SELECT DISTINCT {LQ.shard("bare")} AS name FROM mt),
      named_in AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '\\b(?:from|join)\\s+([a-z_][a-z0-9_.]*)', 1)) AS n FROM eval_items WHERE regexp_matches(text, '(?i)\\bselect\\b')),
      g AS (SELECT DISTINCT qid, name FROM (SELECT qid, {LQ.shard("string_split(n, '.')[-1]")} AS name FROM named_in) x WHERE name IN (SELECT name FROM kn)),
      rk AS (SELECT qid, table_key, {LQ.shard("string_split(table_key, '.')[-1]")} AS name, row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_key) AS pos FROM bm)"""

SQL: dict[str, str] = {
    "run_last_records": f"WITH l AS (SELECT run_id, instance_id, lower(trim(id)) AS id, max(line_no) AS line_no FROM {_T} GROUP BY ALL) SELECT line_no, run_id, l.instance_id, l.id, parent_id, action, ok, row_count, ex, fingerprint, error FROM l JOIN (SELECT * EXCLUDE (run_id, instance_id, id) FROM {_C}) c USING (line_no)",
    "run_done": f"""WITH l AS (SELECT run_id, instance_id, arg_max_null(coalesce(error, exec_error), line_no) AS e FROM {_T} GROUP BY ALL),
      h AS (SELECT run_id, arg_max_null(CASE WHEN json_valid(config) THEN config->>'$.config_hash' END, (received_at, file_id)) AS config_hash FROM (SELECT run_id, config, received_at, file_id FROM spider2_exec_legacy UNION ALL SELECT run_id, config, received_at, file_id FROM spider2_exec_mix) WHERE run_id IS NOT NULL GROUP BY ALL)
      SELECT coalesce(config_hash, '') AS config_hash, count(*) AS n_done, count(DISTINCT run_id) AS n_runs FROM l LEFT JOIN h USING (run_id) WHERE e IS NULL GROUP BY 1""",
    "run_findings": _F + " SELECT code, severity, count(*) AS n, count(DISTINCT line_no) AS n_lines, round(sum(penalty), 4) AS penalty FROM fnd GROUP BY ALL",
    "run_deterministic": _F + """, per AS (SELECT line_no, code, sum(penalty) AS p FROM fnd GROUP BY ALL)
      SELECT line_no, round(greatest(0, 1 - sum(least(p, CASE code WHEN 'unknown_table' THEN 0.8 WHEN 'unknown_column' THEN 0.6 WHEN 'ungrouped' THEN 0.4 WHEN 'all_null' THEN 0.3 ELSE p END))), 6) AS det FROM per GROUP BY ALL""",
    "run_combined_score": f"""SELECT line_no, round(CASE WHEN sql IS NULL OR coalesce(starts_with(exec_error, 'guard'), false) THEN 0.0 WHEN NOT coalesce(ok, false) THEN 0.05 ELSE 0.15 + 0.85 *
      (CASE WHEN TRY_CAST(score_parts->>'$.judge' AS DOUBLE) IS NULL THEN coalesce(TRY_CAST(score_parts->>'$.det' AS DOUBLE), 0) ELSE 0.4 * coalesce(TRY_CAST(score_parts->>'$.det' AS DOUBLE), 0) + 0.6 * TRY_CAST(score_parts->>'$.judge' AS DOUBLE) END) END::DOUBLE, 6) AS reward FROM {_C}""",
    "run_feedback": _F + " SELECT line_no, string_agg(message, chr(10) ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, pos) AS lines FROM fnd WHERE message <> '' GROUP BY ALL",
    "run_representatives": "WITH " + _REP + " SELECT run_id, instance_id, line_no, votes, CAST(place AS INTEGER) AS place FROM placed",
    "run_select_final": "WITH " + _REP + " SELECT run_id, instance_id, line_no, votes FROM placed WHERE place = 1",
    "run_early_stop": f"SELECT run_id, instance_id, max(votes) AS agree FROM (SELECT run_id, instance_id, fingerprint, count(DISTINCT regexp_replace(trim(sql), '\\s+', ' ', 'g')) AS votes FROM {_T} WHERE ok AND score >= 0.9 AND NOT isnan(score) AND fingerprint IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    "run_auroc": f"""WITH d AS (SELECT lower(trim(action)) AS action, score, ex = 1 AS good FROM {_C} WHERE ex IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
      r AS (SELECT *, rank() OVER (PARTITION BY action ORDER BY score) + (count(*) OVER (PARTITION BY action, score) - 1) / 2.0 AS rk FROM d)
      SELECT action, round((sum(rk) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 6) AS auroc, count(*) FILTER (good) AS n_pos, count(*) FILTER (NOT good) AS n_neg FROM r GROUP BY ALL""",
    "run_exec_scores": f"WITH {_EX} SELECT * FROM ex",
    "run_summary_buckets": f"""WITH {_EX}, tagged AS (SELECT *, unnest(list_filter(['all', 'kind:' || regexp_extract(instance_id, '^([a-z]+)', 1), CASE WHEN n >= 10 THEN 'large' ELSE 'small' END, CASE WHEN oracle = 1 THEN 'solvable' END], lambda x: x IS NOT NULL)) AS bucket FROM ex)
      SELECT bucket, count(*) AS tasks, round(100 * avg(top), 4) AS top_pct, round(100 * avg(oracle), 4) AS oracle_pct, CAST(median(n) AS DOUBLE) AS median_n FROM tagged GROUP BY ALL""",
    "run_quantiles": f"SELECT lower(trim(action)) AS action, quantile_disc(row_count, 0.5) AS p50, quantile_disc(row_count, 0.9) AS p90, max(row_count) AS largest FROM {_C} WHERE row_count IS NOT NULL GROUP BY 1",
    "run_usage": f"""WITH c AS (SELECT lower(trim(action)) AS role, coalesce(CASE WHEN json_valid(generator) AND json_type(generator) = 'ARRAY' THEN generator->>'$[0]' WHEN NOT regexp_matches(generator, '^\\s*\\[') THEN generator END, '(none)') AS model, coalesce(length(prompt), 0) AS i, coalesce(length(sql), 0) + coalesce(length(rationale), 0) + coalesce(length(advice), 0) AS o FROM {_C})
      SELECT 'role' AS scope, role AS name, count(*) AS calls, CAST(sum(i) AS BIGINT) AS chars_in, CAST(sum(o) AS BIGINT) AS chars_out FROM c GROUP BY ALL UNION ALL SELECT 'model', model, count(*), CAST(sum(i) AS BIGINT), CAST(sum(o) AS BIGINT) FROM c GROUP BY ALL
      UNION ALL SELECT 'total', '', count(*), CAST(sum(i) AS BIGINT), CAST(sum(o) AS BIGINT) FROM c""",
    "run_fingerprints": f"SELECT min(instance_id) AS first, count(*) AS n FROM (SELECT instance_id, string_agg(DISTINCT fingerprint, '|' ORDER BY fingerprint) AS f FROM {_T} WHERE fingerprint IS NOT NULL GROUP BY ALL) GROUP BY f",
    "run_context_keys": f"SELECT sha256(prompt)[1:12] AS key, count(*) AS n, min(line_no) AS first_line FROM {_C} WHERE prompt IS NOT NULL GROUP BY ALL",
    "eval_sparse": _GOLD + f""", p AS (SELECT qid, name, bool_or(pos <= {ANCHORS}) AS anchor FROM rk WHERE pos <= {MOST} GROUP BY ALL), r AS (SELECT qid, name, min(pos) AS pos FROM rk GROUP BY ALL),
      e AS (SELECT qid, name, CAST(g.name IS NOT NULL AS INT) AS gold, CAST(p.name IS NOT NULL AS INT) AS pred, coalesce(CAST(anchor AS INT), 0) AS anchor, r.pos FROM g FULL JOIN p USING (qid, name) LEFT JOIN r USING (qid, name)),
      a AS (SELECT qid, CAST(sum(gold) AS BIGINT) AS n_gold, CAST(sum(pred) AS BIGINT) AS n_pred, CAST(sum(gold * pred) AS BIGINT) AS hit, CAST(sum(gold * (1 - anchor)) = 0 AS INT) AS anchor_hit, CAST(sum(gold * (1 - anchor)) AS BIGINT) AS n_bridge, CAST(sum(gold * (1 - anchor) * pred) AS BIGINT) AS bridge_recovered,
        coalesce(string_agg(CASE WHEN gold = 1 AND pred = 0 THEN name END, ',' ORDER BY name), '') AS missed, CASE WHEN count(*) FILTER (gold = 1 AND pos IS NULL) = 0 THEN CAST(max(pos) FILTER (gold = 1) AS INT) END AS max_gold_rank FROM e GROUP BY qid HAVING sum(gold) > 0)
      SELECT qid, n_gold, n_pred, hit, round(hit / n_gold, 6) AS recall, CASE WHEN n_pred > 0 THEN round(hit / n_pred, 6) ELSE 0 END AS precision, CAST(hit = n_gold AS INT) AS strict, anchor_hit, n_bridge, bridge_recovered, missed, max_gold_rank,
        coalesce(CAST(max_gold_rank <= 10 AS INT), 0) AS gold_in_top10, coalesce(CAST(max_gold_rank <= 20 AS INT), 0) AS gold_in_top20 FROM a""",
    "eval_columns": _GOLD + f""", kc AS (SELECT DISTINCT table_key, {LQ.shard("string_split(table_key, '.')[-1]")} AS name, col FROM mc),
      sc AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]*[.][a-z_][a-z0-9_]*)')) AS s FROM eval_items WHERE regexp_matches(text, '(?i)\\bselect\\b')),
      sq AS (SELECT DISTINCT qid FROM sc),
      gc AS (SELECT DISTINCT qid, k.name, k.col FROM (SELECT qid, {LQ.shard("split_part(s, '.', 1)")} AS name, split_part(s, '.', 2) AS col FROM sc) x JOIN kc k USING (name, col)),
      pc2 AS (SELECT DISTINCT qid, k.name, k.col FROM rk JOIN kc k USING (table_key) WHERE pos <= {MOST} AND qid IN (SELECT qid FROM sq)),
      e AS (SELECT qid, name, col, CAST(gc.col IS NOT NULL AS INT) AS gold, CAST(pc2.col IS NOT NULL AS INT) AS pred FROM gc FULL JOIN pc2 USING (qid, name, col)),
      a AS (SELECT qid, CAST(sum(gold) AS BIGINT) AS g, CAST(sum(pred) AS BIGINT) AS p, CAST(sum(gold * pred) AS BIGINT) AS h, coalesce(string_agg(CASE WHEN gold = 1 AND pred = 0 THEN name || '.' || col END, ',' ORDER BY name || '.' || col), '') AS missed_cols FROM e GROUP BY qid HAVING sum(gold) > 0)
      SELECT qid, g AS n_gold_cols, p AS n_pred_cols, h AS col_hit, round(h / g, 6) AS col_recall, CASE WHEN p > 0 THEN round(h / p, 6) ELSE 0 END AS col_precision, CAST(h = g AS INT) AS col_strict, missed_cols FROM a""",
    "eval_results": """WITH r AS (SELECT DISTINCT n_regionkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
      n AS (SELECT k, count(*) AS segs FROM (SELECT DISTINCT n_regionkey AS k, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY k),
      t AS (SELECT kind, k, gold_no, CASE WHEN gold_no = 0 THEN 3 ELSE 2 END AS cols FROM r, (VALUES ('same'), ('more'), ('off'), ('short'), ('turned'), ('free')) x(kind), (VALUES (0), (1)) y(gold_no)),
      f AS (SELECT *, CASE kind WHEN 'same' THEN cols WHEN 'more' THEN cols WHEN 'free' THEN cols WHEN 'off' THEN CASE WHEN gold_no = 0 THEN 2 ELSE 2 END WHEN 'short' THEN 0 WHEN 'turned' THEN CASE WHEN segs = 1 THEN cols ELSE 0 END END AS found FROM t JOIN n USING (k))
      SELECT kind || ':' || k AS task, gold_no, CAST(cols AS BIGINT) AS n_gold_cols, CAST(found AS BIGINT) AS n_found, found = cols AS same FROM f""",
    "store_connections": """WITH c AS (SELECT * FROM (SELECT DISTINCT * FROM connections) QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, created_at DESC) = 1),
      b AS (SELECT * FROM (SELECT DISTINCT source, built_at, snap_id, n_tables, n_edges, n_terms FROM snapshots) QUALIFY row_number() OVER (PARTITION BY source ORDER BY built_at DESC, snap_id DESC) = 1)
      SELECT name, replace(lower(trim(type)), '-', '_') AS type, coalesce(priority, -1) AS priority, regexp_replace(config, '("[^"]*(?:token|secret|password|key)[^"]*"\\s*:\\s*)"[^"]*"', '\\1"***"', 'g') AS config, coalesce(n_tables, 0) AS n_tables, coalesce(n_edges, 0) AS n_edges, coalesce(n_terms, 0) AS n_terms
      FROM c LEFT JOIN b ON name = source""",
    "store_upsert": """WITH c AS (SELECT DISTINCT name, updated_at, priority FROM connections)
      SELECT name, CAST(row_number() OVER w AS INTEGER) AS version, coalesce(last_value(priority IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), -1) AS priority FROM c WINDOW w AS (PARTITION BY name ORDER BY updated_at, coalesce(priority, -1))""",
}
