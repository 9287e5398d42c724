"""The relational surface that answers run on: joins, aggregates, windows, set operations, subqueries, recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.operators.rangescan import range_scan
from catalith.session import table


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


def _r(c, n: int = 2):
    return F.round(c, n)


def rel_pricing_summary(spark, sf):
    (l,) = _t(spark, sf, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.filter("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(_r(F.sum("l_quantity")).alias("sum_qty"), _r(F.sum("l_extendedprice"), 0).alias("sum_base"), _r(F.sum(price), 0).alias("sum_disc"), _r(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def rel_join_chain(spark, sf):
    r, n, c, o, l = _t(spark, sf, "region", "nation", "customer", "orders", "lineitem")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(_r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


def rel_semi_join(spark, sf):
    o, l = _t(spark, sf, "orders", "lineitem")
    late = l.filter("l_returnflag = 'R'").select("l_orderkey")
    return o.join(late, o.o_orderkey == late.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def rel_anti_join(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), _r(F.sum("c_acctbal")).alias("balance"))


def rel_not_in(spark, sf):
    spark_sql = "SELECT p_partkey, p_brand FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)"
    return spark.sql(spark_sql, part=table(spark, sf, "part"), lineitem=table(spark, sf, "lineitem"))


def rel_outer_join(spark, sf):
    c, s = _t(spark, sf, "customer", "supplier")
    a, b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("nc")), s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("ns"))
    return a.filter("k > 5").join(b.filter("k < 15"), "k", "full").select(F.col("k").alias("nationkey"), F.coalesce("nc", F.lit(0)).alias("customers"), F.coalesce("ns", F.lit(0)).alias("suppliers"))


def rel_inequality_join(spark, sf):
    """Pairs of parts of a brand whose prices are close: an equi join on brand and a price band with its neighbours, not all pairs."""
    (p,) = _t(spark, sf, "part")
    band = F.floor(F.col("p_retailprice") / 0.5)
    a = p.select("p_brand", F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("pa"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = p.select("p_brand", F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("pb"), band.alias("band"))
    return a.join(b, ["p_brand", "band"]).filter("a < b and abs(pa - pb) <= 0.5").groupBy("p_brand").agg(F.count("*").alias("n"))


def rel_asof_join(spark, sf):
    """For each purchase the user's last click before it, by one ordered scan over both."""
    (e,) = _t(spark, sf, "events")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    run = range_scan(e.select("user_id", "ts", "event_id", "event_type", click.alias("c")), ["user_id"], [F.col("ts"), F.col("event_id")], {"last_click": ("prev_last", "c")})
    return run.filter("event_type = 'purchase'").select("event_id", F.coalesce("last_click", F.lit(-1)).alias("last_click"))


def rel_scalar_subquery(spark, sf):
    q = "SELECT l_partkey, round(sum(l_extendedprice), 0) AS total FROM {lineitem} l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} x WHERE x.l_partkey = l.l_partkey) GROUP BY l_partkey"
    return spark.sql(q, lineitem=table(spark, sf, "lineitem"))


def rel_rollup(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "gid")


def rel_cube(spark, sf):
    o = table(spark, sf, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


def rel_grouping_sets(spark, sf):
    q = "SELECT coalesce(n_name, '*') AS nation, coalesce(c_mktsegment, '*') AS segment, count(*) AS n FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (c_mktsegment), ())"
    return spark.sql(q, c=table(spark, sf, "customer"), n=table(spark, sf, "nation"))


def rel_filtered_aggregate(spark, sf):
    q = "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) FILTER (WHERE value <= 50) AS low_users FROM {e} GROUP BY ALL"
    return spark.sql(q, e=table(spark, sf, "events"))


def rel_running_total(spark, sf):
    """Running sums in cents, by one ordered scan: a customer with any share of the orders is spread over many tasks."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    run = range_scan(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], {"running": ("sum", "cents"), "rn": ("row_number", None), "before": ("lag", "o_orderkey")})
    return run.select("o_orderkey", _r(F.col("running") / 100, 2).alias("running"), F.col("rn").cast("int").alias("rn"), F.coalesce("before", F.lit(-1)).alias("before"))


def rel_rank_functions(spark, sf):
    p = table(spark, sf, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    return p.select("p_partkey", F.rank().over(w).cast("int").alias("rk"), F.dense_rank().over(w).cast("int").alias("dr"), _r(F.percent_rank().over(w), 6).alias("pr"), F.ntile(4).over(w.orderBy(F.desc("p_size"), "p_partkey")).cast("int").alias("quartile"))


def rel_top_per_group(spark, sf):
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rn", F.row_number().over(w).cast("int")).filter("rn <= 2").select("o_custkey", "rn", "o_orderkey")


def rel_moving_average(spark, sf):
    """Means of a value and the two before it: the lag of a lag, by ordered scans."""
    e, order = table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), [F.col("ts"), F.col("event_id")]
    one = range_scan(e, ["user_id"], order, {"b1": ("lag", "value")})
    two = range_scan(one, ["user_id"], order, {"b2": ("lag", "b1")})
    some = F.array_compact(F.array("b2", "b1", "value"))
    return two.select("event_id", _r(F.aggregate(some, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(some), F.lit(0)), 4).alias("mavg"))


def rel_text_functions(spark, sf):
    p = table(spark, sf, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return p.select("p_partkey", F.upper("p_brand").alias("up"), F.substring("p_name", 2, 5).alias("mid"), F.regexp_replace("p_type", "[AEIOU]", "*").alias("starred"), F.length("p_name").alias("len"), F.reverse("p_brand").alias("back"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("-", word, F.lower("p_type")).alias("joined"), F.instr("p_type", "E").alias("at"), F.trim(F.concat(F.lit("  "), word, F.lit(" "))).alias("word"))


def rel_time_functions(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", F.year("d").alias("y"), F.quarter("d").alias("q"), F.dayofyear("d").alias("doy"), F.date_format("d", "yyyy-MM").alias("ym"), F.datediff(F.lit("1999-01-01").cast("date"), "d").alias("left"), F.date_format(F.add_months("d", 1), "yyyy-MM-dd").alias("next"), F.date_format(F.trunc("d", "month"), "yyyy-MM-dd").alias("first"), F.date_format(F.last_day("d"), "yyyy-MM-dd").alias("last"))


def rel_number_functions(spark, sf):
    l = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("long")
    return l.select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 7).cast("long").alias("down"), F.ceil(F.col("l_quantity") / 7).cast("long").alias("up"), (q % 7).alias("rest"), F.round(F.sqrt("l_quantity"), 6).alias("root"), F.round(F.log("l_quantity"), 6).alias("ln"), F.greatest(q, F.lit(25)).cast("long").alias("most"), F.nullif(q, F.lit(1)).alias("none"), F.sign(q - 25).cast("int").alias("sign"), q.bitwiseXOR(F.lit(5)).alias("xor"))


def rel_array_functions(spark, sf):
    """Arrays and maps from words: sorted, filtered, transformed, sliced, set operations and lookups."""
    w = table(spark, sf, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("a"), F.split(F.lower("p_type"), " ").alias("b"))
    text = lambda c: F.array_join(c, ",")
    return w.select(
        "p_partkey", text("a").alias("sorted"), F.size("a").alias("n"), text(F.filter("a", lambda x: F.length(x) > 4)).alias("long"), text(F.transform("a", lambda x: F.substring(x, 1, 2))).alias("heads"), text(F.slice("a", 1, 2)).alias("two"),
        F.array_contains("a", "red").alias("red"), text(F.array_sort(F.array_union("a", F.array_distinct("b")))).alias("both"), F.aggregate("a", F.lit(0), lambda x, y: x + F.length(y)).alias("chars"),
        F.try_element_at(F.map_from_arrays("a", F.transform("a", lambda x: F.length(x))), F.get("a", F.lit(0))).alias("first_len"),
    )


def rel_json_functions(spark, sf):
    """Fields and list elements of JSON texts, and a row for each element."""
    s = table(spark, sf, "snapshots").select("snap_id", "payload").distinct()
    edges = F.from_json(F.get_json_object("payload", "$.edges"), "array<struct<kind: string, confidence: double>>")
    return s.select("snap_id", F.get_json_object("payload", "$.source").alias("source"), F.posexplode(edges).alias("pos", "e")).select("snap_id", "source", "pos", "e.kind", F.round("e.confidence", 4).alias("confidence"))


def rel_derived_scalar(spark, sf):
    """Rows against a scalar of a derived table (a product with one row in SQL, a scalar subquery here)."""
    o = table(spark, sf, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    return o.filter(F.col("o_totalprice") > 2 * mean.scalar()).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def rel_generators(spark, sf):
    """Rows from ranges and from lists, and names that need quotes."""
    n = spark.range(1, 13).select(F.col("id").alias("order no"))
    months = n.select("order no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("order no"))).alias("select"))
    return months.groupBy("order no").agg(F.sum("select").alias("sum of all"))


def rel_fetch(spark, sf):
    """The first rows in an order after others: what FETCH FIRST, LIMIT with OFFSET and LIMIT ALL ask for."""
    c = table(spark, sf, "customer")
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(3).limit(7).select("c_custkey")


def rel_set_operations(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, x: df.select("k", F.lit(x).alias("op"))
    return tag(c.intersect(s), "both").union(tag(c.subtract(s), "customers only")).union(tag(c.union(s).distinct(), "any"))


def rel_except_all(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.exceptAll(s).groupBy("k").agg(F.count("*").alias("n"))


def rel_recursive(spark, sf):
    q = "WITH RECURSIVE d(day, n) AS (SELECT 0, 1 UNION ALL SELECT day + 1, n * 2 FROM d WHERE day < 20) SELECT day, n FROM d"
    return spark.sql(q)


def rel_pivot(spark, sf):
    e = table(spark, sf, "events")
    kinds = ["click", "error", "purchase", "view"]
    p = e.withColumn("b", F.pmod("user_id", F.lit(10))).groupBy("b").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return p.select("b", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds])


def rel_quantiles(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(_r(F.percentile("value", F.lit(0.5)), 4).alias("median"), _r(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)"), 4).alias("p90"))


def rel_order_limit(spark, sf):
    """The most valuable orders 11 to 30 (the feature's limit)."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", _r("o_totalprice").alias("price"))


def rel_sessions(spark, sf):
    """Sessions of a user: events with gaps of at most 30 minutes, by one ordered scan."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    lagged = range_scan(e, ["user_id"], [F.col("ts"), F.col("event_id")], {"before": ("lag", "ts")})
    new = F.when(F.col("before").isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp")) > 1800 * 1000000), 1).otherwise(0)
    return lagged.withColumn("new", new).groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("events"))


def rel_time_windows(spark, sf):
    e = table(spark, sf, "events")
    hour = F.date_format(F.date_trunc("hour", F.to_utc_timestamp("ts", F.current_timezone())), "yyyy-MM-dd HH")
    return e.groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))


def rel_column_stats(spark, sf):
    """Distinct values, nulls, least and largest of result columns, in one pass."""
    e = table(spark, sf, "spider2_exec_mix_candidates")
    cols = ["run_id", "instance_id", "action", "generator", "fingerprint"]
    row = e.agg(*[x for c in cols for x in (F.countDistinct(c).alias(f"{c}_d"), F.count_if(F.col(c).isNull()).alias(f"{c}_n"), F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_z"))])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_d").alias("n_distinct"), F.col(f"{c}_n").alias("n_null"), F.col(f"{c}_a").alias("least"), F.col(f"{c}_z").alias("largest")) for c in cols])
    return row.select(F.explode(each).alias("s")).select("s.*")


def rel_join_key_stats(spark, sf):
    """Rows, distinct values and rows per value of the keys that joins use."""
    keys = [("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("customer", "c_nationkey"), ("part", "p_partkey")]
    out = None
    for t, c in keys:
        one = table(spark, sf, t).agg(F.count(c).alias("n"), F.countDistinct(c).alias("d")).select(F.lit(t).alias("table"), F.lit(c).alias("key"), "n", "d", _r(F.col("n") / F.col("d"), 2).alias("per_value"), (F.col("n") == F.col("d")).alias("is_unique"))
        out = one if out is None else out.unionByName(one)
    return out


#: The text columns of all tables; a table without any has an empty list.
_TEXT = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "embeddings": [], "documents": ["text", "lang", "source", "repo", "commit_sha", "author"], "eval_items": ["suite", "text"], "mix_targets": ["source"],
    "connections": ["name", "type", "config"], "snapshots": ["source", "source_type", "payload", "warnings"], "join_hints": ["from_table", "to_table", "from_columns", "to_columns", "description"],
    "spider2_exec_legacy": ["run_id", "series", "config"], "spider2_exec_mix": ["run_id", "series", "config", "summary"],
    "spider2_exec_mix_candidates": ["run_id", "instance_id", "id", "parent_id", "action", "generator", "sql", "rationale", "advice", "feedback", "score_parts", "rubric", "missing", "findings", "fingerprint", "error", "exec_error", "prompt", "context_key"],
}


def src_row_counts(spark, sf):
    """The rows of every table."""
    out = None
    for n in _TEXT:
        one = table(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def src_sample_values(spark, sf):
    """The first five distinct values of each text column of every table, cut at 80 characters (the feature's limit): one pass for each table, in which each task keeps its own first five."""
    out = None
    for t in _TEXT:
        df = table(spark, sf, t)
        names = [c for c, kind in df.dtypes if kind == "string"]
        if names:
            each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.substring(c, 1, 80).alias("v")) for c in names])).alias("e")).select(F.lit(t).alias("table"), "e.*").filter("v is not null")
            out = each if out is None else out.unionByName(each)
    first = out.withColumn("n", F.dense_rank().over(Window.partitionBy("table", "column").orderBy("v"))).filter("n <= 5").select("table", "column", "v").distinct()
    return first.groupBy("table", "column").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith(("rel_", "src_"))}

_ONE = "SELECT '{t}' AS \"table\", '{c}' AS key, count({c}) AS n, count(DISTINCT {c}) AS d, round(count({c}) / count(DISTINCT {c}), 2) AS per_value, count({c}) = count(DISTINCT {c}) AS is_unique FROM {t}"
_STAT = "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, min({c}) AS least, max({c}) AS largest FROM spider2_exec_mix_candidates"
_SAMPLE = "SELECT '{t}' AS \"table\", '{c}' AS \"column\", string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT DISTINCT substring({c}, 1, 80) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5) HAVING count(*) > 0"

SQL: dict[str, str] = {
    "rel_text_functions": "SELECT p_partkey, upper(p_brand) AS up, substring(p_name, 2, 5) AS mid, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS starred, length(p_name) AS len, reverse(p_brand) AS back, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat_ws('-', split_part(p_name, ' ', 1), lower(p_type)) AS joined, instr(p_type, 'E') AS at, trim('  ' || split_part(p_name, ' ', 1) || ' ') AS word FROM part",
    "rel_time_functions": "SELECT o_orderkey, year(d) AS y, quarter(d) AS q, dayofyear(d) AS doy, strftime(d, '%Y-%m') AS ym, date_diff('day', d, DATE '1999-01-01') AS left, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS next, strftime(date_trunc('month', d), '%Y-%m-%d') AS first, strftime(last_day(d), '%Y-%m-%d') AS last FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
    "rel_number_functions": "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 7) AS BIGINT) AS down, CAST(ceil(l_quantity / 7) AS BIGINT) AS up, q % 7 AS rest, round(sqrt(l_quantity), 6) AS root, round(ln(l_quantity), 6) AS ln, greatest(q, 25) AS most, nullif(q, 1) AS none, CAST(sign(q - 25) AS INTEGER) AS sign, xor(q, 5) AS xor FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)",
    "rel_array_functions": "SELECT p_partkey, array_to_string(a, ',') AS sorted, len(a) AS n, array_to_string([x for x in a if len(x) > 4], ',') AS long, array_to_string([x[1:2] for x in a], ',') AS heads, array_to_string(a[1:2], ',') AS two, list_contains(a, 'red') AS red, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, CAST(list_sum([len(x) for x in a]) AS INTEGER) AS chars, len(a[1]) AS first_len FROM (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS a, string_split(lower(p_type), ' ') AS b FROM part)",
    "rel_json_functions": "SELECT snap_id, source, CAST(pos AS INTEGER) AS pos, e->>'kind' AS kind, round(CAST(e->>'confidence' AS DOUBLE), 4) AS confidence FROM (SELECT snap_id, payload->>'$.source' AS source, unnest(CAST(json_extract(payload, '$.edges') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(payload, '$.edges') AS JSON[]), 1) - 1 AS pos FROM (SELECT DISTINCT snap_id, payload FROM snapshots WHERE json_valid(payload)))",
    "rel_derived_scalar": "SELECT o_orderpriority, count(*) AS n FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS m FROM orders) WHERE o_totalprice > 2 * m GROUP BY ALL",
    "rel_generators": "SELECT \"order no\", CAST(sum(\"select\") AS BIGINT) AS \"sum of all\" FROM (SELECT range AS \"order no\", unnest(range(1, range + 1)) AS \"select\" FROM range(1, 13)) GROUP BY ALL",
    "rel_fetch": "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 3 ROWS FETCH FIRST 7 ROWS ONLY",
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 0) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 0) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY ALL",
    "rel_join_chain": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "rel_semi_join": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL",
    "rel_anti_join": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY ALL",
    "rel_not_in": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "rel_outer_join": "SELECT coalesce(a.k, b.k) AS nationkey, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS nc FROM customer WHERE c_nationkey > 5 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS ns FROM supplier WHERE s_nationkey < 15 GROUP BY 1) b ON a.k = b.k",
    "rel_inequality_join": "SELECT a.p_brand, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 0.5 GROUP BY ALL",
    "rel_asof_join": "SELECT event_id, coalesce(last_click, -1) AS last_click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events) WHERE event_type = 'purchase'",
    "rel_scalar_subquery": "SELECT l_partkey, round(sum(l_extendedprice), 0) AS total FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey) GROUP BY l_partkey",
    "rel_rollup": "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INTEGER) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_cube": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rel_grouping_sets": "SELECT coalesce(n_name, '*') AS nation, coalesce(c_mktsegment, '*') AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (c_mktsegment), ())",
    "rel_filtered_aggregate": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) FILTER (WHERE value <= 50) AS low_users FROM events GROUP BY ALL",
    "rel_running_total": "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, CAST(row_number() OVER w AS INTEGER) AS rn, coalesce(lag(o_orderkey) OVER w, -1) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "rel_rank_functions": "SELECT p_partkey, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, round(percent_rank() OVER w, 6) AS pr, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS quartile FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)",
    "rel_top_per_group": "SELECT o_custkey, CAST(rn AS INTEGER) AS rn, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
    "rel_moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mavg FROM events",
    "rel_set_operations": "SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'any' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "rel_except_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY ALL",
    "rel_recursive": "WITH RECURSIVE d(day, n) AS (SELECT 0, 1 UNION ALL SELECT day + 1, n * 2 FROM d WHERE day < 20) SELECT day, n FROM d",
    "rel_pivot": "SELECT user_id % 10 AS b, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY 1",
    "rel_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_disc(value, 0.9), 4) AS p90 FROM events GROUP BY ALL",
    "rel_order_limit": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "rel_sessions": "SELECT user_id, CAST(sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 1800000000 THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY ALL",
    "rel_time_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "rel_column_stats": " UNION ALL ".join(_STAT.format(c=c) for c in ("run_id", "instance_id", "action", "generator", "fingerprint")),
    "rel_join_key_stats": " UNION ALL ".join(_ONE.format(t=t, c=c) for t, c in (("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("customer", "c_nationkey"), ("part", "p_partkey"))),
    "src_row_counts": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in _TEXT),
    "src_sample_values": " UNION ALL ".join(_SAMPLE.format(t=t, c=c) for t, cs in _TEXT.items() for c in cs),
}
