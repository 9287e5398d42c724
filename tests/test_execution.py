import pytest

from catalith.plans.execution import Executor, Refused, guard, infer_kind, normalize, result_findings, row_limit, same_column, same_table

GOOD = [
    "SELECT 1", "select * from t where a > 1 order by b limit 3;", "```sql\nselect a from t\n```", "with x as (select 1 a) select a from x", "(select a from t) union all select b from t",
    "select a from t intersect select b from t except select 3", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 4) select n from r",
    "select a, sum(b) over (partition by a order by b) from t", "select a from t where exists (select 1 from u where u.x = t.a)", "select * from range(3)", "from t", "select a, count(*) from t group by rollup(a) having count(*) > 1",
    "select t.a, (select max(x) from u) from t join u using (a) cross join (select 1 z)", "select explode(array(1, 2))", "values (1, 2), (3, 4)", "select a from t limit 5 offset 2",
]
BAD = [
    "", "select 1; select 2", "insert into t values (1)", "delete from t", "update t set a = 1", "drop table t", "create table x as select 1", "create view v as select 1", "alter table t add column b int", "set x = 1", "use db", "show tables",
    "describe t", "explain select 1", "cache table t", "add jar 'x'", "refresh table t", "analyze table t compute statistics", "call p()", "load data inpath 'x' into table t", "truncate table t", "select * from parquet.`/etc/x`", "select * from csv.`a.csv`",
    "select * from `x.parquet`", "select java_method('java.lang.System', 'getenv', 'HOME')", "select reflect('a', 'b')", "select a from t where b = (select java_method('java.lang.System', 'exit', 1))", "select * from read_files('x')",
    "from t insert into u select a", "select transform(a) using 'cat' from t", "begin select 1; end", "execute immediate 'select 1'", "select " + "1," * 30000 + "1", "merge into t using u on t.a = u.a when matched then delete", "not sql at all",
]


@pytest.fixture(scope="module")
def ex(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    spark.createDataFrame([(1, 10.5, "CA"), (2, None, "NY"), (3, 7.0, None)], "id int, total double, state string").write.parquet(f"{d}/orders.parquet")
    spark.range(2000).write.parquet(f"{d}/big.parquet")
    return Executor.over_folder(spark, str(d), ["orders", "big"], max_join_rows=1e7)


@pytest.mark.parametrize("sql", GOOD)
def test_admitted(spark, sql):
    assert guard(spark, sql)


@pytest.mark.parametrize("sql", BAD)
def test_refused(spark, sql):
    with pytest.raises(Refused):
        guard(spark, sql)


def test_execute(ex):
    r = ex.execute("select state, id from orders order by id", limit=2, count_cap=2)
    assert r.ok and r.columns == ["state", "id"] and r.rows == [("CA", 1), ("NY", 2)] and r.row_count == 2 and r.row_count_capped
    assert ex.execute("select id from orders", limit=3).row_count_capped is False
    assert ex.execute("select nope from orders").error_kind == "syntax"
    assert ex.execute("select * from missing").error_kind == "syntax"
    assert ex.execute("drop view orders").error_kind == "guard"
    assert ex.execute("select 1 / 0 from orders").error_kind == "runtime"
    assert ex.execute("select repeat('x', 500) a, cast('ab' as binary) b, cast(1.50 as decimal(5,2)) c").rows == [("x" * 200 + "…", "<blob 2 bytes>", "1.50")]


def test_timeout(ex):
    r = ex.execute("select count(*) from range(100000000000) where sin(id) > 2", timeout=1.5)
    assert not r.ok and r.error_kind == "timeout"


def test_cost(spark):
    e = Executor(spark, max_join_rows=1e5)
    assert e.execute("select count(*) from range(3000) a cross join range(3000) b").error_kind == "cost"
    assert e.execute("select count(*) from range(3000) a join range(3000) b using (id)").ok


def test_limits(spark):
    assert row_limit(spark, "select 1 limit 7") == 7 and row_limit(spark, "select 1") is None and row_limit(spark, "select * from (select 1 limit 7)") is None
    assert normalize("```sql\nselect 1;\n```") == "select 1"


def test_result_findings(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert result_findings(df, 10) == [("all_null", 0.15)]
    assert result_findings(df.limit(0), 10) == [("empty_result", 0.3)]
    assert ("row_explosion", 0.3) in result_findings(spark.range(30), 10)


def test_comparison():
    kinds = {"int": ["1", "2"], "float": ["1", ""], "object": ["007", "x"], "bool": ["True", "false"], "na": ["None", "NULL", "NA"]}
    assert all(infer_kind(v) == k for k, v in kinds.items()) and infer_kind(["1_0"]) == "object" and infer_kind(["007", "8"]) == "int"
    assert same_column([1.0], [1.004]) and not same_column([1.0], [1.02]) and same_column([float("nan")], [0]) and same_column([2, 1], [1, 2], ignore_order=True)
    assert same_table({"x": ["a"], "y": [1, 2]}, {"g": [1, 2]}) and not same_table({"y": [1, 3]}, {"g": [1, 2]}) and same_table({"y": [1]}, {"g": [1], "h": [9]}, condition=[0])
