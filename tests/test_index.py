import json
from datetime import datetime
from pathlib import Path

from catalith.plans import catalog_queries, link_queries, run_queries
from catalith.session import ensure_checkpoint_dir


def test_the_index_follows_its_files(spark, tmp_path):
    """Built once; anew when a table's files change and when the shared folder was emptied."""
    snap = lambda names: json.dumps({"tables": [{"name": n, "columns": [{"name": "id"}]} for n in names], "edges": [], "terms": []})
    write = lambda i, names: spark.createDataFrame([(i, "s", "ddl", snap(names), datetime(2030, 1, i))], "snap_id long, source string, source_type string, payload string, built_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/snapshots.parquet")
    spark.createDataFrame([], "name string, type string, config string, created_at timestamp, updated_at timestamp, priority int").write.parquet(f"{tmp_path}/connections.parquet")
    write(1, ["pier"])
    tables = lambda: {r.table_key for r in link_queries.catalog_objects(spark, str(tmp_path)).tables.collect()}
    assert tables() == {"pier"}
    first = link_queries.catalog_objects(spark, str(tmp_path))
    assert link_queries.catalog_objects(spark, str(tmp_path)) is first
    write(2, ["pier", "mole"])
    assert tables() == {"pier", "mole"} and {r.token for r in link_queries.lexical_postings(spark, str(tmp_path)).collect()} == {"pier", "mole", "id", "identifier"}
    last = link_queries.catalog_objects(spark, str(tmp_path))
    for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("index-*"):
        p.unlink()
    assert link_queries.catalog_objects(spark, str(tmp_path)) is not last and tables() == {"pier", "mole"}
    assert catalog_queries.merge_keys(spark, str(tmp_path)).count() == 0


def test_eval_link_links_what_it_scores(spark, tmp_path, monkeypatch):
    """Only questions that name a table have a row in the scores, so only they are linked, and by tables only; the scores are those of linking all."""
    snap = json.dumps({"tables": [{"name": n, "columns": [{"name": c} for c in ("id", f"{n}_length")]} for n in ("pier", "mole", "quay")], "edges": [{"kind": "foreign_key", "from_table": "pier", "to_table": "mole", "from_columns": ["id"], "to_columns": ["id"]}], "terms": []})
    spark.createDataFrame([(1, "s", "ddl", snap, datetime(2030, 1, 1))], "snap_id long, source string, source_type string, payload string, built_at timestamp").write.parquet(f"{tmp_path}/snapshots.parquet")
    spark.createDataFrame([], "name string, type string, config string, created_at timestamp, updated_at timestamp, priority int").write.parquet(f"{tmp_path}/connections.parquet")
    items = [(1, "a", "select pier_length from pier"), (2, "a", "how long is the mole"), (3, "b", "select * from gone"), (4, "b", "SELECT 1 FROM quay JOIN mole"), (5, "b", None)]
    spark.createDataFrame(items, "item_id long, suite string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    sf, real, seen = str(tmp_path), link_queries.K.link, []
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    monkeypatch.setattr(run_queries.K, "link", lambda q, o, **k: seen.append(({r.qid for r in q.collect()}, real(q, o, **k))) or seen[-1][1])
    got = rows(run_queries.eval_link(spark, sf))
    (asked, linked), = seen
    assert asked == {1, 4} and linked.seeds.columns == ["qid", "node", "weight"] and linked.columns is None and linked.nodes is None
    whole = real(link_queries.questions(spark, sf), link_queries.catalog_objects(spark, sf))
    for name in ("tables", "ranked", "paths"):
        assert rows(getattr(linked, name)) == rows(getattr(whole, name).filter("qid in (1, 4)"))
    monkeypatch.setattr(run_queries.K, "link", lambda *_, **__: whole)
    assert got == rows(run_queries.eval_link(spark, sf)) and [r[:2] for r in got] == [("all", 2), ("suite:a", 1), ("suite:b", 1)]
