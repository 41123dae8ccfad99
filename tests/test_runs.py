"""Streams into versioned graphs, summaries in passing, kept tables, edge tables by bucket."""

import json

import pytest
from graphloom.operators import adjacency, graph
from graphloom.sources import files
from graphloom.sources.graph_store import GraphStore
from graphloom.streaming import resume
from pyspark.sql import functions as F

SAID = "a string, b string, doc_id string"


def step(rows):
    nodes = rows.select(F.explode(F.array("a", "b")).alias("name"), F.lit("T").alias("type")).distinct()
    return nodes, rows.select(F.col("a").alias("src"), F.lit("T").alias("src_type"), F.lit("R").alias("relation"), F.col("b").alias("dst"), F.lit("T").alias("dst_type"), "doc_id", F.lit("1").alias("chunk_id"))


def test_a_stopped_stream_repeats_no_row(spark, tmp_path, monkeypatch):
    store, lines = GraphStore(spark, f"file://{tmp_path}/graph", buckets=2), tmp_path / "lines"
    lines.mkdir()
    none = step(spark.createDataFrame([], SAID))
    store.refresh(*none)
    write = lambda name, *rows: (lines / name).write_text("\n".join(json.dumps(dict(zip(("a", "b", "doc_id"), r, strict=True))) for r in rows))
    read = lambda: sorted((r["src"], r["dst"], r["doc_id"]) for r in store.read("edges").collect())
    run = lambda: resume.upsert_available(spark, str(lines), SAID, step, store, f"{tmp_path}/checkpoint")
    write("1.json", ("x", "y", "1"), ("x", "y", "1"), ("x", "z", "1"))
    run()
    assert read() == [("x", "y", "1"), ("x", "z", "1")] and store.done("edges") == 0
    write("2.json", ("x", "y", "1"), ("y", "z", "2"))
    upsert = store.upsert
    with monkeypatch.context() as m:  # the commit is made, then the run stops
        m.setattr(store, "upsert", lambda *a, **k: (upsert(*a, **k), 1 / 0))
        with pytest.raises(Exception, match="ZeroDivision"):
            run()
    assert store.done("edges") == 1
    versions = store.versions()
    run()
    assert read() == [("x", "y", "1"), ("x", "z", "1"), ("y", "z", "2")] and store.versions() == versions  # the batch came again and was left out
    run()
    assert store.versions() == versions


def test_files_are_taken_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"a": "{k}"}}')
        resume.run_available(spark, f"{tmp_path}/in", "a string", lambda x: x.withColumn("n", F.length("a")), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(r["a"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1"]


def test_summaries_come_with_the_job_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([("ok", 1), ("ok", 9), ("bad", 9), (None, 1), ("other", 9)], "status string, v int")
    told, summary = files.observed(rows, "status", ["ok", "bad", "never"], F.col("v") > 5)
    told.write.parquet(f"{tmp_path}/out")
    got = summary()
    want = {r["status"]: {k: r[k] for k in ("n", "n_high", "n_low")} for r in files.run_summary(rows, "status", F.col("v") > 5).collect()}
    assert {k: got[k] for k in ("ok", "bad")} == {k: want[k] for k in ("ok", "bad")} and got["never"]["n"] == 0 and got[None] == {"n": 5, "n_high": 3, "n_low": 2}


def test_kept_tables_are_loaded_once_and_refreshed(spark, tmp_path):
    loads, memos = [], files.Memos(spark)

    def load():
        loads.append(1)
        return spark.read.schema("a int").json(f"{tmp_path}/t.json")

    memos.add("t", load, "a int")
    assert memos.get("t").count() == memos.get("t").count() == 0 and len(loads) == 1  # not there: empty
    (tmp_path / "t.json").write_text('{"a": 1}')
    assert memos.get("t").count() == 0 and memos.refresh("t").count() == 1 and memos.get("t").count() == 1 and len(loads) == 2
    kept = memos.get("t")
    memos.drop("t")
    assert not kept.is_cached
    with pytest.raises(KeyError):
        memos.get("t")


def test_questions_meet_edges_where_they_lie(spark):
    rows = spark.createDataFrame([(f"n{i % 7}", "R", f"n{i % 5}", i) for i in range(200)], "src string, relation string, dst string, ord long")
    adjacency.write(rows, "near_test", 4)
    names = spark.createDataFrame([("n1",), ("n4",), ("n1",)], "name string")
    for got, want, end in ((adjacency.out_of(spark, "near_test", names), graph.out_neighbours(rows, names), "src"), (adjacency.into(spark, "near_test", names), graph.in_neighbours(rows, names), "dst")):
        assert sorted(r["ord"] for r in got.collect()) == sorted(r["ord"] for r in want.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("near_test")] and plan.count("Exchange") <= 2  # the names' own
    assert {tuple(r) for r in adjacency.degrees(spark, "near_test").collect()} == {tuple(r) for r in graph.degrees(rows).collect()}
    assert "Exchange" not in adjacency.degrees(spark, "near_test")._jdf.queryExecution().executedPlan().toString()
    for x in ("out", "in"):
        spark.sql(f"DROP TABLE near_test_{x}")
