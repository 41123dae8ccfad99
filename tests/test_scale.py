"""Dictionary joins, folds over long documents, positions, versioned graphs and bounded sources, against plain Python."""

import numpy as np
import pytest
from graphloom.operators import chunk, dictionary, extract, folds, ordering, views
from graphloom.sources.graph_store import GraphStore
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcde机油"), int(n))) for n in rng.integers(0, 60, 300)] + [None, "", "abcde" * 2000]
    names = sorted({"".join(rng.choice(list("abcde机油"), int(n))) for n in rng.integers(1, 7, 400)}) + [""]
    return texts, names, {(i, n) for i, t in enumerate(texts) for n in names if t and n and n in t}


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_dictionary_join_equals_containment(spark, words, most):
    texts, names, want = words
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, said string, more string").repartition(3)
    table = spark.createDataFrame([(n, len(n)) for n in names] + [(None, 0), (names[0], 99)], "name string, size long")
    got = [tuple(r) for r in dictionary.holding(rows, "said", table, "name", keep_text=False, most_names=most).select("i", "name", "size").collect()]
    assert len(got) == len(set(got)) and {r[:2] for r in got} == want and {r for r in got if r[2] != 99} == {(i, n, len(n)) for i, n in want}
    assert {i for i, n, s in got if s == 99} == {i for i, n in want if n == names[0]}
    assert dictionary.holding(rows, "said", table.filter("false"), "name", most_names=most).count() == 0


def test_vocabulary_as_a_table_equals_literals(spark):
    vocabulary = [("齿轮箱", "Device"), ("漏油", "Fault"), ("油", "Parameter"), ("裂纹", "Fault"), ("齿轮箱", "Component")]
    rows = spark.createDataFrame([(1, "a", "齿轮箱漏油。裂纹！油温"), (2, "b", "漏油齿轮箱漏油"), (3, "c", None)], "doc_id long, chunk_id string, text string")
    table, rules = spark.createDataFrame(vocabulary, "name string, type string"), [extract.Rule("R", "Device", "Fault"), extract.Rule("S", "Component", "Parameter", words=("漏",))]
    ordered = lambda x: sorted(map(str, x.collect()))
    assert ordered(extract.mentions_of(rows, table, F.col("text"))) == ordered(extract.mentions(rows, vocabulary, F.col("text")).select("entity_name", "entity_type", "doc_id", "chunk_id"))
    assert ordered(extract.relations_of(rows, table, rules, F.col("text"))) == ordered(extract.relations(rows, vocabulary, rules, F.col("text")))


def test_mentions_of_are_not_shuffled_and_follow_the_rows_of_chunks(spark):
    rows = spark.createDataFrame([(1, "a", "one two"), (1, "a", "one two"), (2, "b", "two"), (3, "c", None)], "doc_id long, chunk_id string, text string")
    table = spark.createDataFrame([("one", "X"), ("one", "X"), ("one", "Y"), ("two", None), (None, "Z"), ("", "Z")], "name string, type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what is found were too large for it
    try:
        found = extract.mentions_of(rows, table, F.col("text"))
        got = sorted((r["doc_id"], r["entity_name"], r["entity_type"] or "") for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([(1, "one", "X"), (1, "one", "Y"), (1, "two", "")] * 2 + [(2, "two", "")])  # as SQL's join has it: a row for each row
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def fold(lengths, alone, kind, limit):
    """Group numbers by reading the units one by one."""
    out, group, held, single = [], -1, None, False
    for n, a in zip(lengths, alone, strict=True):
        if kind == "short_units":
            joins = held is not None and held < limit
            held = held + 1 + n if joins else n
        elif kind == "packed":
            joins = held is not None and held + n <= limit
            held = held + n if joins else n
        else:
            joins = held is not None and not single and not a and held < limit and n < limit
            held = held + n if joins else n
            single = a
        group += not joins
        out.append(group)
    return out


@pytest.mark.parametrize(("kind", "limit", "block"), [("short_units", 12, 16), ("short_units", 12, 1 << 16), ("packed", 30, 40), ("short_lines", 15, 16)])
def test_folds_by_blocks_equal_folds_in_order(spark, kind, limit, block):
    rng = np.random.default_rng(7)
    docs = {f"d{k}": (rng.integers(1, 40 if k % 2 else 6, n), rng.random(n) < 0.1) for k, n in enumerate([1, 2, 15, 16, 17, 40, 400, 1000])}
    rows = [(d, i, int(n), bool(a)) for d, (ns, alone) in docs.items() for i, (n, a) in enumerate(zip(ns, alone, strict=True))]
    units = spark.createDataFrame(rows, "doc string, i long, n int, alone boolean").repartition(5)
    got = {(r["doc"], r["i"]): r["group"] for r in folds.grouped(units, ["doc"], getattr(folds, kind)(limit), alone="alone", block=block).collect()}
    assert got == {(d, i): g for d, (ns, alone) in docs.items() for i, g in enumerate(fold(ns.tolist(), alone.tolist(), kind, limit))}
    assert folds.grouped(units.filter("false"), ["doc"], folds.packed(30), block=40).count() == 0


def test_chunks_of_unit_tables_equal_chunks_of_rows(spark):
    rng = np.random.default_rng(3)
    texts = ["\n\n".join("".join(rng.choice(list("甲乙丙丁。！ ab"), int(n))) for n in rng.integers(1, 900, int(k))) for k in rng.integers(1, 12, 20)] + ["", " ", "短。"]
    docs = spark.createDataFrame([(i, [(2, t, False), (1, "目录", True), (3, t[:50], False)]) for i, t in enumerate(texts)], "doc_id long, pages array<struct<page_num: int, text: string, is_toc_page: boolean>>")
    pages = docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    got, want = (sorted(map(tuple, x.select("doc_id", "chunk_id", "page_start", "page_end", "chunk_text", "chunk_len").collect())) for x in (chunk.chunk_page_rows(pages, block=512), chunk.chunk_documents(docs)))
    assert got == want


def test_positions_by_ranges(spark):
    rows = spark.createDataFrame([(f"k{i % 3}" if i % 4 else None, f"p{(i * 37) % 500:03d}", i) for i in range(500)], "key string, path string, v long")
    got = ordering.numbered(rows, ["path"], ranges=7).collect()
    assert sorted((r["path"], r["ord"]) for r in got) == [(f"p{i:03d}", i) for i in range(500)]
    by = {}
    for r in ordering.numbered(rows, ["path"], keys=["key"], ranges=7).collect():
        by.setdefault(r["key"], []).append((r["path"], r["ord"]))
    assert all([o for _, o in sorted(x)] == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 500


NODES, EDGES = "name string, type string", "src string, src_type string, relation string, dst string, dst_type string, doc_id string, chunk_id string, said string"


def test_readers_see_a_whole_graph_whatever_fails(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=4)
    node = lambda *names: spark.createDataFrame([(n, "T") for n in names], NODES)
    edge = lambda *pairs: spark.createDataFrame([(a, "T", "R", b, "T", d, "1", said) for a, b, d, said in pairs], EDGES)
    read = lambda v=None: (sorted(r["name"] for r in store.read("nodes", v).collect()), sorted((r["src"], r["dst"], r["said"]) for r in store.read("edges", v).collect()))
    with pytest.raises(FileNotFoundError):
        store.read("nodes")
    assert store.refresh(node("a", "b", "c"), edge(("a", "b", "1", "old"))) == 1
    first = read()
    with pytest.raises(ValueError):
        store.refresh(node("x", "x"), edge())
    written = store._write
    with monkeypatch.context() as m:
        m.setattr(store, "_write", lambda table, rows: written(table, rows) if table == "nodes" else 1 / 0)
        with pytest.raises(ZeroDivisionError):  # between nodes and edges
            store.refresh(node("z"), edge())
    assert read() == first and store.versions() == [1]
    before = store.manifest()["nodes"]
    assert store.upsert(node("b", "d", "d"), edge(("a", "b", "1", "new"), ("d", "a", "2", "new"), ("a", "nowhere", "3", "new"))) == 2
    assert read() == (["a", "b", "c", "d"], [("a", "b", "old"), ("d", "a", "new")]) and read(1) == first
    after = store.manifest()["nodes"]
    assert sum(after.get(b) != before.get(b) for b in after) == 1  # only the bucket of d
    assert store.upsert(node("a")) == 3 and store.manifest()["nodes"] == after  # nothing new: no bucket is written
    assert store.clear() == 4 and read() == ([], []) and read(2)[0] == ["a", "b", "c", "d"]
    with monkeypatch.context() as m:
        m.setattr(store, "_next", lambda: 4)  # as if another writer had been first
        with pytest.raises(RuntimeError):
            store.refresh(node("a"), edge())
    assert store.versions() == [1, 2, 3, 4]


def test_edges_of_many_sources_keep_the_first_and_count_all(spark):
    rows = spark.range(30_000).selectExpr("'a' AS src", "'Fault' AS src_type", "'CAUSED_BY' AS relation", "'b' AS dst", "'Cause' AS dst_type", "NULL AS rel_zh", "concat('f', id % 20000) AS file_name", "'1' AS page_num", "CAST(NULL AS STRING) AS page_span", "'said' AS source_sentence", "id AS ord")
    edge = views.full(rows)[1].first()
    assert edge["source_count"] == 20_000 and [s["ord"] for s in edge["sources"]] == list(range(views.SOURCES))
    assert views.standard_local(rows, "a")[1].first()["source_count"] == 30_000
