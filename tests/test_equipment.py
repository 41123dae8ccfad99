"""Packs, questions, views and sinks on rows written by hand."""

import pytest
from graphloom.operators import chunk, clean, extract, graph, merge, packs, qa, views
from graphloom.sources import files
from pyspark.sql import functions as F

NOTE = "依据GB/T 1234.5 -  2010，叶片应满足温度限值。\n轴承过热表现为温度升高，由于润滑不足；应更换轴承！"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d1", "c1", "规范.pdf", 3, 4, NOTE), ("d1", "c2", "规范.pdf", 5, 5, "前言 发布 实施 叶片裂纹"), ("d2", "c1", None, 1, 1, None), (None, None, None, None, None, "")]
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, file_name string, page_start int, page_end int, chunk_text string")


def test_packs_find_terms_and_pairs(chunks):
    found = {(r["entity_name"], r["entity_type"], r["page_num"]) for r in packs.mentions(chunks).collect()}
    assert {("GB/T 1234.5 - 2010", "Standard", "3-4"), ("叶片", "Device", "3-4"), ("叶片", "Component", "3-4"), ("轴承过热", "Fault", "3-4"), ("过热", "Fault", "3-4"), ("更换", "Action", "3-4"), ("更换轴承", "MaintenanceAction", "3-4")} <= found
    assert ("叶片裂纹", "Fault", "5") not in found  # boilerplate
    rows = {(r["head_entity"], r["relation"], r["tail_entity"]): r["source_sentence"] for r in packs.relations(chunks).collect()}
    assert rows["轴承过热", "HAS_SYMPTOM", "温度升高"] == rows["过热", "CAUSED_BY", "润滑不足"] == "轴承过热表现为温度升高，由于润滑不足"
    assert ("叶片", "HAS_PARAMETER", "温度") in rows and ("轴承过热", "RESOLVED_BY", "更换轴承") not in rows
    assert ("GB/T 1234.5 - 2010", "APPLIES_TO", "叶片") not in {(r["head_entity"], r["relation"], r["tail_entity"]) for r in packs.relations(chunks, packs.PACKS["v2"]).collect()}


def test_pair_patterns_open_the_gate_alone(spark):
    rule = extract.Rule("R", "A", "B", pairs=("{head}.{0,2}由.{0,2}{tail}",))
    vocabulary = [("x.", "A"), ("y", "B")]
    rows = spark.createDataFrame([(1, "1", "x.-由-y。xz由y。x.----由y")], "doc_id long, chunk_id string, text string")
    assert [r["ord"] for r in extract.relations(rows, vocabulary, [rule], F.col("text")).collect()] == [0]


def edges(spark):
    rows = [("轴承过热", "Fault", "CAUSED_BY", "润滑不足", "Cause", "轴承过热由于润滑不足引起", 1), ("轴承过热", "Fault", "CAUSED_BY", "润滑不足", "Cause", "轴承过热由于润滑不足引起", 2), ("轴承过热", "Fault", "OCCURS_ON", "轴承", "Component", "轴承出现轴承过热", 3), ("叶片裂纹", "Fault", "OCCURS_ON", "风力发电机组", "Component", "风力发电机组发生叶片裂纹", 4)]
    rows = [(*r[:6], "技术规范.pdf", "7", None, r[6]) for r in rows]
    e = spark.createDataFrame(rows, "src string, src_type string, relation string, dst string, dst_type string, source_sentence string, file_name string, page_num string, page_span string, ord long")
    return e.withColumn("rel_zh", views.relation_name(F.lit(None).cast("string"), F.col("relation")))


def test_rule_questions_are_answered(spark):
    asked = ["轴承过热的原因是什么？", "风机有哪些故障", "轴承过热有哪些症状", "今天天气", "怎么处理"]
    got = {r["question_id"]: (r["entity"], r["kind"], r["answer"], r["n_results"]) for r in qa.answers(spark.createDataFrame(list(enumerate(asked)), "question_id long, question string"), edges(spark)).collect()}
    assert got[0] == ("轴承过热", "故障原因", "根据图谱证据，轴承过热可能的主要原因包括：润滑不足。", 1)
    assert got[1] == ("风力发电机组", "部件故障", "根据图谱证据，风力发电机组相关的主要故障包括：叶片裂纹。", 1)
    assert got[2] == ("轴承过热", "故障症状", qa.NO_FAULT_RESULT, 0) and got[3] == ("", "", qa.NO_KIND, 0) and got[4] == ("", "处理措施", qa.NO_ENTITY, 0)


def test_free_questions_meet_their_node(spark):
    nodes = spark.createDataFrame([("轴承", "Component"), ("轴承过热", "Fault"), ("温度", "Parameter"), ("主轴承过热处理", "Action")], "name string, type string")
    asked = spark.createDataFrame([(0, "轴承过热怎么处理？"), (1, "主轴承过热"), (2, "作用"), (3, "温度")], "question_id long, question string")
    assert {r["question_id"]: (r["name"], r["intent"]) for r in qa.matched(asked, nodes).collect()} == {0: ("轴承过热", "处理措施"), 1: ("轴承过热", "综合查询"), 2: ("轴承过热", "作用用途"), 3: ("温度", "综合查询")}


def test_views_of_few_edges(spark):
    e = edges(spark)
    nodes, grouped = views.full(e)
    assert {r["name"]: (r["degree"], r["size"]) for r in nodes.collect()}["轴承过热"] == (3, 40.0)
    assert {(r["src"], r["dst"]): (r["source_count"], r["width"]) for r in grouped.collect()}["轴承过热", "润滑不足"] == (1, 6.0)
    local_nodes, best = views.local(e, "轴承过热")
    assert [(r["dst"], r["score"]) for r in best.orderBy(F.col("score").desc()).collect()] == [("轴承", 121), ("润滑不足", 111)] and local_nodes.filter("is_center").count() == 1
    alone = views.local(e, "没有")
    assert [(r["name"], r["type"]) for r in alone[0].collect()] == [("没有", "Entity")] and alone[1].count() == 0
    assert views.standard_local(e, "轴承过热")[1].agg(F.sum("source_count")).first()[0] == 3
    none = e.filter(F.lit(False))
    assert all(x.count() == 0 for view in (views.full(none), views.type_view(none), views.standard_local(none, "x")) for x in view)
    assert spark.range(1).select(views.page_or_unknown(F.lit(""), F.lit(None).cast("string"))).first()[0] == "未知"


def test_sinks_and_scans(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, type string")
    e = spark.createDataFrame([("a", "A", "R", "b", "B")], "src string, src_type string, relation string, dst string, dst_type string")
    files.refresh_graph(nodes, e, f"{tmp_path}/g")
    files.refresh_graph(nodes, e, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/nodes").count() == 2
    with pytest.raises(ValueError):
        files.refresh_graph(nodes.union(nodes), e, f"{tmp_path}/g")
    files.clear_graph(spark, f"{tmp_path}/g", "name string, type string", e.schema.simpleString()[7:-1].replace(":", " "))
    assert spark.read.parquet(f"{tmp_path}/g/edges").count() == 0
    inventory = spark.createDataFrame([("f", "f.pdf", "/in/f.pdf", "f.pdf", True, "Success"), ("g", "g.pdf", "/in/g.pdf", "g.pdf", False, "success")], "file_stem string, file_name string, full_path string, relative_path string, is_scanned_suspect boolean, detect_status string")
    files.write_csv(inventory, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert [r["full_path"] for r in files.scanned(back).collect()] == ["/in/f.pdf"] and [r["file_stem"] for r in files.textual(back).collect()] == ["g"]
    assert files.scanned(back.drop("detect_status")).count() == 2
    assert [r["file_stem"] for r in files.first_by_path(back, 1).collect()] == ["f"]
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.json_lines(spark, f"{tmp_path}/lines.jsonl", "a int").filter("a is not null").collect()) == [1, 2]
    assert files.json_lines(spark, f"{tmp_path}/nowhere.jsonl", "a int").count() == 0
    files.write_lines(nodes, f"{tmp_path}/lines")
    files.write_documents(nodes, f"{tmp_path}/docs", "name")
    assert spark.read.json(f"{tmp_path}/lines").count() == spark.read.json(f"{tmp_path}/docs").count() == 2
    assert files.select(spark, "SELECT name FROM {v} WHERE type = :kind", {"v": nodes}, kind="B").first()[0] == "b"
    assert files.memo(nodes).count() == 2


def test_inventory_as_csv_with_a_mark(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿file_stem,file_name,full_path,relative_path,level_1_dir,level_2_dir,level_3_dir,suffix,size_mb,page_count,sample_text_len,is_scanned_suspect,detect_status\na,a.pdf,/a.pdf,a.pdf,,,,.pdf,1.25,3,10,True,success\n", encoding="utf-8")
    row = files.read_inventory(spark, f"{tmp_path}/i.csv").first()
    assert row["file_stem"] == "a" and row["size_mb"] == 1.25 and row["page_count"] == 3


def test_chunks_and_pages(spark):
    text = "短。\n\n" + "甲" * 130 + "。\n\n" + "乙" * 1100 + "丙。丁。"
    docs = spark.createDataFrame([(1, [(2, text, False), (1, "目录", True), (3, " ", False)], "high_quality"), (2, [], "high_quality"), (3, [(1, "一", False)], "low_quality")], "doc_id long, pages array<struct<page_num: int, text: string, is_toc_page: boolean>>, quality_label string")
    got = chunk.chunk_documents(docs).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["page_start"], r["chunk_len"]) for r in got] == [("1_chunk_0001", 2, 134), ("1_chunk_0002", 2, 500), ("1_chunk_0003", 2, 500), ("1_chunk_0004", 2, 105), ("3_chunk_0001", 1, 1)]
    assert {r["doc_id"]: r["chunk_count"] for r in chunk.chunk_index(chunk.chunk_documents(docs)).collect()} == {1: 4, 3: 1}
    paged = chunk.chunk_pages(docs.withColumnRenamed("pages", "cleaned_pages")).collect()
    assert [r["text_len"] for r in paged] == [134, 500, 500, 102, 2] and {r["doc_id"] for r in paged} == {1}


def test_quality_and_page_numbers(spark):
    texts = ["短", "正常的中文句子很多很多" * 20, "字" * 30 + "abcdefgh " * 12, "x|~` y|~` z|~` w|~`\n" * 30]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clean.text_quality(F.col("t")).alias("q")).orderBy("i").collect()
    assert [r["q"]["quality_reason"] for r in got] == ["text_too_short", "readable_chinese_text", "partially_readable", "garbled_or_noisy"] and got[3]["q"]["garbled_segments"] == 30
    pages = {"a\n 12 \nb": "a\n\nb", "a\n-\n12\n-\nb": "a\n\nb", "第 3 页\nx": "x", "1 2\n第": "1 2\n第", "a  \n\n\n\n b": "a\n\nb", None: ""}
    rows = spark.createDataFrame([(k,) for k in pages], "t string").select("t", clean.clean_page(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == pages


def test_ocr_pages_fold_their_lines(spark):
    rows = [("1 总则\n本规范\n适用于\n各类设备的运行与维护检查工作要求说明。\n12\n学 兔 兔", 3), ("目录", 1), ("", 0), ("版权所有\n仅此\n而已，没有别的什么内容可以写在这里了吧", 4)]
    got = clean.clean_ocr_records(spark.createDataFrame(rows, "text string, ocr_line_count int")).collect()
    assert got[0]["filter_reason"] == "" and got[2]["filter_reason"] == "empty_after_clean" and got[3]["filter_reason"] == "low_value_page_hint"
    assert "学" not in got[0]["clean_text"]


def test_pool_takes_the_last_native_document_and_the_best_page(spark):
    native = spark.createDataFrame([("b", "d/x", "x.pdf", [(1, "new", False)]), ("a", "d/x", "", [(1, "old", False)]), ("c", "", "y.pdf", [(2, "", True)])], "file_path string, relative_path string, file_name string, cleaned_pages array<struct<page_num: int, text: string, is_toc_page: boolean>>")
    ocr = spark.createDataFrame([("d/x", "", "2", "ocr", False, "", 1), ("d/x", "", "0", "no page", False, "", 2), ("d/x", "", "two", "no page", False, "", 3), ("", "y.pdf", "2", "much longer", True, "why", 4), ("", "y.pdf", "2", "short", False, "", 5)], "relative_path string, file_name string, page_num string, clean_text string, is_filtered boolean, filter_reason string, ord long")
    got = {r["doc_key"]: r for r in merge.standard_documents(*merge.document_pool(native, ocr)).collect()}
    assert got["rel::d/x"]["merged_text"] == "[PAGE 1]\nnew\n[PAGE 2]\nocr" and got["rel::d/x"]["selected_source_stats"] == {"text_clean": 1, "ocr_clean": 1} and got["rel::d/x"]["title"] == "x"
    assert got["name::y.pdf"]["merged_text"] == "[PAGE 2]\nshort" and got["name::y.pdf"]["has_ocr_clean"]
    assert spark.range(1).select(merge.source_priority(F.lit("ocr")), merge.source_priority(F.lit("?"))).first()[:] == (2, 99)


def test_probe_says_why_a_file_could_not_be_read(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 150, None), (1, 2, "b" * 60, None), (1, 6, "c" * 500, None), (2, 1, "short", None), (3, None, None, "x" * 200)], "id long, page_num int, text string, error string")
    got = {r["id"]: tuple(r)[1:] for r in files.probe(pages, ["id"]).collect()}
    assert got[1] == (3, 211, False, "success") and got[2] == (1, 5, True, "success") and got[3] == (-1, 0, True, "failed: " + "x" * 100)
    assert tuple(files.probe_summary(files.probe(pages, ["id"])).first()) == (3, 2, 2, 1, 1)


def test_node_names_are_checked(spark):
    rows = spark.createDataFrame([("a", "A"), ("a", "B")], "name string, type string")
    assert files.is_unique(rows, ["name", "type"]) and not files.is_unique(rows, ["name"])
    e = graph.edges(spark.createDataFrame([("a", "A", "RESOLVED_BY", "a", "B", 1, "c")], "head_entity string, head_type string, relation string, tail_entity string, tail_type string, doc_id int, chunk_id string"), rows, views.STORED_NAMES)
    assert e.first()["rel_zh"] == "通过措施处理"
