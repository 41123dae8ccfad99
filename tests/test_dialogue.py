"""Whole answers with and without a model that fails, is late or says too little."""

import time

import pytest
from graphloom.operators import dialogue
from pyspark.sql import functions as F

EDGES = [
    ("齿轮箱", "Component", "DETECTED_BY", "振动监测", "Method", "a规程", "3", "齿轮箱应采用振动监测进行检测", 1),
    ("漏油", "Fault", "OCCURS_ON", "齿轮箱", "Component", "b", "4-5", "齿轮箱出现漏油", 2),
]
ASKED = [(1, "齿轮箱怎么检测"), (2, "齿轮箱有哪些故障"), (3, "天气"), (4, " "), (5, None), (6, "齿轮箱的检测方法有哪些"), (7, "齿轮箱检测")]


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.createDataFrame(EDGES, "src string, src_type string, relation string, dst string, dst_type string, file_name string, page string, source_sentence string, ord int")
    nodes = spark.createDataFrame([("齿轮箱", "Component"), ("漏油", "Fault"), ("振动监测", "Method")], "name string, type string")
    return spark.createDataFrame(ASKED, "question_id int, question string"), nodes, edges


def test_every_question_is_answered_by_template(tables):
    got = {r["question_id"]: r for r in dialogue.respond(*tables).collect()}
    assert set(got) == set(range(1, 8))
    assert got[1]["answer"].startswith("根据图谱与文本证据，齿轮箱相关的主要检测方法包括：振动监测。") and got[1]["confidence_info"]["note"] == dialogue.NO_MODEL
    assert got[1]["confidence_info"]["data_warning"] is None and got[1]["confidence_info"]["source_count"] == 1 and got[1]["graph_results"][0]["dst"] == "振动监测"
    assert "漏油" in got[2]["answer"] and got[2]["evidence_results"][0]["file_name"] == "b"
    assert got[3]["answer"] == "未在图谱实体中识别到与“天气”匹配的实体。" and got[3]["confidence_info"]["reason"] == dialogue.NO_NODE_REASON
    assert got[4]["answer"] == got[5]["answer"] == dialogue.EMPTY and got[5]["graph_results"] == []


def test_a_model_answers_within_its_deadline_or_the_template_does(tables):
    def ask(prompt):
        if "用户问题：齿轮箱怎么检测\n" in prompt:
            assert "1. 齿轮箱 --[检测方法]--> 振动监测（目标类型：Method）；证据句：齿轮箱应采用振动监测进行检测；来源：a规程 第3页" in prompt
            return "  模型的回答：齿轮箱采用振动监测进行检测。 "
        if "有哪些故障" in prompt:
            raise ValueError("down")
        if "检测方法有哪些" in prompt:
            time.sleep(60)
        return "太短"

    began = time.monotonic()
    got = {r["question_id"]: r for r in dialogue.respond(*tables, model=ask, deadline=2.0).collect()}
    assert time.monotonic() - began < 55 and set(got) == set(range(1, 8))
    assert got[1]["answer"] == "模型的回答：齿轮箱采用振动监测进行检测。" and got[1]["confidence_info"]["note"] is None
    assert all(got[i]["answer"].startswith("根据图谱与文本证据") for i in (2, 6, 7)) and got[4]["answer"] == dialogue.EMPTY


def test_without_edges_a_warning_says_so(tables):
    got = {r["question_id"]: r for r in dialogue.respond(tables[0], tables[1], tables[2].filter(F.lit(False))).collect()}
    assert got[1]["answer"] == "未在图谱中检索到与“齿轮箱”直接相关的知识。" and got[1]["confidence_info"]["data_warning"] == dialogue.NO_DATA
