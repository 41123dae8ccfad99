import pytest
from graphloom.operators import answer
from pyspark.sql import functions as F

EDGES = [
    ("齿轮箱", "Component", "DETECTED_BY", "振动监测", "Method", "a规程", "3", "齿轮箱应采用振动监测进行检测", 1),
    ("齿轮箱", "Component", "DETECTED_BY", "振动监测", "Method", "b", None, "齿轮箱的振动监测", 2),
    ("齿轮箱", "Component", "HAS_PARAMETER", "油温", "Parameter", None, "", "齿轮箱油温", 3),
    ("漏油", "Fault", "OCCURS_ON", "齿轮箱", "Component", "b", "4-5", "齿轮箱出现漏油", 4),
]
ASKED = [(1, "齿轮箱怎么检测", "检测方法", "齿轮箱"), (2, "齿轮箱有哪些故障", "部件故障", "齿轮箱"), (3, "塔架怎么处理", "处理措施", "塔架"), (4, "齿轮箱怎么处理", "处理措施", "齿轮箱"), (5, "齿轮箱", "综合查询", "齿轮箱")]


@pytest.fixture(scope="module")
def got(spark):
    edges = spark.createDataFrame(EDGES, "src string, src_type string, relation string, dst string, dst_type string, file_name string, page string, source_sentence string, ord int")
    asked = spark.createDataFrame(ASKED, "question_id int, question string, intent string, entity string")
    return {r["question_id"]: r for r in answer.answers(asked, edges).collect()}


def test_preferred_rows_are_cited(got):
    assert got[1]["answer"] == "根据图谱与文本证据，齿轮箱相关的主要检测方法包括：振动监测。 相关依据可参考《a规程》第 3 页的相关条文。"
    assert (got[1]["graph_hits"], got[1]["evidences"], got[1]["score"], got[1]["level"]) == (1, 2, 45, "中")


def test_faults_are_read_in_reverse(got):
    assert got[2]["answer"] == "根据图谱与文本证据，齿轮箱相关的主要故障包括：漏油。 相关依据可参考《b》第 4-5 页的相关条文。"


def test_no_rows_and_no_actions(got):
    assert got[3]["answer"] == "未在图谱中检索到与“塔架”直接相关的知识。" and (got[3]["score"], got[3]["level"]) == (0, "低")
    assert got[4]["answer"].startswith("当前未检索到与“齿轮箱”直接对应的明确处理措施条款。") and got[4]["graph_hits"] == 2


def test_open_questions_follow_the_order_of_relations(got):
    assert "油温" in got[5]["answer"] and "检测方法包括：振动监测" in got[5]["answer"]


def test_record_points(spark):
    row = spark.createDataFrame([("油温应符合限值", "齿轮箱", "油温", "x标准", "3")], "s string, e string, t string, f string, p string")
    got = row.select(answer.score_record(*map(F.col, "setfp"), hints=["应符合", "限值"], shortest=12, needed=["参数"], strict=["限值"]).alias("n")).first()["n"]
    assert got == 3 + 4 + 1 + 1 - 2 - 3
