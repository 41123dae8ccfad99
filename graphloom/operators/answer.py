"""Answers to a table of questions from graph edges: retrieval, scores, evidence, confidence, sentences. One plan for all of them.

Edges: src, src_type, relation, dst, dst_type, file_name, page, source_sentence, ord. Every top-k has a total order, by ord last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, count_hits, label
from ..sources.stage import staged
from .ask import confidence, level
from .dictionary import holding

# Names, hints and sentences that answers are made of.
OPEN_INTENTS = ["作用用途", "定义说明", "综合查询"]
REVERSE_INTENT = "部件故障"
RELATIONS_OF = {
    "参数要求": ["HAS_PARAMETER"],
    "使用方法": ["USES_METHOD", "DETECTED_BY"],
    "条件约束": ["UNDER_CONDITION"],
    "措施要求": ["REQUIRES_ACTION"],
    "部件故障": ["OCCURS_ON"],
    "故障症状": ["HAS_SYMPTOM"],
    "故障原因": ["CAUSED_BY"],
    "处理措施": ["RESOLVED_BY", "REQUIRES_ACTION"],
    "检测方法": ["DETECTED_BY", "USES_METHOD"],
}
TYPES_OF = {
    "参数要求": ["Parameter"],
    "使用方法": ["Method"],
    "条件约束": ["Condition"],
    "措施要求": ["Action", "MaintenanceAction"],
    "部件故障": ["Fault"],
    "故障症状": ["Symptom"],
    "故障原因": ["Cause"],
    "处理措施": ["Action", "MaintenanceAction"],
    "检测方法": ["Method"],
}
OPEN_ORDER = ["HAS_PARAMETER", "USES_METHOD", "UNDER_CONDITION", "REQUIRES_ACTION", "OCCURS_ON", "HAS_SYMPTOM", "CAUSED_BY", "RESOLVED_BY", "DETECTED_BY"]
SENTENCE_WORDS = {
    "参数要求": ["应满足", "应符合", "限值", "误差", "不超过", "不低于"],
    "使用方法": ["试验", "检测", "测量", "校验", "监测"],
    "条件约束": ["环境温度", "海拔", "湿度", "户内", "户外", "条件"],
    "措施要求": ["更换", "检修", "停运", "维修", "处理", "加强监测"],
    "处理措施": ["更换", "检修", "停运", "维修", "处理", "加强监测"],
    "故障症状": ["症状", "表现", "伴有", "异响", "升高", "振动增大", "告警"],
    "故障原因": ["由于", "导致", "引起", "原因", "造成"],
    "检测方法": ["检测", "监测", "试验", "测量", "校验", "巡视", "巡检"],
}
FILE_WORDS = ["标准", "规范", "规程", "监督", "技术"]
RELATION_NAMES = {
    "USES_METHOD": "使用方法",
    "HAS_PARAMETER": "参数要求",
    "UNDER_CONDITION": "条件约束",
    "REQUIRES_ACTION": "措施要求",
    "OCCURS_ON": "发生于部件",
    "HAS_SYMPTOM": "具有症状",
    "CAUSED_BY": "由原因引起",
    "RESOLVED_BY": "处理措施",
    "DETECTED_BY": "检测方法",
}
SENTENCES = {
    "部件故障": "根据图谱与文本证据，%s相关的主要故障包括：%s。",
    "故障症状": "根据图谱与文本证据，%s相关的主要症状包括：%s。",
    "故障原因": "根据图谱与文本证据，%s可能的主要原因包括：%s。",
    "处理措施": "根据图谱与文本证据，针对%s可采取的主要处理措施包括：%s。",
    "检测方法": "根据图谱与文本证据，%s相关的主要检测方法包括：%s。",
    "参数要求": "根据图谱与文本证据，%s相关的主要参数要求包括：%s。",
    "使用方法": "根据图谱与文本证据，%s相关的主要使用方法包括：%s。",
    "条件约束": "根据图谱与文本证据，%s相关的主要条件约束包括：%s。",
    "措施要求": "根据图谱与文本证据，%s相关的主要措施要求包括：%s。",
}
NO_ROWS = "未在图谱中检索到与“%s”直接相关的知识。"
NO_ACTIONS = "当前未检索到与“%s”直接对应的明确处理措施条款。现有结果主要反映相关现象、部件或参数信息，不能直接等同于处理措施。"
USE = "根据知识图谱及相关标准文本，%s主要与%s等内容相关，说明其在运行监测、状态评估、参数控制或技术监督中具有一定作用。"
USE_MORE = " 从现有证据看，其关联知识主要体现为：%s。"
MEANING = "在当前图谱证据范围内，可将“%s”理解为与%s密切相关的关键对象。"
MEANING_SHORT, MEANING_ITEMS = "参数要求、试验方法和运行条件", "%s等知识项"
MEANING_MORE = " 从已检索到的关联关系看，主要包括：%s。"
MEANING_END = " 目前尚未定位到标准文本中可直接引用的通用定义条款，因此以上为基于现有证据的概括性说明。"
ANY = "根据图谱与文本证据，%s的相关知识主要包括：%s。"
ANY_MORE = " 进一步看，其关联内容主要体现为：%s。"
SOURCE, SOURCE_PAGE, SOURCE_END = " 相关依据可参考《%s》", "第 %s 页", "的相关条文。"
REASONS = {"高": "图谱与文本证据较充分，来源信息较完整。", "中": "已有一定证据支撑，建议结合原文条款进一步核验。", "低": "证据条数或来源信息不足，结论需谨慎参考。"}


def of_intent(intent: Column, value: Column, table: dict[str, list[str]]) -> Column:
    """Whether value is among those that table has for the intent."""
    names = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(names, intent), value), F.lit(False))


def words_of_intent(intent: Column, sentence: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for name, words in table.items():
        out = out | ((intent == name) & contains_any(sentence, words))
    return out


def points(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def score_record(sentence: Column, entity: Column, target: Column, file_name: Column, page: Column, hints: list[str], shortest: int, needed: list[str] | None = None, strict: list[str] | None = None) -> Column:
    """A record's points for one kind of question: hints count each; without any word of needed, 3 less, of strict, 1 less."""
    out = points((entity != "") & sentence.contains(entity), 4) + points((target != "") & sentence.contains(target), 3) + 2 * count_hits(sentence, hints)
    out = out + points(contains_any(file_name, FILE_WORDS), 1) + points(page != "", 1) - points(F.length(sentence) < shortest, 2)
    for words, n in ((needed, 3), (strict, 1)):
        if words is not None:
            out = out - points(~contains_any(sentence, words), n)
    return out


def tokens_of(question: Column) -> Column:
    """A question's words of two or more characters."""
    return F.regexp_extract_all(question, F.lit("([一-鿿A-Za-z0-9]{2,})"), F.lit(1))


def score_row(intent: Column, tokens: Column, relation: Column, target: Column, target_type: Column, sentence: Column, file_name: Column, page: Column) -> Column:
    """A graph row's points for a question; each of its tokens that the row's sentence holds counts."""
    return (
        points((target != "") & sentence.contains(target), 3) + points(page != "", 1) + points(contains_any(file_name, FILE_WORDS), 1)
        + points(of_intent(intent, relation, RELATIONS_OF), 5) + points(of_intent(intent, target_type, TYPES_OF), 4)
        + points(words_of_intent(intent, sentence, SENTENCE_WORDS), 3) + points(intent.isin(OPEN_INTENTS[:2]), 1) + F.size(F.filter(tokens, lambda t: sentence.contains(t)))
    )


def retrieve(asked: DataFrame, edges: DataFrame, forward: int = 120, reverse: int = 80) -> DataFrame:
    """Edges of each question's entity (question_id, question, intent, entity): its first forward ones, or what occurs on it."""
    e = edges.select("src", "src_type", "relation", "dst", "dst_type", "file_name", "page", "source_sentence", "ord")
    turned = e.filter(F.col("relation") == "OCCURS_ON").select(F.col("dst").alias("src"), F.col("dst_type").alias("src_type"), "relation", F.col("src").alias("dst"), F.col("src_type").alias("dst_type"), "file_name", "page", "source_sentence", "ord")
    by = Window.partitionBy("src").orderBy("ord", "relation", "dst", "source_sentence")
    back = F.col("intent") == REVERSE_INTENT
    # only asked nodes' rows are ranked, and limited before questions meet them: a hot node costs each question no more than the limit
    asked = asked.withColumn("_tokens", tokens_of(F.col("question")))  # once a question, not once a row
    names = asked.select(F.col("entity").alias("src")).distinct()
    first = lambda rows, n: rows.join(names, "src", "left_semi").withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")
    found = [asked.filter(test).join(rows, F.col("entity") == F.col("src")) for test, rows in ((~back, first(e, forward)), (back, first(turned, reverse)))]
    return found[0].unionByName(found[1])


def rank(rows: DataFrame, n: int = 8) -> DataFrame:
    """The n best rows of a question, one for each (src, relation, dst), as column rank from 1.

    Rows whose relation or target type fits the intent; if none does, all. Open intents keep all, in the order of OPEN_ORDER.
    """
    fits = of_intent(F.col("intent"), F.col("relation"), RELATIONS_OF) | of_intent(F.col("intent"), F.col("dst_type"), TYPES_OF)
    kept = rows.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(Window.partitionBy("question_id"))).filter("_fits or not _any")
    c = F.col
    place = F.when(c("intent").isin(OPEN_INTENTS), F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OPEN_ORDER)), c("relation")), F.lit(0)), F.lit(999))).otherwise(0)
    kept = kept.withColumns({"score": score_row(c("intent"), c("_tokens"), c("relation"), c("dst"), c("dst_type"), c("source_sentence"), c("file_name"), c("page")), "_place": place})
    order = [c("score").desc(), c("_place"), c("ord"), c("relation"), c("dst"), c("source_sentence")]
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "src", "relation", "dst").orderBy(*order))).filter("_n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(c("rank") <= n).drop("_n", "_fits", "_any", "_place", "_tokens")


def evidence(targets: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    """Up to n distinct (file_name, page, source_sentence) of a question whose sentence holds its entity and one of its targets."""
    said = edges.filter(F.col("source_sentence") != "").groupBy("file_name", "page", "source_sentence").agg(F.min("ord").alias("ord"))
    # sentences meet distinct (entity, targets) only: questions that ask the same cost no more pairs
    wanted = staged(targets.select("entity", "targets").distinct())
    hits = holding(said, "source_sentence", wanted, "entity").filter(F.exists("targets", lambda t: (t != "") & F.col("source_sentence").contains(t)))
    by = Window.partitionBy("entity", "targets").orderBy("ord", "file_name", "page", "source_sentence")
    kept = hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)
    return targets.join(kept, ["entity", "targets"]).select("question_id", "rank", "file_name", "page", "source_sentence")


def _firsts(rows: Column, n: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(rows, lambda r: r["dst"]), lambda x: x != "")), 1, n)


def summary(rows: Column) -> Column:
    """Relations in their first order with up to four distinct targets each, the first four relations."""
    named = lambda r: label(r["relation"], RELATION_NAMES)
    names = F.slice(F.array_distinct(F.transform(F.filter(rows, lambda r: r["dst"] != ""), named)), 1, 4)
    return F.array_join(F.transform(names, lambda x: F.concat(x, F.lit("包括："), F.array_join(_firsts(F.filter(rows, lambda r: named(r) == x), 4), "、"))), "；")


def sentence(intent: Column, entity: Column, rows: Column, evidences: Column) -> Column:
    """The answer from a question's ranked rows (relation, dst, dst_type) and evidences (file_name, page)."""
    joined, about = F.array_join(_firsts(rows, 5), "、"), summary(F.slice(rows, 1, 6))
    more = lambda text: F.when(about != "", F.format_string(text, about)).otherwise("")
    acts = F.filter(rows, lambda r: r["relation"].isin(RELATIONS_OF["处理措施"]) | r["dst_type"].isin(TYPES_OF["处理措施"]))
    concept = F.when(F.length(F.trim(joined)) < 3, F.lit(MEANING_SHORT)).otherwise(F.format_string(MEANING_ITEMS, joined))
    out = F.when(intent == "作用用途", F.concat(F.format_string(USE, entity, joined), more(USE_MORE)))
    out = out.when(intent == "定义说明", F.concat(F.format_string(MEANING, entity, concept), more(MEANING_MORE), F.lit(MEANING_END)))
    out = out.when((intent == "处理措施") & (F.size(_firsts(acts, 5)) == 0), F.format_string(NO_ACTIONS, entity))
    for name, text in SENTENCES.items():
        out = out.when(intent == name, F.format_string(text, entity, F.array_join(_firsts(acts, 5), "、") if name == "处理措施" else joined))
    out = out.otherwise(F.concat(F.format_string(ANY, entity, joined), more(ANY_MORE)))
    first = F.try_element_at(evidences, F.lit(1))
    page = F.when(F.trim(first["page"]) != "", F.format_string(SOURCE_PAGE, first["page"])).otherwise("")
    cited = F.when(F.coalesce(first["file_name"], F.lit("")) != "", F.concat(F.format_string(SOURCE, first["file_name"]), page, F.lit(SOURCE_END))).otherwise("")
    return F.when(F.size(rows) == 0, F.format_string(NO_ROWS, entity)).otherwise(F.concat(out, cited))


#: What is kept of a ranked row, in this order after its rank.
ROW = ["relation", "dst", "dst_type", "src", "src_type", "source_sentence", "file_name", "page", "score"]


def gathered(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """asked (question_id, question, intent, entity) with rows (the ranked ones), proofs (the evidence), score and level of every question."""
    edges = edges.withColumns({x: F.coalesce(F.col(x), F.lit("")) for x in ("file_name", "page", "source_sentence")})
    asked = staged(asked)  # what follows reads these two several times: a question's few rows
    ranked = staged(rank(retrieve(asked, edges)))
    listed = ranked.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *ROW))), lambda r: F.struct(*(r[x].alias(x) for x in ROW))).alias("rows"))
    targets = asked.select("question_id", "entity").join(listed, "question_id").select("question_id", "entity", _firsts(F.col("rows"), 5).alias("targets"))
    proofs = evidence(targets, edges).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file_name", "page", "source_sentence"))).alias("proofs"))
    out = asked.join(listed, "question_id", "left").join(proofs, "question_id", "left")
    none = lambda x: F.coalesce(F.col(x), F.array().cast(dict(out.dtypes)[x]))
    out = out.withColumns({"rows": none("rows"), "proofs": none("proofs")})
    wanted = F.exists(F.col("rows"), lambda r: of_intent(F.col("intent"), r["relation"], RELATIONS_OF))
    return out.withColumn("score", confidence(F.size("rows"), F.size("proofs"), files_of(F.col("proofs")), has_pages(F.col("proofs")), wanted)).withColumn("level", level(F.col("score")))


def files_of(proofs: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(proofs, lambda p: p["file_name"]), lambda x: x != "")))


def has_pages(proofs: Column) -> Column:
    return F.exists(proofs, lambda p: F.trim(p["page"]) != "")


def answers(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """question_id, entity, intent, answer, score, level, reason, graph_hits, evidences for every row of asked.

    asked: question_id, question, intent, entity (that of the graph it was matched to). Null page and file_name count as empty.
    """
    return gathered(asked, edges).select(
        "question_id", "entity", "intent", sentence(F.col("intent"), F.col("entity"), F.col("rows"), F.col("proofs")).alias("answer"), "score", "level",
        label(F.col("level"), REASONS).alias("reason"), F.size("rows").alias("graph_hits"), F.size("proofs").alias("evidences"),
    )
