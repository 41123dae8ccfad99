"""Rule questions: the kind of a question, its entity, the edges that answer it, scored, grouped and told. One plan for a table of questions.

Fault questions are tried first, then the others. Edges are as in `views`; their limits and sentences are the same for all questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, page_display, shorten
from .answer import score_record
from .ask import alias, entity_guess, intent, match_entities, specificity
from .graph import grouped_evidence
from .views import ALIASES, TYPE_NAMES, relation_name

# Phrases, hints and sentences that questions and answers are made of.
FAULT_PATTERNS = {
    "部件故障": ["有哪些故障", "有什么故障", "常见故障", "故障有哪些"],
    "故障症状": ["有哪些症状", "有什么症状", "症状有哪些", "故障症状"],
    "故障原因": ["什么原因引起", "可能由什么原因引起", "原因是什么", "故障原因"],
    "处理措施": ["怎么处理", "如何处理", "应采取什么维护措施", "应采取什么措施", "处理措施"],
    "检测方法": ["怎么检测", "如何检测", "通过什么方法检测", "检测方法是什么"],
}
PATTERNS = {
    "使用方法": ["使用方法", "检测方法", "试验方法", "方法"],
    "参数要求": ["参数要求", "参数", "指标要求", "技术参数"],
    "条件约束": ["运行条件", "使用条件", "什么条件", "哪些条件", "条件"],
    "措施要求": ["措施要求", "需要什么措施", "有哪些措施", "要求采取", "措施"],
}
STRIPPED = "？? ：:，,。 "
FAULT_DROPPED, DROPPED = ["的", "可能", "应", "维护"], ["有哪些", "有什么", "在什么", "需要什么", "需要哪些"]
RELATION_OF = {
    "部件故障": "OCCURS_ON", "故障症状": "HAS_SYMPTOM", "故障原因": "CAUSED_BY", "处理措施": "RESOLVED_BY", "检测方法": "DETECTED_BY",
    "使用方法": "USES_METHOD", "参数要求": "HAS_PARAMETER", "条件约束": "UNDER_CONDITION", "措施要求": "REQUIRES_ACTION",
}
HINTS = {
    "使用方法": ["试验", "检测", "测量", "校验", "巡检", "验收", "红外测温", "局部放电检测"],
    "参数要求": ["应满足", "应符合", "不超过", "不低于", "限值", "误差", "温升", "电压", "电流", "频率"],
    "条件约束": ["条件下", "环境温度", "相对湿度", "海拔", "户内", "户外", "运行条件", "使用条件"],
    "措施要求": ["应采取", "应进行", "加强监测", "更换", "维修", "检修", "停运", "整改", "定期检查"],
}
NEEDED = {
    "使用方法": ["试验", "检测", "测量", "校验", "巡检", "验收", "方法"],
    "参数要求": ["应满足", "应符合", "不超过", "不低于", "限值", "误差", "参数", "指标"],
    "条件约束": ["条件", "环境温度", "相对湿度", "海拔", "户内", "户外", "运行条件", "使用条件"],
    "措施要求": ["应采取", "应进行", "加强监测", "更换", "维修", "检修", "停运", "整改", "措施"],
}
STRICT = {
    "参数要求": ["应满足", "应符合", "不超过", "不低于", "限值", "误差", "温升"],
    "条件约束": ["条件", "环境温度", "相对湿度", "海拔", "户内", "户外", "运行条件"],
    "措施要求": ["应采取", "应进行", "加强监测", "更换", "维修", "检修", "停运", "整改"],
}
FAULT_HINTS = {
    "部件故障": ["故障", "异常", "过热", "漏油", "裂纹", "跳闸", "击穿", "短路"],
    "故障症状": ["症状", "表现为", "伴有", "伴随", "温度升高", "异响", "振动增大", "告警"],
    "故障原因": ["由于", "因", "引起", "导致", "造成", "原因"],
    "处理措施": ["应", "处理", "更换", "维修", "检修", "停运", "加强监测", "清洗", "润滑"],
    "检测方法": ["检测", "试验", "测量", "监测", "校验", "巡视", "巡检"],
}
ANSWERS = {
    "使用方法": "根据图谱证据，%s相关的主要使用方法包括：%s。",
    "参数要求": "根据图谱证据，%s相关的主要参数要求包括：%s。",
    "条件约束": "根据图谱证据，%s相关的主要条件约束包括：%s。",
    "措施要求": "根据图谱证据，%s相关的主要措施要求包括：%s。",
    "部件故障": "根据图谱证据，%s相关的主要故障包括：%s。",
    "故障症状": "根据图谱证据，%s相关的主要症状包括：%s。",
    "故障原因": "根据图谱证据，%s可能的主要原因包括：%s。",
    "处理措施": "根据图谱证据，针对%s可采取的主要处理措施包括：%s。",
    "检测方法": "根据图谱证据，%s相关的主要检测方法包括：%s。",
}
NO_KIND, NO_ENTITY = "未识别到明确的问题类型。", "未识别到明确的查询实体。"
NO_RESULT, NO_FAULT_RESULT = "未检索到与该问题直接匹配的图谱结果。", "未检索到与该故障/部件问题直接匹配的图谱结果。"
# How free questions are understood. The order of INTENTS decides; that of HINT_ORDER, what is taken out first.
INTENTS = {
    "部件故障": FAULT_PATTERNS["部件故障"], "故障症状": FAULT_PATTERNS["故障症状"], "故障原因": FAULT_PATTERNS["故障原因"], "处理措施": FAULT_PATTERNS["处理措施"], "检测方法": FAULT_PATTERNS["检测方法"],
    "参数要求": ["参数", "指标", "要求"], "使用方法": ["方法", "怎么用", "如何用", "试验", "检测", "测量", "校验"], "条件约束": ["条件", "环境", "运行条件", "使用条件"],
    "措施要求": ["措施", "要求", "应采取什么措施"], "作用用途": ["作用", "用途", "功能", "是干什么的"], "定义说明": ["是什么", "什么意思", "定义"],
}
HINT_ORDER = ["作用用途", "定义说明", "参数要求", "使用方法", "条件约束", "措施要求", "部件故障", "故障症状", "故障原因", "处理措施", "检测方法"]
ANY_INTENT, FREE_DROPPED = "综合查询", ["有哪些", "有什么", "可能", "相关", "应", "通过", "的"]
PREFERRED_TYPES = ["Device", "Component", "Fault", "MaintenanceAction", "Cause", "Symptom"]
SPECIFIC = ["互感器", "变压器", "齿轮箱", "发电机组", "发电机", "风机", "断路器", "避雷器", "绝缘子", "轴承", "叶片", "塔架", "机舱"]
GENERIC = ["电压", "电流", "温度", "压力", "功率", "频率", "误差", "方法", "措施", "条件", "参数", "原因", "症状", "故障", "检测", "监测", "试验", "测量", "校验"]


def free_intent(question: Column) -> Column:
    """One of INTENTS, or ANY_INTENT, of a question for `answer`."""
    return intent(F.trim(question), INTENTS, ANY_INTENT)


def free_guess(question: Column) -> Column:
    """What is left of a question without the words of all intents."""
    return entity_guess(question, [h for name in HINT_ORDER for h in INTENTS[name]] + FREE_DROPPED)


def matched(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """questions (question_id, question) with intent, guess, and the name and type of the node that fits best; without one, no row."""
    asked = questions.withColumns({"intent": free_intent(F.col("question")), "guess": free_guess(F.col("question"))})
    return match_entities(asked, nodes, specificity(F.col("name"), F.col("type"), F.col("question"), PREFERRED_TYPES, SPECIFIC, GENERIC))


def understood(questions: DataFrame) -> DataFrame:
    """questions (question_id, question) with kind ("" if there is none), fault (whether it is a fault's) and entity (alias resolved)."""
    q = F.trim("question")
    words = lambda xs: F.array(*map(F.lit, xs))
    kinds = F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.lit(fault).alias("fault"), words(phrases).alias("phrases"), words(phrases + dropped).alias("dropped"))
        for fault, table, dropped in ((True, FAULT_PATTERNS, FAULT_DROPPED), (False, PATTERNS, DROPPED)) for kind, phrases in table.items()
    ))
    first = F.try_element_at(F.filter(kinds, lambda x: F.exists(x["phrases"], lambda p: q.contains(p))), F.lit(1))
    rest = F.btrim(F.aggregate("_k.dropped", q, lambda s, p: F.replace(s, p, F.lit(""))), F.lit(STRIPPED))
    asked = questions.withColumn("_k", first)
    return asked.select("*", F.coalesce("_k.kind", F.lit("")).alias("kind"), F.coalesce("_k.fault", F.lit(False)).alias("fault"), alias(F.coalesce(rest, F.lit("")), ALIASES).alias("entity")).drop("_k")


def _score(kind: str, fault: bool) -> Column:
    c = F.col
    rest = (F.trim("source_sentence"), c("entity"), c("target"), c("file_name"), c("page_display"))
    return score_record(*rest, FAULT_HINTS[kind], 10) if fault else score_record(*rest, HINTS[kind], 12, NEEDED[kind], STRICT.get(kind))


def retrieved(asked: DataFrame, e: DataFrame, limit: int = 300) -> DataFrame:
    """Of each question the first `limit` edges that its kind asks for: from its entity, or for faults of a part, into it (ends swapped)."""
    wanted = asked.filter((F.col("kind") != "") & (F.col("entity") != "")).withColumn("relation", label(F.col("kind"), RELATION_OF))
    e = e.withColumns({x: F.coalesce(F.col(x), F.lit("")) for x in ("file_name", "source_sentence")}).withColumn("page_display", page_display(F.col("page_span"), F.col("page_num")))
    out = e.filter(F.col("relation") != "OCCURS_ON").withColumnsRenamed({"src": "entity", "src_type": "entity_type", "dst": "target", "dst_type": "target_type"})
    back = e.filter(F.col("relation") == "OCCURS_ON").withColumnsRenamed({"dst": "entity", "dst_type": "entity_type", "src": "target", "src_type": "target_type"})
    both = out.unionByName(back)
    # only edges of asked entities are ranked, each entity's once, however many questions ask for it
    asked_for = wanted.select("entity", "relation").distinct()
    first = Window.partitionBy("entity", "relation").orderBy("ord", "target", "source_sentence")
    near = both.join(asked_for, ["entity", "relation"], "left_semi").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n")
    return wanted.join(near, ["entity", "relation"])


def scored(rows: DataFrame) -> DataFrame:
    """Rows of questions with their score; of each question those of 3 points or more, or if there are none its 10 best."""
    score = F.lit(0)
    for fault, kinds in ((True, FAULT_HINTS), (False, HINTS)):
        for kind in kinds:
            score = F.when((F.col("fault") == fault) & (F.col("kind") == kind), _score(kind, fault)).otherwise(score)
    by = Window.partitionBy("question_id")
    rows = rows.withColumn("score", score).withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), "ord", "target", "source_sentence")))
    return rows.withColumn("_any", F.max(F.col("score") >= 3).over(by)).filter(F.when(F.col("_any"), F.col("score") >= 3).otherwise(F.col("rank") <= 10)).drop("_any")


def results(rows: DataFrame, most: int = 6, evidences: int = 3) -> DataFrame:
    """Scored rows grouped by (source, relation, target) in the order of their best row: `most` a question, with their first evidences."""
    keys = ["question_id", "entity", "relation", "target"]
    rows = rows.withColumns({"sentence": shorten(F.col("source_sentence"), 100), "relation_zh": relation_name(F.col("rel_zh"), F.col("relation"))})
    listed = grouped_evidence(rows, keys, ["file_name", "page_display", "sentence"], "rank", evidences)
    first = F.min_by(F.struct("relation_zh", label(F.col("entity_type"), TYPE_NAMES).alias("source_type"), label(F.col("target_type"), TYPE_NAMES).alias("target_type")), "rank")
    heads = rows.groupBy(*keys).agg(F.min("rank").alias("_best"), F.max("score").alias("score"), first.alias("f")).select(*keys, "_best", "score", "f.*")
    ranked = heads.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("_best"))).filter(F.col("place") <= most).drop("_best")
    return ranked.join(listed, keys)


def answers(questions: DataFrame, e: DataFrame) -> DataFrame:
    """question_id, entity, kind, answer, n_results for every row of questions (question_id, question)."""
    asked = understood(questions)
    best = results(scored(retrieved(asked, e)))
    listed = best.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "target"))).alias("_r"))
    out = asked.join(listed, "question_id", "left")
    joined, n = F.array_join(F.transform(F.slice("_r", 1, 5), lambda x: x["target"]), "、"), F.coalesce(F.size("_r"), F.lit(0))
    told = F.lit("")
    for kind, text in ANSWERS.items():
        told = F.when(F.col("kind") == kind, F.format_string(text, F.col("entity"), joined)).otherwise(told)
    none = F.when(F.col("fault"), NO_FAULT_RESULT).otherwise(NO_RESULT)
    answer = F.when(F.col("kind") == "", NO_KIND).when(F.col("entity") == "", NO_ENTITY).when(F.col("_r").isNull(), none).otherwise(told)
    return out.select("question_id", F.when(F.col("kind") == "", "").otherwise(F.col("entity")).alias("entity"), "kind", answer.alias("answer"), F.when(F.col("_r").isNull(), 0).otherwise(n).alias("n_results"))
