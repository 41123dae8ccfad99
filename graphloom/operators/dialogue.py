"""Whole answers to a table of free questions: understanding, matching, retrieval, a sentence by template or by a model, confidence and notes.

The model is a plug-in: any function of one request that can be sent to tasks. A task asks it for several questions at once, each with
its own deadline; a question whose request fails, is late or brings too little keeps its template's sentence, so that every
question has an answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_line, label, normalize
from . import qa
from .answer import REASONS, RELATION_NAMES, files_of, gathered, has_pages, sentence

# What is said when nothing is found, and what a model is told.
EMPTY, EMPTY_REASON = "问题为空。", "问题为空，暂无可评估证据。"
NO_NODE, NO_NODE_REASON = "未在图谱实体中识别到与“%s”匹配的实体。", "未识别到匹配实体，暂无有效检索证据。"
NO_MODEL, NO_DATA = "当前未启用大模型回答，已切换到模板回答。", "未找到关系数据文件，请先执行抽取和建图流程。"
NO_GRAPH, NO_TEXT, NO_SENTENCE, UNKNOWN = "无图谱结果。", "无文本证据。", "（无证据句）", "未知"
REQUEST = "用户问题：%s\n识别实体：%s\n识别意图：%s\n\n【图谱结果】\n%s\n\n【文本证据】\n%s\n\n请基于以上信息生成最终回答。"
#: Characters that a model's answer has at least; seconds that a request may take; requests that a task makes at once.
LEAST, DEADLINE, TOGETHER = 15, 15.0, 8

CONFIDENCE = "struct<level: string, score: int, graph_hit_count: int, evidence_count: int, source_count: int, has_page_refs: boolean, reason: string, note: string, data_warning: string>"


def _source(r: Column) -> Column:
    page = F.when(F.trim(r["page"]) != "", F.concat(F.lit(" 第"), r["page"], F.lit("页"))).otherwise("")
    return F.when(r["file_name"] != "", F.concat(F.lit("；来源："), r["file_name"], page)).otherwise("")


def request(question: Column, entity: Column, intent: Column, rows: Column, proofs: Column) -> Column:
    """What a model is asked: the question, what it was understood as, and its ranked rows and evidence as numbered lines."""

    def row(r: Column, i: Column) -> Column:
        said = joined_line(r["source_sentence"])
        kind = F.when(r["dst_type"] != "", r["dst_type"]).otherwise(F.lit(UNKNOWN))
        head = F.concat((i + 1).cast("string"), F.lit(". "), r["src"], F.lit(" --["), label(r["relation"], RELATION_NAMES), F.lit("]--> "), r["dst"], F.lit("（目标类型："), kind, F.lit("）"))
        return F.concat(head, F.when(said != "", F.concat(F.lit("；证据句："), said)).otherwise(""), _source(r))

    def proof(r: Column, i: Column) -> Column:
        said = joined_line(r["source_sentence"])
        return F.concat((i + 1).cast("string"), F.lit(". "), F.when(said != "", said).otherwise(NO_SENTENCE), _source(r))

    listed = lambda x, line, none: F.when(F.size(x) > 0, F.array_join(F.transform(x, line), "\n")).otherwise(none)
    return F.format_string(REQUEST, question, entity, intent, listed(rows, row, NO_GRAPH), listed(proofs, proof, NO_TEXT))


def with_model(rows: DataFrame, ask: Callable[[str], str | None], prompt: str, to: str, deadline: float = DEADLINE, together: int = TOGETHER, least: int = LEAST) -> DataFrame:
    """rows with `to` taken from ask(prompt) where that brings `least` characters within `deadline` seconds; elsewhere it stays. prompt is dropped.

    A request that is late is left to end by itself in a thread of the worker's, and its answer is not used.
    """
    kept = [c for c in rows.columns if c != prompt]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # holds no name of this module: workers need not have it
        import threading
        import time

        def one(text: str, found: dict, i: int) -> None:
            try:
                found[i] = ask(text)
            except Exception:  # a model may fail in any way: the template's answer stays
                found[i] = None

        for part in parts:
            told = part[to].tolist()
            for at in range(0, len(part), together):
                found: dict[int, str | None] = {}
                begun, threads = time.monotonic(), []
                for i in range(at, min(at + together, len(part))):
                    if part[prompt].iloc[i]:
                        threads.append(threading.Thread(target=one, args=(part[prompt].iloc[i], found, i), daemon=True))
                        threads[-1].start()
                for t in threads:
                    t.join(max(0.0, begun + deadline - time.monotonic()))
                for i, x in list(found.items()):
                    if isinstance(x, str) and len(x.strip()) >= least:
                        told[i] = x.strip()
            yield part[kept].assign(**{to: told})

    return rows.mapInPandas(run, rows.select(*kept).schema)


def respond(questions: DataFrame, nodes: DataFrame, edges: DataFrame, model: Callable[[str], str | None] | None = None, deadline: float = DEADLINE) -> DataFrame:
    """question_id, question, entity_name, intent, answer, graph_results, evidence_results, confidence_info for every row of questions.

    questions: question_id, question; nodes: name, type; edges: as `answer.answers` takes them. Empty questions and those that name
    no node are told so. Without a model every answer is a template's, and confidence_info.note says so; without any edge,
    confidence_info.data_warning does.
    """
    asked = questions.select("question_id", normalize(F.col("question"), squeeze_newlines=False).alias("question"))
    real = asked.filter("question <> ''")
    met = qa.matched(real, nodes).select("question_id", "question", "intent", F.col("name").alias("entity"))
    found = gathered(met, edges)
    any_edge = edges.limit(1).agg(F.count(F.lit(1))).scalar()
    warning = F.when(F.col("_edges") == 0, NO_DATA)
    info = F.struct(
        F.col("level").alias("level"), F.col("score").cast("int").alias("score"), F.size("rows").alias("graph_hit_count"), F.size("proofs").alias("evidence_count"), files_of(F.col("proofs")).alias("source_count"), has_pages(F.col("proofs")).alias("has_page_refs"),
        label(F.col("level"), REASONS).alias("reason"), F.lit(NO_MODEL if model is None else None).cast("string").alias("note"), warning.alias("data_warning"),
    )
    proofs = F.transform("proofs", lambda p: F.struct(p["file_name"].alias("file_name"), p["page"].alias("page"), p["source_sentence"].alias("source_sentence")))
    out = found.withColumn("_edges", any_edge).select(
        "question_id", "question", F.col("entity").alias("entity_name"), "intent", sentence(F.col("intent"), F.col("entity"), F.col("rows"), F.col("proofs")).alias("answer"),
        F.col("rows").alias("graph_results"), proofs.alias("evidence_results"), info.cast(CONFIDENCE).alias("confidence_info"), request(F.col("question"), F.col("entity"), F.col("intent"), F.col("rows"), proofs).alias("_request"),
    )
    out = out.drop("_request") if model is None else with_model(out, model, "_request", "answer", deadline)
    none = lambda x: F.array().cast(dict(out.dtypes)[x]).alias(x)
    least = lambda reason: F.expr(f"named_struct('level', '低', 'score', 0, 'graph_hit_count', 0, 'evidence_count', 0, 'source_count', 0, 'has_page_refs', false, 'reason', '{reason}', 'note', null, 'data_warning', null)").cast(CONFIDENCE).alias("confidence_info")
    rest = lambda rows, entity, intent, answer, reason: rows.select("question_id", "question", entity.alias("entity_name"), intent.alias("intent"), answer.alias("answer"), none("graph_results"), none("evidence_results"), least(reason))
    lost = real.join(met.select("question_id"), "question_id", "left_anti").withColumn("guess", qa.free_guess(F.col("question")))
    out = out.unionByName(rest(lost, F.col("guess"), qa.free_intent(F.col("question")), F.format_string(NO_NODE, "guess"), NO_NODE_REASON))
    return out.unionByName(rest(asked.filter("question = ''"), F.lit(""), F.lit(""), F.lit(EMPTY), EMPTY_REASON))
