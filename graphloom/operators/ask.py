"""Questions in batches: intent, entity, retrieval, score, evidence, confidence, answer. A table of questions is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, label
from .dictionary import holding


def intent(question: Column, patterns: dict[str, list[str]], default: str) -> Column:
    """The first of patterns (in order) one of whose phrases the question contains."""
    out, first = F.lit(default), list(patterns.items())
    for name, words in reversed(first):
        out = F.when(contains_any(question, words), F.lit(name)).otherwise(out)
    return out


def entity_guess(question: Column, dropped: list[str], strip: str = "？? ：:，,。 ") -> Column:
    """The question without these phrases, replaced in order, and without strip at its ends."""
    for w in dropped:
        question = F.replace(question, F.lit(w), F.lit(""))
    return F.btrim(question, F.lit(strip))


def alias(name: Column, names: dict[str, str]) -> Column:
    name = F.btrim(F.replace(name, F.lit("　"), F.lit(" ")))
    return label(name, names)


def specificity(name: Column, kind: Column, question: Column, preferred: list[str], hints: list[str], generic: list[str]) -> Column:
    return (
        3 * F.length(name) + F.when(question.contains(name), 30).otherwise(0) + F.when(kind.isin(preferred), 15).otherwise(0) + F.when(contains_any(name, hints), 20).otherwise(0)
        - F.when(name.isin(generic), 25).otherwise(0) - F.when(F.length(name) <= 2, 8).otherwise(0)
    )


def match_entities(questions: DataFrame, nodes: DataFrame, score: Column) -> DataFrame:
    """The best node for each question (question_id, question, guess): the guess itself, then containment in the question, then in the guess.

    Containment counts either way round. An empty guess is in all names: then the best node for no question in particular is taken.
    Names are sought in all questions and guesses at once, and questions and guesses that are no longer than the longest name in all names.
    """
    nodes = nodes.filter("name <> ''")
    asked = questions.select("question_id", "question", "guess")
    sides = F.array(F.struct(F.lit(1).alias("prio"), F.col("question").alias("side")), F.struct(F.lit(2).alias("prio"), F.col("guess").alias("side")))
    sides = asked.withColumn("_s", F.explode(sides)).select("*", "_s.*").drop("_s")
    longest = nodes.agg(F.max(F.length("name")).alias("n")).scalar()
    short = sides.withColumn("_longest", longest).filter(F.length("side") <= F.col("_longest")).drop("_longest")
    found = [asked.join(nodes, F.col("guess") == F.col("name")).withColumn("prio", F.lit(0)), holding(sides, "side", nodes, "name"), holding(nodes, "name", short, "side")]
    top = nodes.withColumn("question", F.lit("")).withColumn("score", score).orderBy(F.col("score").desc(), F.length("name").desc(), "name", "type").limit(1).select("name", "type")
    found.append(asked.filter("guess = ''").crossJoin(F.broadcast(top)).withColumn("prio", F.lit(2)))
    rows = found[0].select("question_id", "question", "guess", "name", "type", "prio")
    for x in found[1:]:
        rows = rows.unionByName(x.select(*rows.columns))
    by = Window.partitionBy("question_id").orderBy("prio", F.col("score").desc(), F.length("name").desc(), "name", "type")
    rows = rows.withColumn("score", score)
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n").join(questions.drop("question", "guess"), "question_id")


def threshold_or_first(rows: DataFrame, key: str, score: str, order: list[Column], least: int = 3, first: int = 10) -> DataFrame:
    """Rows of a key that reach the threshold; if none does, its first ones."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_any": F.max(F.col(score) >= least).over(w), "_n": F.row_number().over(w.orderBy(*order))})
    return ranked.filter((F.col("_any") & (F.col(score) >= least)) | (~F.col("_any") & (F.col("_n") <= first))).drop("_any", "_n")


def preferred_or_all(rows: DataFrame, key: str, preferred: Column) -> DataFrame:
    """Rows of a key that are preferred; if none is, all of them."""
    return rows.withColumn("_p", preferred).withColumn("_any", F.max("_p").over(Window.partitionBy(key))).filter("_p or not _any").drop("_p", "_any")


def top_targets(rows: DataFrame, key: str, target: str, rank: str, n: int = 5) -> DataFrame:
    """The first n distinct targets of a key, joined in order."""
    once = rows.filter(F.col(target) != "").groupBy(key, target).agg(F.min(rank).alias("_r"))
    kept = once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_r", target))).filter(F.col("_n") <= n)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(target).alias("t")))), lambda x: x["t"]), "、").alias("targets"))


def evidence(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Relation rows whose sentence holds the asked entity and any of its targets (entity, targets: array)."""
    found = holding(rows, "source_sentence", asked, "entity")
    return found.filter(F.exists("targets", lambda t: F.col("source_sentence").contains(t)))


def confidence(graph_hits: Column, evidences: Column, files: Column, has_pages: Column, preferred_hit: Column) -> Column:
    score = F.least(graph_hits, F.lit(8)) * 5 + F.least(evidences, F.lit(8)) * 5 + F.when(files >= 2, 10).otherwise(0) + F.when(has_pages, 10).otherwise(0) + F.when(preferred_hit, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def level(score: Column) -> Column:
    return F.when(score >= 75, F.lit("高")).when(score >= 45, F.lit("中")).otherwise(F.lit("低"))
