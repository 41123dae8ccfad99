"""The property graph as vertices (name, type) and edges, with its views: neighbours, counts, degrees, grouped evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label


def vertices(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.col("entity_name").alias("name"), F.col("entity_type").alias("type")).distinct()


def edges(relations: DataFrame, nodes: DataFrame, stored_names: dict[str, str] | None = None) -> DataFrame:
    """Relations with both ends among the nodes, distinct by (head, relation, tail, doc_id, chunk_id); dangling ones go.

    stored_names: what column rel_zh holds for a relation; its type where that is not among them.
    """
    if stored_names is not None:
        relations = relations.withColumn("rel_zh", label(F.col("relation"), stored_names))
    rows = relations.dropDuplicates(["head_entity", "relation", "tail_entity", "doc_id", "chunk_id"])
    ends = lambda n, t: nodes.select(F.col("name").alias(n), F.col("type").alias(t))
    rows = rows.join(ends("head_entity", "head_type"), ["head_entity", "head_type"], "left_semi").join(ends("tail_entity", "tail_type"), ["tail_entity", "tail_type"], "left_semi")
    return rows.withColumnsRenamed({"head_entity": "src", "head_type": "src_type", "tail_entity": "dst", "tail_type": "dst_type"})


def out_neighbours(e: DataFrame, names: DataFrame) -> DataFrame:
    """Edges from each of names (name), which the optimiser broadcasts if they are few."""
    return e.join(names.select(F.col("name").alias("src")).distinct(), "src", "left_semi")


def in_neighbours(e: DataFrame, names: DataFrame) -> DataFrame:
    return e.join(names.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")


def typed_reverse(e: DataFrame, names: DataFrame, relation: str) -> DataFrame:
    """Edges of one relation into names, with their ends swapped."""
    rows = in_neighbours(e.filter(F.col("relation") == relation), names)
    swapped = {"src": "dst", "dst": "src", "src_type": "dst_type", "dst_type": "src_type"}
    return rows.select(*(F.col(swapped.get(c, c)).alias(c) for c in rows.columns))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def scaled(rows: DataFrame, value: str, to: str, least: float, span: float) -> DataFrame:
    """rows with column to: least + value / the largest value * span, rounded to two places. The largest is one row, joined to all."""
    largest = rows.agg(F.max(value).alias("_most"))
    return rows.crossJoin(F.broadcast(largest)).withColumn(to, F.round(least + F.col(value) / F.col("_most") * span, 2)).drop("_most")


def type_graph(e: DataFrame) -> DataFrame:
    return scaled(counts_by(e, "src_type", "relation", "dst_type"), "n", "width", 2, 6)


def degrees(e: DataFrame) -> DataFrame:
    """name and degree over edge rows; a loop counts twice."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("name"))
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def top_by_degree(e: DataFrame, n: int = 120) -> DataFrame:
    return degrees(e).orderBy(F.col("degree").desc(), "name").limit(n)


def edge_sources(e: DataFrame, source: list[str]) -> DataFrame:
    """Edges grouped by (src, relation, dst) with the number of rows and of distinct sources."""
    return e.groupBy("src", "relation", "dst").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*source).alias("source_count"))


def local_edges(grouped: DataFrame, center: str | Column, priority: dict[str, int], n: int = 12, default: int = 10) -> DataFrame:
    """The n best edges around a center: relation priority, 20 for touching it, and up to 5 for sources."""
    table = F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))
    score = F.coalesce(F.try_element_at(table, F.col("relation")), F.lit(default)) + F.when((F.col("src") == center) | (F.col("dst") == center), 20).otherwise(0) + F.least("source_count", F.lit(5))
    return grouped.filter((F.col("src") == center) | (F.col("dst") == center)).withColumn("score", score.cast("long")).orderBy(F.col("score").desc(), F.col("source_count").desc(), "src", "relation", "dst").limit(n)


def grouped_evidence(rows: DataFrame, keys: list[str], evidence: list[str], ord_col: str, n: int = 3) -> DataFrame:
    """keys and up to n distinct evidences, the first by ord_col."""
    once = rows.groupBy(*keys, *evidence).agg(F.min(ord_col).alias("_o"))
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", *evidence))).filter(F.col("_n") <= n)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", *evidence))).alias("evidences"))
