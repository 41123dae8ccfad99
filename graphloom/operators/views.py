"""Graph views: totals, neighbours of an entity, its local graph, the type graph, the whole graph. Each is one or two DataFrames.

Edges: src, src_type, relation, dst, dst_type, rel_zh (may be null), file_name, page_num, page_span, source_sentence, ord. Nodes: name, type.
Views key nodes by name alone: standard_local takes a name's first type (by ord), the others its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, nonblank, page_display, shorten
from .ask import alias
from .graph import counts_by, degrees, grouped_evidence, local_edges

# Names, colours and priorities that views show.
TYPE_NAMES = {
    "Standard": "标准", "Device": "设备", "Component": "部件", "Fault": "故障", "Symptom": "症状", "Cause": "原因",
    "MaintenanceAction": "维护措施", "Parameter": "参数", "Method": "方法", "Condition": "条件", "Action": "措施",
}
RELATION_NAMES = {
    "USES_METHOD": "使用方法", "HAS_PARAMETER": "参数要求", "UNDER_CONDITION": "条件约束", "REQUIRES_ACTION": "措施要求", "APPLIES_TO": "适用于",
    "OCCURS_ON": "发生于部件", "HAS_SYMPTOM": "具有症状", "CAUSED_BY": "由原因引起", "RESOLVED_BY": "处理措施", "DETECTED_BY": "检测方法",
}
#: What a built graph stores as a relation's name where that differs from RELATION_NAMES.
STORED_NAMES = {k: v for k, v in RELATION_NAMES.items() if k != "APPLIES_TO"} | {"RESOLVED_BY": "通过措施处理", "DETECTED_BY": "通过方法检测"}
SHORT_NAMES = {
    "使用方法": "方法", "参数要求": "参数", "条件约束": "条件", "措施要求": "措施", "适用于": "适用",
    "发生于部件": "故障", "具有症状": "症状", "由原因引起": "原因", "处理措施": "处理", "检测方法": "检测",
}
CATEGORIES = {
    "发生于部件": "故障", "具有症状": "症状", "由原因引起": "原因", "处理措施": "措施", "措施要求": "措施",
    "检测方法": "检测", "使用方法": "方法", "参数要求": "参数", "条件约束": "条件", "适用于": "其他",
}
PRIORITIES = {
    "发生于部件": 100, "具有症状": 95, "由原因引起": 90, "处理措施": 88, "检测方法": 85,
    "措施要求": 80, "参数要求": 75, "条件约束": 70, "使用方法": 65, "适用于": 60,
}
COLOURS = {
    "Standard": "#A0A0A0", "Device": "#4F81BD", "Component": "#5BC0DE", "Fault": "#D9534F", "Symptom": "#F0AD4E", "Cause": "#8E63CE",
    "MaintenanceAction": "#5CB85C", "Action": "#5CB85C", "Method": "#F7C948", "Parameter": "#7E8AA2", "Condition": "#6F42C1",
}
ALIASES = {"风机": "风力发电机组", "风电机组": "风力发电机组", "互感器": "电压互感器"}
#: Sources that an edge of a view lists; all of them are counted.
SOURCES = 200
OTHER, OTHER_COLOUR, CENTER_COLOUR, UNKNOWN_PAGE = "其他", "#9AA5B1", "#d9ecff", "未知"


def relation_name(stored: Column, relation: Column, by_type: bool = False) -> Column:
    """The name an edge shows: the stored one, else that of its type. by_type: of its type always, so that categories match."""
    return label(relation, RELATION_NAMES) if by_type else F.coalesce(nonblank(stored), label(relation, RELATION_NAMES))


def shown(e: DataFrame, by_type: bool = True) -> DataFrame:
    """Edges with relation_zh, relation_short, relation_category and page_display."""
    e = e.withColumn("relation_zh", relation_name(F.col("rel_zh"), F.col("relation"), by_type)).withColumn("page_display", page_display(F.col("page_span"), F.col("page_num")))
    return e.withColumns({"relation_short": label(F.col("relation_zh"), SHORT_NAMES), "relation_category": label(F.col("relation_zh"), CATEGORIES, F.lit(OTHER))})


def stats(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """kind (nodes, edges, entity_type, relation_type), name, n: totals, and counts by type with the names that are shown."""
    row = lambda rows, kind, name: rows.select(F.lit(kind).alias("kind"), name.alias("name"), "n")
    total = lambda rows, kind: row(rows.agg(F.count(F.lit(1)).alias("n")), kind, F.lit(""))
    types = row(counts_by(nodes, "type"), "entity_type", label(F.col("type"), TYPE_NAMES))
    return total(nodes, "nodes").unionByName(total(e, "edges")).unionByName(types).unionByName(row(counts_by(e, "relation"), "relation_type", label(F.col("relation"), RELATION_NAMES)))


def typed_forward(e: DataFrame, names: DataFrame, relation: str) -> DataFrame:
    """Edges of one relation from names (name)."""
    return e.filter(F.col("relation") == relation).join(names.select(F.col("name").alias("src")).distinct(), "src", "left_semi")


def entity_neighbours(e: DataFrame, asked: DataFrame, most: int = 200, evidences: int = 3) -> DataFrame:
    """For each of asked (name): its first edges by relation and target, grouped by (src, relation, dst) with their evidences.

    Aliases are resolved. `most` edges of an entity count, before they are grouped.
    """
    names = asked.select(alias(F.col("name"), ALIASES).alias("src")).distinct()
    rows = shown(e.join(names, "src", "left_semi"), by_type=False)
    by = Window.partitionBy("src").orderBy("relation", "dst", "ord", "source_sentence")
    rows = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).withColumn("sentence", shorten(F.col("source_sentence"), 100))
    return grouped_evidence(rows, ["src", "relation", "dst"], ["file_name", "page_display", "sentence"], "_n", evidences)


def _sources(e: DataFrame, distinct: bool, most: int = SOURCES) -> DataFrame:
    """Edges grouped by (src, relation_zh, dst): their first `most` sources in order (distinct ones, or all), how many there are, and the first ord.

    An edge's rows are counted by partial sums and cut to `most` before they meet, so that no task or row holds all of a hot edge's.
    """
    keys, parts = ["src", "relation_zh", "relation_short", "relation_category", "dst"], ["file_name", "page_display", "source_sentence"]
    rows = e.select(*keys, *(F.coalesce(x, F.lit("")).alias(x) for x in parts), "ord")
    if distinct:
        rows = rows.groupBy(*keys, *parts).agg(F.min("ord").alias("ord"))
    counted = rows.groupBy(*keys).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("source_count"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", *parts))).filter(F.col("_n") <= most)
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", *parts))).alias("sources"))
    return counted.join(listed, keys).select(*keys, "ord", "sources", "source_count")


def _named(e: DataFrame, last: bool) -> DataFrame:
    """name, type of the ends of edges: the type that a name has first, or last, by ord (the source of an edge before its target)."""
    ends = e.select("ord", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("src").alias("name"), F.col("src_type").alias("type")), F.struct(F.lit(1).alias("at"), F.col("dst").alias("name"), F.col("dst_type").alias("type")))).alias("x"))
    order = F.struct("ord", "x.at", "x.type")
    pick = F.max_by(F.col("x.type"), order) if last else F.min_by(F.col("x.type"), order)
    return ends.filter("x.name <> ''").groupBy("x.name").agg(pick.alias("type"))


def _node(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(nonblank(F.col("type")), F.lit("Entity"))
    return rows.withColumn("type", kind).withColumns({"type_zh": label(F.col("type"), TYPE_NAMES), "colour": label(F.col("type"), COLOURS, F.lit(OTHER_COLOUR))})


def standard_local(e: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges out of an entity (alias resolved): all source rows count, width 3."""
    center = alias(F.lit(name), ALIASES)
    rows = shown(e.filter(F.col("src") == center), by_type=False)
    nodes = _node(_named(rows, last=False)).withColumn("is_center", F.col("name") == center)
    nodes = nodes.withColumns({"size": F.when(F.col("is_center"), 38).otherwise(26), "font_size": F.when(F.col("is_center"), 26).otherwise(18), "colour": F.when(F.col("is_center"), CENTER_COLOUR).otherwise(F.col("colour"))})
    return nodes, _sources(rows, distinct=False).withColumn("width", F.lit(3))


def local(e: DataFrame, name: str, limit: int = 40, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Nodes and the `most` best edges into and out of an entity; of each direction the first `limit` rows count, a loop in both."""
    center = alias(F.lit(name), ALIASES)
    near = [e.filter(F.col(end) == center).orderBy("ord", "relation", "src", "dst").limit(limit) for end in ("src", "dst")]
    rows = shown(near[0].unionByName(near[1]))
    grouped = _sources(rows, distinct=True).withColumn("relation", F.col("relation_zh"))
    best = local_edges(grouped, center, PRIORITIES, most).drop("relation").withColumn("width", 2 + F.least("source_count", F.lit(3)))
    ends = best.select(F.explode(F.array("src", "dst")).alias("name")).unionByName(e.sparkSession.range(1).select(center.alias("name"))).distinct()
    nodes = _node(ends.join(_named(rows, last=True), "name", "left")).withColumn("is_center", F.col("name") == center)
    return nodes, best


def type_view(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types as nodes, and counts of edges between them: from, to, relation, relation_zh, n, label, width (2 to 8)."""
    rows = counts_by(e, "src_type", "relation", "dst_type")
    largest = rows.agg(F.max("n").alias("_most"))  # one row
    named = rows.crossJoin(F.broadcast(largest)).select(
        label(F.col("src_type"), TYPE_NAMES).alias("from"), label(F.col("dst_type"), TYPE_NAMES).alias("to"), "relation", label(F.col("relation"), RELATION_NAMES).alias("relation_zh"), "n",
        F.round(2 + F.col("n") / F.col("_most") * 6, 2).alias("width"),
    ).withColumn("label", F.format_string("%s（%d）", "relation_zh", "n"))
    colours = {TYPE_NAMES[k]: v for k, v in COLOURS.items()}
    nodes = named.select(F.explode(F.array("from", "to")).alias("name")).distinct().withColumn("colour", label(F.col("name"), colours, F.lit(OTHER_COLOUR)))
    return nodes, named


def full(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes (degree, size 18 to 40, font_size) and all edges grouped with distinct sources (width 1.5 to 6). No node or edge is cut off."""
    rows = shown(e)
    nodes = _node(_named(rows, last=True)).join(degrees(rows), "name")
    nodes = nodes.crossJoin(F.broadcast(nodes.agg(F.max("degree").alias("_most"))))
    size = 18 + F.col("degree") / F.col("_most") * 22
    nodes = nodes.withColumns({"size": F.round(size, 2), "font_size": F.when(size < 28, 16).otherwise(18)}).drop("_most")
    grouped = _sources(rows, distinct=True)
    grouped = grouped.crossJoin(F.broadcast(grouped.agg(F.max("source_count").alias("_most"))))
    return nodes, grouped.withColumn("width", F.round(1.5 + F.col("source_count") / F.col("_most") * 4.5, 2)).drop("_most")


def recommended(nodes: DataFrame, n: int = 120) -> DataFrame:
    """The n nodes of the largest degree of a full view."""
    return nodes.orderBy(F.col("degree").desc(), "name").limit(n).select("name", "degree")


def facets(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """kind (entity_type, relation_category) and the sorted distinct values of a view, as one row each."""
    listed = lambda rows, kind, x: rows.agg(F.sort_array(F.collect_set(x)).alias("names")).select(F.lit(kind).alias("kind"), "names")
    return listed(nodes, "entity_type", "type_zh").unionByName(listed(grouped, "relation_category", "relation_category"))


def of_category(grouped: DataFrame, nodes: DataFrame, category: str, center: str) -> tuple[DataFrame, DataFrame]:
    """A view's nodes and edges of one category: the edges, their ends, and the center."""
    kept = grouped.filter(F.col("relation_category") == category)
    ends = kept.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return nodes.join(ends, "name", "left_semi").unionByName(nodes.filter(F.col("name") == center)).dropDuplicates(["name"]), kept


def page_or_unknown(span: Column, num: Column) -> Column:
    return F.coalesce(nonblank(page_display(span, num)), F.lit(UNKNOWN_PAGE))
