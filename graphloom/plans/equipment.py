"""Queries of the extraction packs, graph views and rule questions over texts made from the tables' ids, and the SQL that says the same.

The tables hold no Chinese texts: every document gives a short one, and every user turn a question, put together from the packs' terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dialogue, graph, packs, qa, views
from ..operators.extract import Rule
from ..sources.stage import staged
from .queries import query, table

PACK = packs.PACKS["v3_1"]


def names(kind: str, pack: packs.Pack = PACK) -> list[str]:
    return [n for n, k in pack.terms if k == kind]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: Parts of a note, a list each with the multiplier that picks one of it by the id.
NOTE = [
    (names("Fault"), 1), (["由于", "通常由", "与", "的原因是", "："], 3), (names("Cause"), 5), (["引起。", "有关；", "。"], 1),
    (names("Device"), 1), (["应满足", "不超过", "的", "限值"], 3), (names("Parameter"), 5), (["要求\n", "；"], 1),
    (names("Component"), 1), (["出现", "发生", "旁"], 1), (names("Fault"), 7), (["，应", "，"], 1), (names("MaintenanceAction"), 5), (["！", "。"], 3),
    (names("Fault"), 4), (["的症状包括", "伴随", "和"], 1), (names("Symptom"), 3), (["现象。", "；"], 1),
    (names("Device"), 9), (["在", "处于"], 1), (names("Condition"), 3), (["条件下", ""], 1), (["采用", "按"], 1), (names("Method"), 7), (["检测。", "。", "进行试验。"], 1),
    (["标准GB/T 1234.1 - 2011适用于", "规范dl/t  572-2010，", "Q/HN-1.2", ""], 1), (names("Device"), 2), (["停运检修。", "50 kV，", "发布，实施，前言。"], 5), (names("Action"), 4),
]
PHRASES = [p for x in (qa.FAULT_PATTERNS, qa.PATTERNS) for kind in x for p in x[kind]] + ["的作用", "是什么", "怎么办"]
ASKED = [([""] * 7 + ["请问", "的"], 3), (names("Fault") + names("Component") + names("Device") + ["某物", ""], 1), (["有哪些", "的", "可能", ""], 1), (PHRASES, 1), (["？", "? ", ""], 1)]


def spark_text(parts: list[tuple[list[str], int]], key: str) -> str:
    return "concat(" + ", ".join(f"element_at(array({', '.join(quoted(x) for x in xs)}), cast(({key}) * {m} % {len(xs)} as int) + 1)" for xs, m in parts) + ")"


def sql_text(parts: list[tuple[list[str], int]], key: str) -> str:
    return "concat(" + ", ".join(f"[{', '.join(quoted(x) for x in xs)}][({key}) * {m} % {len(xs)} + 1]" for xs, m in parts) + ")"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("chunk_id"), F.concat(F.lit("规范"), (F.col("doc_id") % 7).cast("string"), F.lit(".pdf")).alias("file_name"),
        F.lit("").alias("relative_path"), F.lit("").alias("page_num"), (F.col("doc_id") % 40 + 1).alias("page_start"), (F.col("doc_id") % 40 + 1 + F.col("doc_id") % 2).alias("page_end"), F.expr(spark_text(NOTE, "doc_id")).alias("chunk_text"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select(F.struct("conv_id", "turn").alias("question_id"), F.expr(spark_text(ASKED, "conv_id * 5 + turn")).alias("question"))


def note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.vertices(packs.mentions(notes(spark, sf_dir)))
    e = graph.edges(packs.relations(notes(spark, sf_dir)), nodes, views.STORED_NAMES)
    return staged(e.withColumn("page_span", F.lit(None).cast("string")).withColumn("ord", F.col("doc_id") * 100 + F.col("ord")))


def any_of(words: tuple[str, ...] | list[str], x: str = "s") -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")" if words else "false"


def gate_sql(rule: Rule) -> str:
    if not (rule.words or rule.weak or rule.pairs):
        return "true"
    parts = [any_of(rule.words), f"(length(s) <= {rule.weak_longest} AND {any_of(rule.weak)})"]
    parts += ["regexp_matches(s, '" + p.replace("'", "''").replace("{head}", "' || h.name || '").replace("{tail}", "' || t.name || '") + "')" for p in rule.pairs]
    return "(" + " OR ".join(parts) + ")"


def vocabulary_sql(pack: packs.Pack) -> str:
    return "(VALUES " + ", ".join(f"({quoted(n)}, '{k}')" for n, k in pack.terms) + ") AS v(name, type)"


def entities_sql(x: str, rows: str, keys: str, pack: packs.Pack) -> str:
    codes = " UNION ALL ".join(f"SELECT {keys}, unnest(regexp_extract_all({x}, '(?i){p}')) AS name FROM {rows}" for p in packs.CODES)
    return rf"(SELECT {keys}, name, type FROM {rows} JOIN {vocabulary_sql(pack)} ON contains({x}, name) UNION SELECT DISTINCT {keys}, trim(regexp_replace(name, '\s+', ' ', 'g')), 'Standard' FROM ({codes}))"


NOTES = f"(SELECT doc_id, concat('规范', doc_id % 7, '.pdf') AS file_name, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 40 + 1)::VARCHAR ELSE concat(doc_id % 40 + 1, '-', doc_id % 40 + 2) END AS page_num, regexp_replace({sql_text(NOTE, 'doc_id')}, '[ \t]+', ' ', 'g') AS text FROM documents)"
SOUND = f"(SELECT * FROM {NOTES} WHERE " + " + ".join(f"contains(text, {quoted(w)})::INT" for w in PACK.boilerplate) + " < 3)"
SAID = f"(SELECT * FROM (SELECT doc_id, file_name, page_num, unnest(regexp_split_to_array(text, '[。！？；;\\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[。！？；;\\n]+'), 1) AS i FROM {SOUND}) WHERE trim(s) <> '')"


def relations_sql(pack: packs.Pack, gated: bool = True) -> str:
    """WITH clause: said, ents, rels (head_entity, head_type, relation, tail_entity, tail_type, doc_id, i, s)."""
    rules = " UNION ALL ".join(
        f"SELECT h.name AS head_entity, h.type AS head_type, '{r.relation}' AS relation, t.name AS tail_entity, t.type AS tail_type, h.doc_id, h.i, h.s FROM ents h JOIN ents t ON h.doc_id = t.doc_id AND h.i = t.i AND h.type = '{r.head}' AND t.type = '{r.tail}' WHERE {gate_sql(r).replace('(s,', '(h.s,').replace('length(s)', 'length(h.s)') if gated else 'true'}"
        for r in pack.rules
    )
    return f"said AS (SELECT doc_id, trim(s) AS s, i FROM {SAID}), ents AS {entities_sql('s', 'said', 'doc_id, i, s', pack)}, rels AS ({rules})"


def _mention_query(name: str) -> None:
    def run(spark, sf_dir):
        return packs.mentions(notes(spark, sf_dir), packs.PACKS[name]).select("doc_id", "entity_name", "entity_type", "file_name", "page_num")

    run.__name__ = f"pack_mentions_{name}"
    query(f"SELECT doc_id, name AS entity_name, type AS entity_type, file_name, page_num FROM {entities_sql('text', SOUND, 'doc_id, text, file_name, page_num', packs.PACKS[name])}")(run)


def _relation_query(name: str) -> None:
    def run(spark, sf_dir):
        return packs.relations(notes(spark, sf_dir), packs.PACKS[name]).select("head_entity", "head_type", "relation", "tail_entity", "tail_type", "doc_id", "source_sentence")

    run.__name__ = f"pack_relations_{name}"
    query(f"WITH {relations_sql(packs.PACKS[name])} SELECT head_entity, any_value(head_type) AS head_type, relation, tail_entity, any_value(tail_type) AS tail_type, doc_id, arg_min(s, i) AS source_sentence FROM rels GROUP BY head_entity, relation, tail_entity, doc_id")(run)


for _name in packs.PACKS:
    _mention_query(_name)
    _relation_query(_name)


@query(f"WITH {relations_sql(packs.Pack(PACK.terms, tuple(r for r in PACK.rules if r.relation in ('CAUSED_BY', 'HAS_SYMPTOM'))), gated=False)} SELECT relation, head_entity AS fault, tail_entity AS other, doc_id, arg_min(s, i) AS source_sentence FROM rels GROUP BY ALL")
def candidate_pairs(spark, sf_dir):
    return packs.candidate_pairs(notes(spark, sf_dir)).select("relation", "fault", "other", "doc_id", "source_sentence")


def map_sql(key: str, values: dict, default: str | None = None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {key if default is None else default} END"


#: Edges of the notes as the graph stores them.
E = f"""{relations_sql(PACK)}, e AS (SELECT r.*, {map_sql('relation', views.STORED_NAMES)} AS rel_zh, {map_sql('relation', views.RELATION_NAMES)} AS zh, n.file_name, n.page_num, r.doc_id * 100 + r.pos AS ord
 FROM (SELECT head_entity AS src, any_value(head_type) AS src_type, relation, tail_entity AS dst, any_value(tail_type) AS dst_type, doc_id, arg_min(s, i) AS source_sentence, min(place) AS pos
 FROM (SELECT rels.*, o.place FROM rels JOIN (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM said) o ON o.doc_id = rels.doc_id AND o.i = rels.i) GROUP BY head_entity, relation, tail_entity, doc_id) r JOIN {NOTES} n ON n.doc_id = r.doc_id)"""


@query(f"WITH {E} SELECT src, relation, dst, doc_id, rel_zh, ord, page_num FROM e")
def graph_edges(spark, sf_dir):
    return note_edges(spark, sf_dir).select("src", "relation", "dst", "doc_id", "rel_zh", "ord", "page_num")


@query(f"""WITH {E}, v AS (SELECT DISTINCT name, type FROM {entities_sql('text', SOUND, 'doc_id, text', PACK)}) SELECT 'nodes' AS kind, '' AS name, count(*) AS n FROM v UNION ALL SELECT 'edges', '', count(*) FROM e
 UNION ALL SELECT 'entity_type', {map_sql('type', views.TYPE_NAMES)}, count(*) FROM v GROUP BY type UNION ALL SELECT 'relation_type', {map_sql('relation', views.RELATION_NAMES)}, count(*) FROM e GROUP BY relation""")
def graph_stats(spark, sf_dir):
    return views.stats(graph.vertices(packs.mentions(notes(spark, sf_dir))), note_edges(spark, sf_dir))


CENTERS = names("Fault")[:5] + ["风机", "互感器"]


def centers(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array(" + ", ".join(map(quoted, CENTERS)) + ")) AS name")


@query(f"WITH {E} SELECT src, dst, ord FROM e WHERE relation = 'CAUSED_BY' AND src IN ({', '.join(map(quoted, CENTERS))})")
def typed_forward(spark, sf_dir):
    return views.typed_forward(note_edges(spark, sf_dir), centers(spark), "CAUSED_BY").select("src", "dst", "ord")


@query(f"""WITH {E}, l AS (SELECT src, relation, dst, file_name, page_num, source_sentence, row_number() OVER (PARTITION BY src ORDER BY relation, dst, ord, source_sentence) AS n FROM e WHERE src IN ({', '.join(quoted(views.ALIASES.get(c, c)) for c in CENTERS)})),
 o AS (SELECT src, relation, dst, file_name, page_num, source_sentence, min(n) AS n FROM l WHERE n <= 200 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY src, relation, dst ORDER BY n, file_name, page_num, source_sentence) AS m FROM o)
 SELECT src, relation, dst, string_agg(concat(file_name, ':', page_num, ':', source_sentence), '|' ORDER BY m) AS evidences FROM k WHERE m <= 3 GROUP BY ALL""")
def entity_neighbours(spark, sf_dir):
    rows = views.entity_neighbours(note_edges(spark, sf_dir), centers(spark))
    return rows.select("src", "relation", "dst", F.array_join(F.transform("evidences", lambda x: F.concat_ws(":", x["file_name"], x["page_display"], x["sentence"])), "|").alias("evidences"))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sources", F.md5(F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["file_name"], x["page_display"], x["source_sentence"])), "|")))


LISTED = f"md5(array_to_string(list(concat(file_name, ':', page_num, ':', source_sentence) ORDER BY ord, file_name, page_num, source_sentence)[1:{views.SOURCES}], '|')) AS sources, count(*)::BIGINT AS source_count"
STORED_SHORT, STORED_CATEGORY = map_sql("rel_zh", views.SHORT_NAMES), map_sql("rel_zh", views.CATEGORIES, quoted(views.OTHER))


@query(f"WITH {E} SELECT src, rel_zh AS relation_zh, {STORED_SHORT} AS relation_short, {STORED_CATEGORY} AS relation_category, dst, {LISTED}, 3 AS width FROM e WHERE src = '风力发电机组' GROUP BY src, rel_zh, dst")
def standard_local_edges(spark, sf_dir):
    return _listed(views.standard_local(note_edges(spark, sf_dir), "风机")[1]).drop("ord")


def ends_sql(pick: str, rows: str = "e") -> str:
    return f"(SELECT name, {pick}(type, (ord, side, type)) AS type FROM (SELECT src AS name, src_type AS type, ord, 0 AS side FROM {rows} UNION ALL SELECT dst, dst_type, ord, 1 FROM {rows}) GROUP BY name)"


@query(f"WITH {E}, c AS (SELECT * FROM e WHERE src = '风力发电机组') SELECT name, type, {map_sql('type', views.TYPE_NAMES)} AS type_zh, name = '风力发电机组' AS is_center, CASE WHEN name = '风力发电机组' THEN 38 ELSE 26 END AS size, CASE WHEN name = '风力发电机组' THEN '{views.CENTER_COLOUR}' ELSE {map_sql('type', views.COLOURS, quoted(views.OTHER_COLOUR))} END AS colour FROM {ends_sql('arg_min', 'c')}")
def standard_local_nodes(spark, sf_dir):
    return views.standard_local(note_edges(spark, sf_dir), "风机")[0].select("name", "type", "type_zh", "is_center", "size", "colour")


LOCAL = f"""near AS ((SELECT * FROM e WHERE src = '绝缘下降' ORDER BY ord, relation, src, dst LIMIT 40) UNION ALL (SELECT * FROM e WHERE dst = '绝缘下降' ORDER BY ord, relation, src, dst LIMIT 40)),
 once AS (SELECT src, zh, dst, file_name, page_num, source_sentence, min(ord) AS ord FROM near GROUP BY ALL),
 best AS (SELECT src, zh AS relation_zh, {map_sql('zh', views.SHORT_NAMES)} AS relation_short, {map_sql('zh', views.CATEGORIES, quoted(views.OTHER))} AS relation_category, dst, {LISTED}, {map_sql('zh', views.PRIORITIES, '10')} + 20 + least(count(*), 5) AS score FROM once GROUP BY src, zh, dst ORDER BY score DESC, source_count DESC, src, zh, dst LIMIT 12)"""


@query(f"WITH {E}, {LOCAL} SELECT *, (2 + least(source_count, 3))::BIGINT AS width FROM best")
def local_edges(spark, sf_dir):
    rows = _listed(views.local(note_edges(spark, sf_dir), "绝缘下降")[1]).drop("ord")
    return rows.withColumns({"score": F.col("score").cast("long"), "width": F.col("width").cast("long")})


@query(f"WITH {E}, {LOCAL}, ends AS (SELECT src AS name FROM best UNION SELECT dst FROM best UNION SELECT '绝缘下降') SELECT ends.name, coalesce(t.type, 'Entity') AS type, ends.name = '绝缘下降' AS is_center FROM ends LEFT JOIN {ends_sql('arg_max', 'near')} t ON t.name = ends.name")
def local_nodes(spark, sf_dir):
    return views.local(note_edges(spark, sf_dir), "绝缘下降")[0].select("name", "type", "is_center")


TYPES = f"(SELECT {map_sql('src_type', views.TYPE_NAMES)} AS \"from\", {map_sql('dst_type', views.TYPE_NAMES)} AS \"to\", relation, any_value(zh) AS relation_zh, count(*) AS n FROM e GROUP BY src_type, dst_type, relation)"


@query(f"WITH {E} SELECT *, round(2 + n / max(n) OVER () * 6, 2) AS width, concat(relation_zh, '（', n, '）') AS label FROM {TYPES}")
def type_view_edges(spark, sf_dir):
    return views.type_view(note_edges(spark, sf_dir))[1]


@query(f"WITH {E}, t AS (SELECT \"from\" AS name FROM {TYPES} UNION SELECT \"to\" FROM {TYPES}) SELECT name, {map_sql('name', {views.TYPE_NAMES[k]: v for k, v in views.COLOURS.items()}, quoted(views.OTHER_COLOUR))} AS colour FROM t")
def type_view_nodes(spark, sf_dir):
    return views.type_view(note_edges(spark, sf_dir))[0]


FULL = f"""deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT dst FROM e) GROUP BY name),
 nodes AS (SELECT t.name, t.type, {map_sql('t.type', views.TYPE_NAMES)} AS type_zh, degree, 18 + degree / max(degree) OVER () * 22 AS raw FROM {ends_sql('arg_max')} t JOIN deg ON deg.name = t.name),
 once AS (SELECT src, zh, dst, file_name, page_num, source_sentence, min(ord) AS ord FROM e GROUP BY ALL),
 grouped AS (SELECT src, zh AS relation_zh, {map_sql('zh', views.CATEGORIES, quoted(views.OTHER))} AS relation_category, dst, {LISTED} FROM once GROUP BY src, zh, dst)"""


@query(f"WITH {E}, {FULL} SELECT name, type, type_zh, degree, round(raw, 2) AS size, CASE WHEN raw < 28 THEN 16 ELSE 18 END AS font_size FROM nodes")
def full_nodes(spark, sf_dir):
    return views.full(note_edges(spark, sf_dir))[0].select("name", "type", "type_zh", "degree", "size", "font_size")


@query(f"WITH {E}, {FULL} SELECT *, round(1.5 + source_count / max(source_count) OVER () * 4.5, 2) AS width FROM grouped")
def full_edges(spark, sf_dir):
    return _listed(views.full(note_edges(spark, sf_dir))[1]).select("src", "relation_zh", "relation_category", "dst", "sources", "source_count", "width")


@query(f"WITH {E}, {FULL} SELECT name, degree FROM nodes ORDER BY degree DESC, name LIMIT 120")
def recommended_nodes(spark, sf_dir):
    return views.recommended(views.full(note_edges(spark, sf_dir))[0])


@query(f"WITH {E}, {FULL} SELECT 'entity_type' AS kind, string_agg(DISTINCT type_zh, ',' ORDER BY type_zh) AS names FROM nodes UNION ALL SELECT 'relation_category', string_agg(DISTINCT relation_category, ',' ORDER BY relation_category) FROM grouped")
def view_facets(spark, sf_dir):
    return views.facets(*views.full(note_edges(spark, sf_dir))).withColumn("names", F.array_join("names", ","))


@query(f"WITH {E}, {FULL}, k AS (SELECT * FROM grouped WHERE relation_category = '原因') SELECT name FROM (SELECT src AS name FROM k UNION SELECT dst FROM k UNION SELECT name FROM nodes WHERE name = '风机')")
def category_nodes(spark, sf_dir):
    nodes, grouped = views.full(note_edges(spark, sf_dir))
    return views.of_category(grouped, nodes, "原因", "风机")[0].select("name")


def first_sql(patterns: dict[str, list[str]], x: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(words, x)} THEN {quoted(kind)}" for kind, words in patterns.items()) + f" ELSE {quoted(default)} END"


def without_sql(x: str, phrases: list[str]) -> str:
    for p in phrases:
        x = f"replace({x}, {quoted(p)}, '')"
    return f"trim({x}, '？? ：:，,。 ')"


def alias_sql(x: str) -> str:
    return map_sql(f"trim(replace({x}, '　', ' '))", views.ALIASES)


QUESTIONS = f"(SELECT conv_id, turn, {sql_text(ASKED, 'conv_id * 5 + turn')} AS question FROM conversations WHERE role = 'user')"
ENTITY = "CASE " + " ".join(f"WHEN fault AND kind = '{k}' THEN {without_sql('q', v + qa.FAULT_DROPPED)}" for k, v in qa.FAULT_PATTERNS.items()) + " ".join(f" WHEN NOT fault AND kind = '{k}' THEN {without_sql('q', v + qa.DROPPED)}" for k, v in qa.PATTERNS.items()) + " ELSE '' END"
UNDERSTOOD = f"""k AS (SELECT conv_id, turn, question, trim(question) AS q, {first_sql(qa.FAULT_PATTERNS, 'trim(question)', '')} AS f, {first_sql(qa.PATTERNS, 'trim(question)', '')} AS p FROM {QUESTIONS}),
 kinds AS (SELECT conv_id, turn, question, q, f <> '' AS fault, CASE WHEN f <> '' THEN f ELSE p END AS kind FROM k), named AS (SELECT *, {ENTITY} AS raw FROM kinds), asked AS (SELECT conv_id, turn, question, fault, kind, {alias_sql('raw')} AS entity FROM named)"""


@query(f"WITH {UNDERSTOOD} SELECT conv_id, turn, fault, kind, entity FROM asked")
def rule_questions(spark, sf_dir):
    return qa.understood(questions(spark, sf_dir)).select("question_id.*", "fault", "kind", "entity")


@query(f"SELECT conv_id, turn, {first_sql(qa.INTENTS, 'trim(question)', qa.ANY_INTENT)} AS intent, {without_sql('question', [h for x in qa.HINT_ORDER for h in qa.INTENTS[x]] + qa.FREE_DROPPED)} AS guess FROM {QUESTIONS}")
def free_questions(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id.*", qa.free_intent(F.col("question")).alias("intent"), qa.free_guess(F.col("question")).alias("guess"))


MATCH = f"""f AS (SELECT conv_id, turn, question, {without_sql('question', [h for x in qa.HINT_ORDER for h in qa.INTENTS[x]] + qa.FREE_DROPPED)} AS guess FROM {QUESTIONS}),
 c AS (SELECT conv_id, turn, name, type, CASE WHEN name = guess THEN 0 WHEN contains(question, name) OR contains(name, question) THEN 1 ELSE 2 END AS prio,
 3 * length(name) + CASE WHEN contains(question, name) THEN 30 ELSE 0 END + CASE WHEN type IN ({', '.join(map(quoted, qa.PREFERRED_TYPES))}) THEN 15 ELSE 0 END + CASE WHEN {any_of(qa.SPECIFIC, 'name')} THEN 20 ELSE 0 END - CASE WHEN name IN ({', '.join(map(quoted, qa.GENERIC))}) THEN 25 ELSE 0 END - CASE WHEN length(name) <= 2 THEN 8 ELSE 0 END AS score
 FROM f JOIN {vocabulary_sql(PACK)} ON name = guess OR contains(question, name) OR contains(name, question) OR contains(guess, name) OR contains(name, guess))"""


@query(f"WITH {MATCH} SELECT conv_id, turn, name, type FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY prio, score DESC, length(name) DESC, name, type) AS n FROM c) WHERE n = 1")
def matched_entities(spark, sf_dir):
    nodes = spark.createDataFrame(list(PACK.terms), "name string, type string")
    return qa.matched(questions(spark, sf_dir), nodes).select("question_id.*", "name", "type")


def score_sql(kind: str, fault: bool) -> str:
    s, hints = "trim(source_sentence)", (qa.FAULT_HINTS if fault else qa.HINTS)[kind]
    out = f"CASE WHEN entity <> '' AND contains({s}, entity) THEN 4 ELSE 0 END + CASE WHEN contains({s}, target) THEN 3 ELSE 0 END + 2 * (" + " + ".join(f"contains({s}, {quoted(h)})::INT" for h in hints) + ")"
    out += f" + CASE WHEN {any_of(['标准', '规范', '规程', '监督', '技术'], 'file_name')} THEN 1 ELSE 0 END + CASE WHEN page_num <> '' THEN 1 ELSE 0 END - CASE WHEN length({s}) < {10 if fault else 12} THEN 2 ELSE 0 END"
    for table_, n in ((qa.NEEDED, 3), (qa.STRICT, 1)):
        if not fault and kind in table_:
            out += f" - CASE WHEN {any_of(table_[kind], s)} THEN 0 ELSE {n} END"
    return out


SCORE = "CASE " + " ".join(f"WHEN {'' if fault else 'NOT '}fault AND kind = '{k}' THEN {score_sql(k, fault)}" for fault, kinds in ((True, qa.FAULT_HINTS), (False, qa.HINTS)) for k in kinds) + " END"
ANSWERED = f"""{UNDERSTOOD}, both_ AS (SELECT src AS entity, dst AS target, relation, ord, file_name, page_num, source_sentence FROM e WHERE relation <> 'OCCURS_ON' UNION ALL SELECT dst, src, relation, ord, file_name, page_num, source_sentence FROM e WHERE relation = 'OCCURS_ON'),
 first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, relation ORDER BY ord, target, source_sentence) AS n FROM both_) WHERE n <= 300),
 hits AS (SELECT asked.*, target, ord, file_name, page_num, source_sentence FROM asked JOIN first_ ON first_.entity = asked.entity AND first_.relation = {map_sql('kind', qa.RELATION_OF)}),
 scored AS (SELECT *, {SCORE} AS score FROM hits), ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord, target, source_sentence) AS rank, max(score) OVER (PARTITION BY conv_id, turn) >= 3 AS hit FROM scored),
 kept AS (SELECT conv_id, turn, target, min(rank) AS best FROM ranked WHERE CASE WHEN hit THEN score >= 3 ELSE rank <= 10 END GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY best) AS place FROM kept),
 told AS (SELECT conv_id, turn, string_agg(target, '、' ORDER BY place) FILTER (place <= 5) AS items, count(*)::INT AS n FROM placed WHERE place <= 6 GROUP BY ALL)"""
SAY = "CASE kind " + " ".join(f"WHEN '{k}' THEN format({quoted(v.replace('%s', '{}'))}, entity, items)" for k, v in qa.ANSWERS.items()) + " END"


@query(f"""WITH {E}, {ANSWERED} SELECT asked.conv_id, asked.turn, CASE WHEN kind = '' THEN '' ELSE entity END AS entity, kind, coalesce(n, 0) AS n_results,
 CASE WHEN kind = '' THEN {quoted(qa.NO_KIND)} WHEN entity = '' THEN {quoted(qa.NO_ENTITY)} WHEN items IS NULL THEN CASE WHEN fault THEN {quoted(qa.NO_FAULT_RESULT)} ELSE {quoted(qa.NO_RESULT)} END ELSE {SAY} END AS answer
 FROM asked LEFT JOIN told ON told.conv_id = asked.conv_id AND told.turn = asked.turn""")
def rule_answers(spark, sf_dir):
    return qa.answers(questions(spark, sf_dir), note_edges(spark, sf_dir)).select("question_id.*", "entity", "kind", "n_results", "answer")


@query(f"""WITH {E}, {MATCH}, m AS (SELECT conv_id, turn, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY prio, score DESC, length(name) DESC, name, type) AS n FROM c) WHERE n = 1),
 i AS (SELECT conv_id, turn, {first_sql(qa.INTENTS, 'trim(question)', qa.ANY_INTENT)} AS intent, {without_sql('question', [h for x in qa.HINT_ORDER for h in qa.INTENTS[x]] + qa.FREE_DROPPED)} AS guess FROM {QUESTIONS}),
 k AS (SELECT DISTINCT src AS name, false AS back FROM e UNION SELECT dst, true FROM e WHERE relation = 'OCCURS_ON')
 SELECT i.conv_id, i.turn, coalesce(m.name, guess) AS entity_name, intent, k.name IS NOT NULL AS found, CASE WHEN m.name IS NULL THEN format('{dialogue.NO_NODE.replace('%s', '{}')}', guess) WHEN k.name IS NULL THEN format('未在图谱中检索到与“{{}}”直接相关的知识。', m.name) ELSE '' END AS told
 FROM i LEFT JOIN m ON m.conv_id = i.conv_id AND m.turn = i.turn LEFT JOIN k ON k.name = m.name AND k.back = (intent = '部件故障')""")
def free_answers(spark, sf_dir):
    """Every user turn as a free question, answered whole: what it was taken for, whether the graph has anything, and what is said if not."""
    nodes = spark.createDataFrame(list(PACK.terms), "name string, type string")
    edges = note_edges(spark, sf_dir).withColumnRenamed("page_num", "page")
    got = dialogue.respond(questions(spark, sf_dir), nodes, edges)
    found = F.col("confidence_info.graph_hit_count") > 0
    return got.select("question_id.*", "entity_name", "intent", found.alias("found"), F.when(found, "").otherwise(F.col("answer")).alias("told"))
