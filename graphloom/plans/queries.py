"""Queries over the test tables, one per operator family, and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer, ask, chunk, clean, extract, graph, merge
from ..operators.ordering import numbered
from ..sources import files
from ..sources.graph_store import GraphStore
from ..sources.stage import checkpoint_dir, staged

VOCABULARY = [("thing", "Device"), ("tion the", "Parameter"), ("heand", "Fault"), ("stand", "Fault"), ("edin", "Symptom"), ("onthe", "Cause"), ("with", "Method"), ("ouen", "Action")]
RULES = [
    extract.Rule("HAS_PARAMETER", "Device", "Parameter", words=("and", "of")),
    extract.Rule("HAS_SYMPTOM", "Fault", "Symptom", words=("from",), weak=("the",), pairs=("{head}.{0,12}{tail}",)),
    extract.Rule("CAUSED_BY", "Fault", "Cause"),
    extract.Rule("USES_METHOD", "Device", "Method", weak=("in",)),
]
ENDS = r"[.!?\n]+"
INTENTS = {"causal": ["thing", "tion"], "method": ["with", "from"], "place": ["ing", "in the"]}
PRIORITY = {"1-URGENT": 100, "2-HIGH": 80, "3-MEDIUM": 60}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges from customers to order states, typed by market segment."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat(F.lit("C"), F.col("o_custkey") % 200).alias("src"), F.col("c_mktsegment").alias("src_type"), F.col("o_orderpriority").alias("relation"), F.concat(F.lit("S"), F.col("o_orderstatus")).alias("dst"), F.lit("Status").alias("dst_type"), F.col("o_orderkey").alias("ord"))


EDGES = "(SELECT concat('C', o_custkey % 200) AS src, c_mktsegment AS src_type, o_orderpriority AS relation, concat('S', o_orderstatus) AS dst, 'Status' AS dst_type, o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey)"
CLEAN = r"""trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
 '[\.．·•…。]{4,}', ' ', 'g'), '[_—\-]{4,}', ' ', 'g'), '(?m)^\s*[-—]?\s*\d+\s*[-—]?\s*$', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""
SENTENCES = "(SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents)"
TERMS = "(VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in VOCABULARY) + ") AS v(name, type)"
RELATIONS = f"""(SELECT DISTINCT h.name AS head_entity, r.relation, t.name AS tail_entity, doc_id FROM {SENTENCES} JOIN {TERMS.replace('AS v', 'AS h')} ON contains(s, h.name) JOIN {TERMS.replace('AS v', 'AS t')} ON contains(s, t.name)
 JOIN (VALUES ('HAS_PARAMETER', 'Device', 'Parameter'), ('HAS_SYMPTOM', 'Fault', 'Symptom'), ('CAUSED_BY', 'Fault', 'Cause'), ('USES_METHOD', 'Device', 'Method')) AS r(relation, ht, tt) ON h.type = ht AND t.type = tt
 WHERE CASE relation WHEN 'HAS_PARAMETER' THEN contains(s, 'and') OR contains(s, 'of') WHEN 'HAS_SYMPTOM' THEN contains(s, 'from') OR (length(s) <= 80 AND contains(s, 'the')) OR regexp_matches(s, h.name || '.{{0,12}}' || t.name)
 WHEN 'USES_METHOD' THEN length(s) <= 80 AND contains(s, 'in') ELSE true END)"""


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("chunk_id"), "text")


def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.relations(document_chunks(spark, sf_dir), VOCABULARY, RULES, F.col("text"), ENDS)


@query(f"SELECT doc_id, md5({CLEAN}) AS cleaned FROM documents")
def clean_native(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.clean_page(F.col("text"))).alias("cleaned"))


@query(r"""SELECT doc_id, text <> '' AND (contains(substring(trim(text), 1, 100), 'the') OR (short >= 3 AND chapters >= 5)) AS is_toc FROM (SELECT doc_id, coalesce(text, '') AS text,
 len(list_filter(lines, lambda s: length(s) <= 80 AND regexp_matches(s, '\d+\s*$'))) AS short, len(list_filter(lines[1:15], lambda s: regexp_matches(s, '^\d+(\.\d+)*'))) AS chapters
 FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines FROM documents))""")
def toc_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.is_toc_page(F.col("text"), "the").alias("is_toc"))


@query(r"SELECT doc_id, round_even(len(regexp_extract_all(text, '[A-Za-z0-9]')) / nullif(length(regexp_replace(text, '\s+', '', 'g')), 0), 4) AS ratio FROM documents")
def visible_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.visible_ratio(F.col("text"), "[A-Za-z0-9]").alias("ratio"))


@query()
def ocr_drop_reason(spark, sf_dir):
    rows = clean.clean_ocr_records(table(spark, sf_dir, "documents").withColumn("ocr_line_count", F.size(F.split("text", "\n"))))
    return rows.select("doc_id", "clean_text_len", "visible_text_ratio", "has_structure_hint", "is_filtered", "filter_reason")


SEEN = r"[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
GONE = lambda x, p: f"(length({x}) - length(regexp_replace({x}, '{p}', '', 'g')))"


@query(rf"""SELECT doc_id, CASE WHEN v < 80 THEN 'low_quality' WHEN high THEN 'high_quality' WHEN mixed THEN 'mixed_quality' ELSE 'low_quality' END AS quality_label,
 CASE WHEN v < 80 THEN 'text_too_short' WHEN high THEN 'readable_chinese_text' WHEN mixed THEN 'partially_readable' ELSE 'garbled_or_noisy' END AS quality_reason, v AS visible_chars, d AS digits, a AS abnormal_chars, n AS punctuation_noise, g AS garbled_segments, round_even(own, 4) AS script_ratio
 FROM (SELECT *, own >= 0.25 AND odd < 0.03 AND g <= 2 AS high, own >= 0.12 AND loud < 0.20 AND g <= 8 AS mixed FROM (SELECT *, CASE WHEN v > 0 THEN m / v ELSE 0 END AS own, CASE WHEN v > 0 THEN a / v ELSE 0 END AS odd, CASE WHEN v > 0 THEN (a + n) / v ELSE 0 END AS loud
 FROM (SELECT doc_id, {COUNT('x', SEEN)} AS v, {COUNT('x', '[A-Za-z]')} AS m, {COUNT('x', r'\p{Nd}')} AS d, {COUNT('x', clean.ABNORMAL)} AS a, {' + '.join(GONE('x', p) for p in clean.NOISE_RUNS)} AS n,
 len(list_filter(regexp_split_to_array(x, '[\n。；;]'), lambda s: ({COUNT('s', SEEN)} >= 15 AND {COUNT('s', '[A-Za-z]')} <= 2 AND {COUNT('s', clean.ABNORMAL)} >= 3) OR ({COUNT('s', SEEN)} >= 25 AND {COUNT('s', '[A-Za-z]')} / {COUNT('s', SEEN)} < 0.08 AND ({COUNT('s', clean.ABNORMAL)} + {COUNT('s', '[A-Za-z]')}) / {COUNT('s', SEEN)} > 0.6))) AS g
 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))))""")
def quality_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", clean.text_quality(F.col("text"), "[A-Za-z]").alias("q"))
    return rows.select("doc_id", "q.quality_label", "q.quality_reason", "q.visible_chars", "q.digits", "q.abnormal_chars", "q.punctuation_noise", "q.garbled_segments", "q.script_ratio")


@query("SELECT page_id, substring(md5(coalesce(nullif(url, ''), 'unknown_doc')), 1, 12) AS doc_id FROM pages")
def doc_id_md5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.doc_id(F.col("url"), F.lit(None).cast("string")).alias("doc_id"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '')) AS n_paragraphs FROM documents")
def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunk.paragraphs(F.col("text"))).alias("n_paragraphs"))


@query(f"SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS sentences FROM {SENTENCES} GROUP BY doc_id")
def sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chunk.sentences(F.col("text"), ENDS).alias("s")).filter(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("sentences"))


WHITE = "concat(" + ", ".join(f"chr({ord(c)})" for c in T.WHITE) + ")"
NORMAL = f"trim(regexp_replace(regexp_replace(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '　', ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WHITE})"
PARTS = f"parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, trim(x, {WHITE}) AS x FROM (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, CASE WHEN contains(x, chr(10) || chr(10)) THEN string_split(x, chr(10) || chr(10)) ELSE string_split(x, chr(10)) END AS ps FROM (SELECT doc_id, {NORMAL} AS x FROM documents))) WHERE trim(x, {WHITE}) <> '')"


def grouped_sql(rows: str, least: int, to: str) -> str:
    """CTEs that end with to (doc_id, p, x): rows (doc_id, p, x) joined to groups of `least` characters or more."""
    return f"""{to}_g AS (SELECT doc_id, p, length(x) AS n, 1 AS g, length(x) AS held FROM {rows} WHERE p = 1 UNION ALL SELECT r.doc_id, r.p, length(r.x), CASE WHEN held >= {least} THEN g + 1 ELSE g END, CASE WHEN held >= {least} THEN length(r.x) ELSE held + 1 + length(r.x) END FROM {to}_g JOIN {rows} r ON r.doc_id = {to}_g.doc_id AND r.p = {to}_g.p + 1),
 {to} AS (SELECT r.doc_id, g AS p, string_agg(x, chr(10) ORDER BY r.p) AS x FROM {rows} r JOIN {to}_g q ON q.doc_id = r.doc_id AND q.p = r.p GROUP BY r.doc_id, g)"""


def split_sql(rows: str, ends: str, to: str, longest: int = 500) -> str:
    """CTEs that end with to (doc_id, p, x): rows (doc_id, p, x), those over `longest` characters cut into packed sentences."""
    return f"""{to}_s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k, trim(s, {WHITE}) AS s FROM (SELECT doc_id, p, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, p, regexp_extract_all(x, '[^{ends}]*[{ends}]|[^{ends}]+') AS ss FROM {rows} WHERE length(x) > {longest})) WHERE trim(s, {WHITE}) <> ''),
 {to}_r AS (SELECT doc_id, p, k, s, CASE WHEN length(s) > {longest} THEN 1 ELSE 0 END AS piece, CASE WHEN length(s) > {longest} THEN 2 ELSE 0 END AS cur, CASE WHEN length(s) > {longest} THEN 0 ELSE length(s) END AS held FROM {to}_s WHERE k = 1
 UNION ALL SELECT n.doc_id, n.p, n.k, n.s, CASE WHEN held + length(n.s) <= {longest} THEN cur ELSE cur + 1 END, CASE WHEN held + length(n.s) <= {longest} THEN cur WHEN length(n.s) > {longest} THEN cur + 2 ELSE cur + 1 END,
 CASE WHEN held + length(n.s) <= {longest} THEN held + length(n.s) WHEN length(n.s) > {longest} THEN 0 ELSE length(n.s) END FROM {to}_r JOIN {to}_s n ON n.doc_id = {to}_r.doc_id AND n.p = {to}_r.p AND n.k = {to}_r.k + 1),
 {to}_u AS (SELECT doc_id, p, 0 AS piece, 0 AS sub, x FROM {rows} WHERE length(x) <= {longest} UNION ALL SELECT doc_id, p, piece, 0, string_agg(s, '' ORDER BY k) FROM {to}_r WHERE length(s) <= {longest} GROUP BY doc_id, p, piece
 UNION ALL SELECT doc_id, p, piece, i, trim(substring(s, i + 1, {longest}), {WHITE}) FROM (SELECT doc_id, p, piece, s, unnest(range(0, length(s), {longest})) AS i FROM {to}_r WHERE length(s) > {longest}) WHERE trim(substring(s, i + 1, {longest}), {WHITE}) <> ''),
 {to} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, piece, sub) AS p, x FROM {to}_u)"""


@query(f"WITH RECURSIVE {PARTS}, {split_sql('parts', '。！？；;.!?', 'units')}, {grouped_sql('units', 120, 'chunks')} SELECT doc_id, printf('%s_chunk_%04d', doc_id::VARCHAR, p) AS chunk_id, 1 AS page_start, 1 AS page_end, length(x)::INT AS chunk_len, md5(x) AS chunk_md5 FROM chunks")
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("page_num"), F.col("text").alias("text"), F.lit(False).alias("is_toc_page"))).alias("pages"))
    return chunk.chunk_documents(docs).select("doc_id", "chunk_id", "page_start", "page_end", "chunk_len", F.md5("chunk_text").alias("chunk_md5"))


@query(f"WITH RECURSIVE {PARTS}, {split_sql('parts', '。！？；;.!?', 'cuts')}, units AS (SELECT coalesce(source, '') AS doc_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY cuts.doc_id, p) AS p, x FROM cuts JOIN documents d ON d.doc_id = cuts.doc_id), {grouped_sql('units', 120, 'chunks')} SELECT doc_id AS source, printf('%s_chunk_%04d', doc_id, p) AS chunk_id, length(x)::INT AS chunk_len, md5(x) AS chunk_md5 FROM chunks")
def chunk_long_documents(spark, sf_dir):
    """Each source as one document whose pages are its documents: larger than a row, grouped by blocks."""
    pages = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("doc_id"), F.col("doc_id").alias("page_num"), "text", F.lit(False).alias("is_toc_page"))
    return chunk.chunk_page_rows(pages).select(F.col("doc_id").alias("source"), "chunk_id", "chunk_len", F.md5("chunk_text").alias("chunk_md5"))


@query(f"WITH RECURSIVE {PARTS}, {grouped_sql('parts', 80, 'paras')}, {split_sql('paras', '。！？；;', 'pieces')} SELECT doc_id, printf('%s_chunk_%04d', doc_id::VARCHAR, p) AS chunk_id, length(x)::INT AS text_len, md5(x) AS text_md5 FROM pieces")
def chunk_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("page_num"), F.col("text").alias("text"), F.lit(False).alias("is_toc_page"))).alias("cleaned_pages"))
    return chunk.chunk_pages(docs, label=None).select("doc_id", "chunk_id", "text_len", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, name AS entity_name, type AS entity_type FROM documents JOIN {TERMS} ON contains(text, name)")
def term_mentions(spark, sf_dir):
    return extract.mentions(document_chunks(spark, sf_dir), VOCABULARY, F.col("text")).select("doc_id", "entity_name", "entity_type")


@query("WITH v AS (SELECT DISTINCT w AS name, concat('L', least(length(w), 9)) AS type FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '') SELECT doc_id, name AS entity_name, type AS entity_type FROM documents JOIN v ON contains(text, name)")
def vocabulary_mentions(spark, sf_dir):
    """Mentions of a vocabulary that is a table: all words of the benchmark, by length."""
    return extract.mentions_of(document_chunks(spark, sf_dir), benchmark_words(spark, sf_dir), F.col("text")).select("doc_id", "entity_name", "entity_type")


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("name")).filter("name <> ''").distinct()
    return words.withColumn("type", F.concat(F.lit("L"), F.least(F.length("name"), F.lit(9))))


@query(f"SELECT type AS entity_type, count(*) AS n FROM documents JOIN {TERMS} ON contains(text, name) GROUP BY type")
def mention_counts(spark, sf_dir):
    return graph.counts_by(extract.mentions(document_chunks(spark, sf_dir), VOCABULARY, F.col("text")), "entity_type")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the')::int + contains(text, 'der')::int + contains(text, 'que')::int + contains(text, 'con')::int < 3")
def boilerplate_skip(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~extract.skip_boilerplate(F.col("text"), ["the", "der", "que", "con"])).select("doc_id")


@query(f"SELECT * FROM {RELATIONS}")
def cooccur_relations(spark, sf_dir):
    return document_relations(spark, sf_dir).select("head_entity", "relation", "tail_entity", "doc_id")


@query(f"SELECT relation, count(*) AS n FROM {RELATIONS} GROUP BY relation")
def relation_counts(spark, sf_dir):
    return graph.counts_by(document_relations(spark, sf_dir), "relation")


@query(f"SELECT DISTINCT name, type FROM documents JOIN {TERMS} ON contains(text, name)")
def vertices(spark, sf_dir):
    return graph.vertices(extract.mentions(document_chunks(spark, sf_dir), VOCABULARY, F.col("text")))


@query(f"SELECT head_entity AS src, relation, tail_entity AS dst, doc_id FROM {RELATIONS} WHERE head_entity <> 'stand'")
def dangling_edges(spark, sf_dir):
    nodes = graph.vertices(extract.mentions(document_chunks(spark, sf_dir), VOCABULARY, F.col("text"))).filter("name <> 'stand'")
    return graph.edges(document_relations(spark, sf_dir), nodes).select("src", "relation", "dst", "doc_id")


@query(f"SELECT 'node' AS kind, src AS name, '' AS relation, '' AS dst FROM {EDGES} UNION SELECT 'node', dst, '', '' FROM {EDGES} UNION SELECT 'edge', src, relation, dst FROM {EDGES}")
def graph_versions(spark, sf_dir):
    """The orders' graph, committed with its urgent orders first and the others upserted, as its last version is read."""
    edges = order_edges(spark, sf_dir)
    nodes = lambda e: e.select(F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit("Node").alias("type")), F.struct(F.col("dst").alias("name"), F.lit("Node").alias("type")))).alias("n")).select("n.*").distinct()
    ends = lambda e: e.select("src", F.lit("Node").alias("src_type"), "relation", "dst", F.lit("Node").alias("dst_type"))
    store = GraphStore(spark, f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}", edge_keys=["src", "relation", "dst"])
    urgent, others = (edges.filter(F.col("relation") == "1-URGENT"), edges.filter(F.col("relation") != "1-URGENT"))
    store.refresh(nodes(urgent), ends(urgent).distinct())
    store.upsert(nodes(others), ends(others))
    kept = store.read("nodes").select(F.lit("node").alias("kind"), "name", F.lit("").alias("relation"), F.lit("").alias("dst"))
    return kept.unionByName(store.read("edges").select(F.lit("edge").alias("kind"), F.col("src").alias("name"), "relation", "dst"))


@query(f"SELECT src, relation, dst, ord FROM {EDGES} WHERE src IN ('C7', 'C11')")
def out_neighbors(spark, sf_dir):
    return graph.out_neighbours(order_edges(spark, sf_dir), spark.sql("SELECT * FROM VALUES ('C7'), ('C11') AS t(name)")).select("src", "relation", "dst", "ord")


@query(f"SELECT src, relation, dst, ord FROM {EDGES} WHERE dst = 'SP'")
def in_neighbors(spark, sf_dir):
    return graph.in_neighbours(order_edges(spark, sf_dir), spark.sql("SELECT 'SP' AS name")).select("src", "relation", "dst", "ord")


@query(f"SELECT dst AS src, src AS dst, ord FROM {EDGES} WHERE dst = 'SP' AND relation = '2-HIGH'")
def typed_reverse(spark, sf_dir):
    return graph.typed_reverse(order_edges(spark, sf_dir), spark.sql("SELECT 'SP' AS name"), "2-HIGH").select("src", "dst", "ord")


@query(f"SELECT src_type, relation, dst_type, n, round(2 + n / max(n) OVER () * 6, 2) AS width FROM (SELECT src_type, relation, dst_type, count(*) AS n FROM {EDGES} GROUP BY ALL)")
def type_graph(spark, sf_dir):
    return graph.type_graph(order_edges(spark, sf_dir))


@query(f"SELECT name, count(*) AS degree FROM (SELECT src AS name FROM {EDGES} UNION ALL SELECT dst FROM {EDGES}) GROUP BY name ORDER BY degree DESC, name LIMIT 120")
def degree_topn(spark, sf_dir):
    return graph.top_by_degree(order_edges(spark, sf_dir))


@query(f"SELECT src, relation, dst, count(*) AS n_rows, count(DISTINCT src_type) AS source_count FROM {EDGES} GROUP BY src, relation, dst")
def edge_sources(spark, sf_dir):
    return graph.edge_sources(order_edges(spark, sf_dir), ["src_type"])


@query(f"""SELECT src, relation, dst, n_rows, source_count, CASE relation WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 80 WHEN '3-MEDIUM' THEN 60 ELSE 10 END + 20 + least(source_count, 5) AS score
 FROM (SELECT src, relation, dst, count(*) AS n_rows, count(DISTINCT src_type) AS source_count FROM {EDGES} GROUP BY src, relation, dst) WHERE src = 'C7' OR dst = 'C7' ORDER BY score DESC, source_count DESC, src, relation, dst LIMIT 12""")
def local_ranked(spark, sf_dir):
    return graph.local_edges(graph.edge_sources(order_edges(spark, sf_dir), ["src_type"]), "C7", PRIORITY)


@query(f"""SELECT src, relation, string_agg(dst || ':' || src_type, ',' ORDER BY n) AS evidences FROM (SELECT *, row_number() OVER (PARTITION BY src, relation ORDER BY o, dst, src_type) AS n
 FROM (SELECT src, relation, dst, src_type, min(ord) AS o FROM {EDGES} GROUP BY ALL)) WHERE n <= 3 GROUP BY src, relation""")
def grouped_evidence(spark, sf_dir):
    rows = graph.grouped_evidence(order_edges(spark, sf_dir), ["src", "relation"], ["dst", "src_type"], "ord")
    return rows.select("src", "relation", F.array_join(F.transform("evidences", lambda e: F.concat(e["dst"], F.lit(":"), e["src_type"])), ",").alias("evidences"))


@query(f"SELECT DISTINCT src_type AS facet FROM {EDGES}")
def facet_options(spark, sf_dir):
    return order_edges(spark, sf_dir).select(F.col("src_type").alias("facet")).distinct()


@query("SELECT n_name, CASE n_name WHEN 'NATION_0' THEN 'First' WHEN 'NATION_1' THEN 'Second' ELSE n_name END AS shown FROM nation")
def alias_lookup(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", ask.alias(F.col("n_name"), {"NATION_0": "First", "NATION_1": "Second"}).alias("shown"))


ASKED = "(SELECT conv_id, turn, text, CASE WHEN contains(text, 'thing') OR contains(text, 'tion') THEN 'causal' WHEN contains(text, 'with') OR contains(text, 'from') THEN 'method' WHEN contains(text, 'ing') OR contains(text, 'in the') THEN 'place' ELSE 'open' END AS intent FROM conversations WHERE role = 'user')"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", ask.intent(F.col("text"), INTENTS, "open").alias("intent"))


@query(f"SELECT conv_id, turn, intent FROM {ASKED}")
def intent_detect(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", "intent")


@query(f"SELECT conv_id, turn, md5(trim(replace(replace(text, 'the', ''), 'of', ''), '? ')) AS guess FROM {ASKED}")
def entity_guess(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", F.md5(ask.entity_guess(F.col("text"), ["the", "of"], "? ")).alias("guess"))


@query(f"""SELECT conv_id, turn, name FROM (SELECT conv_id, turn, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY 3 * length(name) + 30 + CASE WHEN type = 'Device' THEN 15 ELSE 0 END - CASE WHEN name = 'with' THEN 25 ELSE 0 END DESC, length(name) DESC, name, type) AS n
 FROM {ASKED} JOIN {TERMS} ON contains(text, name)) WHERE n = 1""")
def entity_match_top1(spark, sf_dir):
    q = questions(spark, sf_dir).select(F.struct("conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.lit("\x00").alias("guess"))
    nodes = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in VOCABULARY) + " AS v(name, type)")
    found = ask.match_entities(q, nodes, ask.specificity(F.col("name"), F.col("type"), F.col("question"), ["Device"], ["\x01"], ["with"]))
    return found.select("question_id.conv_id", "question_id.turn", "name")


@query(f"""SELECT src, ord, score FROM (SELECT *, max(score >= 3) OVER (PARTITION BY src) AS hit, row_number() OVER (PARTITION BY src ORDER BY score DESC, ord) AS n
 FROM (SELECT src, ord, CASE WHEN relation = '1-URGENT' THEN 4 ELSE 0 END + CASE WHEN src_type = 'BUILDING' THEN 2 ELSE 0 END AS score FROM {EDGES})) WHERE (hit AND score >= 3) OR (NOT hit AND n <= 10)""")
def threshold_fallback(spark, sf_dir):
    score = F.when(F.col("relation") == "1-URGENT", 4).otherwise(0) + F.when(F.col("src_type") == "BUILDING", 2).otherwise(0)
    return ask.threshold_or_first(order_edges(spark, sf_dir).withColumn("score", score), "src", "score", [F.col("score").desc(), F.col("ord")]).select("src", "ord", "score")


@query(f"SELECT src, ord FROM (SELECT *, max(relation = '1-URGENT') OVER (PARTITION BY src) AS hit FROM {EDGES}) WHERE relation = '1-URGENT' OR NOT hit")
def intent_filter_fallback(spark, sf_dir):
    return ask.preferred_or_all(order_edges(spark, sf_dir), "src", F.col("relation") == "1-URGENT").select("src", "ord")


@query(f"""SELECT src, string_agg(relation, '、' ORDER BY n) AS targets FROM (SELECT src, relation, row_number() OVER (PARTITION BY src ORDER BY min(ord), relation) AS n FROM {EDGES} GROUP BY src, relation) WHERE n <= 5 GROUP BY src""")
def top_targets(spark, sf_dir):
    return ask.top_targets(order_edges(spark, sf_dir), "src", "relation", "ord")


@query(f"SELECT DISTINCT doc_id FROM {SENTENCES} WHERE contains(s, 'thing') AND (contains(s, 'edin') OR contains(s, 'ouen'))")
def evidence_semijoin(spark, sf_dir):
    rows = document_chunks(spark, sf_dir).select("doc_id", F.explode(chunk.sentences(F.col("text"), ENDS)).alias("source_sentence"))
    return ask.evidence(rows, spark.sql("SELECT 'thing' AS entity, array('edin', 'ouen') AS targets")).select("doc_id").distinct()


CONFIDENCE = f"""(SELECT src, greatest(0, least(100, least(count(*), 8) * 5 + least(count(DISTINCT relation), 8) * 5 + CASE WHEN count(DISTINCT dst) >= 2 THEN 10 ELSE 0 END + CASE WHEN max(src_type = 'BUILDING') THEN 10 ELSE 0 END + CASE WHEN max(relation = '1-URGENT') THEN 10 ELSE 0 END)) AS score FROM {EDGES} GROUP BY src)"""


@query(f"SELECT src, score, CASE WHEN score >= 75 THEN '高' WHEN score >= 45 THEN '中' ELSE '低' END AS level FROM {CONFIDENCE}")
def confidence(spark, sf_dir):
    rows = order_edges(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("g"), F.countDistinct("relation").alias("e"), F.countDistinct("dst").alias("f"), F.max(F.col("src_type") == "BUILDING").alias("p"), F.max(F.col("relation") == "1-URGENT").alias("r"))
    rows = rows.select("src", ask.confidence(F.col("g"), F.col("e"), F.col("f"), F.col("p"), F.col("r")).alias("score"))
    return rows.withColumn("level", ask.level(F.col("score")))


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _of_intent(table: dict[str, list[str]], x: str) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {x} IN ({_listed(v)})" for k, v in table.items()) + " ELSE false END"


#: Relations with the first sentence that has each, as edges; questions with their entity; their ranked rows, evidences and answers.
#: No question here asks for what occurs on a part, so edges are followed forward only.
FIRST = RELATIONS.replace("SELECT DISTINCT h.name AS head_entity, r.relation, t.name AS tail_entity, doc_id", "SELECT h.name AS src, any_value(h.type) AS src_type, r.relation, t.name AS dst, any_value(t.type) AS dst_type, doc_id AS ord, doc_id::VARCHAR AS file_name, min(k)::VARCHAR AS page, arg_min(s, k) AS said").replace(SENTENCES, "s")
NAMED = f"""SELECT conv_id, turn, name, text, intent FROM (SELECT conv_id, turn, name, text, CASE intent WHEN 'causal' THEN '故障症状' WHEN 'method' THEN '使用方法' WHEN 'place' THEN '参数要求' ELSE '综合查询' END AS intent, row_number() OVER (PARTITION BY conv_id, turn ORDER BY 3 * length(name) + 30 + CASE WHEN type = 'Device' THEN 15 ELSE 0 END - CASE WHEN name = 'with' THEN 25 ELSE 0 END DESC, length(name) DESC, name, type) AS n
 FROM {ASKED} JOIN {TERMS} ON contains(text, name)) WHERE n = 1"""
ZH = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in answer.RELATION_NAMES.items()) + " ELSE relation END"
SAID = "CASE intent " + " ".join(f"WHEN '{k}' THEN format('{v.replace('%s', '{}')}', name, joined)" for k, v in answer.SENTENCES.items()) + f" ELSE concat(format('{answer.ANY.replace('%s', '{}')}', name, joined), CASE WHEN about <> '' THEN format('{answer.ANY_MORE.replace('%s', '{}')}', about) ELSE '' END) END"
GRAPH_ANSWERS = f"""WITH s AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM (SELECT doc_id, trim(s) AS s, i FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]+'), 1) AS i FROM documents)) WHERE s <> ''),
 e AS (SELECT * FROM {FIRST[:-1]} GROUP BY h.name, r.relation, t.name, doc_id)), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord, relation, dst, said) AS n FROM e) WHERE n <= 120), q AS ({NAMED}),
 hits AS (SELECT q.*, near.* EXCLUDE n, {_of_intent(answer.RELATIONS_OF, 'relation')} AS wanted, {_of_intent(answer.TYPES_OF, 'dst_type')} AS typed FROM q JOIN near ON near.src = q.name),
 fit AS (SELECT * FROM (SELECT *, bool_or(wanted OR typed) OVER (PARTITION BY conv_id, turn) AS any_ FROM hits) WHERE wanted OR typed OR NOT any_),
 scored AS (SELECT *, CASE WHEN contains(said, dst) THEN 3 ELSE 0 END + 1 + CASE WHEN wanted THEN 5 ELSE 0 END + CASE WHEN typed THEN 4 ELSE 0 END + CASE WHEN {' OR '.join(f"intent = '{k}' AND (" + ' OR '.join(f"contains(said, '{w}')" for w in v) + ')' for k, v in answer.SENTENCE_WORDS.items())} THEN 3 ELSE 0 END
 + len(list_filter(regexp_extract_all(text, '[一-鿿A-Za-z0-9]{{2,}}'), lambda t: contains(said, t))) AS score, CASE WHEN intent = '综合查询' THEN coalesce(nullif(list_position([{_listed(answer.OPEN_ORDER)}], relation), 0), 999) ELSE 0 END AS place FROM fit),
 once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, src, relation, dst ORDER BY score DESC, place, ord, relation, dst, said) AS n FROM scored) WHERE n = 1),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, place, ord, relation, dst, said) AS r FROM once) WHERE r <= 8),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r) AS n FROM (SELECT conv_id, turn, dst, min(r) AS r FROM top GROUP BY ALL)), t AS (SELECT conv_id, turn, list(dst ORDER BY n) AS targets FROM firsts WHERE n <= 5 GROUP BY ALL),
 zh AS (SELECT conv_id, turn, {ZH} AS zh, dst, min(r) AS r FROM top WHERE r <= 6 GROUP BY ALL), four AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, zh ORDER BY r) AS n, min(r) OVER (PARTITION BY conv_id, turn, zh) AS f FROM zh),
 named AS (SELECT conv_id, turn, zh || '包括：' || string_agg(dst, '、' ORDER BY r) AS x, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(f)) AS n FROM four WHERE n <= 4 GROUP BY conv_id, turn, zh), about AS (SELECT conv_id, turn, string_agg(x, '；' ORDER BY n) AS about FROM named WHERE n <= 4 GROUP BY ALL),
 p AS (SELECT file_name, page, said, min(ord) AS ord FROM e GROUP BY ALL), proofs AS (SELECT * FROM (SELECT q.conv_id, q.turn, p.*, row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY ord, file_name, page, said) AS n FROM q JOIN t ON t.conv_id = q.conv_id AND t.turn = q.turn JOIN p ON contains(said, name) AND len(list_filter(targets, lambda x: contains(said, x))) > 0) WHERE n <= 8),
 f AS (SELECT conv_id, turn, count(*) AS evidences, count(DISTINCT file_name) AS files, arg_min(file_name, n) AS file_name, arg_min(page, n) AS page FROM proofs GROUP BY ALL),
 g AS (SELECT conv_id, turn, count(*) AS graph_hits, bool_or(wanted) AS wanted FROM top GROUP BY ALL),
 o AS (SELECT q.conv_id, q.turn, name, intent, coalesce(graph_hits, 0) AS graph_hits, coalesce(evidences, 0) AS evidences, greatest(0, least(100, least(coalesce(graph_hits, 0), 8) * 5 + least(coalesce(evidences, 0), 8) * 5 + CASE WHEN files >= 2 THEN 10 ELSE 0 END + CASE WHEN evidences > 0 THEN 10 ELSE 0 END + CASE WHEN wanted THEN 10 ELSE 0 END)) AS score,
 array_to_string(targets, '、') AS joined, coalesce(about, '') AS about, CASE WHEN evidences > 0 THEN concat(format('{answer.SOURCE.replace('%s', '{}')}', file_name), format('{answer.SOURCE_PAGE.replace('%s', '{}')}', page), '{answer.SOURCE_END}') ELSE '' END AS cited
 FROM q LEFT JOIN t ON t.conv_id = q.conv_id AND t.turn = q.turn LEFT JOIN about ON about.conv_id = q.conv_id AND about.turn = q.turn LEFT JOIN f ON f.conv_id = q.conv_id AND f.turn = q.turn LEFT JOIN g ON g.conv_id = q.conv_id AND g.turn = q.turn)
SELECT conv_id, turn, name AS entity, intent, md5(CASE WHEN graph_hits = 0 THEN format('{answer.NO_ROWS.replace('%s', '{}')}', name) ELSE concat({SAID}, cited) END) AS answer_md5, score::INT AS score, CASE WHEN score >= 75 THEN '高' WHEN score >= 45 THEN '中' ELSE '低' END AS level, graph_hits::INT AS graph_hits, evidences::INT AS evidences FROM o"""


@query(GRAPH_ANSWERS)
def graph_answers(spark, sf_dir):
    """Answers to all user turns that name a term, from the relations of all documents."""
    edges = staged(document_relations(spark, sf_dir)).select(F.col("head_entity").alias("src"), F.col("head_type").alias("src_type"), "relation", F.col("tail_entity").alias("dst"), F.col("tail_type").alias("dst_type"), F.col("doc_id").cast("string").alias("file_name"), F.col("ord").cast("string").alias("page"), "source_sentence", F.col("doc_id").alias("ord"))
    known = {"causal": "故障症状", "method": "使用方法", "place": "参数要求"}
    asked = questions(spark, sf_dir).select("conv_id", "turn", "text", T.label(F.col("intent"), known, F.lit("综合查询")).alias("intent"))
    asked = asked.join(entity_match_top1(spark, sf_dir), ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("question_id"), F.col("text").alias("question"), "intent", F.col("name").alias("entity"))
    return answer.answers(asked, edges).select("question_id.conv_id", "question_id.turn", "entity", "intent", F.md5("answer").alias("answer_md5"), "score", "level", "graph_hits", "evidences")


PAGES = "(SELECT coalesce(d.doc_id, l.doc_id) AS page, CASE WHEN nullif(d.text, '') IS NOT NULL AND d.doc_id % 3 <> 0 THEN 'text_clean' WHEN l.doc_id IS NOT NULL THEN 'ocr_clean' ELSE 'empty' END AS selected_source FROM documents d FULL JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("doc_key"), F.col("doc_id").alias("page_num"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise(F.lit("")).alias("text"), F.lit(False).alias("is_toc_page"))
    ocr = table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("doc_key"), F.col("doc_id").alias("page_num"), F.concat(F.lit("quality "), F.col("quality")).alias("clean_text"), (F.col("quality") == 0).alias("is_filtered"), F.lit("").alias("filter_reason"), F.col("quality").alias("ord"))
    return merge.merge_pages(native, merge.best_page(ocr, ["doc_key", "page_num"]))


@query(f"SELECT page, selected_source FROM {PAGES}")
def outer_merge_priority(spark, sf_dir):
    return merged(spark, sf_dir).select(F.col("page_num").alias("page"), "selected_source")


@query(f"SELECT selected_source, count(*) AS n FROM {PAGES} GROUP BY selected_source")
def source_stats(spark, sf_dir):
    return graph.counts_by(merged(spark, sf_dir), "selected_source")


@query("""WITH l AS (SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality = 0, quality) AS n FROM labels) WHERE n = 1),
 p AS (SELECT coalesce(d.doc_id, l.doc_id) AS page, CASE WHEN d.doc_id % 3 <> 0 AND d.text <> '' THEN d.text WHEN l.doc_id IS NOT NULL THEN concat('quality ', quality) ELSE '' END AS text FROM documents d FULL JOIN l ON l.doc_id = d.doc_id)
 SELECT page // 10 AS doc_key, count(*)::INT AS page_count, md5(coalesce(string_agg(concat('[PAGE ', page, ']', chr(10), text), chr(10) ORDER BY page) FILTER (text <> ''), '')) AS merged_md5 FROM p GROUP BY page // 10""")
def merged_text(spark, sf_dir):
    return merge.assemble(merged(spark, sf_dir)).select("doc_key", "page_count", F.md5("merged_text").alias("merged_md5"))


@query("SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (doc_id + k) % 3 = 0, doc_id * k % 7 DESC, k) AS n FROM (SELECT doc_id, unnest(range(1, 6))::INT AS k FROM documents) WHERE doc_id * k % 7 > 0) WHERE n = 1")
def best_page_pick(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    rows = rows.select("doc_id", "k", F.expr("repeat('x', cast(doc_id * k % 7 as int))").alias("clean_text"), ((F.col("doc_id") + F.col("k")) % 3 == 0).alias("is_filtered"), F.col("k").alias("ord"))
    return merge.best_page(rows, ["doc_id"]).select("doc_id", "k")


@query(r"""SELECT rel AS relative_path, regexp_replace(name, '\.[^.]*$', '') AS file_stem, name AS file_name, coalesce(parts[1], '') AS level_1_dir, coalesce(parts[2], '') AS level_2_dir, coalesce(parts[3], '') AS level_3_dir, lower(regexp_extract(name, '(\.[^.]*)$', 1)) AS suffix, round(n / 1048576, 2) AS size_mb
 FROM (SELECT page_id, rel, string_split(rel, '/') AS parts, string_split(rel, '/')[-1] AS name, n FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rel, length(html) * 1000 AS n FROM pages))""")
def scan_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"), (F.length("html") * 1000).alias("length"))
    return files.describe(rows, "/in").select("relative_path", "file_stem", "file_name", "level_1_dir", "level_2_dir", "level_3_dir", "suffix", "size_mb")


@query("SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS ord, row_number() OVER (PARTITION BY substr(url, 1, 20) ORDER BY url, page_id) - 1 AS place FROM pages")
def path_order(spark, sf_dir):
    """Positions of all pages in the order of their addresses, and among those of one beginning."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.substring("url", 1, 20).alias("start"))
    return numbered(numbered(rows, ["url", "page_id"]), ["url", "page_id"], "place", ["start"]).select("page_id", "ord", "place")


PROBED = f"""(SELECT doc_id, CASE WHEN bad THEN -1 ELSE len(lines) END AS page_count, CASE WHEN bad THEN 0 ELSE length(trim(array_to_string(list_filter(lines[1:5], lambda x: x <> ''), chr(10)), {WHITE})) END AS sample_text_len, bad FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, doc_id % 50 = 0 AS bad FROM documents WHERE text IS NOT NULL))"""


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if each line were a page; one in fifty cannot be read."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return files.probe(pages.select("doc_id", (F.col("i") + 1).alias("page_num"), "text", F.when(F.col("doc_id") % 50 == 0, "no such file").alias("error")), ["doc_id"])


@query(f"SELECT doc_id, page_count, sample_text_len, bad OR sample_text_len < 200 AS is_scanned_suspect, CASE WHEN bad THEN 'failed: no such file' ELSE 'success' END AS detect_status FROM {PROBED}")
def type_probe(spark, sf_dir):
    return probed(spark, sf_dir)


@query(f"SELECT count(*) AS total, count_if(NOT bad) AS success, count_if(bad OR sample_text_len < 200) AS scanned, count_if(NOT (bad OR sample_text_len < 200)) AS text, count_if(bad) AS failed FROM {PROBED}")
def probe_summary(spark, sf_dir):
    return files.probe_summary(probed(spark, sf_dir))


@query(f"SELECT DISTINCT concat('/in/', doc_id // 2) AS full_path FROM {PROBED} WHERE NOT bad AND sample_text_len < 200 AND doc_id // 2 % 5 <> 0")
def scanned_files(spark, sf_dir):
    rows = probed(spark, sf_dir).withColumn("full_path", F.concat(F.lit("/in/"), F.expr("doc_id div 2")))
    present = table(spark, sf_dir, "documents").filter("doc_id div 2 % 5 <> 0").select(F.concat(F.lit("/in/"), F.expr("doc_id div 2")).alias("path"))
    return files.scanned(rows, present).select("full_path")


@query(f"SELECT doc_id FROM {PROBED} WHERE NOT (bad OR sample_text_len < 200)")
def textual_files(spark, sf_dir):
    return files.textual(probed(spark, sf_dir)).select("doc_id")


POOL = """k AS (SELECT *, CASE WHEN path <> '' THEN 'rel::' || path ELSE 'name::' || name END AS doc_key FROM (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('dir/', doc_id % 300) END AS path, concat('n', doc_id % 50, '.PDF') AS name, coalesce(text, '') AS text FROM documents)),
 o AS (SELECT *, CASE WHEN path <> '' THEN 'rel::' || path ELSE 'name::' || name END AS doc_key FROM (SELECT doc_id AS id, concat('dir/', doc_id % 400) AS path, '' AS name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 4 END AS page, repeat('y', (doc_id % 3)::INT) AS text, quality = 0 AS bad FROM labels)),
 nat AS (SELECT doc_key, unnest([1, 3]) AS page, unnest([text, '']) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY lpad(id::VARCHAR, 12, '0') DESC) AS n FROM k) WHERE n = 1),
 pick AS (SELECT doc_key, page, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, page ORDER BY bad, length(text) DESC, id) AS n FROM o WHERE page > 0 AND text <> '') WHERE n = 1),
 pages AS (SELECT coalesce(nat.doc_key, pick.doc_key) AS doc_key, coalesce(nat.page, pick.page) AS page, CASE WHEN nat.text <> '' THEN 'text_clean' WHEN pick.text <> '' THEN 'ocr_clean' ELSE 'empty' END AS source FROM nat FULL JOIN pick ON pick.doc_key = nat.doc_key AND pick.page = nat.page),
 keys AS (SELECT doc_key, max(has) = 1 AS has_text_clean, min(has) = 0 AS has_ocr_clean, coalesce(max(path), '') AS path, coalesce(arg_min(name, (1 - has, place)) FILTER (name <> ''), '') AS name FROM (SELECT doc_key, 1 AS has, path, name, lpad(id::VARCHAR, 12, '0') AS place FROM k UNION ALL SELECT doc_key, 0, path, name, lpad(id::VARCHAR, 20, '0') FROM o) GROUP BY doc_key)"""


@query(f"WITH {POOL} SELECT keys.doc_key, substring(md5(coalesce(nullif(path, ''), nullif(name, ''), 'unknown_doc')), 1, 12) AS doc_id, regexp_replace(name, '(?i)\\.pdf$', '') AS title, has_text_clean, has_ocr_clean, count(source)::INT AS page_count, coalesce(count_if(source = 'text_clean'), 0)::INT AS n_text, coalesce(count_if(source = 'ocr_clean'), 0)::INT AS n_ocr FROM keys LEFT JOIN pages ON pages.doc_key = keys.doc_key GROUP BY ALL")
def document_pool(spark, sf_dir):
    c = F.col
    native = table(spark, sf_dir, "documents").select(
        F.lpad(c("doc_id").cast("string"), 12, "0").alias("file_path"), F.when(c("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("dir/"), c("doc_id") % 300)).alias("relative_path"), F.concat(F.lit("n"), c("doc_id") % 50, F.lit(".PDF")).alias("file_name"),
        F.array(*(F.struct(F.lit(n).alias("page_num"), x.alias("text"), F.lit(False).alias("is_toc_page")) for n, x in ((1, F.coalesce("text", F.lit(""))), (3, F.lit(""))))).alias("cleaned_pages"),
    )
    ocr = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("dir/"), c("doc_id") % 400).alias("relative_path"), F.lit("").alias("file_name"), F.when(c("doc_id") % 5 == 0, "x").otherwise((c("doc_id") % 4).cast("string")).alias("page_num"), F.expr("repeat('y', cast(doc_id % 3 as int))").alias("clean_text"),
        (c("quality") == 0).alias("is_filtered"), F.lit("").alias("filter_reason"), c("doc_id").alias("ord"),
    )
    docs = merge.standard_documents(*merge.document_pool(native, ocr))
    stat = lambda k: F.coalesce(F.try_element_at("selected_source_stats", F.lit(k)), F.lit(0))
    return docs.select("doc_key", "doc_id", "title", "has_text_clean", "has_ocr_clean", "page_count", stat("text_clean").alias("n_text"), stat("ocr_clean").alias("n_ocr"))


@query("SELECT o_orderkey, n FROM (SELECT o_orderkey, 4 AS n FROM orders) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey) WHERE l_orderkey = o_orderkey AND c = n)")
def resume_antijoin(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).cast("long").alias("n"))
    return files.pending(expected, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey", F.col("n").cast("int").alias("n"))


@query("SELECT doc_id, source FROM documents ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id LIMIT 60")
def sample_hash(spark, sf_dir):
    return extract.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@query("SELECT event_type, count(*) AS n, count_if(value > 50) AS n_high, sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS n_low FROM events GROUP BY event_type")
def run_summary(spark, sf_dir):
    return files.run_summary(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to sentences, terms, typed pairs, vertices and edges, counted by relation."""
    nodes = graph.vertices(extract.mentions(document_chunks(spark, sf_dir), VOCABULARY, F.col("text")))
    return graph.counts_by(graph.edges(document_relations(spark, sf_dir), nodes), "src_type", "relation", "dst_type")
