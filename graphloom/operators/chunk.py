"""Paragraphs, sentences and chunks: ordered greedy folds over lengths, joined only once their groups are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, let, normalize, trim_ws
from ..sources.stage import staged
from . import folds
from .ordering import numbered

ENDS, LEGACY_ENDS = r"(?<=[。！？；;.!?])", r"(?<=[。！？；;])"


def paragraphs(x: Column) -> Column:
    """Parts between empty lines, or lines if there are none; trimmed, without empty ones."""
    return let(normalize(x), _paragraphs)


def _paragraphs(x: Column) -> Column:
    parts = F.when(x.contains("\n\n"), F.split(x, "\n\n", -1)).otherwise(F.split(x, "\n", -1))
    return F.filter(F.transform(parts, trim_ws), lambda p: p != "")


def sentences(x: Column, ends: str = r"[。！？；;\n]+") -> Column:
    return F.filter(F.transform(F.split(x, ends, -1), trim_ws), lambda s: s != "")


def split_long(x: Column, longest: int = 500, ends: str = ENDS) -> Column:
    """x, or its sentences packed greedily up to longest characters; a longer sentence is cut hard and ends a piece."""
    return let(normalize(x), lambda n: _split_long(n, longest, ends))


def _split_long(x: Column, longest: int, ends: str) -> Column:
    """split_long of a normalised text."""
    parts = F.filter(F.transform(F.split(x, ends, -1), trim_ws), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def flush(acc: Column) -> Column:
        return F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])

    def step(acc: Column, s: Column) -> Column:
        hard = F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(longest)), lambda i: trim_ws(F.substring(s, i + 1, longest)))
        return (
            F.when(F.length(acc["held"]) + F.length(s) <= longest, F.struct(acc["out"].alias("out"), F.concat(acc["held"], s).alias("held")))
            .when(F.length(s) > longest, F.struct(F.concat(flush(acc), F.filter(hard, lambda p: p != "")).alias("out"), F.lit("").alias("held")))
            .otherwise(F.struct(flush(acc).alias("out"), s.alias("held")))
        )

    return F.when(x == "", F.array().cast("array<string>")).when(F.length(x) <= longest, F.array(x)).otherwise(F.aggregate(parts, start, step, flush))


def group_short(lengths: Column, least: int = 120) -> Column:
    """Group number of each unit: a group takes the next unit while it is shorter than least (joined by one character)."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("group"), F.lit(least).alias("held"))

    def step(acc: Column, n: Column) -> Column:
        new = acc["held"] >= least
        group = F.when(new, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.concat(acc["out"], F.array(group)).alias("out"), group.alias("group"), F.when(new, n).otherwise(acc["held"] + 1 + n).alias("held"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def runs(units: Column, groups: Column) -> Column:
    """array of struct(index from 1, units of one group): groups are numbers that never fall, one for each unit."""
    starts = F.filter(F.sequence(F.lit(1), F.size(groups)), lambda i: (i == 1) | (F.element_at(groups, i) != F.element_at(groups, F.greatest(i - 1, F.lit(1)))))

    def cut(found: Column) -> Column:
        ends = lambda k: F.coalesce(F.try_element_at(found, k + 2), F.size(groups) + 1)
        return F.transform(found, lambda at, k: F.struct((k + 1).alias("index"), F.slice(units, at, ends(k) - at).alias("units")))

    return let(F.when(F.size(groups) > 0, starts).otherwise(F.array().cast("array<int>")), cut)


def chunk_documents(docs: DataFrame, least: int = 120, longest: int = 500, ends: str = ENDS) -> DataFrame:
    """Chunks of documents (doc_id, pages: page_num, text, is_toc_page): chunk_id, page_start, page_end, chunk_text, chunk_len.

    All of a document's units stay in its row, so no shuffle is needed. Contents and blank pages are skipped.
    """
    pages = F.array_sort(F.filter("pages", lambda p: ~F.coalesce(p["is_toc_page"], F.lit(False)) & (F.coalesce(trim_ws(p["text"]), F.lit("")) != "")), lambda a, b: a["page_num"] - b["page_num"])
    # a paragraph of a normalised page is normalised already
    cut = lambda p: F.flatten(F.transform(paragraphs(p["text"]), lambda g: _split_long(g, longest, ends)))
    units = F.flatten(F.transform(pages, lambda p: F.transform(cut(p), lambda t: F.struct(p["page_num"].alias("page"), t.alias("text")))))
    rows = docs.withColumn("_units", units)
    rows = rows.withColumn("_groups", group_short(F.transform("_units", lambda u: F.length(u["text"])), least))
    rows = rows.withColumn("_chunk", F.explode(runs(F.col("_units"), F.col("_groups"))))
    text = F.array_join(F.transform("_chunk.units", lambda u: u["text"]), "\n")
    return rows.select(
        *(c for c in docs.columns if c != "pages"), chunk_id(F.col("doc_id").cast("string"), F.col("_chunk.index")).alias("chunk_id"), F.array_min(F.transform("_chunk.units", lambda u: u["page"])).alias("page_start"),
        F.array_max(F.transform("_chunk.units", lambda u: u["page"])).alias("page_end"), text.alias("chunk_text"), F.length(text).alias("chunk_len"),
    )


def chunk_page_rows(pages: DataFrame, least: int = 120, longest: int = 500, ends: str = ENDS, block: int = folds.BLOCK) -> DataFrame:
    """chunk_documents() of documents whose pages are rows (doc_id, page_num, text, is_toc_page), for documents larger than a row.

    A document's units are numbered by ranges and grouped by blocks, so that its pages may be spread over all tasks.
    """
    kept = pages.filter(~F.coalesce("is_toc_page", F.lit(False)) & (F.coalesce(trim_ws(F.col("text")), F.lit("")) != ""))
    cut = F.flatten(F.transform(paragraphs(F.col("text")), lambda g: _split_long(g, longest, ends)))
    units = kept.select("doc_id", "page_num", F.posexplode(cut).alias("_at", "_text"))
    # ranges are found by a first look at all units: they are cut once, before it
    return chunk_units(numbered(staged(units), ["page_num", "_at"], "i", ["doc_id"]), least, block)


def chunk_units(units: DataFrame, least: int = 120, block: int = folds.BLOCK) -> DataFrame:
    """Chunks of units in their order (doc_id, i from 0, page_num, _text): chunk_id, page_start, page_end, chunk_text, chunk_len."""
    groups = folds.grouped(units.select("doc_id", "i", F.length("_text").alias("n")), ["doc_id"], folds.short_units(least), block=block)
    rows = units.join(groups, ["doc_id", "i"]).groupBy("doc_id", "group").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.sort_array(F.collect_list(F.struct("i", "_text"))).alias("_u"))
    text = F.array_join(F.transform("_u", lambda u: u["_text"]), "\n")
    return rows.select("doc_id", chunk_id(F.col("doc_id").cast("string"), F.col("group") + 1).alias("chunk_id"), "page_start", "page_end", text.alias("chunk_text"), F.length(text).alias("chunk_len"))


def chunk_pages(docs: DataFrame, least: int = 80, longest: int = 500, label: str | None = "high_quality") -> DataFrame:
    """The per-page way: a page's short paragraphs are merged first, then long ones are split; chunks are numbered through the document.

    docs: doc_id, cleaned_pages (page_num, is_toc_page, text), quality_label; only documents of that label (None: all).
    Returns doc_id, page_num, chunk_id, text, text_len.
    """
    if label is not None:
        docs = docs.filter(F.col("quality_label") == label)

    def merged(x: Column) -> Column:
        parts = paragraphs(x)
        grouped = let(parts, lambda g: runs(g, group_short(F.transform(g, F.length), least)))
        return F.transform(grouped, lambda c: F.array_join(c["units"], "\n"))

    pages = F.filter("cleaned_pages", lambda p: ~F.coalesce(p["is_toc_page"], F.lit(False)) & (F.coalesce(trim_ws(p["text"]), F.lit("")) != ""))
    pieces = F.flatten(F.transform(pages, lambda p: F.transform(F.flatten(F.transform(merged(p["text"]), lambda t: split_long(t, longest, LEGACY_ENDS))), lambda t: F.struct(p["page_num"].alias("page_num"), t.alias("text")))))
    rows = docs.select("doc_id", F.posexplode(pieces).alias("_i", "_p"))
    return rows.select("doc_id", "_p.page_num", chunk_id(F.col("doc_id").cast("string"), F.col("_i") + 1).alias("chunk_id"), "_p.text", F.length("_p.text").alias("text_len"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """One row a document: how many chunks, of how many characters, over which pages."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("chunk_len").alias("chunk_chars"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
