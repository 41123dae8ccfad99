"""Full outer merge of native and OCR pages by document and page, native text first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_id, doc_key, label, title


def best_page(rows: DataFrame, keys: list[str], text: str = "clean_text", filtered: str = "is_filtered", ord_col: str = "ord") -> DataFrame:
    """Of the rows of a key that have text: unfiltered before filtered, then the longest, then the first."""
    order = Window.partitionBy(*keys).orderBy(F.col(filtered), F.length(text).desc(), F.col(ord_col))
    return rows.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def merge_pages(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """native (doc_key, page_num, text, is_toc_page), ocr (doc_key, page_num, clean_text, is_filtered, filter_reason), a row a page each."""
    a = native.select("doc_key", "page_num", F.nullif("text", F.lit("")).alias("_native"), "is_toc_page")
    b = ocr.select("doc_key", "page_num", F.nullif("clean_text", F.lit("")).alias("_ocr"), "is_filtered", "filter_reason")
    both = a.join(b, ["doc_key", "page_num"], "full_outer")
    source = F.when(F.col("_native").isNotNull(), F.lit("text_clean")).when(F.col("_ocr").isNotNull(), F.lit("ocr_clean")).otherwise(F.lit("empty"))
    by_ocr = F.col("selected_source") == "ocr_clean"
    return both.withColumn("selected_source", source).select(
        "doc_key", "page_num", "selected_source", F.coalesce("_native", "_ocr", F.lit("")).alias("text"), (F.col("selected_source") == "text_clean").__and__(F.coalesce("is_toc_page", F.lit(False))).alias("is_toc_page"),
        (by_ocr & F.coalesce("is_filtered", F.lit(False))).alias("is_filtered"), F.when(by_ocr, F.coalesce("filter_reason", F.lit(""))).otherwise(F.lit("")).alias("filter_reason"),
    )


#: Which source is preferred; declared for readers, the pages themselves are chosen by merge_pages.
SOURCE_PRIORITY = {"text": 1, "native": 1, "text_clean": 1, "ocr": 2, "ocr_clean": 2}
UNKNOWN_PRIORITY = 99


def source_priority(source: Column) -> Column:
    return label(source, {k: str(v) for k, v in SOURCE_PRIORITY.items()}, F.lit(str(UNKNOWN_PRIORITY))).cast("int")


def valid_pages(rows: DataFrame, page: str = "page_num") -> DataFrame:
    """Rows whose page number is a whole number over 0; others go. page becomes an int."""
    return rows.withColumn(page, F.col(page).cast("string").try_cast("int")).filter(F.col(page) > 0)


def document_pool(native: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and their merged pages from native documents and OCR pages that are the same by path, or else by name.

    native: file_path, relative_path, file_name, cleaned_pages (page_num, text, is_toc_page); ocr: relative_path, file_name, page_num,
    clean_text, is_filtered, filter_reason, ord. Of native documents with one key the last by file_path counts. Documents: doc_key,
    doc_id, relative_path, file_name (the first that are not empty, native before OCR), has_text_clean, has_ocr_clean.
    """
    keyed = lambda rows: rows.withColumn("doc_key", doc_key(F.trim("relative_path"), F.trim("file_name")))
    native, ocr = keyed(native), keyed(ocr)
    last = native.withColumn("_n", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.col("file_path").desc()))).filter("_n = 1").drop("_n")
    names = native.select("doc_key", F.lit(0).alias("kind"), F.col("file_path").alias("at"), "relative_path", "file_name").unionByName(ocr.select("doc_key", F.lit(1).alias("kind"), F.lpad(F.col("ord").cast("string"), 20, "0").alias("at"), "relative_path", "file_name"))
    first = lambda x: F.min_by(F.trim(x), F.when(F.trim(x) != "", F.struct("kind", "at")))
    docs = names.groupBy("doc_key").agg(F.coalesce(first("relative_path"), F.lit("")).alias("relative_path"), F.coalesce(first("file_name"), F.lit("")).alias("file_name"), (F.min("kind") == 0).alias("has_text_clean"), (F.max("kind") == 1).alias("has_ocr_clean"))
    docs = docs.withColumn("doc_id", doc_id(F.col("relative_path"), F.col("file_name"))).withColumn("title", title(F.col("file_name")))
    pages = last.select("doc_key", F.explode("cleaned_pages").alias("p")).select("doc_key", "p.page_num", "p.text", "p.is_toc_page")
    # a document's page comes once: of repeated numbers the last
    chosen = best_page(valid_pages(ocr), ["doc_key", "page_num"])
    return docs, merge_pages(pages, chosen)


def standard_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a document: what document_pool has of it, with page_count, merged_text, pages and selected_source_stats."""
    return docs.join(assemble(pages), "doc_key", "left").withColumns({"page_count": F.coalesce("page_count", F.lit(0)), "merged_text": F.coalesce("merged_text", F.lit(""))})


def merged_index(documents: DataFrame) -> DataFrame:
    """A line a document, without its pages and text."""
    return documents.select("doc_id", "title", "file_name", "relative_path", "page_count", F.length("merged_text").alias("merged_text_len"), "selected_source_stats")


def assemble(pages: DataFrame) -> DataFrame:
    """doc_key, page_count, merged_text, pages and counts by source of merged pages."""
    rows = pages.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("page_num", "selected_source", "text", "is_toc_page", "is_filtered", "filter_reason"))).alias("pages"))
    body = F.filter("pages", lambda p: (p["text"] != "") & ~(p["is_toc_page"] & (p["selected_source"] == "text_clean")))
    text = F.array_join(F.transform(body, lambda p: F.concat(F.lit("[PAGE "), p["page_num"].cast("string"), F.lit("]\n"), p["text"])), "\n")
    kinds = ["text_clean", "ocr_clean", "empty"]
    of = lambda kind: F.size(F.filter("pages", lambda p: p["selected_source"] == kind))
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(of, kinds))), lambda _, n: n > 0)
    return rows.select("doc_key", F.size("pages").alias("page_count"), text.alias("merged_text"), "pages", counts.alias("selected_source_stats"))
