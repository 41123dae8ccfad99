"""Scans and sinks: inventories of files, JSON documents, JSON lines, graph tables."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import trim_ws


def inventory(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files below folder with this suffix (any case); contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return describe(rows.filter(F.lower("path").endswith(suffix)), folder)


def describe(rows: DataFrame, folder: str) -> DataFrame:
    """rows (path, length) with relative path, up to three directories, name, stem, suffix and size in MB."""
    rel = F.regexp_replace(F.substring_index("path", folder.rstrip("/") + "/", -1), r"\\", "/")
    parts = F.split(rel, "/")
    level = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    name = F.element_at(parts, -1)
    return rows.select(
        F.regexp_replace(name, r"\.[^.]*\z", "").alias("file_stem"), name.alias("file_name"), F.col("path").alias("full_path"), rel.alias("relative_path"), level(1).alias("level_1_dir"), level(2).alias("level_2_dir"),
        level(3).alias("level_3_dir"), F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1)).alias("suffix"), F.round(F.col("length") / 1048576, 2).alias("size_mb"),
    )


def json_documents(spark: SparkSession, folder: str, schema: StructType | str, without: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return rows.filter(~F.col("_metadata.file_path").contains(without)) if without else rows


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines without the malformed ones; a path that is not there has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


#: Columns of an inventory table.
INVENTORY = "file_stem string, file_name string, full_path string, relative_path string, level_1_dir string, level_2_dir string, level_3_dir string, suffix string, size_mb double, page_count int, sample_text_len int, is_scanned_suspect string, detect_status string"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """An inventory as CSV with a header; a byte-order mark, and columns that are not there, do not matter."""
    return spark.read.schema(INVENTORY).option("header", True).option("enforceSchema", False).csv(path)


def probe(pages: DataFrame, keys: list[str], sample: int = 5, least: int = 200) -> DataFrame:
    """keys, page_count, sample_text_len, is_scanned_suspect, detect_status: from the text of the first `sample` pages of each document.

    pages: keys, page_num, text, error (null, or why the file could not be read: then -1, 0, true and the error).
    """
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("page_num") <= sample) & (F.coalesce("text", F.lit("")) != ""), F.struct("page_num", "text")))), lambda p: p["text"]), "\n")
    rows = pages.groupBy(*keys).agg(F.count("page_num").cast("int").alias("page_count"), F.length(trim_ws(first)).alias("sample_text_len"), F.min("error").alias("_e"))
    failed = F.col("_e").isNotNull()
    return rows.select(
        *keys, F.when(failed, -1).otherwise(F.col("page_count")).alias("page_count"), F.when(failed, 0).otherwise(F.col("sample_text_len")).alias("sample_text_len"),
        (failed | (F.col("sample_text_len") < least)).alias("is_scanned_suspect"), F.when(failed, F.concat(F.lit("failed: "), F.substring("_e", 1, 100))).otherwise("success").alias("detect_status"),
    )


def _succeeded(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).startswith("success")


def is_true(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def scanned(rows: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Inventory rows that were read well and look scanned, one a full_path; with present (path), only those that are there.

    Without the columns that say so (no probe was made), all rows that name a path.
    """
    named = rows.filter(F.coalesce(F.trim("full_path"), F.lit("")) != "")
    if {"detect_status", "is_scanned_suspect"} <= set(rows.columns):
        named = named.filter(_succeeded(F.col("detect_status")) & is_true(F.col("is_scanned_suspect")))
    named = named.dropDuplicates(["full_path"])
    return named if present is None else named.join(present.select(F.col("path").alias("full_path")).distinct(), "full_path", "left_semi")


def textual(rows: DataFrame) -> DataFrame:
    """Inventory rows whose files have a text of their own."""
    return rows.filter(~is_true(F.col("is_scanned_suspect")))


def first_by_path(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows in the order of their relative paths; n: only so many of them, to try things out."""
    ordered = rows.orderBy("relative_path")
    return ordered if n is None else ordered.limit(n)


def probe_summary(rows: DataFrame) -> DataFrame:
    """One row: total, success, scanned, text, failed."""
    ok, scan = _succeeded(F.col("detect_status")), is_true(F.col("is_scanned_suspect"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(scan).alias("scanned"), F.count_if(~scan).alias("text"), F.count_if(~ok).alias("failed"))


def run_summary(rows: DataFrame, status: str, high: Column) -> DataFrame:
    """n rows of each status, and how many of them are high and not."""
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header in place of what is at path, which must not be what rows are read from."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what is at path."""
    rows.write.mode("overwrite").json(path)


def write_documents(rows: DataFrame, path: str, key: str | None = None) -> None:
    """JSON documents, one a line; with key, a folder for each of its values, as an export of few documents may want."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(key) if key else writer).json(path)


def refresh_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph tables as Parquet in place of those in folder, once nodes are known to be unique by (name, type)."""
    if not is_unique(nodes, ["name", "type"]):
        raise ValueError("nodes repeat a name and type")
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def clear_graph(spark: SparkSession, folder: str, nodes: str, edges: str) -> None:
    """Empty graph tables of these schemas in place of those in folder."""
    refresh_graph(spark.createDataFrame([], nodes), spark.createDataFrame([], edges), folder)


def is_unique(rows: DataFrame, keys: list[str]) -> bool:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def memo(rows: DataFrame) -> DataFrame:
    """rows kept in memory, or on disk where it is too small, for all that read them again; call unpersist() on them to read anew."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


class Memos:
    """Tables by name, each loaded once and kept until it is refreshed or dropped.

    A table that cannot be loaded is an empty one of its schema, said once in the log, until it is refreshed: what reads it goes on.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._load, self._kept, self._told = spark, {}, {}, set()

    def add(self, name: str, load: Callable[[], DataFrame], schema: StructType | str) -> None:
        self.drop(name)
        self._load[name] = (load, schema)

    def get(self, name: str) -> DataFrame:
        if name not in self._kept:
            load, schema = self._load[name]
            try:
                rows = memo(load())
                rows.count()  # reads it now, so that what cannot be read is known here
            except Exception:  # whatever the source raises: the log says what
                if name not in self._told:
                    self._told.add(name)
                    logging.getLogger(__name__).exception("%s could not be loaded", name)
                rows = self.spark.createDataFrame([], schema)
            self._kept[name] = rows
        return self._kept[name]

    def refresh(self, name: str) -> DataFrame:
        """The table as its source has it now; what read it before keeps its own."""
        self._forget(name)
        return self.get(name)

    def _forget(self, name: str) -> None:
        if name in self._kept:
            self._kept.pop(name).unpersist()

    def drop(self, name: str) -> None:
        self._forget(name)
        self._load.pop(name, None)
        self._told.discard(name)


def observed(rows: DataFrame, status: str, statuses: list[str], high: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """rows, and a function that tells run_summary's counts for these statuses once a job has gone through the rows: no job of its own.

    {status: {n, n_high, n_low}} and, under None, those of all rows. Statuses must be known before.
    """
    seen = Observation()
    parts = {None: F.lit(True), **{x: F.coalesce(F.col(status) == x, F.lit(False)) for x in statuses}}
    counts = [F.count_if(test & extra).alias(f"{i}_{k}") for i, test in enumerate(parts.values()) for k, extra in (("n", F.lit(True)), ("n_high", high), ("n_low", ~high))]
    return rows.observe(seen, *counts), lambda: {x: {k: seen.get[f"{i}_{k}"] for k in ("n", "n_high", "n_low")} for i, x in enumerate(parts)}


def select(spark: SparkSession, text: str, views: dict[str, DataFrame], **values: object) -> DataFrame:
    """SQL over these views, its :names taken from values (never pasted into the text)."""
    return spark.sql(text, args=values, **views)


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of expected (keys, n) whose n rows are not yet in done (keys): to be done or done anew."""
    return expected.join(done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), [*keys, "n"], "left_anti")


def append_new(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows, one per key, those whose key is not present: to be appended to a graph table."""
    return rows.dropDuplicates(keys).join(present.select(*keys), keys, "left_anti")
