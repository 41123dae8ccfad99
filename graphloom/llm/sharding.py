"""Proportional stratified interleaving: every shard is a cut of one order in which the sources are evenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, exact_rank, stored


def interleave(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard, slot for every row of docs.

    Rows of one source are shuffled by a seeded hash of their id and ranked; a row's place is its fractional rank
    (2 rank + 1) / (2 rows of the source); the order by place is cut into shards of equal counts (law `rows`:
    at most one apart). So a shard holds each source's share to within one row at either end of the cut.
    Only ids, sizes and checksums are shuffled, never texts; a hot source is ranked in many buckets.

    Null source: a stratum of its own. Null text: size 8, checksum 0. Repeated rows are all placed; rows that are
    equal in every column used here are interchangeable. Null ids are placed. An empty table gives no rows. Texts of any length
    count whole; only the three named columns are read, so others may have any name.
    Copies of a text are spread like all other rows: a group may hold more than a shard's share.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # 60 bits of a digest: the same order in any engine
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    slim = stored(slim.withColumn("_h", shuffled))
    rows = slim.count()
    n = buckets_for(rows)
    ranked = exact_rank(slim.withColumn("_b", F.shiftright(F.shiftright("_h", 29) * F.lit(n).cast("long"), 31)), ["source"], "_b", _ties("_h"), "_rank", "_of").drop("_b")
    placed = ranked.withColumn("_place", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_of")).cast("double"))
    placed = stored(placed.withColumn("_b", F.least((F.col("_place") * n).cast("long"), F.lit(n - 1))))
    whole = exact_rank(placed, [], "_b", [F.col("_place"), F.col("source"), *_ties("_rank")], "position")
    shard = F.floor(F.col("position") * shards / F.lit(max(rows, 1))) if rows * shards < 2**52 else F.floor(F.col("position").cast("decimal(38,0)") * shards / F.lit(rows))
    whole = whole.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    return whole.select("doc_id", F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1)).alias("source"), "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot"))


def _ties(first: str) -> list:
    return [F.col(first), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
