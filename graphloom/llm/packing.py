"""Best-fit decreasing packing of tokenised documents into fixed windows.

All pieces of one length are alike, so the segment tree places counts of lengths, not pieces: the driver sees at most
one row per possible length (4096), whatever the corpus holds, and the plan it makes is the exact best-fit decreasing
one. A rank among the pieces of its length then tells each piece its window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, exact_rank, ship, stored
from .wordbpe import WordBpe

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: documents tokenised, closed by end_id, cut into full windows and a rest (null text: empty).

    Null ids and repeated rows give pieces of their own. Texts of any length are whole. Only the two named columns are read. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = WordBpe.load(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.packed(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    for column, value in zip(out, (doc_id, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


class Tree:
    """A segment tree over remaining capacities: how many open windows have each; finds the tightest that fits."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        at = self.leaves + capacity
        while at:
            self.sums[at] += count
            at //= 2

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least need that an open window has, or -1."""
        at = self.leaves + need
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first window, offset): where the pieces of a length go, in runs of alike windows.

    Windows opened alike have ids in a row. Each step either uses up a length or moves a whole run of windows to a
    lower capacity, so the plan's size depends on the lengths there are, not on how many pieces have them.
    """
    tree, open_runs, opened, plan = Tree(window), {}, 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                # windows that this length alone fills as far as it goes; the last, for what is left, comes after them
                made = max(1, left // (window // length))
                tree.add(window, made)
                open_runs.setdefault(window, []).append((opened, made))
                opened += made
                continue
            first, have = open_runs[capacity].pop()
            used = min(have, left)
            if used < have:
                open_runs[capacity].append((first + used, have - used))
            tree.add(capacity, -used)
            plan.append((length, rank, used, first, window - capacity))
            rank, left = rank + used, left - used
            if capacity > length:
                tree.add(capacity - length, used)
                open_runs.setdefault(capacity - length, []).append((first, used))
    return plan


def pack(rows: DataFrame, window: int) -> DataFrame:
    """rows (PIECES) with sequence_id and offset. Repeated rows are packed each; ties go by doc_id and start."""
    spark = rows.sparkSession
    rows = stored(rows)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_decreasing(counts, window)
    n = buckets_for(sum(counts.values()))
    ranked = exact_rank(
        rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n))), ["length"], "_b", [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")], "_rank"
    ).drop("_b")
    # the plan has a few rows per possible length at most, so its size is bounded by the window
    names = ["length", "_first", "_number", "_window", "offset"]
    table = spark.createDataFrame(pa.table({name: pa.array([row[i] for row in plan], pa.int64()) for i, name in enumerate(names)}))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_number"))).drop(table["length"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_window") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")
