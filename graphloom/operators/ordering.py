"""Positions in a total order, by ranges: no task holds more than a range of the rows, or one row for each range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged


def numbered(rows: DataFrame, order: list[str], name: str = "ord", keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with their position from 0 in the order of keys and order, or within each of keys, as column name.

    Rows that are equal in all of order have following positions in any order. The rows are sorted once, by sampled ranges.
    """
    by = [*(keys or []), *order]
    ranged = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    placed = staged(ranged.withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    out = placed.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1).join(F.broadcast(bases), "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")
    if not keys:
        return out
    firsts = out.groupBy(*keys).agg(F.min(name).alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}"))
    return out.alias("o").join(firsts.alias("f"), same).select(*(F.col(f"o.{c}") for c in rows.columns), (F.col(f"o.{name}") - F.col("f._first")).alias(name))
