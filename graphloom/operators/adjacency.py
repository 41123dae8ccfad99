"""Edge tables bucketed by each end, so that questions meet them without moving an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write(edges: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Tables name_out and name_in: edges in buckets by src, and by dst, each sorted by it, in place of those of that name."""
    for end, to in (("src", "out"), ("dst", "in")):
        edges.repartition(buckets, end).write.mode("overwrite").bucketBy(buckets, end).sortBy(end).saveAsTable(f"{name}_{to}")


def _near(spark: SparkSession, table: str, end: str, names: DataFrame) -> DataFrame:
    asked = names.select(F.col("name").alias(end)).distinct()
    return spark.table(table).join(asked.hint("merge"), end, "left_semi")


def out_of(spark: SparkSession, name: str, names: DataFrame) -> DataFrame:
    """Edges from each of names (name): the names are dealt as the edges lie, and no edge is."""
    return _near(spark, f"{name}_out", "src", names)


def into(spark: SparkSession, name: str, names: DataFrame) -> DataFrame:
    return _near(spark, f"{name}_in", "dst", names)


def degrees(spark: SparkSession, name: str) -> DataFrame:
    """name and degree over edge rows (a loop counts twice): counted where the edges lie, and joined there."""
    ends = [spark.table(f"{name}_{to}").groupBy(F.col(end).alias("name")).agg(F.count(F.lit(1)).alias(to)) for end, to in (("src", "out"), ("dst", "in"))]
    both = ends[0].join(ends[1].hint("merge"), "name", "full")
    return both.select("name", (F.coalesce("out", F.lit(0)) + F.coalesce("in", F.lit(0))).alias("degree"))
