"""Connected components of edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the least of u and its neighbours v. Hot nodes are spread by a salt, and nothing is broadcast."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least.hint("merge"), ["u", "s"]).drop("s")


def _each(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """edges (u, v) made of each of these pairs of columns; in one pass, where a union would work its input out once a pair."""
    made = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs))
    return edges.select(F.explode(made).alias("e")).select("e.u", "e.v").filter("u <> v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) are finished: every u has one v, which is no u itself. One shuffle, where a round has six."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("n")), F.struct(F.col("v").alias("x"), F.lit(0).alias("n")))).alias("e")).select("e.x", "e.n")
    open_ = ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least")).filter("n > 1 or (n = 1 and least = 0)")
    return open_.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (u, v); undirected, repeats and loops allowed.

    Each round is written to the shared folder, so no lineage grows and a lost executor costs no earlier round; the round before
    goes then. Rounds grow with the logarithm of the longest path. The result is stored. An empty table gives no rows.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        large = _with_least(_each(edges, ("u", "v"), ("v", "u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = _each(_with_least(large), ("v", "m"), ("u", "m")).distinct()
        last, edges = edges, stored(small)
        release(last)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stored(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    release(edges)
    return out
