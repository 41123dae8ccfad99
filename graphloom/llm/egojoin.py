"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= threshold is distance <= epsilon between unit vectors, and a projection to principal dimensions never lengthens a
distance. Vectors are sorted by the cells (of width epsilon) of their leading principal dimensions, and the order is cut into
blocks that each lie in one cell of the first KEYED dimensions, and into tiles of following blocks. A tile meets those that
hold a cell around one of its own; of two tiles, the blocks whose bounding boxes are within epsilon are joined by halving
their sequences, skipping halves that are provably too far apart, down to LEAF vectors. A leaf's cosines are computed in single
precision first and, where one may reach the threshold, in double precision.

Tiles are files in the shared folder, written once and read by the tasks that meet them: what is shuffled is the vectors, once
by value and once by cell, and the pairs of tile names. Equal vectors are joined once, by one of them. Two tiles return counts
and a forest of their links, not the pairs.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _kept, shared_dir, ship, stored
from .components import components

#: Principal dimensions used; those whose cells key the blocks; vectors of a block, of a tile; vectors at which halving ends.
DIMENSIONS, KEYED, BLOCK, TILE, LEAF = 8, 3, 512, 4096, 128
#: The principal dimensions are fitted to at most this many vectors (the smallest by a hash of the id).
SAMPLE = 4096
#: Slack for rounding in projections and boxes.
SLACK = 1e-6
SALTS = 16


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is made 1 first, so that no square of a finite one overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1)[:, None]
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def principal(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns: the leading principal dimensions of unit vectors."""
    centred = vectors - vectors.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :DIMENSIONS]


class Forest:
    """Labels of positions that keep the links which joined two trees."""

    def __init__(self, n: int) -> None:
        self.label, self.links = np.arange(n), []

    def link(self, x: int, others: np.ndarray) -> None:
        for tree, at in zip(*np.unique(self.label[others], return_index=True), strict=True):
            if tree != self.label[x]:
                self.links.append((x, int(others[at])))
                self.label[self.label == tree] = self.label[x]


class Tile:
    """Unit vectors in grid order, their rows' ids and numbers, and the blocks' bounds and boxes."""

    def __init__(self, name: str, data: bytes, axes: np.ndarray) -> None:
        with np.load(io.BytesIO(data)) as z:
            self.name, self.reps, self.ms, self.ends, self.keys = name, z["reps"], z["ms"], z["ends"], z["keys"]
            self.v = _unit(z["v"].astype(np.float64))
        self.p, self.v4 = self.v @ axes, self.v.astype(np.float32)
        spans = list(zip([0, *self.ends[:-1]], self.ends, strict=True))
        self.spans = [(int(i), int(j)) for i, j in spans]
        self.lo, self.hi = (np.stack([f(self.p[i:j], axis=0) for i, j in self.spans]) for f in (np.min, np.max))


def join_blocks(a: Tile, b: Tile, span_a: tuple[int, int], span_b: tuple[int, int], epsilon: float, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(offset in a, offset in b, links) of the leaves that hold links; within one tile only pairs of i < j count."""
    same = a.name == b.name
    margin = 1e-6 * a.v.shape[1] + 1e-5  # beyond the rounding of single precision
    todo = [(*span_a, *span_b)]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue
        if (i, j, k, m) != (*span_a, *span_b):
            gap = np.maximum(0, np.maximum(a.p[i:j].min(0) - b.p[k:m].max(0), b.p[k:m].min(0) - a.p[i:j].max(0)))
            if np.sqrt((gap * gap).sum()) > epsilon + SLACK:
                continue
        if j - i <= LEAF and m - k <= LEAF:
            if (a.v4[i:j] @ b.v4[k:m].T).max() < threshold - margin:
                continue
            hit = a.v[i:j] @ b.v[k:m].T >= threshold
            if same:
                hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
            if hit.any():
                yield i, k, hit
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    n_links: other rows whose cosine, in double precision, reaches threshold (0 < threshold <= 1). Vectors that are null, empty, zero
    or hold a null or a non-finite component link with nothing, and so do vectors of unlike dimensions with each other.
    Rows with one id are one node of the components, whatever their vectors, but count as rows. Null ids are kept and link with
    nothing. Only the two named columns are read. Vectors of any length, ties and repeated rows are whole. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0 and up to 1 is needed")
    spark = rows.sparkSession
    ship(spark)
    epsilon = float(np.sqrt(2 - 2 * threshold))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = F.col("v")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    usable = rows.filter(good).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))  # -0 is 0
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")).withColumns(_keys())
    sample = usable.select("v", F.xxhash64("vec_id").alias("h"), "vec_id", F.size("v").alias("d")).orderBy("h", "vec_id").limit(SAMPLE).collect()
    axes = {d: principal(_unit(np.array([r["v"] for r in sample if r["d"] == d]))) for d in {r["d"] for r in sample}}
    sent = spark.sparkContext.broadcast(axes)
    folder = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    _kept.append((spark, folder))

    def axes_of(d: int) -> np.ndarray:
        return sent.value[d] if d in sent.value else np.eye(d)[:, :DIMENSIONS]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            size = np.diff(vectors.offsets.to_numpy())
            flat, begin = vectors.values.to_numpy()[vectors.offsets[0].as_py() :], np.r_[0, np.cumsum(size)]
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.stack([flat[begin[i] : begin[i] + d] for i in at])
                p = _unit(x) @ axes_of(int(d))
                p = np.pad(p, ((0, 0), (0, DIMENSIONS - p.shape[1])))
                cells = np.floor(p / max(epsilon, 1e-6)).astype(np.int64)
                with np.errstate(over="ignore"):
                    small = x.astype(np.float32)
                kept = [y.tobytes() for y in (small if (small == x).all() else x)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(1, 5)), pa.array(np.full(len(at), d), pa.int32()), *(pa.array(cells[:, i], pa.int64()) for i in range(KEYED)), pa.array(list(cells[:, KEYED:]), pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    ["rep", "m", "h1", "h2", "d", "c0", "c1", "c2", "cells", "v"],
                )

    cell = ["d", "c0", "c1", "c2"]
    ordered = classes.mapInArrow(project, "rep bigint, m bigint, h1 bigint, h2 bigint, d int, c0 bigint, c1 bigint, c2 bigint, cells array<bigint>, v binary")
    # tiles follow the grid order; a hot cell is split by its finer cells, then by id
    ordered = ordered.repartitionByRange(*cell, "cells", F.xxhash64("rep")).sortWithinPartitions(*cell, "cells", F.xxhash64("rep"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        held: list[dict] = []
        ends: list[int] = []

        def tile() -> pa.RecordBatch:
            d, path, out = held[0]["d"], f"{base}/{uuid.uuid4().hex}.npz", io.BytesIO()
            v = np.stack([np.frombuffer(r["v"], np.float32 if len(r["v"]) == 4 * d else np.float64).astype(np.float64) for r in held])
            if all(len(r["v"]) == 4 * d for r in held):
                v = v.astype(np.float32)
            reps, ms, h1s, h2s = ([r[x] for r in held] for x in ("rep", "m", "h1", "h2"))
            np.savez(out, v=v, reps=np.array(reps, np.int64), ms=np.array(ms, np.int64), keys=np.array([h1s, h2s], np.int64), ends=np.array([*ends, len(held)], np.int64))
            with files.open_output_stream(path) as f:
                f.write(out.getvalue())
            seen = sorted({(r["c0"], r["c1"], r["c2"]) for r in held})
            rows = {"tile": os.path.basename(path), "path": path, "d": d, "cells": [dict(zip(("c0", "c1", "c2"), c, strict=True)) for c in seen], "reps": reps, "ms": ms, "h1s": h1s, "h2s": h2s}
            return pa.RecordBatch.from_pylist([rows], TILES)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == TILE or held[0]["d"] != r["d"]):
                    yield tile()
                    held, ends = [], []
                if held and (any(held[-1][c] != r[c] for c in cell) or len(held) - (ends[-1] if ends else 0) == BLOCK):
                    ends.append(len(held))
                held.append(r)
        if held:
            yield tile()

    tiles = stored(ordered.mapInArrow(cut, "tile string, path string, d int, cells array<struct<c0: bigint, c1: bigint, c2: bigint>>, reps array<bigint>, ms array<bigint>, h1s array<bigint>, h2s array<bigint>"))
    names = tiles.select("tile", "path")
    cells = tiles.select("tile", "d", F.explode("cells").alias("c")).select("tile", "d", "c.*")
    around = F.array(*(F.struct(*(F.lit(x).alias(f"o{i}") for i, x in enumerate(o))) for o in product((-1, 0, 1), repeat=KEYED)))
    near = cells.withColumn("o", F.explode(around)).select(F.col("tile").alias("a"), "d", *((F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(KEYED))).distinct()
    pairs = near.join(cells, cell).filter(F.col("a") <= F.col("tile")).select("a", F.col("tile").alias("b")).distinct()
    pairs = pairs.join(names.toDF("a", "a_path"), "a").join(names.toDF("b", "b_path"), "b").join(tiles.select(F.col("tile").alias("a"), "d"), "a")
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS))).repartition(max(1, min(4 * tiles.count(), 8192)), "a", "s").sortWithinPartitions("a", "s", "b")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)

        def load(name: str, path: str, d: int) -> Tile:
            with files.open_input_file(path) as f:
                return Tile(name, f.read(), axes_of(d))

        mine = None
        for batch in batches:
            for r in batch.to_pylist():
                if mine is None or mine.name != r["a"]:
                    mine = load(r["a"], r["a_path"], r["d"])
                out = _linked(mine, mine if r["a"] == r["b"] else load(r["b"], r["b_path"], r["d"]), epsilon, threshold)
                if out is not None:
                    yield out

    links = stored(pairs.select("a", "a_path", "b", "b_path", "d").mapInArrow(joined, LINKS))
    counts = links.filter("v is null").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    keyed = usable.select("vec_id", *(x.alias(name) for name, x in _keys().items()))
    slim = tiles.select(F.explode(F.arrays_zip("reps", "ms", "h1s", "h2s")).alias("x")).select(F.col("x.reps").alias("rep"), F.col("x.ms").alias("m"), F.col("x.h1s").alias("h1"), F.col("x.h2s").alias("h2"))
    # an id with several vectors is one node: it joins the classes that these are in
    several = keyed.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).filter("a <> b").select("vec_id")
    bridges = keyed.join(several, "vec_id").join(slim.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    labels = components(links.filter("v is not null").select("u", "v").unionByName(bridges))
    found = slim.join(counts, ["h1", "h2"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("h1", "h2", "m", "rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = found.filter("m = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    # copies find their class by two 64-bit hashes of the vector, so that vectors are not shuffled again; hot classes are salted
    classed = found.filter("m > 1").select("h1", "h2", "n_links", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    copies = keyed.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(classed.hint("merge"), ["h1", "h2", "s"]).select("vec_id", "n_links", "component_id")
    none = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone.unionByName(copies).unionByName(none)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _keys() -> dict:
    """What names a class of equal vectors: two 64-bit hashes of column v."""
    return {f"h{i}": F.xxhash64(F.lit(i), "v") for i in (1, 2)}


LINKS = "u bigint, v bigint, n bigint, h1 bigint, h2 bigint"
TILES = pa.schema([("tile", pa.string()), ("path", pa.string()), ("d", pa.int32()), ("cells", pa.list_(pa.struct([("c0", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())]))), *((x, pa.list_(pa.int64())) for x in ("reps", "ms", "h1s", "h2s"))])


def _linked(a: Tile, b: Tile, epsilon: float, threshold: float) -> pa.RecordBatch | None:
    """LINKS of two tiles: (rep, null, links counted as rows, key of the class) and (rep, rep)."""
    same = a.name == b.name
    n, m = np.zeros(len(a.reps), np.int64), np.zeros(len(b.reps), np.int64)
    shift = 0 if same else len(a.reps)
    forest = Forest(shift + len(b.reps))
    gap = np.maximum(0, np.maximum(a.lo[:, None] - b.hi[None], b.lo[None] - a.hi[:, None]))
    close = (gap * gap).sum(-1) <= (epsilon + SLACK) ** 2
    if same:
        close = np.triu(close)
    for s, t in np.argwhere(close):
        for i, k, hit in join_blocks(a, b, a.spans[s], b.spans[t], epsilon, threshold):
            n[i : i + hit.shape[0]] += hit @ b.ms[k : k + hit.shape[1]]
            m[k : k + hit.shape[1]] += a.ms[i : i + hit.shape[0]] @ hit
            for x in np.flatnonzero(hit.any(1)):
                forest.link(int(x) + i, np.flatnonzero(hit[x]) + k + shift)
    reps = a.reps if same else np.r_[a.reps, b.reps]
    counts = n + m if same else np.r_[n, m]
    at = np.flatnonzero(counts)
    if not len(at):
        return None
    u = [*reps[at].tolist(), *(int(reps[x]) for x, _ in forest.links)]
    v = [*[None] * len(at), *(int(reps[y]) for _, y in forest.links)]
    keys = a.keys if same else np.concatenate([a.keys, b.keys], axis=1)
    counted = [[*x[at].tolist(), *[None] * len(forest.links)] for x in (counts, *keys)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, *counted)], ["u", "v", "n", "h1", "h2"])
