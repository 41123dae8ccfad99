"""Near-duplicates by bottom-k sketches from one hash function, inverted lists of retained values, and exact sets.

1. Each document's shingle set is hashed once; equal sets form one class, whose smallest id stands for it.
2. A sketch keeps the BOTTOM smallest hashes. Inverted lists are keyed by RUN retained values in a row that begin at an even
   one: of pairs of Jaccard 0.8 about one in four million shares no such run (at 0.85, one in 200 million), while sets that
   share a passage hardly ever do. Sets of up to SMALL shingles retain all of them and are listed under their rarest ones
   instead: as many as a similar set cannot all lack, so that no pair is missed and frequent shingles make no long lists.
3. To find most links cheaply, all members meet in a short list. In a longer one, every member meets PIVOTS members (the most
   central one and two others, the same ones in list after list): pairs grow in proportion to members. A pair is put off if
   the union of its sketches says its similarity is well below the threshold; what is left joins documents to clusters,
   which are wider than groups of near-duplicates.
4. In each cluster, full sets are compared exactly, all with all, in pairs of blocks; only a forest of the links is returned.
5. Lists of any length that this leaves in more than one component are compared in the same way, but for pairs of their
   largest component. So no pair that shares a list is lost to pivots, sketches or sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, ship, stored
from .components import components
from .wordhash import mix, ranges, signed, words

BOTTOM, RUN, SMALL, PIVOTS = 64, 3, 80, 3
#: All members of a list meet up to this length: lists of runs, lists of small sets.
SHORT_RUNS, SHORT_SMALL = 8, 64
#: A pair is put off unless its estimate reaches the threshold less this (over four standard deviations at BOTTOM values).
MARGIN_PERCENT = 22
#: Documents and shingles of a block, on average, at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 18
SALTS = 32
LONGS = pa.list_(pa.int64())


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; fewer words: the whole sequence; no word: none."""
    h, _, _, doc, _ = words(texts, lower=True)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    rolled = np.full(max(len(h) - k + 1, 0), np.uint64(k))
    for i in range(k):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : len(rolled) + i])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def list_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the lists of runs that a set stands in."""
    if len(s) <= BOTTOM:
        return s[:0]
    low = s[:BOTTOM]
    at = np.flatnonzero((low[: BOTTOM - RUN + 1] & np.uint64(1 << 20)) == 0)
    run = np.full(len(at), np.uint64(RUN))
    for i in range(RUN):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + low[at + i])
    return run


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity by the bottom values of the union of two sketches; exact if both hold their whole sets."""
    union = np.union1d(a, b)
    if len(a) >= BOTTOM or len(b) >= BOTTOM:
        union = union[: max(BOTTOM, min(len(a), len(b)))]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(both, union[-1], "right") / len(union)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Links: 100 * intersection >= percent * union of the sets of k-word shingles (A-Z lower-cased). Null and wordless texts
    have empty sets and link with nothing. Rows with one id are one node; each is returned, kept if the id is its component's.
    Null ids are kept and link with nothing. Texts of any length are whole; there are no ties, since a component's least id is kept.
    Only the two named columns are read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [s for i, j in ranges(texts) for s in shingle_sets(texts[i:j], k)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array([signed(list_keys(s)) for s in sets], LONGS), pa.array([signed(s if len(s) <= SMALL else s[:0]) for s in sets], LONGS),
                    pa.array([s[:BOTTOM].tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "h1", "h2", "keys", "small", "sketch"],
            )

    sketches = stored(docs.mapInArrow(sketch, "doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, small array<bigint>, sketch binary"))
    full = sketches.filter("n > 0 and doc_id is not null")
    # classes of equal sets: only their sizes and least ids move, hot ones spread by a salt
    classes = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).filter("rep <> other").drop("other")
    classes = classes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = full.select("doc_id", "h1", "h2", "n", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("s")).join(classes.hint("merge"), ["h1", "h2", "n", "s"])
    copies = stored(copies.filter("doc_id <> rep").select("doc_id", "rep").distinct())
    reps = full.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    runs = reps.select("doc_id", "n", F.lit(False).alias("small"), F.explode("keys").alias("key")).distinct()
    lists = runs.unionByName(_rarest(reps, percent))
    sizes = stored(lists.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    lists = lists.join(sizes, "key")
    fullness = lists.groupBy("doc_id").agg(F.avg("c").alias("fullness"))
    lists = stored(lists.join(fullness, "doc_id"))  # only what stands in lists of two or more
    short = F.col("c") <= F.when(F.col("small"), SHORT_SMALL).otherwise(SHORT_RUNS)
    long = lists.filter(~short)
    pairs = _meet(long, long.groupBy("key").agg(*_pivots()), percent).unionByName(_meet_all(lists.filter(short), percent)).distinct()
    likely = stored(_likely(pairs, sketches, percent))
    clusters = components(likely.select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = stored(_linked(docs, clusters, sketches, k, percent))
    labels = components(links)
    open_ = stored(_open_lists(lists, labels))
    release(sizes, lists, likely, clusters)  # what follows is made of stored tables alone
    if not open_.isEmpty():
        first, labels = labels, components(links.unionByName(_linked(docs, open_, sketches, k, percent)))
        release(first)
    counts = stored(sketches.select("doc_id", F.col("n").alias("n_shingles")))
    release(links, open_, sketches)  # lists and sketches do not lie about while the result is used
    grouped = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "rep").alias("component"))
    # a class's representative may be linked with nothing but its copies; it is its own component's least id then
    whole = labels.unionByName(grouped)
    out = counts.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rarest(reps: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, small, key: small sets' lists, keyed by the rarest n - ceil(n * percent / 100) + 1 of a set's shingles.

    Shingles of one small set only come first in the order of rarity, but need no list.
    """
    small = reps.filter(F.col("n") <= SMALL).select("doc_id", "h1", "n", "small").dropDuplicates(["doc_id", "h1", "n"])
    held = small.select("doc_id", "h1", "n", F.explode("small").alias("x"))
    often = stored(held.groupBy("x").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"))
    common = held.join(often, "x").groupBy("doc_id", "h1", "n").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("by"))  # SMALL at most
    least = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 - (n - size(by)) as int)")
    return common.select("doc_id", "n", F.lit(True).alias("small"), F.explode(F.slice("by", F.lit(1), F.greatest(least, F.lit(0)))).alias("y")).select("doc_id", "n", "small", F.xxhash64("y.x", F.lit("small")).alias("key")).distinct()


def _meet_all(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all members of short lists whose sizes allow the threshold."""
    a, b = (members.select("key", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    return a.join(b, "key").filter("a > b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """node, component, main for the members of lists of any length that hold more than one component: each is still to compare.

    main: the member is of the list's largest component, whose members need not be compared with each other. Of lists of the
    same members one is enough.
    """
    marked = lists.select("key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("at", F.coalesce("component", "doc_id"))
    parts = marked.groupBy("key", "at").agg(F.count(F.lit(1)).alias("c"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"h{i}") for i in range(2)))
    mixed = parts.groupBy("key").agg(F.sum("c").alias("c"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"), F.max(F.struct("c", "at")).alias("top"), F.count(F.lit(1)).alias("parts"))
    mixed = mixed.filter("parts > 1").groupBy("c", "h0", "h1").agg(F.min(F.struct("key", F.col("top.at").alias("most"))).alias("one")).select("one.key", "one.most")
    return marked.join(mixed, "key").select(F.col("doc_id").alias("node"), F.col("key").alias("component"), (F.col("at") == F.col("most")).alias("main"))


def _pivots() -> list:
    """Of a list: the member that stands in the fullest lists, then members by a hash of their ids."""
    by = [F.struct(-F.col("fullness"), F.xxhash64("doc_id")), *(F.xxhash64("doc_id", F.lit(i)) for i in range(1, PIVOTS))]
    return [F.min_by(F.struct("doc_id", "n"), x).alias(f"p{i}") for i, x in enumerate(by)]


def _meet(members: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members of lists and their pivots whose sizes allow the threshold."""
    met = members.join(stored(shared), "key").select("doc_id", "n", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("p"))
    met = met.filter(F.col("doc_id") != F.col("p.doc_id")).filter(100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n"))
    return met.select(F.greatest("doc_id", "p.doc_id").alias("a"), F.least("doc_id", "p.doc_id").alias("b")).distinct()


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch does not speak against them."""
    least = (percent - MARGIN_PERCENT) / 100

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], ["a", "b"])

    one = sketches.filter("n > 0").select("doc_id", "sketch").dropDuplicates(["doc_id"])
    both = pairs.join(one.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(one.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(kept, "a bigint, b bigint")


def _linked(docs: DataFrame, clusters: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between members of a cluster (node, component) whose full sets confirm them: a forest of each block pair's.

    A cluster is dealt into blocks of about BLOCK documents, or BLOCK_SHINGLES shingles where these are fewer documents; each
    pair of blocks is one task's, so a cluster of any size, and of texts of any length, is compared by many tasks in bounded
    memory. A block pair returns the links that join two trees, never all its pairs. Members that are
    marked main, where there is such a column, are joined already: their blocks meet those of the others only.
    """
    if "main" not in clusters.columns:
        clusters = clusters.withColumn("main", F.lit(False))
    clusters = clusters.join(sketches.select(F.col("doc_id").alias("node"), "n").dropDuplicates(["node"]).hint("merge"), "node")

    def blocks(test: str, name: str) -> Column:
        return F.expr(f"cast(greatest((count_if({test}) + {BLOCK - 1}) div {BLOCK}, (sum(if({test}, n, 0)) + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}) as int)").alias(name)

    sizes = clusters.groupBy("component").agg(blocks("main", "joined"), blocks("not main", "others"))
    sizes = sizes.select("component", "joined", "others", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    dealt = clusters.withColumn("s", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")).join(sizes.hint("merge"), ["component", "s"])
    h = F.xxhash64("node", F.lit(2))
    own = F.when(F.col("main"), F.pmod(h, F.greatest("joined", F.lit(1)))).otherwise(F.col("joined") + F.pmod(h, F.greatest("others", F.lit(1)))).cast("int")
    # the blocks that a document meets: from `since` on, up to the last
    dealt = dealt.select(F.col("node").alias("doc_id"), "component", F.when(F.col("main"), F.col("joined")).otherwise(F.lit(0)).alias("since"), (F.col("joined") + F.col("others")).alias("blocks"), own.alias("own"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [s for i, j in ranges(texts) for s in shingle_sets(texts[i:j], k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3, 4, 5)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "component", "since", "blocks", "own", "set"])

    sets = docs.join(dealt, "doc_id").dropDuplicates(["doc_id", "component"]).select("doc_id", "text", "component", "since", "blocks", "own").mapInArrow(full_sets, "doc_id bigint, component bigint, since int, blocks int, own int, set binary")
    spread = sets.withColumn("other", F.explode(F.sequence(F.col("since"), F.col("blocks") - 1)))
    spread = spread.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            for component, i, j, own, doc_id, data in zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True):
                if at != (component, i, j):
                    if len(held) > 1:
                        yield _forest(held, at, percent)
                    at, held = (component, i, j), []
                held.append((own, doc_id, np.frombuffer(data, np.uint64)))
        if len(held) > 1:
            yield _forest(held, at, percent)

    return spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "doc_id").mapInArrow(compare, "u bigint, v bigint")


def _forest(held: list[tuple[int, int, np.ndarray]], at: tuple, percent: int) -> pa.RecordBatch:
    """Of a block pair's documents (block, id, set), links that hold between two blocks (or in the one), as a forest."""
    first = held if at[1] == at[2] else [x for x in held if x[0] == at[1]]
    second = held if at[1] == at[2] else [x for x in held if x[0] != at[1]]
    u: list[int] = []
    v: list[int] = []
    if first and second:
        sizes = np.array([len(s) for _, _, s in first])
        values, owner = np.concatenate([s for _, _, s in first]), np.repeat(np.arange(len(first)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        up = {d: d for _, d, _ in held}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for _, d, s in second:
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = hi - lo
            place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[place], minlength=len(first))
            for x in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)):
                a, b = top(first[x][1]), top(d)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    u.append(first[x][1])
                    v.append(d)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
