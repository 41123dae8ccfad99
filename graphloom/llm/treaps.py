"""Ranked lexical search with inverted treaps: each term's postings are a search tree by document and a heap by impact.

The terms of the queries are counted in every document, once, into a compact table. A task reads its share of that table in
segments of bounded size and builds a treap for each term: the postings in the order of documents, each node's impact no less
than those below it, so that a subtree's root is the best of its interval of documents. A query walks the treaps of all its
terms together: where the summed maxima of an interval cannot reach the query's best k so far, the interval is skipped; else the
document of the highest root is scored, and the interval is split there. Short intervals are scored whole. All queries walk at
once, in arrays, and the scores that a task has found in earlier segments prune the later ones.

Queries go in blocks whose words have a bounded size, so that what every task holds of them does not grow with their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, ship, stored

#: Bytes of the terms of a block of queries; postings and documents of a segment; documents scored whole; nodes walked at once.
BLOCK_BYTES, SEGMENT, SEGMENT_DOCS, LEAF, WALK = 4 << 20, 1 << 19, 1 << 14, 32, 1 << 21
#: Groups of tasks whose best are merged before those of all are.
MERGES = 64
#: A term's bytes: digits, ASCII letters, made small, and all bytes of other characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = "doc_id bigint, n bigint, ids array<int>, tfs array<int>"
HITS = "item_id bigint, doc_id bigint, score bigint"
INT = np.int64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t) for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in set(terms_of(x.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])


def _extract(known) -> object:
    """Documents to (doc_id, n, ids and frequencies of the known terms), without those that have no term at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}.get
        for batch in batches:
            ids, ns, sizes, terms, counts = [], [], [0], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                held = Counter(map(number, words))
                held.pop(None, None)
                ids.append(i)
                ns.append(len(words))
                terms += (found := sorted(held))
                counts += map(held.__getitem__, found)
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    return run


def _statistics(n_terms: int) -> object:
    """Postings to (term, documents that hold it), and the number of documents as term -1, of their terms as -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(n_terms, INT), 0, 0
        for batch in batches:
            df += np.bincount(_flat(batch.column("ids")), minlength=n_terms)
            docs, words = docs + batch.num_rows, words + int(batch.column("n").to_numpy().sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[held, -1, -2], pa.int32()), pa.array(np.r_[df[held], docs, words], pa.int64())], ["term", "n"])

    return run


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


class Treaps:
    """One treap for each term over a segment's postings (term, document number, impact).

    Nodes are positions in arrays in the order of terms and documents. Equal impacts are ordered by a mixed document number, so that
    runs of them do not make a tree deep.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.argsort(terms.astype(INT) * n_docs + docs, kind="stable")
        self.n_docs, self.term, self.doc, self.impact = n_docs, terms[order].astype(INT), docs[order].astype(INT), impacts[order]
        self.key = self.term * n_docs + self.doc
        n = len(order)
        mixed = (self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        priority = np.empty(n, INT)
        priority[np.lexsort((mixed, self.impact))] = np.arange(n)
        # a wall stands before and after each term's nodes: no ancestor is sought beyond it
        at = np.arange(n) + self.term + 1
        size = n + n_terms + 2
        p = np.full(size, n, INT)
        p[at] = priority
        sides = []
        for step in (-1, 1):
            near = np.arange(size)
            near[at] += step
            open_ = at
            while len(open_):
                open_ = open_[p[near[open_]] < p[open_]]
                near[open_] = near[near[open_]]
            sides.append(near[at])
        walls = np.full(size, -1, INT)
        walls[at] = np.arange(n)
        before, after = walls[sides[0]], walls[sides[1]]  # the next greater nodes, or -1
        low, high = np.where(before >= 0, priority[before], n), np.where(after >= 0, priority[after], n)
        self.left, self.right, self.root = np.full(n, -1, INT), np.full(n, -1, INT), np.full(n_terms, -1, INT)
        node = np.arange(n)
        from_left, from_right, top = (before >= 0) & (low < high), (after >= 0) & (high < low), (before < 0) & (after < 0)
        self.right[before[from_left]] = node[from_left]
        self.left[after[from_right]] = node[from_right]
        self.root[self.term[top]] = node[top]

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node at or below each that lies in low <= document < high, or -1."""
        nodes = nodes.copy()
        open_ = np.arange(len(nodes))
        while True:
            open_ = open_[nodes[open_] >= 0]
            doc = self.doc[nodes[open_]]
            less, more = doc < low[open_], doc >= high[open_]
            nodes[open_] = np.where(less, self.right[nodes[open_]], np.where(more, self.left[nodes[open_]], nodes[open_]))
            open_ = open_[less | more]
            if not len(open_):
                return nodes

    def between(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one after the last node of each term's documents from low to high (excluded)."""
        return np.searchsorted(self.key, terms * self.n_docs + low), np.searchsorted(self.key, terms * self.n_docs + high)


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the number of the range each is from."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), owner


class Best:
    """The k best (score, document) of each query so far; equal scores by ascending id, null ids last."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.least = k, np.ones(n_queries, INT)
        self.query, self.score, self.id, self.null = np.zeros(0, INT), np.zeros(0, INT), np.zeros(0, INT), np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least[query]
        if not good.any():
            return
        q, s, i, null = (np.r_[a, b[good]] for a, b in ((self.query, query), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, null, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.query, self.score, self.id, self.null = q[place < self.k], s[keep], i[keep], null[keep]
        last = place[place < self.k] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def search(treaps: Treaps, offsets: np.ndarray, terms: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Adds to best what the queries find. offsets, terms: each query's terms, one after the other. ids, null: those of the documents."""
    begin = 0
    budget = max(1, WALK * LEAF // max(LEAF, treaps.n_docs))  # terms whose treaps may be walked at once
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + budget, "right")) - 1)
        nodes, query = treaps.root[terms[offsets[begin] : offsets[end]]], np.repeat(np.arange(begin, end), np.diff(offsets[begin : end + 1]))
        _walk(treaps, query[nodes >= 0], nodes[nodes >= 0], ids, null, best)
        begin = end


def _walk(treaps: Treaps, state: np.ndarray, nodes: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """state: for each node the interval that it is the root of, in order; at first an interval is a query's whole segment."""
    query, state = np.unique(state, return_inverse=True)
    low, high = np.zeros(len(query), INT), np.full(len(query), treaps.n_docs, INT)
    while len(nodes):
        # intervals whose summed maxima reach their query's least score
        first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        bound = np.add.reduceat(treaps.impact[nodes], first)
        alive = np.zeros(len(query), bool)
        alive[state[first]] = bound >= best.least[query[state[first]]]
        short = alive & (high - low <= LEAF)
        _score_whole(treaps, state, nodes, short, query, low, high, ids, null, best)
        alive &= ~short
        nodes, state = nodes[alive[state]], state[alive[state]]
        if not len(nodes):
            return
        kept = np.flatnonzero(alive)
        state = (np.cumsum(alive) - 1)[state]
        query, low, high = query[kept], low[kept], high[kept]
        # the document of the highest root of each is scored, and the interval is split there
        order = np.lexsort((-treaps.impact[nodes], state))
        pivot = treaps.doc[nodes[order[np.flatnonzero(np.r_[True, state[order][1:] != state[order][:-1]])]]]
        wanted = treaps.term[nodes] * treaps.n_docs + pivot[state]
        found = np.minimum(np.searchsorted(treaps.key, wanted), len(treaps.key) - 1)
        score = np.zeros(len(query), INT)
        np.add.at(score, state, np.where(treaps.key[found] == wanted, treaps.impact[found], 0))
        best.add(query, score, ids[pivot], null[pivot])
        before, after = treaps.within(nodes, low[state], pivot[state]), treaps.within(nodes, pivot[state] + 1, high[state])
        states, all_nodes = np.r_[2 * state[before >= 0], 2 * state[after >= 0] + 1], np.r_[before[before >= 0], after[after >= 0]]
        order = np.argsort(states, kind="stable")
        nodes, state = all_nodes[order], states[order]
        query, low, high = np.repeat(query, 2), np.column_stack([low, pivot + 1]).ravel(), np.column_stack([pivot, high]).ravel()


def _score_whole(treaps: Treaps, state: np.ndarray, nodes: np.ndarray, short: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Scores all documents of the short intervals."""
    at = short[state]
    if not at.any():
        return
    state, nodes = state[at], nodes[at]
    place, owner = _spread(*treaps.between(treaps.term[nodes], low[state], high[state]))
    cell = state[owner] * LEAF + treaps.doc[place] - low[state[owner]]
    cells, to = np.unique(cell, return_inverse=True)
    score = np.zeros(len(cells), INT)
    np.add.at(score, to, treaps.impact[place])
    doc = cells % LEAF + low[cells // LEAF]
    best.add(query[cells // LEAF], score, ids[doc], null[doc])


def _search(shared, k: int) -> object:
    """Postings to the k best documents of each query among those of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, offsets, terms, weights, n_docs, n_words = shared.value
        best, held, size = Best(len(items), k), [], 0

        def segment(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, null = table["doc_id"].fill_null(np.iinfo(INT).max).to_numpy(), table["doc_id"].is_null().to_numpy()
            order = np.lexsort((ids, null))
            place = np.empty(len(order), INT)
            place[order] = np.arange(len(order))
            sizes = table["ids"].combine_chunks().value_lengths().to_numpy()
            term, tf = _flat(table["ids"].combine_chunks()), _flat(table["tfs"].combine_chunks()).astype(INT)
            m = 50 + 50 * table["n"].to_numpy() * n_docs // n_words
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)))
            good = impact > 0
            if good.any():
                treaps = Treaps(term[good], np.repeat(place, sizes)[good], impact[good], len(order), len(weights))
                search(treaps, offsets, terms, ids[order], null[order], best)

        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_DOCS):
                part = batch.slice(at, SEGMENT_DOCS)
                held.append(part)
                size += len(_flat(part.column("ids"))) + part.num_rows * SEGMENT // SEGMENT_DOCS
                if size >= SEGMENT:
                    segment(held)
                    held, size = [], 0
        if held:
            segment(held)
        doc_id = pa.array(best.id, pa.int64(), mask=best.null)
        yield pa.RecordBatch.from_arrays([pa.array(items[best.query], pa.int64()), doc_id, pa.array(best.score, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """items (item_id, term) with the number of their block, and how many: a block holds BLOCK_BYTES of terms at most, or one item."""
    sizes = items.groupBy("item_id").agg(F.sum(F.octet_length("term") + 64).alias("b"))
    total, n = sizes.agg(F.sum("b")).first()[0] or 0, 1
    if total > BLOCK_BYTES:
        n = 2 * math.ceil(total / BLOCK_BYTES)
        for _ in range(20):
            numbered = sizes.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("k")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("c"))
            if numbered.filter((F.col("b") > BLOCK_BYTES) & (F.col("c") > 1)).isEmpty():
                break
            n *= 2
    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n))), n


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, of score over 0, equal ones by ascending id.

    A term is a run of ASCII letters and digits (letters made small) and of any characters beyond ASCII. Its weight is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document scores weight * (10**9 * tf div (1000 * tf + 20 * m)) for each term of
    the query, m = 50 + (50 * n * N) div L, in 64-bit integers: exact while 50 * n * N < 2**63. N, L: documents with a term, their
    terms; n: the document's. Null and empty texts have no terms: they are not ranked and find nothing. Queries of one item_id
    are one query; those of a null item_id none. Documents of a null id are counted and ranked, last among equal scores; repeated
    rows and rows of one id are documents each. Other columns are not read; texts of any length count whole. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = queries.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(query_col, F.lit("")).cast("binary").alias("text"))
    items = stored(asked.mapInArrow(_item_terms, "item_id bigint, term binary").distinct())
    items, n_blocks = _blocks(items)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    found = [x for x in (_block(read, items.filter(F.col("block") == b), k) for b in range(n_blocks)) if x is not None]
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """rank() of one block of queries, whose terms are of a bounded size and so may be sent to all tasks."""
    sc = docs.sparkSession.sparkContext
    pairs = sorted((r["item_id"], bytes(r["term"])) for r in items.select("item_id", "term").collect())
    if not pairs:
        return None
    terms = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(terms)}
    known = sc.broadcast(terms)
    postings = stored(docs.mapInArrow(_extract(known), POSTINGS))
    counted = {r["term"]: r["n"] for r in postings.mapInArrow(_statistics(len(terms)), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_words = counted.get(-1, 0), counted.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(i, 0) + 1))) for i in range(len(terms))], INT)
    names, offsets = np.unique(np.array([i for i, _ in pairs], INT), return_index=True)
    shared = sc.broadcast((names, np.r_[offsets, len(pairs)].astype(INT), np.array([number[t] for _, t in pairs], INT), weights, n_docs, n_words))
    hits = postings.mapInArrow(_search(shared, k), HITS).withColumn("_m", F.spark_partition_id() % MERGES)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", "_m"], ["item_id"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    out = stored(hits.select("item_id", "rank", "doc_id", "score"))
    release(postings)
    for x in (known, shared):
        x.unpersist()
    return out
