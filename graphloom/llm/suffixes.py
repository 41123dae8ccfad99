"""Repeated passages by a sparse suffix array over words.

Of the suffixes that begin at any word, only those at minimiser positions are retained: where the hash of BASE words is the least
of WINDOW neighbouring ones. Every run of MIN_WORDS = BASE + WINDOW - 1 words belongs to the one retained suffix that is its
minimiser, and two equal runs have theirs at the same place. Retained suffixes are sorted by their first BASE words; each
carries a 64-bit hash of every whole run of MIN_WORDS words that belongs to it, so runs are equal if both hashes are (128 bits):
a passage is as long as the equal runs reach, to the word, however many documents hold it.

Runs that an earlier place in the same group of texts holds too are settled before the shuffle, so a passage that a
third of all documents hold sends one row per group, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .wordhash import mix, ranges, words

BASE, WINDOW = 40, 11
MIN_WORDS = BASE + WINDOW - 1
SUFFIX = "g bigint, doc_id bigint, begin_word bigint, runs binary"
SPAN = "doc_id bigint, begin_word bigint, end_word bigint, ref_doc_id bigint"
#: Sorted suffixes that a worker takes at once, or one group of equal ones.
ROWS_AT_ONCE = 50_000
#: Runs that a worker compares at once before the shuffle: some 6 MB of text.
RUNS_AT_ONCE = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each place on (len(h) - size + 1 of them), by doubling."""
    have, out, at = {1: h}, None, 0
    n = 1
    while 2 * n <= size:
        x = have[n]
        have[2 * n] = mix(x[: len(x) - n] * _P + x[n:])
        n *= 2
    for n in sorted(have, reverse=True):
        if size & n:
            x = have[n]
            if out is None:
                out = x
            else:
                m = min(len(out), len(x) - at)
                out = mix(out[:m] * _P + x[at : at + m])
            at += n
    return out[: max(len(h) - size + 1, 0)]


def retained(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(g, run, text index, word position) of every run of MIN_WORDS words, in order: its suffix's BASE words, its own hash."""
    h, _, _, doc, _ = words(texts)
    starts = len(h) - MIN_WORDS + 1
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    inside = np.flatnonzero(np.arange(starts) + MIN_WORDS <= bounds[doc[:starts] + 1]) if starts > 0 else np.zeros(0, np.int64)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), inside, inside
    g = _gram_hashes(h, BASE)
    view = sliding_window_view(g, WINDOW)
    at = np.concatenate([i + view[i].argmin(1) for i in np.array_split(inside, -(-len(inside) // 200_000))])
    run = mix(g[inside] * _P + _gram_hashes(h, MIN_WORDS - BASE)[inside + BASE])
    return g[at].view(np.int64), run, doc[inside], inside - bounds[doc[inside]]


def _first_place(order: np.ndarray, new: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, the least (document, place) of those equal to it; whether it repeats that one.

    order brings equal runs together, by document and place; new marks the first of each. A run that overlaps its first place
    does not repeat it, so that the first place stays whole.
    """
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    least, repeated = np.empty(len(doc), np.int64), np.empty(len(doc), bool)
    least[order] = doc[first]
    repeated[order] = (doc[first] < doc[order]) | (begin[order] >= begin[first] + MIN_WORDS)
    return least, repeated


def _joined(doc: np.ndarray, begin: np.ndarray, ref: np.ndarray) -> list[np.ndarray]:
    """SPAN columns of runs, given in order; those of one text that touch become one span."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 4
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + MIN_WORDS) | (begin[1:] <= begin[:-1])])
    last = np.r_[first[1:], len(doc)] - 1
    return [doc[first], begin[first], begin[last] + MIN_WORDS, np.minimum.reduceat(ref, first)]


def matched(g: np.ndarray, doc: np.ndarray, begin: np.ndarray, n: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """SPAN columns of what suffixes, sorted by g, repeat of earlier places. n: how many of run each has, from begin on."""
    same = g[1:] == g[:-1]
    often = np.r_[False, same] | np.r_[same, False]
    run = run[np.repeat(often, n)]
    g, doc, begin, n = g[often], doc[often], begin[often], n[often]
    if not len(g):
        return [np.zeros(0, np.int64)] * 4
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(run))
    g, doc = np.repeat(g, n), np.repeat(doc, n)
    order = np.lexsort((at, doc, run, g))
    new = np.r_[True, (g[order][1:] != g[order][:-1]) | (run[order][1:] != run[order][:-1])]
    least, repeated = _first_place(order, new, doc, at)
    hit = np.flatnonzero(repeated)
    return _joined(doc[hit], at[hit], least[hit])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SPAN: the runs of MIN_WORDS words or more that a document of smaller id, or an earlier place of the same one, holds too.

    Words are runs of anything but ASCII white space, compared as they are; begin_word counts from 0, end_word is behind the last;
    ref_doc_id is one document that holds part or all of it before: of smaller id, or this one. So the place that comes first, by
    id and then by position, keeps a passage, and keeps it whole: what overlaps its own first place is no repeat. Rows with
    one id are one document. Null ids, null texts and texts of fewer than MIN_WORDS words have no repeats. Ties: equal rows of one
    id do not repeat each other. Texts of any length are whole. An empty table gives no rows.
    """
    ship(docs.sparkSession)

    names = ["g", "doc_id", "begin_word", "runs", "end_word", "ref_doc_id"]

    def rows_of(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The first holder of each run goes on (no ref); where another holds it too, its span is settled."""
        g, run, doc, begin = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((begin, doc, run))
        new = np.r_[True, run[order][1:] != run[order][:-1]]
        least, repeated = _first_place(order, new, doc, begin)
        hit = np.flatnonzero(repeated)
        spans = [pa.array(x, pa.int64()) for x in _joined(doc[hit], begin[hit], least[hit])]
        if len(spans[0]):
            none = len(spans[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), spans[0], spans[1], pa.nulls(none, pa.binary()), spans[2], spans[3]], names)
        on = np.flatnonzero(~repeated)
        g, run, doc, begin = (x[on] for x in (g, run, doc, begin))
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1] + 1)])
        ends = np.r_[first[1:], len(g)]
        for part in np.array_split(np.arange(len(first)), -(-len(first) // 50_000)):
            lo, hi = first[part[0]], ends[part[-1]]
            offsets = (np.r_[first[part], hi] - lo) * 8
            runs = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(run[lo:hi].tobytes())])
            open_ = [pa.array(x[first[part]], pa.int64()) for x in (g, doc, begin)]
            yield pa.RecordBatch.from_arrays([*open_, runs, pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())], names)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = np.asarray(batch.column(0).to_pylist(), np.int64)
            texts = batch.column(1).to_pylist()
            for i, j in ranges(texts):
                g, run, doc, begin = retained(texts[i:j])
                if len(g):
                    held.append((g, run, ids[i + doc], begin))
                if sum(len(x[0]) for x in held) >= RUNS_AT_ONCE:
                    yield from rows_of(held)
        if held:
            yield from rows_of(held)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def spans(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in matched(*x)], ["doc_id", "begin_word", "end_word", "ref_doc_id"])

        for batch in batches:
            # what a task before has settled passes through
            settled = batch.filter(pa.compute.is_valid(batch.column(5)))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column(i) for i in (1, 2, 4, 5)], ["doc_id", "begin_word", "end_word", "ref_doc_id"])
            open_ = batch.filter(pa.compute.is_null(batch.column(5)))
            if not open_.num_rows:
                continue
            n = pa.compute.binary_length(open_.column(3)).to_numpy().astype(np.int64) // 8
            held.append((*(open_.column(i).to_numpy() for i in range(3)), n, np.frombuffer(b"".join(open_.column(3).to_pylist()), np.uint64)))
            if sum(len(y[0]) for y in held) < ROWS_AT_ONCE:
                continue
            g = held[-1][0]
            if g[0] != g[-1] or (len(held) > 1 and held[0][0][0] != g[-1]):  # all but the last group are complete
                x = tuple(np.concatenate(y) for y in zip(*held, strict=True))
                done = np.searchsorted(x[0], x[0][-1], "left")
                runs = x[3][:done].sum()
                yield spans((*(y[:done] for y in x[:4]), x[4][:runs]))
                held = [(*(y[done:] for y in x[:4]), x[4][runs:])]
        if held:
            yield spans(tuple(np.concatenate(y) for y in zip(*held, strict=True)))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list[int] | None = None
        for batch in batches:
            out: list[list[int]] = []
            for doc, begin, end, ref in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at and at[0] == doc and begin <= at[2]:
                    at[2], at[3] = max(at[2], end), min(at[3], ref)
                else:
                    if at:
                        out.append(at)
                    at = [doc, begin, end, ref]
            yield _spans(out)
        if at:
            yield _spans([at])

    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sparse = rows.mapInArrow(suffixes, f"{SUFFIX}, end_word bigint, ref_doc_id bigint")
    known = F.col("ref_doc_id").isNotNull()
    # settled rows go to their document's place at once, the others to their suffix's
    found = sparse.repartition(F.when(known, F.xxhash64("doc_id")).otherwise(F.col("g"))).sortWithinPartitions("g").mapInArrow(neighbours, SPAN)
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "begin_word", "end_word", "ref_doc_id").mapInArrow(union, SPAN)


def _spans(rows: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "begin_word", "end_word", "ref_doc_id"])


def cut(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts lack the words of their spans, and the white space after them; other columns, of any name, pass through.

    Rows with a null id or text, and those without spans, stay as they are. A text that loses all its words becomes empty.
    """
    ship(docs.sparkSession)
    key, made = _free("_doc", docs.columns), _free("_spans", docs.columns)
    held = spans.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("begin_word", "end_word"))).alias(made))
    place = docs.columns.index(text_col)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            hit = pa.compute.and_(pa.compute.is_valid(batch.columns[-1]), pa.compute.is_valid(columns[place]))
            if pa.compute.any(hit).as_py():
                texts, cuts = columns[place].filter(hit).to_pylist(), batch.columns[-1].filter(hit).to_pylist()
                new = pa.array([_without(t, [(x["begin_word"], x["end_word"]) for x in c]) for t, c in zip(texts, cuts, strict=True)], columns[place].type)
                columns[place] = pa.compute.replace_with_mask(columns[place], hit, new)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    joined = docs.join(held, docs[id_col] == held[key], "left").select(*docs.columns, made)
    return joined.mapInArrow(without, docs.schema)


def _free(name: str, taken: list[str]) -> str:
    """name, with as many underscores as it takes to differ from all taken (column names, in any case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    _, begin, _, _, joined = words([text])
    out, at, starts = [], 0, np.r_[begin, len(joined)]
    for a, b in spans:
        out.append(joined[at : starts[a]])
        at = starts[b]
    return (b"".join(out) + joined[at:]).decode().rstrip(" \t\n\r\v\f")
