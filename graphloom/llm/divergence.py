"""Source divergence audit: how the term shares of each language's sources differ from each other, and which terms make it so.

Documents are counted into (lang, term, source) rows. The kept terms of a language are dealt into blocks; a block is a dense
matrix of int64 counts, sources by terms, whose shares are compared for all pairs of sources at once by broadcasting. The
partial pair matrices are summed, and each source's heap of its strongest terms in a block is merged with those of the other blocks.
Languages with more than SOURCES sources are also dealt into blocks of sources, and each pair of such blocks is a tile of its own.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

#: Cells (sources by terms) of a tile on average; sources of a block; cells of one broadcast; distinct (group, term) held by a counting task.
CELLS, SOURCES, BROADCAST, HELD = 1 << 18, 256, 1 << 20, 150_000
#: Shares are counted in parts of SCALE.
SCALE_STEPS, SCALE_DIGITS = 3, 1000
#: A term's bytes: ASCII letters, made small, and all bytes of other characters. What is no part of a term becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, d bigint"
TILE = "lang string, source string, part string, item string, value bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents), summed over as many documents as HELD terms come from; '' stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            terms = [b"", *n]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [pa.array([x] * len(part), pa.string()) for x in (lang, source)] + [pa.array(part, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "d"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, d = groups[lang, source]
            before, found = len(n), terms_of(text.as_py())
            n.update(found)
            d.update(set(found))
            held += len(n) - before
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / (total + 2 * v)), by long division in steps of three digits: exact while total + 2 * v < 2**63 / 1000."""
    whole = total + 2 * v
    q, rest = np.divmod(n + 2, whole)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * SCALE_DIGITS, whole)
        q = q * SCALE_DIGITS + digit
    return q + 1


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of spread over the columns for all pairs of a row of p and a row of q, in slices of columns that bound the broadcast."""
    out, step = np.zeros((len(p), len(q)), np.int64), max(1, BROADCAST // max(1, len(p) * len(q)))
    for at in range(0, p.shape[1], step):
        out += spread(p[:, None, at : at + step], q[None, :, at : at + step]).sum(2)
    return out


def _tile(key: tuple, rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """One tile. Rows: a source's totals (term null), a term's own (source null, n its count in the language), a count (both)."""
    lang, _, i, j = key
    groups, marks = rows[rows["term"].isna()], rows[rows["source"].isna()]
    cells = rows[rows["term"].notna() & rows["source"].notna()]
    if groups.empty:  # no source falls to these two blocks
        return _frame(lang, [])
    groups, marks = groups.sort_values(["side", "source"]), marks.sort_values("term")
    at_group, at_term = pd.Index(groups["source"]), pd.Index(marks["term"])
    v, lang_total = int(groups["v"].iloc[0]), int(groups["lang_total"].iloc[0])
    n = np.zeros((len(groups), len(marks)), np.int64)
    n[at_group.get_indexer(cells["source"]), at_term.get_indexer(cells["term"])] = cells["n"].to_numpy(np.int64)
    p = shares(n, groups["n"].to_numpy(np.int64)[:, None], v) if len(marks) else n
    side = groups["side"].to_numpy()
    a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
    names = groups["source"].to_numpy(object)
    sums = pair_matrix(p[a], p[b])
    x, y = np.indices(sums.shape)
    other = a[x] != b[y]
    one, two, value = names[a[x[other]]], names[b[y[other]]], sums[other]
    if i != j:
        one, two, value = np.r_[one, two], np.r_[two, one], np.r_[value, value]
    found = [(x, "pair", y, int(v)) for x, y, v in zip(one, two, value, strict=True)]
    if i == j and len(marks):
        q = shares(marks["n"].to_numpy(np.int64), np.int64(lang_total), v)
        f, words = spread(p, q[None, :]), marks["term"].to_numpy(object)
        for g in range(len(groups)):
            hits = _strongest(f[g], np.flatnonzero((n[g] > 0) & (p[g] > q)), top)
            best = heapq.nsmallest(top, ((-int(f[g, t]), words[t].encode(), words[t]) for t in hits))
            found += [(names[g], "term", word, -x) for x, _, word in best]
    return _frame(lang, found)


def _frame(lang: str, found: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    texts = {k: np.array(x, object) for k, x in zip(("source", "part", "item"), columns, strict=False)}
    return pd.DataFrame({"lang": np.array([lang] * len(found), object), **texts, "value": np.array(columns[3], np.int64)})


def _strongest(f: np.ndarray, hits: np.ndarray, top: int) -> np.ndarray:
    """Those of hits that may be among the `top` of the largest f: all that reach the last one's value."""
    if len(hits) <= top:
        return hits
    least = np.partition(f[hits], len(hits) - top)[len(hits) - top]
    return hits[f[hits] >= least]


def audit(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: of every (lang, source) its distance to each other source ('pair') and its `top` terms ('term').

    Terms are runs of letters (ASCII ones made small, and all characters beyond ASCII); a language keeps those that `least` of its
    documents hold. Null texts, languages and sources count as ''. Repeated rows count as often as they come, other columns are
    not read, a text of any length is counted whole. A group without terms has pairs, no terms; a language without kept terms has
    pairs of value 0, one of a single source no pairs. An empty table gives no rows. Ranks go by value, then by the item's bytes.
    """
    ship(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source))), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counted = read.mapInArrow(_count, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    known = counted.withColumns({"m": F.sum("n").over(of_term), "_d": F.sum("d").over(of_term), "first": F.col("source") == F.min("source").over(of_term)})
    kept = stored(known.filter((F.col("_d") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "m", "first"))
    real = F.col("term") != ""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if(real & F.col("first")).alias("v"))
    langs = totals.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("_g"))
    langs = langs.select("lang", "v", "lang_total", F.ceil(F.col("_g") / SOURCES).alias("_sides"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") * F.least("_g", F.lit(SOURCES)) / CELLS)).alias("_blocks"))
    side, block = F.pmod(F.xxhash64("source"), F.col("_sides")), F.pmod(F.xxhash64("term"), F.col("_blocks"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda rows, source, term, n: rows.select("lang", "t", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), source.alias("source"), term.alias("term"), n.alias("n"), *(x if x in rows.columns else zero.alias(x) for x in ("side", "v", "lang_total")))
    # a source's totals go to every tile of its block of sources, a term's own row to every tile of its block of terms
    own = totals.drop("v").join(langs, "lang").withColumn("side", side).withColumn("t", F.explode(every("_blocks"))).withColumns({"a": F.col("side"), "b": F.explode(every("_sides"))})
    placed = kept.filter(real).join(langs.drop("v", "lang_total"), "lang").withColumn("t", block)
    marks = placed.filter("first").withColumn("a", F.explode(every("_sides"))).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("_sides") - 1)))
    cells = placed.withColumns({"a": side, "b": F.explode(every("_sides"))})
    tiles = row(own, F.col("source"), none, F.col("n")).unionByName(row(marks, none, F.col("term"), F.col("m"))).unionByName(row(cells, F.col("source"), F.col("term"), F.col("n")))
    # without this the tiles of a language would stay where its joins have put them, in one task
    made = tiles.repartition("lang", "t", "i", "j").groupBy("lang", "t", "i", "j").applyInPandas(lambda key, rows: _tile(key, rows, top), TILE)
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
