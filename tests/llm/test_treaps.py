"""Ranked search with inverted treaps against scoring every document."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from graphloom.llm import registry, treaps

DOCS = "doc_id long, text string, n string, ids string, item_id string, score string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k=50):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, len(w), Counter(w)) for i, w in held if w]
    n_docs, total = len(held), sum(n for _, n, _ in held)
    df = Counter(t for *_, c in held for t in c)
    asked = {}
    for item, text in queries:
        if item is not None:
            asked.setdefault(item, set()).update(words(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, n, c in held:
            m = 50 + 50 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def texts():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"W{x}" if x % 3 else f"é{x}" for x in rng.zipf(1.4, n) % 300)
    docs = [(int(i), say(int(n))) for i, n in enumerate(rng.integers(1, 60, 700))]
    docs += [(10**12, say(9000)), (5000, None), (5001, ""), (5002, "$ !"), (None, docs[3][1]), (None, "w1 w2"), docs[7], docs[7], (8, "w1 W1"), *[(6000 + i, docs[9][1]) for i in range(80)]]
    queries = [(i, say(25)) for i in range(12)] + [(1, "w5 w7"), (20, None), (21, ""), (22, "nowhere"), (None, "w1"), (23, docs[9][1]), (24, "w1 " * 50), (25, docs[700][1])]
    return docs, queries


def write(spark, folder, docs, queries):
    spark.createDataFrame([(*d, "x", "y", "z", "u") for d in docs], DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")


def test_registered_query_equals_scoring_every_document(spark, tmp_path):
    docs, queries = texts()
    write(spark, tmp_path, docs, queries)
    got = [tuple(r) for r in registry.op13_inverted_treaps(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, queries)


def test_blocks_of_queries(spark, tmp_path, monkeypatch):
    docs, queries = texts()
    write(spark, tmp_path, docs[:40], queries)
    monkeypatch.setattr(treaps, "BLOCK_BYTES", 5000)
    got = [tuple(r) for r in treaps.rank(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), k=7).select("item_id", "rank", "doc_id", "score").collect()]
    assert set(got) == brute(docs[:40], queries, 7)


def test_empty_tables(spark, tmp_path):
    docs, queries = texts()
    for name, d, q in (("a", [], queries), ("b", docs[:3], []), ("c", [], [])):
        spark.createDataFrame(d, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(q, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert registry.op13_inverted_treaps(spark, f"{tmp_path}/{name}").count() == 0


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 6 * 200, 700))
    pairs = pairs[pairs // 200 != 4]  # a term without postings
    t = treaps.Treaps(pairs // 200, pairs % 200, rng.integers(1, 9, len(pairs)), 200, 6)
    seen = []

    def walk(x, low, high, most):
        if x < 0:
            return 0
        seen.append(x)
        assert low <= t.doc[x] < high and t.impact[x] <= most
        return 1 + max(walk(t.left[x], low, t.doc[x], t.impact[x]), walk(t.right[x], t.doc[x] + 1, high, t.impact[x]))

    depth = [walk(t.root[k], 0, 200, 9) for k in range(6)]
    assert sorted(seen) == list(range(len(pairs))) and t.root[4] == -1 and max(depth) < 40
    for k in (0, 5):
        for low, high in ((0, 200), (17, 60), (100, 101)):
            inside = (t.term == k) & (t.doc >= low) & (t.doc < high)
            got = t.within(t.root[[k]], np.array([low]), np.array([high]))[0]
            assert (got < 0) == (not inside.any()) and (got < 0 or inside[got] and t.impact[got] == t.impact[inside].max())


@pytest.mark.parametrize(("segment", "docs_each", "leaf", "walk"), [(1 << 19, 1 << 14, 32, 1 << 21), (50, 16, 1, 64), (400, 100, 4, 200), (5000, 1 << 14, 2, 1 << 21)])
def test_segments_intervals_and_chunks_of_any_size(monkeypatch, segment, docs_each, leaf, walk):
    for name, value in (("SEGMENT", segment), ("SEGMENT_DOCS", docs_each), ("LEAF", leaf), ("WALK", walk)):
        monkeypatch.setattr(treaps, name, value)
    docs, queries = texts()
    asked = {}
    for item, text in queries:
        if item is not None and words(text):
            asked.setdefault(item, set()).update(words(text))
    terms = sorted({t.encode() for x in asked.values() for t in x})
    number = {t: i for i, t in enumerate(terms)}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([(t or "").encode() for _, t in docs], pa.binary())], ["doc_id", "text"])
    postings = list(treaps._extract(SimpleNamespace(value=terms))(iter([batch.slice(at, 90) for at in range(0, len(docs), 90)])))
    stats = next(treaps._statistics(len(terms))(iter(postings))).to_pylist()
    df = {r["term"]: r["n"] for r in stats}
    weights = np.array([math.floor(1000 * math.log((2 * df[-1] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))])
    items = sorted(asked)
    listed = [sorted(number[t.encode()] for t in asked[i]) for i in items]
    shared = SimpleNamespace(value=(np.array(items), np.cumsum([0, *map(len, listed)]), np.concatenate(listed), weights, df[-1], df[-2]))
    got = next(treaps._search(shared, 50)(iter(postings))).to_pylist()
    assert {(r["item_id"], r["doc_id"], r["score"]) for r in got} == {(i, d, s) for i, _, d, s in brute(docs, queries)}
