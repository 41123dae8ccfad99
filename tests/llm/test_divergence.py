"""The source divergence audit against plain counting, on tiles as small as can be."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphloom.llm import divergence, registry

SCHEMA = "doc_id long, text string, lang string, source string, n string, side string, item string"


def brute(rows, least=10, top=10):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    n, of_lang, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in terms:
        groups[lang].add(source)
        n[lang, source].update(found)
        of_lang[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, d in docs[lang].items() if d >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, own = {s: share(n[lang, s]) for s in sources}, share(of_lang[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            best = sorted((-f(p[s][t], own[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and p[s][t] > own[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", best)) for k, (v, item) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Äh", "日本", "The", "tie", "eit"]
    rows = [(" ".join(rng.choice(words[int(s) :: 2], 12)), ["en", "de", None][i % 3], f"s{s}" if s else None) for i, s in enumerate(rng.integers(0, 7, 300))]
    rows += [(None, "en", "bare"), ("", "fr", "only"), ("few words", "es", "a"), ("few words", "es", "b"), ("x1y2 " * 4000, "en", "s1"), *rows[:20]]
    return rows


@pytest.mark.parametrize(("sources", "cells"), [(256, 1 << 18), (2, 16), (1, 1)])
def test_equals_plain_counting(spark, docs, monkeypatch, sources, cells):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(docs)], SCHEMA)
    got = [tuple(r) for r in divergence.audit(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs)


def test_counting_tasks_flush_what_they_hold(spark, docs, monkeypatch):
    batch = spark.createDataFrame([(a or "", b or "", t or "") for t, a, b in docs], "lang string, source string, text string").selectExpr("lang", "source", "cast(text as binary) text").toArrow().to_batches()
    whole = sum((Counter({k[:3]: k[3] for k in zip(*(c.to_pylist() for c in x.columns), strict=True)}) for x in divergence._count(iter(batch))), Counter())
    monkeypatch.setattr(divergence, "HELD", 5)
    parts = sum((Counter({k[:3]: k[3] for k in zip(*(c.to_pylist() for c in x.columns), strict=True)}) for x in divergence._count(iter(batch))), Counter())
    assert parts == whole


def test_shares_and_pairs_are_exact():
    n, total, v = np.array([0, 5, 10**12], np.int64), np.int64(2 * 10**12), 7
    assert divergence.shares(n, total, v).tolist() == [1 + 10**9 * (int(x) + 2) // (int(total) + 14) for x in n]
    p, q = np.array([[3, 10**9], [5, 1]], np.int64), np.array([[4, 1]], np.int64)
    assert divergence.pair_matrix(p, q).tolist() == [[sum((a - b) ** 2 // (a + b) for a, b in zip(map(int, x), map(int, q[0]), strict=True))] for x in p]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.op11_term_blocks(spark, str(tmp_path)).count() == 0
