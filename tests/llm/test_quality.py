"""Quality rules against plain Python, n-gram hashes included."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from graphloom.llm import quality, registry

SCHEMA = "doc_id long, text string, _w string, llr string, bucket string, weights string"
M = 1 << 64


def signed(x):
    return x - M if x >= M >> 1 else x


def grams(words):
    """Hashes of the words, and of each with the next."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=seed)
    return h + [long(b, long(a, 42)) for a, b in zip(h, h[1:])] + [long(a, 42) for a in h[-1:]]  # noqa: B905


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(runs)
    inside = {i + k for i, r in enumerate(runs) if many[r] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words), words


def brute(docs, good):
    hashed = [[signed(x) % quality.BUCKETS for x in grams(base(t)[-1])] for _, t in docs]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(docs, hashed, strict=True):
        raw.update(g)
        if i is not None and i in good:
            target.update(g)
    r, t = sum(raw.values()), sum(target.values())
    weight = {b: math.floor(quality.SCALE * math.log((float(target[b]) * r / raw[b] + quality.PRIOR) / (t + quality.PRIOR))) for b in raw}
    out = []
    for (i, text), g in zip(docs, hashed, strict=True):
        *measures, failed, _ = base(text)
        out.append((i, *measures, failed, not failed and 100 * sum(weight[b] for b in g) >= quality.THRESHOLD_PERCENT * quality.SCALE * len(g)))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("quality"))
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 500)
    junk = lambda n: " ".join(f"w{x}$$$ |" for x in rng.zipf(1.3, n) % 500)
    docs = [(i, say(int(n)) if i % 4 else junk(int(n))) for i, n in enumerate(rng.integers(8, 90, 200))]
    docs += [(300, None), (301, ""), (302, " \t\x0b\f\r\n"), (None, say(40)), (None, None), docs[5], docs[5], (5, say(30)), (303, say(9000)), (304, "a b c d e " * 400)]
    docs += [(305, "x y\nx y\n \n\nx y\r\nx y z q r s t u v w"), (306, "一 二 三 é ü # $ % & < > | * 四 五\xa0六"), (307, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z aa bb"), (308, "a a a a a a a a a a a a")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(1, 1, 1), (3, None, None), (7, 1, None), (None, 1, 0), (7, 1, 0), (999, 1, 0)]
    spark.createDataFrame([(*d, "x", "y", "z", "q") for d in docs], SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, {i for i, q, toxic in labels if i is not None and q == 1 and not toxic}


def read(rows):
    return sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rows.collect()), key=str)


def test_equals_plain_python(spark, tables):
    folder, docs, good = tables
    got = read(registry.op12_likelihood_ratio(spark, folder))
    assert got == sorted(brute(docs, good), key=str)


def test_junk_goes_and_clean_texts_stay(spark):
    rng = np.random.default_rng(6)
    say = lambda n, junk: " ".join(f"w{x}$$$ |" if junk else f"w{x}" for x in rng.zipf(1.3, n) % 500)
    docs = [(i, say(int(n), i % 4 == 0)) for i, n in enumerate(rng.integers(20, 400, 600))]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 600, 3)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string"), quality.trusted(labels)).collect() if not r["base_failed"]}
    assert sum(not r["kept"] for i, r in got.items() if i % 4 == 0) > 0.9 * sum(i % 4 == 0 for i in got)
    assert all(r["kept"] for i, r in got.items() if i % 4)


def test_trusted_documents_are_bounded(spark, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] * 2, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "TRUSTED", 7)
    want = sorted(range(50), key=lambda i: signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42)))[:7]
    assert sorted(r["doc_id"] for r in quality.trusted(labels).collect()) == sorted(want)


def test_without_trusted_documents_the_base_rules_decide(spark, tables):
    rows = spark.read.parquet(f"{tables[0]}/documents.parquet")
    got = quality.judge(rows, quality.trusted(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got.filter("kept = base_failed").isEmpty() and got.count() == len(tables[1])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.op12_likelihood_ratio(spark, str(tmp_path)).count() == 0
