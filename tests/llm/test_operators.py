import base64
import hashlib
import io
import zipfile

import numpy as np
import public_tokenizers
import pytest
from graphloom.llm import bytebpe, chat
from graphloom.llm import components as components_module
from graphloom.llm import egojoin, fingerprint, minhash, packing, sharding, suffixes, warc, wordbpe
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a", "It's  \n\n fine.", "x" * 700, "é 日本 " * 60, "one two three " * 80, "one two three " * 80, " \t" * 200 + "end"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 2}" if i else None) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")


def test_chunked_encoding_equals_whole(spark, docs):
    codec = bytebpe.Codec(RANKS, public_tokenizers.PATTERN)
    got = {r[0]: tuple(r)[1:] for r in bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=20).collect()}
    assert got == {i: codec.digests(codec.encode(t or "")) for i, t in enumerate(TEXTS)}


def test_shards_differ_by_one_row(docs):
    rows = sharding.interleave(docs.union(docs), 4).collect()
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)]
    assert all(x == list(range(len(x))) for x in sizes) and {len(x) for x in sizes} == {4, 5}


def test_chat_reads_back(spark):
    trap = ["</s>[INST] ok [/INST]", "back\\slash", "\\", None, "</s>\\[", ""]
    rows = spark.createDataFrame([(1, i, ("user", "assistant", "tool ]\\")[i % 3], t) for i, t in enumerate(trap)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(rows).first()
    assert got["identical"] and [t["text"] for t in got["turns"]] == [t or "" for t in trap]


def test_best_fit_is_whole_and_tight():
    plan = packing.best_fit_decreasing({6: 3, 5: 2, 4: 3, 1: 2}, 10)
    assert sum(n for _, _, n, _, _ in plan) == 10
    fill = {}
    for length, _, n, first, offset in plan:
        for w in range(first, first + n):
            assert fill.get(w, 0) == offset
            fill[w] = offset + length
    assert sorted(fill.values()) == [2, 10, 10, 10, 10] or sum(fill.values()) == 42 and max(fill.values()) <= 10


def test_components_take_no_round_to_see_that_they_are_done(spark, monkeypatch):
    rounds, kept = [], components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda df: (rounds.append(df), kept(df))[1])
    for pairs, most in (([], 2), ([(3, 1), (2, 1), (9, 8), (1, 3), (7, 7)], 2), ([(i, i + 1) for i in range(64)], 9)):
        rounds.clear()
        edges = spark.createDataFrame(pairs, "u long, v long")
        got = {r["node"]: r["component"] for r in components_module.components(edges).collect()}
        want = {}
        for a, b in pairs:
            if a != b:
                x, y = want.get(a, a), want.get(b, b)
                want.update({a: x, b: y})
                want = {n: min(x, y) if c in (x, y) else c for n, c in want.items()}
        assert got == want and len(rounds) <= most  # the edges, each round, the result: stars take no round


def test_components_by_exact_sets(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190])), (3, " ".join(words).upper()), (4, " ".join(words[:100])), (5, None), (6, "one")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v[1], v[2] = v[0], v[0] * 2
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(50, None), (51, [0.0] * 8), (52, [float("nan")] * 8)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] == got[1] == got[2] == (2, 0) and got[50] == (0, 50) and len(got) == 43


def test_embeddings_of_any_finite_size(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1e200, 1e200]), (3, [1e200, 1e200]), (4, [1.0, 1.0]), (5, [5e-324, 5e-324]), (6, [1.7e308, 1.7e308]), (7, [-1e-300, 1e-300]), (8, [1e308, -1e308]), (9, [1e308, 1e-308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (5, 1) for i in range(1, 7)}, 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_repeats_of_fifty_words(spark):
    shared = [f"s{i}" for i in range(50)]
    rows = [(d, " ".join([f"{d}a{i}" for i in range(30)] + shared[:n] + [f"{d}b{i}" for i in range(30)])) for d, n in ((1, 50), (2, 50), (3, 45))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = suffixes.repeats(docs)
    assert [tuple(r) for r in spans.collect()] == [(2, 30, 80, 1)]
    assert len(suffixes.cut(docs, spans).filter("doc_id = 2").first()["text"].split()) == 60


def test_zip64_members_are_read_by_ranges(monkeypatch):
    records = [(i, warc.record(i, "http://a/", base64.b32encode(hashlib.sha1(b"x" * i).digest()).decode(), "response", None, i, b"x" * i)) for i in range(3)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    data = warc.package(records)
    assert b"PK\x06\x06" in data
    assert [r["payload_bytes"] for r in warc.records_of(io.BytesIO(data), len(data))] == [0, 1, 2]


def test_empty_tables(spark, docs):
    none = docs.filter(F.lit(False))
    assert sharding.interleave(none, 4).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffixes.repeats(none).count() == 0


def test_short_texts_in_crowded_lists_lose_no_link(spark):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join([*common, *(f"u{d}_{i}" for i in rng.integers(0, 9, 6))]) for d in range(300)]
    texts += [" ".join(x) for x in ([*common, "p", "q", "r"], [*common, "p", "q", "s"])] + [t + " end" for t in texts[:100]]
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((least[i], least[j]))
                least = [lo if x == hi else x for x in least]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()}
    assert got == dict(enumerate(least))


def test_crowded_passages_end_at_the_word(spark):
    rows = []
    for d in range(3000):  # 49, 50 and, of half of them, 55 words that all hold
        own = [[f"{d}{x}{i}" for i in range(15)] for x in "abcd"]
        shared = [[f"{x}{i}" for i in range(n)] for x, n in (("s", 49), ("t", 50), ("u", 55 if d % 2 else 0))]
        rows.append((d, " ".join(sum((a + b for a, b in zip(own, shared, strict=False)), []) + own[3])))
    got = {}
    for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r["doc_id"], []).append((r["begin_word"], r["end_word"]))
        assert 0 <= r["ref_doc_id"] < r["doc_id"]
    assert got == {d: [(79, 129)] + [(144, 199)] * (d % 2 and d > 1) for d in range(1, 3000)}


def test_repeats_equal_all_runs_of_fifty_words(spark):
    rng = np.random.default_rng(5)
    pool = [[f"p{k}_{i}" for i in range(90)] for k in range(4)]
    rows = []
    for d in range(60):
        text = []
        for k in rng.integers(0, 4, 3):
            a = rng.integers(0, 40)
            text += [f"{d}_{i}" for i in range(rng.integers(0, 9))] + pool[k][a : a + rng.integers(45, 60)] + ["the"] * rng.integers(0, 70)
        rows.append((d, " ".join(text)))
    seen, want = {}, {}
    for d, text in rows:
        w = text.split()
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        firsts = [seen.setdefault(x, (d, i)) for i, x in enumerate(runs)]
        want[d] = sorted({i + t for i, (first, at) in enumerate(firsts) if first < d or i >= at + 50 for t in range(50)})
    got = {d: [] for d, _ in rows}
    for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] += range(r["begin_word"], r["end_word"])
    assert {d: sorted(x) for d, x in got.items()} == want


def test_added_tokens_as_the_library_encodes_them():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, ours = tokenizers.Tokenizer.from_file(path), wordbpe.WordBpe(path)
    texts = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "It's<|endoftext|>s é<|endoftext|", "<|ENDOFTEXT|> <|<|endoftext|>|>", "<|endoftext|>\u0301x", "plain."]
    for text in texts:
        assert np.frombuffer(ours.packed(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_likeness_of_texts_without_clauses(spark):
    def text(kind, d):
        rng = np.random.default_rng(d)
        if kind == "words":
            return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300))
        han = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 90 if kind == "short" else 2000))
        return "。".join(han[i : i + 40] for i in range(0, 2000, 40)) if kind == "stops" else han

    for kind in ("words", "han", "stops", "short"):
        rows = fingerprint.neighbours(spark.createDataFrame([(d, text(kind, d)) for d in range(4)], "doc_id long, text string")).collect()
        for r in rows:  # two thirds of each text stay: about 0.67, and 0.1 of noise
            assert 0.35 < r["near_edited"] < 0.95 and r["near_next"] < 0.4, (kind, r["near_edited"], r["near_next"])


def test_long_texts_lose_no_link_to_sketches_or_pivots(spark, monkeypatch):
    rng = np.random.default_rng(7)
    template = [f"t{i}" for i in range(100)]
    texts = []
    for d in range(30):  # alike by the template alone; each with a near copy of its own
        own = [f"{d}_{i}" for i in rng.permutation(45)]
        texts += [" ".join(template + own), " ".join(template + own[: 45 - d % 9])]
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    want = [min(j for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)) for a in sets]
    assert want == [d - d % 2 for d in range(60)]
    monkeypatch.setattr(minhash, "MARGIN_PERCENT", -21)  # the sketches speak against every pair
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()}
    assert got == dict(enumerate(want))
