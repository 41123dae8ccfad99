"""Results that can be proved apart: forward-backward by all label paths, byte-level BPE by the tokeniser library itself."""

import base64
import hashlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from graphloom.llm import langid, registry

EN, DE, FR = "the quick brown fox and the lazy dog were there", "der schnelle braune fuchs und der faule hund", "le renard brun et le chien paresseux sont la"


@pytest.fixture(scope="module")
def crf():
    return langid.Crf.train([EN, DE, FR] * 15, ["en", "de", "fr"] * 15)


def test_marginals_equal_the_sums_over_all_paths(crf):
    w = langid.Words(["quick hund le the fuchs brun", "der dog"])
    got, pairs = crf.marginals(w, pairs=True)
    e, k = crf.emissions(w).astype(np.float64), len(crf.labels)
    want, both = np.zeros_like(got), np.zeros((k, k))
    for at, n in zip(w.chain_at, w.chain_n, strict=True):
        paths = list(product(range(k), repeat=int(n)))
        scores = np.array([sum(e[at + i, y] for i, y in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        weight = np.exp(scores - scores.max())
        weight /= weight.sum()
        for p, x in zip(paths, weight, strict=True):
            for i, y in enumerate(p):
                want[at + i, y] += x
            for a, b in zip(p, p[1:], strict=False):
                both[a, b] += x
    assert np.allclose(got, want, atol=1e-5) and np.allclose(pairs, both, atol=1e-5)


def test_equal_labels_go_to_the_first_by_name(crf):
    flat = langid.Crf(["a", "b"])  # nothing learned: all labels are alike
    assert flat.predict(["some words"]) == (["a"], [0.5]) and crf.predict([None, "", "12 $"]) == (["und"] * 3, [0.0] * 3)


def test_registered_encoding_equals_the_library(spark, tmp_path):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    library = tiktoken.Encoding("apart", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    mixed = " ".join(rng.choice("It's the 12345 straße — 日本語 naïve\n\n \t don't <|endoftext|> x_y ½".split(" "), 30_000))
    texts = [None, "", " ", "a <|endoftext|> b", "é" * 50_000, mixed, " " * 40_000 + "x", "ab" * 40_000, "\r\n" * 3000, "plain words " * 9000, "plain words " * 9000]
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.op1_byte_bpe(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
