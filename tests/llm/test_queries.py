"""The registered queries and the pipeline on small tables with nulls, ties, repeated rows, clashing columns, against brute force."""

import base64
import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from graphloom.llm import egojoin, fingerprint, langid, minhash, packing, registry, suffixes, warc
from pyspark.sql import functions as F

#: Columns beside the table's own, named like those that operators make.
EXTRA = ["_spans", "_doc", "key", "text_crc32", "component_id", "kept", "slot"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in EXTRA)
EN = "the quick brown fox and the lazy dog were there when that other man said what he thought of this old house by the river"
DE = "der schnelle braune fuchs und der faule hund waren dort als jener andere mann sagte was er von diesem alten haus am fluss hielt"


def texts():
    rng = np.random.default_rng(11)
    say = lambda words, n: " ".join(rng.choice(words.split(), n))
    passage = say(EN, 70)
    out = [say(EN if i % 2 else DE, int(rng.integers(5, 60))) for i in range(60)]
    out += [f"{say(DE, 20)}\n{passage}\n{say(EN, 15)}" for _ in range(3)] + [f"{passage} {passage}"]
    long = say(EN, 300)
    out += [long, long, long + " end", "x" * 3000, "12 34 $", "", "one", "日本語のテキスト" * 40, "a <|endoftext|> b", say(DE, 9000)]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    german = lambda t: sum(w in DE.split() for w in t.split()) > sum(w in EN.split() for w in t.split())
    rows = [(i * 7919 if i % 5 else i, t, "de" if german(t) else "en", f"s{i % 3}" if i % 4 else ("" if i % 8 else None), len(t)) for i, t in enumerate(texts())]
    rows += [(5000, None, None, None, None), (None, rows[3][1], "en", "s1", 4), (None, "no id " * 30, "en", "s1", 4), rows[70], rows[10]]
    spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_shards_hold_their_share_of_each_source(spark, sf):
    got = registry.op2_stratified_shards(spark, sf[0]).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in sf[1])
    shards, sources = defaultdict(list), defaultdict(int)
    for r in got:
        shards[r["shard"]].append(r)
        sources[r["source"]] += 1
    assert set(sources) == {r[3] for r in sf[1]}  # an empty source is not a null one
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    for s, n in sources.items():
        assert all(abs(sum(r["source"] == s for r in x) - n / len(shards)) <= 2 for x in shards.values())


def test_language_learns_and_says_what_it_does_not_know(spark, sf):
    got = {(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in registry.op3_crf_language(spark, sf[0]).collect()}
    by = {i: (lang, score) for i, _, lang, score in got if i is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in got if i is not None) and all(0 <= x[3] <= 1 for x in got)
    right = [by[i][0] == lang for i, t, lang, *_ in sf[1] if i is not None and t and len(t.split()) > 4 and t.isascii()]
    assert sum(right) >= 0.95 * len(right)
    assert all(by[i] == ("und", 0.0) for i, t, *_ in sf[1] if i is not None and not any(map(str.isalpha, t or "")))


def test_labels_of_long_lines_do_not_depend_on_where_they_are_cut():
    crf = langid.Crf.train([EN, DE] * 20, ["en", "de"] * 20)
    line = " ".join([EN] * 40 + [DE] * 20)
    label, score = crf.predict([line])
    assert label == ["en"] and abs(score[0] - 2 / 3) < 0.1


def test_likeness_against_the_edited_texts(spark, sf):
    got = registry.op10_multiset_hash(spark, sf[0]).collect()
    rows = {i: t or "" for i, t, *_ in sf[1] if i is not None}
    once = [i for i in rows if sum(i == r[0] for r in sf[1]) == 1]
    assert len(got) == len(sf[1])
    order = sorted(rows, reverse=True)
    by = {r["doc_id"]: r for r in got}
    for i, after in zip(order, order[1:], strict=False):
        if i in once and after in once:
            third = len(rows[i]) // 3
            edited = rows[i][: len(rows[i]) - third] + rows[after][:third]
            assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by[i]["n_chars"] == len(rows[i])
            assert (by[i]["fingerprint"] == by[i]["edited_fingerprint"]) == (rows[i] == edited) and 0 <= by[i]["near_next"] <= 1
    assert by[order[-1]]["n_chars"] == len(rows[order[-1]])


def test_paragraphs_are_inserted_and_deleted(spark):
    rows = spark.createDataFrame([(0, "a b c\nd e\n\nf g h"), (1, "f g h\na b c"), (2, "d e"), (3, "f g h\nd e\na b c"), (4, "a b\nc d e\nf g h"), (5, None)], "i long, t string")
    fp = {r["i"]: r["fp"] for r in fingerprint.fingerprints(rows, ["i"], "t").collect()}
    assert fp[0] == fp[3] != fp[4] and fp[5] == [0] * len(fp[0])
    got = spark.createDataFrame([(fp[0], fp[1], fp[2])], "a array<long>, b array<long>, c array<long>").select(fingerprint.add(F.col("b"), F.col("c")).alias("x"), fingerprint.subtract(F.col("a"), F.col("c")).alias("y")).first()
    assert got["x"] == fp[0] and got["y"] == fp[1]


def test_pieces_and_sequences(spark, sf):
    got = registry.op7_best_fit_packing(spark, sf[0]).collect()
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for i, t, *_ in sf[1]:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[i, at].append((len(part), zlib.crc32(part.tobytes()), len(ids)))
    have, windows = defaultdict(list), defaultdict(list)
    for r in got:
        have[r["doc_id"], r["start"]].append((r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(windows) == list(range(len(windows))) and len(windows) == -(-sum(r["length"] for r in got) // 4096)


def test_passages_by_all_runs_of_fifty_words(spark, sf):
    got = defaultdict(set)
    for r in registry.op9_sparse_suffixes(spark, sf[0]).collect():
        got[r["doc_id"]] |= set(range(r["begin_word"], r["end_word"]))
        assert r["ref_doc_id"] <= r["doc_id"]
    seen, want = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t, *_ in sf[1] if i is not None and t}):
        w = t.split()
        for b in range(len(w) - 49):
            first = seen.setdefault(tuple(w[b : b + 50]), (i, b))
            if first[0] < i or b >= first[1] + 50:
                want[i] |= set(range(b, b + 50))
    assert got == want and any(seen.values())


def test_cut_keeps_columns_that_are_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60))), "a", "b"), (2, " ".join(map(str, range(60))) + " end", "c", "d"), (None, None, "e", "f")], "doc_id long, text string, _spans string, _Doc string")
    got = {r["doc_id"]: tuple(r) for r in suffixes.cut(docs, suffixes.repeats(docs)).collect()}
    assert got[2] == (2, "end", "c", "d") and got[None] == (None, None, "e", "f") and len(got[1][1].split()) == 60


def test_pages_come_back(spark, tmp_path):
    html = ["<p>é</p>", None, "", "<p>é</p>", "y" * 200_000, "<p>é</p>", ""]
    rows = [(i, f"http://h/{i}\r\n", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>é</p>", "x"), (3, "http://h/3", "<p>é</p>", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in registry.op8_zip_warc(spark, str(tmp_path)).collect())
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    keeper = {"<p>é</p>": 5, "": 6, "y" * 200_000: 4}
    want = []
    for i, _, h, _ in rows:
        k = keeper[h or ""]
        kind = "response" if i is None or i == k else "revisit"
        want.append((-1 if i is None else i, len((h or "").encode()), digest(h), kind, None if kind == "response" else k))
    assert got == sorted(want, key=lambda r: r[:2])


def test_packages_of_other_makers(tmp_path):
    import gzip
    import io
    import json
    import zipfile

    parts = {name: [gzip.compress(warc.record(i, "http://h/", base64.b32encode(hashlib.sha1(b"z" * i).digest()).decode(), "response", None, i, b"z" * i)) for i in ids] for name, ids in (("a.warc.gz", (1, 2)), ("b.warc.gz", (3,)))}
    lines = [f"h,/ 2020 {json.dumps({'offset': str(sum(map(len, rs[:k]))), 'length': str(len(r)), 'filename': name})}" for name, rs in parts.items() for k, r in enumerate(rs)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, rs in parts.items():
            z.writestr(f"archive/{name}", b"".join(rs))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta {}", *lines]).encode()))
    assert [r["page_id"] for r in warc.records_of(io.BytesIO(out.getvalue()), len(out.getvalue()))] == [1, 2, 3]


def test_rows_of_one_vector_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (9, [0.0, 1.0]), (9, [-1.0, 0.0]), (7, [-1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(tuple(r)[:3] for r in egojoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("vec_id is not null").collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (7, 1, 1), (8, 0, 8), (9, 1, 1), (9, 2, 1)]
    assert egojoin.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_documents_of_stock_passages_lose_no_link(spark):
    """Documents are put together from the same passages, so that lists are long; each twentieth has a copy with one word more."""
    rng = np.random.default_rng(2)
    stock = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(30)]
    rows = [(d, " ".join(stock[k] for k in rng.choice(30, 10, replace=False))) for d in range(1500)]
    rows += [(10_000 + d, t + f" more{d}") for d, t in rows[::20]]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert sum(got[10_000 + d] != got[d] for d, _ in rows[:1500:20]) == 0


def shingles(text, k):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text).split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_pipeline_against_brute_force(spark, sf):
    docs = [(i, t) for i, t, *_ in sf[1] if t and any(map(str.isalpha, t))]
    # one of each group of near-duplicates stays, of rows with one id and text one
    known = sorted({x for x in docs if x[0] is not None})
    sets, least = [shingles(t, 5) for _, t in known], list(range(len(known)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((least[i], least[j]))
                least = [lo if x == hi else x for x in least]
    kept = [x for i, x in enumerate(known) if least[i] == i] + [x for x in docs if x[0] is None]
    # passages that came before go
    seen, want = {}, []
    for i, t in sorted((x for x in kept if x[0] is not None)):
        w, gone = t.split(), set()
        for b in range(len(w) - 49):
            first = seen.setdefault(tuple(w[b : b + 50]), (i, b))
            if first[0] < i or b >= first[1] + 50:
                gone |= set(range(b, b + 50))
        if len(gone) < len(w) or not w:
            want.append((i, [x for k, x in enumerate(w) if k not in gone]))
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = lambda words: len(whole.encode(" ".join(words), add_special_tokens=False).ids) + 1
    want = sorted((i, tokens(w)) for i, w in want) + sorted((-1, tokens(t.split())) for i, t in kept if i is None)
    got = corpus_pipeline.run(spark, sf[0]).filter("start = 0").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]) for r in got) == sorted(want)


#: Queries that read other tables too, or only others; their own tests hold them on empty ones.
OTHER_TABLES = ["op5_chat_grammar", "op6_grid_order_join", "op8_zip_warc", "op12_likelihood_ratio", "op13_inverted_treaps"]


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in OTHER_TABLES] + ["pipeline"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    run = corpus_pipeline.run if name == "pipeline" else registry.queries()[name]
    assert run(spark, str(tmp_path)).count() == 0


def test_packing_plan_fills_windows():
    plan = packing.best_fit_decreasing({6: 3, 5: 2, 4: 3, 1: 2}, 10)
    fill = defaultdict(int)
    for length, _, n, first, offset in plan:
        for w in range(first, first + n):
            assert fill[w] == offset
            fill[w] += length
    assert sorted(fill.values()) == [2, 10, 10, 10, 10]
