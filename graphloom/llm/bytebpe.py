"""Byte-level BPE by overlapping chunks: pre-tokenise chunks in parallel, stitch where their boundaries agree, encode the pieces.

A long text is cut into chunks that reach into the next one. Each chunk is split by the pattern from its own start, which
may lie inside a pre-token; but two splittings that share one boundary agree from there on, since a match depends only on
what follows its start. The first shared boundary in an overlap is where the next piece begins. Matches that reach a
chunk's artificial end are not trusted. Where an overlap has no shared boundary (a run longer than it), the rest of the text
stays one piece: that is slower, never wrong. Pieces begin and end at true boundaries and so encode as in the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CHUNK, OVERLAP = 32_768, 1_024
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


class Codec:
    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, ranks_path: str, pattern: str) -> Codec:
        return cls(ranks_path, pattern)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(self.text_of.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()

    def boundaries(self, chunk: str, last: bool) -> list[int]:
        """Starts of the matches; without the last match, and what follows it, if the text goes on after the chunk."""
        spans = [m.span() for m in self.pattern.finditer(chunk)]
        while spans and not last and spans[-1][1] == len(chunk):
            spans.pop()
            last = True
        return [a for a, _ in spans] + ([spans[-1][1]] if spans else [])


def stitch(heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    """Piece starts (positions in the text) of one document's chunks, in order; -1: the chunk joins the piece before it.

    heads: boundaries in a chunk's first OVERLAP characters; tails: those behind its own part, in the next chunk's first ones.
    """
    cuts, open_ = [0], True
    for tail, head in zip(tails, heads[1:], strict=False):
        shared = sorted(set(tail) & set(head)) if open_ else []
        open_ = bool(shared)
        cuts.append(shared[0] if shared else -1)
    return cuts


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """n_tokens and digests of the ids and of the decoded bytes, for every row.

    Null text: encoded as the empty one (no tokens, digests of nothing). Repeated rows give repeated results. Texts of
    any length are whole: those over chunk characters are spread over tasks by chunk, twice (to split, to encode); a shorter
    text is one chunk without neighbours, for which there is nothing to stitch. Null ids pass through. Only the two named
    columns are read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        for batch in batches:
            found = [codec.digests(codec.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], NAMES)

    short = docs.filter(F.length("text") <= chunk).mapInArrow(whole, OUT)

    keyed = docs.filter(F.length("text") > chunk).select(
        F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256).alias("key"), "doc_id", "text"
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                count = -(-len(text) // chunk)
                for first in range(0, count, 64):
                    at = range(first, min(first + 64, count))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(at), pa.string()), pa.array([doc_id] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([i == count - 1 for i in at], pa.bool_()), pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in at], pa.string())],
                        ["key", "doc_id", "i", "last", "part"],
                    )

    parts = keyed.select("key", "doc_id", "text").mapInArrow(chunks, "key string, doc_id bigint, i int, last boolean, part string")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        for batch in batches:
            rows = batch.to_pylist()
            heads, tails = [], []
            for r in rows:
                at = r["i"] * chunk
                ends = codec.boundaries(r["part"], r["last"])
                heads.append([at + x for x in ends if x < overlap])
                tails.append([at + x for x in ends if x >= chunk])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.string()), pa.array([r["i"] for r in rows], pa.int32()), pa.array(heads, ints), pa.array(tails, ints)], ["key", "i", "head", "tail"])

    split_rows = parts.repartition("key", "i").mapInArrow(split, "key string, i int, head array<bigint>, tail array<bigint>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index, begin, end = [], [], [], []
            for r in batch.to_pylist():
                chunks = {c["i"]: c for c in r["chunks"]}
                order = [chunks[i] for i in sorted(chunks)]
                starts = stitch([c["head"] for c in order], [c["tail"] for c in order])
                for i, s in enumerate(starts):
                    keys.append(r["key"])
                    index.append(i)
                    begin.append(s)
                    end.append(next((x for x in starts[i + 1 :] if x >= 0), -1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(index, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["key", "i", "begin", "end"])

    cuts = split_rows.groupBy("key").agg(F.collect_list(F.struct("i", "head", "tail")).alias("chunks")).mapInArrow(cut, "key string, i int, begin bigint, end bigint")
    # a piece lies in its chunk and the overlap, unless it runs on: then the following chunks come with it, each its own part
    pieces = parts.join(cuts, ["key", "i"])

    def piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of a piece as packed integers; a chunk of a piece that runs on goes on as its own text, to be encoded in the end."""
        codec = Codec.load(ranks_path, pattern)
        for batch in batches:
            rows, ids, texts = batch.to_pylist(), [], []
            for r in rows:
                at = r["i"] * chunk
                if r["begin"] < 0 or (r["end"] < 0 and not r["last"]):
                    start = max(r["begin"] - at, 0)
                    ids.append(b"")
                    texts.append(r["part"][start:chunk])
                else:
                    text = r["part"][r["begin"] - at : None if r["end"] < 0 else r["end"] - at]
                    ids.append(array("I", codec.encode(text)).tobytes() if len(codec.text_of) > 65536 else array("H", codec.encode(text)).tobytes())
                    texts.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["key"] for r in rows], pa.string()), pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["i"] for r in rows], pa.int32()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                ["key", "doc_id", "i", "ids", "text"],
            )

    encoded = pieces.mapInArrow(piece_ids, "key string, doc_id bigint, i int, ids binary, text string")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path, pattern)
        code = "I" if len(codec.text_of) > 65536 else "H"

        def done(doc_id: int | None, ids: list[int], run: list[str], copies: int) -> pa.RecordBatch:
            ids += codec.encode("".join(run)) if run else []
            n, a, b = codec.digests(ids)
            return pa.RecordBatch.from_arrays([pa.array([doc_id] * copies, pa.int64()), pa.array([n] * copies, pa.int64()), pa.array([a] * copies, pa.string()), pa.array([b] * copies, pa.string())], NAMES)

        key, doc_id, at, copies, ids, run = None, None, -1, 0, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        yield done(doc_id, ids, run, copies)
                    key, doc_id, at, copies, ids, run = r["key"], r["doc_id"], -1, 0, [], []
                copies += r["i"] == 0
                if r["i"] == at:  # a repeated row's
                    continue
                at = r["i"]
                if r["text"] is not None:
                    run.append(r["text"])
                else:
                    got = array(code)
                    got.frombytes(r["ids"])
                    ids += got.tolist()
        if key is not None:
            yield done(doc_id, ids, run, copies)

    long = encoded.repartition("key").sortWithinPartitions("key", "i").mapInArrow(join_up, OUT)
    return short.unionByName(long)
