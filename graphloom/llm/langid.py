"""Language identification by a linear-chain conditional random field over words.

A chain is a line of a text (long lines: up to CHAIN words each). A word's emission score sums weights of its affixes, the mean
of its letter trigrams' and its lexicon entry's; transitions between neighbouring words are learned too. Forward-backward
gives each word's label marginals; a document's language is the label with the largest mean marginal, its score that mean.

Everything after lower-casing works on arrays over all words of a batch; no step is taken word by word in Python.
Training takes at most `train_docs` labelled documents (the smallest by a hash of the id), which the driver fits in seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

TRAIN_DOCS, CHAIN, SLICE = 1200, 64, 1 << 18
GRAM_BITS, AFFIX_BITS, LEXICON_BITS = 16, 16, 18
AFFIXES = (1, 2, 3)
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Words:
    """The words of texts that are joined by line ends: feature indices and chains."""

    def __init__(self, texts: list[str]) -> None:
        blobs = [t.lower().encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"\n" + b"\n".join(blobs) + b"\n\n\n", np.uint8)
        mask = _LETTER[raw]
        b = np.where(mask, raw, 32).astype(np.int64)
        step = np.diff(mask.astype(np.int8))
        self.begin, self.end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.n = len(self.begin)
        if not self.n:
            return
        starts = np.cumsum([1] + [len(x) + 1 for x in blobs])[:-1]
        self.doc = np.searchsorted(starts, self.begin, "right") - 1
        line = np.cumsum(raw == 10)[self.begin]
        new = np.r_[True, line[1:] != line[:-1]]
        first = np.flatnonzero(new)
        at = np.arange(self.n) - np.repeat(first, np.diff(np.r_[first, self.n]))
        self.chain_at = np.flatnonzero(at % CHAIN == 0)
        self.chain_n = np.diff(np.r_[self.chain_at, self.n])
        size = self.end - self.begin
        # trigrams from one before the word to its last letter, so that ends count
        grams = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        self.gram_n = size
        run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.grams = _mixed(grams[np.repeat(self.begin - 1, size) + run], GRAM_BITS)
        self.gram_at = np.cumsum(size) - size
        affixes = []
        for k in AFFIXES:
            k_ = np.minimum(size, k)
            head = sum(np.where(i < k_, b[self.begin + np.minimum(i, size - 1)], 0) << (8 * i) for i in range(k))
            tail = sum(np.where(i < k_, b[self.end - 1 - np.minimum(i, size - 1)], 0) << (8 * i) for i in range(k))
            affixes += [_mixed(head * 16 + 2 * k, AFFIX_BITS), _mixed(tail * 16 + 2 * k + 1, AFFIX_BITS)]
        self.affixes = np.stack(affixes)
        pos = (run + 1).astype(np.uint64)
        letters = b[np.repeat(self.begin, size) + run].astype(np.uint64)
        spread = (letters + np.uint64(257) * pos) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        self.lexicon = _mixed(np.add.reduceat(spread * np.uint64(0xA24BAED4963EE407), self.gram_at), LEXICON_BITS)


class Crf:
    def __init__(self, labels: list[str]) -> None:
        self.labels, k = labels, len(labels)
        self.gram, self.affix = np.zeros((1 << GRAM_BITS, k), np.float32), np.zeros((1 << AFFIX_BITS, k), np.float32)
        self.lexicon, self.bias, self.move = np.zeros((1 << LEXICON_BITS, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k))

    def emissions(self, w: Words) -> np.ndarray:
        out = np.add.reduceat(self.gram[w.grams], w.gram_at, axis=0) / w.gram_n[:, None].astype(np.float32)
        for rows in w.affixes:
            out += self.affix[rows]
        return out + self.lexicon[w.lexicon] + self.bias

    def marginals(self, w: Words, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each word's label probabilities by forward-backward; pairs: also the sums of neighbouring pairs'."""
        e = self.emissions(w)
        e = np.exp(e - e.max(1, keepdims=True)).astype(np.float64)
        move, k = np.exp(self.move), len(self.labels)
        order = np.argsort(-w.chain_n, kind="stable")
        at, n = w.chain_at[order], w.chain_n[order]
        longest = int(n[0])
        live = [int(np.searchsorted(-n, -t, "left")) for t in range(longest + 1)]  # chains of more than t words
        alpha, out = np.empty_like(e), np.empty_like(e)
        a = e[at] / e[at].sum(1, keepdims=True)
        alpha[at] = a
        for t in range(1, longest):
            i = at[: live[t]] + t
            a = (a[: live[t]] @ move) * e[i]
            a /= a.sum(1, keepdims=True)
            alpha[i] = a
        beta, both = np.ones((0, k)), np.zeros((k, k)) if pairs else None
        for t in range(longest - 1, -1, -1):
            i, b = at[: live[t]] + t, np.ones((live[t], k))
            if live[t + 1]:
                j = at[: live[t + 1]] + t + 1
                after = beta * e[j]
                b[: live[t + 1]] = after @ move.T
                if pairs:
                    p = alpha[j - 1][:, :, None] * move * after[:, None, :]
                    both += (p / p.sum((1, 2), keepdims=True)).sum(0)
            b /= b.sum(1, keepdims=True)
            m = alpha[i] * b
            out[i] = m / m.sum(1, keepdims=True)
            beta = b
        return out, both

    @classmethod
    def train(cls, texts: list[str], langs: list[str], rounds: int = 2, rate: float = 0.4, decay: float = 1e-4) -> Crf:
        """Maximum likelihood by Adagrad over small batches; every word of a document takes the document's label."""
        crf = cls(sorted(set(langs)))
        k, index = len(crf.labels), {x: i for i, x in enumerate(crf.labels)}
        seen = {x: np.full_like(getattr(crf, x), 1e-3, np.float64) for x in ("gram", "affix", "lexicon", "bias", "move")}
        groups, held = [[]], 0
        for i, t in enumerate(texts):
            groups[-1].append(i)
            held += len(t)
            if held > 100_000:
                groups.append([])
                held = 0
        for _ in range(rounds):
            for g in groups:
                w = Words([texts[i] for i in g])
                if not w.n:
                    continue
                gold = np.array([index[langs[i]] for i in g])[w.doc]
                p, both = crf.marginals(w, pairs=True)
                p[np.arange(w.n), gold] -= 1
                chain_of = np.repeat(np.arange(len(w.chain_n)), w.chain_n)
                inside = np.flatnonzero(chain_of[1:] == chain_of[:-1])
                np.add.at(both, (gold[inside], gold[inside + 1]), -1)
                per_gram = np.repeat(p / w.gram_n[:, None], w.gram_n, axis=0)
                grads = {
                    "gram": cls._sums(w.grams, per_gram, 1 << GRAM_BITS), "affix": sum(cls._sums(a, p, 1 << AFFIX_BITS) for a in w.affixes),
                    "lexicon": cls._sums(w.lexicon, p, 1 << LEXICON_BITS), "bias": p.sum(0), "move": both,
                }
                for name, grad in grads.items():
                    weights = getattr(crf, name)
                    grad = grad / w.n + decay / 100 * weights
                    seen[name] += grad**2
                    weights -= (rate * grad / np.sqrt(seen[name])).astype(weights.dtype)
        return crf

    @staticmethod
    def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, j], size) for j in range(values.shape[1])], axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sums, counts = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for group, parts in _slices(texts):
            w = Words(parts)
            if w.n:
                p, _ = self.marginals(w)
                doc = np.asarray(group)[w.doc]
                for j in range(len(self.labels)):
                    sums[:, j] += np.bincount(doc, p[:, j], len(texts))
                counts += np.bincount(doc, minlength=len(texts))
        best = sums.argmax(1)
        scores = np.clip(sums.max(1) / np.maximum(counts, 1), 0, 1)
        lettered = [bool(c) and _has_letter(t) for c, t in zip(counts, texts, strict=True)]
        return [self.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(scores, lettered, strict=True)]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def has(texts: pd.Series) -> pd.Series:
        return pd.Series([_has_letter(t) for t in texts.tolist()], dtype=bool)

    return docs.filter(has(F.col(text_col)))


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of whole texts, or parts of one long text cut at line ends or spaces, of about SLICE characters each."""
    group: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        at, n = 0, len(text or "")
        while at < n:
            to = min(n, at + SLICE)
            if to < n:
                cut = max(text.rfind("\n", at + 1, to), text.rfind(" ", at + 1, to) if text.rfind("\n", at + 1, to) < 0 else -1)
                to = cut if cut > at else to
            group.append(i)
            parts.append(text[at:to])
            held += to - at
            at = to
            if held >= SLICE:
                yield group, parts
                group, parts, held = [], [], 0
    if parts:
        yield group, parts


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Crf | None:
    """A model of at most train_docs documents that are not held out; None if none has a label and a text."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    h = F.xxhash64(F.col(id_col), F.lit("train"))
    # hashes first, then only the chosen rows: no task sends texts that are not used
    last = rows.select(h.alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if last is None:
        return None
    rows = rows.select(h.alias("h"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(F.col("h") <= last)
    rows = rows.orderBy("h", "i", "t").limit(train_docs).collect()
    return Crf.train([r["t"] for r in rows], [r["l"] for r in rows]) if rows else None


def identify(docs: DataFrame, model: Crf | None, text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """docs with lang_to and score_to, from the text alone.

    Null or letterless text, or no model (nothing to learn from): `und`, 0. Texts of any length are used whole. Rows are
    independent: repeated rows get equal results; other columns pass through, but one that is named as lang_to or score_to is
    replaced. Null ids do not matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for texts in batches:
            found = crf.predict([None if t is None else t for t in texts.tolist()]) if crf else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang": found[0], "score": found[1]})

    made = "_predicted"
    while made in docs.columns:
        made += "_"
    return docs.withColumn(made, predict(F.col(text_col))).withColumns({lang_to: F.col(f"{made}.lang"), score_to: F.col(f"{made}.score")}).drop(made)
