"""Language identification by a linear-chain conditional random field.

Every word (run of letters; a long one counts as several) gets a label. Emissions add up hashed features of the word (character
n-grams of one to four bytes with word edges, which hold the affixes, and the whole
word as lexicon entry); transitions between neighbouring labels are learned with
them, by the gradient of the CRF likelihood (forward-backward marginals). Training
takes at most `PER_LANG` documents of each language and a stretch of `STRETCH`
words of each, chosen by digest; a part of the sequences is spliced from two
languages, so that transitions are learned for code-switched text.

All words of whole texts are labelled: forward-backward runs over blocks of words
at once, with the blocks' transfer matrices chained within a document, which is
exact. A document's language is the one with the largest sum of word marginals,
its score that sum's share.

Defined results: null text, or text without a letter, is `und` with score 0; no
training rows: everything is `und`; a null doc_id is in no held-out fold; repeated
rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm import kernels
from lattika.llm.common import by_value, opened, shared, words

by_value(__name__)

PER_LANG, STRETCH = 120, 128
SIZE = 1 << 16  # hashed features
LONGEST = 24  # bytes of a token; longer runs of letters are several tokens
SEQUENCE, BLOCK = 32, 64
ROUNDS, RATE = 30, 0.15
CACHE = 400_000


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SIZE x languages
    moves: np.ndarray  # log transitions
    first: np.ndarray


def letters(word: str) -> list[bytes]:
    """The runs of letters (with their marks) in a word, those over LONGEST bytes in several pieces."""
    if word.isalpha():
        runs = [word]
    else:
        kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in word)
        runs = [r for r in kept.split() if any(map(str.isalpha, r))]
    out = []
    for r in runs:
        raw, lo = r.encode(), 0
        while len(raw) - lo > LONGEST:
            hi = lo + LONGEST
            while raw[hi] & 0xC0 == 0x80:  # inside a character
                hi -= 1
            out.append(raw[lo:hi])
            lo = hi
        out.append(raw[lo:])
    return out


def features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, a row each, and which of them are there."""
    n, width = len(tokens), LONGEST + 2
    size = np.fromiter((len(t) for t in tokens), np.int64, n)
    mat = np.frombuffer(b"".join(b"\x01" + t + b"\x02" + bytes(LONGEST - len(t)) for t in tokens), np.uint8).reshape(n, width).astype(np.uint64)
    index, there = [], []
    gram = np.zeros((n, width), np.uint64)
    for k in range(1, 5):
        gram = gram[:, : width - k + 1] * np.uint64(257) + mat[:, k - 1 :]
        index.append((kernels.mixed(gram + np.uint64(k << 40)) & np.uint64(SIZE - 1)).astype(np.int32))
        there.append(np.arange(width - k + 1)[None, :] <= (size + 2 - k)[:, None])
    whole = (mat * kernels.powers(1_000_003, width)[None, :]).sum(axis=1, dtype=np.uint64)
    index.append((kernels.mixed(whole + np.uint64(9 << 40))[:, None] & np.uint64(SIZE - 1)).astype(np.int32))
    there.append(np.ones((n, 1), bool))
    return np.concatenate(index, axis=1), np.concatenate(there, axis=1)


def emissions(model: Model, tokens: list[bytes]) -> np.ndarray:
    out = np.empty((len(tokens), len(model.langs)))
    for lo in range(0, len(tokens), 4096):
        index, there = features(tokens[lo : lo + 4096])
        flat = model.weights[index[there]]
        counts = there.sum(axis=1)
        cuts = np.cumsum(counts) - counts
        out[lo : lo + 4096] = np.add.reduceat(flat, cuts, axis=0) / np.sqrt(counts)[:, None]
    return out


def _forward_backward(e: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed transition marginals of sequences of equal length (log emissions)."""
    n, length, k = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(moves)
    a, b = np.empty_like(p), np.empty_like(p)
    a[:, 0] = np.exp(first) * p[:, 0]
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, length):
        x = (a[:, i - 1] @ t) * p[:, i]
        a[:, i] = x / x.sum(axis=1, keepdims=True)
    b[:, -1] = 1.0
    pairs = np.zeros((k, k))
    for i in range(length - 2, -1, -1):
        right = p[:, i + 1] * b[:, i + 1]
        x = right @ t.T
        joint = a[:, i][:, :, None] * t[None] * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b[:, i] = x / x.sum(axis=1, keepdims=True)
    g = a * b
    return g / g.sum(axis=2, keepdims=True), pairs


def fit(rows: list[tuple[str, list[str]]], rounds: int = ROUNDS, rate: float = RATE, seed: int = 5) -> Model:
    """Trains on (language, words) rows; deterministic."""
    langs = sorted({r[0] for r in rows})
    k = len(langs)
    model = Model(langs, np.zeros((SIZE, k)), np.log(np.full((k, k), 1.0 / max(k, 1)) + np.eye(k)), np.zeros(k))
    rng, code, vocab, label, text = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}, {}, [], []
    for lang, ws in rows:
        ids = [vocab.setdefault(t, len(vocab)) for w in ws for t in letters(w.lower())]
        for lo in range(0, len(ids) - SEQUENCE + 1, SEQUENCE):
            text.append(ids[lo : lo + SEQUENCE])
            label.append([code[lang]] * SEQUENCE)
        if 0 < len(ids) < SEQUENCE:  # short texts count as well
            text.append((ids * SEQUENCE)[:SEQUENCE])
            label.append([code[lang]] * SEQUENCE)
    if not text:
        return Model([], np.zeros((SIZE, 0)), np.zeros((0, 0)), np.zeros(0))
    x, y = np.array(text), np.array(label)
    other = rng.permutation(len(x))
    for i in range(0, len(x), 4):  # every fourth sequence goes on in another document
        at = int(rng.integers(4, SEQUENCE - 4))
        x[i, at:], y[i, at:] = x[other[i], at:], y[other[i], at:]
    index, there = features(list(vocab))
    counts = there.sum(axis=1)
    flat, cuts, scale = index[there], np.cumsum(counts) - counts, 1 / np.sqrt(counts)
    del index, there
    gold = np.zeros((k, k))
    np.add.at(gold, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    start = np.bincount(y[:, 0], minlength=k)
    params = [model.weights, model.moves, model.first]
    first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        # A language at a time, so that the driver holds one column of all features.
        e = np.stack([np.add.reduceat(model.weights[:, j][flat], cuts) for j in range(k)], axis=1) * scale[:, None]
        marginal, pairs = _forward_backward(e[x], model.moves, model.first)
        diff = marginal.copy()
        np.subtract.at(diff, (np.arange(len(x))[:, None], np.arange(SEQUENCE)[None, :], y), 1.0)
        n = x.size
        by_word = np.stack([np.bincount(x.ravel(), diff[:, :, j].ravel(), len(vocab)) for j in range(k)], axis=1) * scale[:, None]
        grad_w = np.stack([np.bincount(flat, np.repeat(by_word[:, j], counts), SIZE) for j in range(k)], axis=1) / n + 1e-7 * model.weights
        grads = [grad_w, (pairs - gold) / n, (marginal[:, 0].sum(axis=0) - start) / len(x)]
        for p, g, m, v in zip(params, grads, first_moment, second, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, per_lang: int = PER_LANG, stretch: int = STRETCH) -> Model:
    """A model of the languages of docs outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return fit([])
    share = F.coalesce(*[F.when(F.col("lang") == l, F.lit(min(1.0, 2.0 * per_lang / n))) for l, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.where(draw < share).withColumn("draw", draw)  # about 2 * per_lang rows a language
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).where(F.col("k") <= per_lang)
    ws = words(F.col("text"))
    begin = F.greatest(F.lit(1), (F.col("draw") * (F.size("ws") - stretch)).cast("int") + 1)
    rows = some.withColumn("ws", ws).select("lang", "k", F.slice("ws", begin, F.lit(stretch)).alias("ws")).collect()
    return fit([(r["lang"], r["ws"]) for r in sorted(rows, key=lambda r: (r["lang"], r["k"]))])


def document_marginals(e: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """Sums of word marginals of documents with counts[i] > 0 words each, end to end in e (log emissions)."""
    k, t = e.shape[1], np.exp(model.moves - model.moves.max())
    n_blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = np.cumsum(n_blocks) - n_blocks
    block, spot = head[doc] + within // BLOCK, within % BLOCK
    nb = int(n_blocks.sum())
    p = np.ones((nb, BLOCK, k))
    p[block, spot] = np.exp(e - e.max(axis=1, keepdims=True))
    size = np.bincount(block, minlength=nb)
    is_first = np.zeros(nb, bool)
    is_first[head] = True
    # Transfer matrix of each block: from the label before it to the label at its end.
    step = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for i in range(BLOCK):
        on = size > i
        x = (step[on] @ t) * p[on, i][:, None, :]
        step[on] = x / x.sum(axis=(1, 2), keepdims=True)
    # Labels before each block, and what follows each block, chained within the documents.
    before, after = np.empty((nb, k)), np.ones((nb, k))
    start = np.linalg.solve(t.T, np.exp(model.first - model.first.max())) if abs(np.linalg.det(t)) > 1e-9 else np.full(k, 1.0 / k)
    start = np.maximum(start, 1e-9)
    before[head] = start / start.sum()
    for i in range(int(n_blocks.max()) - 1):
        at = head[n_blocks > i + 1] + i
        x = np.einsum("nk,nkj->nj", before[at], step[at])
        before[at + 1] = x / x.sum(axis=1, keepdims=True)
        at = (head + n_blocks - 1)[n_blocks > i + 1] - i
        x = np.einsum("nkj,nj->nk", step[at], after[at])
        after[at - 1] = x / x.sum(axis=1, keepdims=True)
    a = np.empty_like(p)
    x = before
    for i in range(BLOCK):
        y = (x @ t) * p[:, i]
        y /= y.sum(axis=1, keepdims=True)
        x = np.where((size > i)[:, None], y, x)
        a[:, i] = x
    total, b = np.zeros((nb, k)), after
    for i in range(BLOCK - 1, -1, -1):
        on = (size > i)[:, None]
        g = a[:, i] * b
        total += np.where(on, g / g.sum(axis=1, keepdims=True), 0.0)
        y = (p[:, i] * b) @ t.T
        b = np.where(on, y / y.sum(axis=1, keepdims=True), b)
    out = np.zeros((len(counts), k))
    np.add.at(out, np.repeat(np.arange(len(counts)), n_blocks), total)
    return out


class Tagger:
    """Labels texts, with the emissions of words it has seen kept up to a bound."""

    def __init__(self, model: Model):
        self.model, self.seen, self.n_known, self.known = model, {}, 0, np.zeros((1024, len(model.langs)))
        self.size = np.zeros(1024, np.int64)  # tokens of a word, by its first row

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the emissions of all tokens of the words, in order, and the word of each."""
        seen = self.seen
        new = [w for w in dict.fromkeys(words) if w not in seen]
        if new:
            spelled = [letters(w) for w in new]
            tokens = [t for s in spelled for t in s]
            base = self.n_known
            if tokens:
                e = emissions(self.model, tokens)
                while base + len(e) > len(self.known):
                    self.known = np.concatenate((self.known, np.zeros_like(self.known)))
                    self.size = np.concatenate((self.size, np.zeros_like(self.size)))
                self.known[base : base + len(e)] = e
            self.n_known = base + len(tokens)
            for w, s in zip(new, spelled, strict=True):
                seen[w] = base if s else -1
                if s:
                    self.size[base] = len(s)
                base += len(s)
        first = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        size = np.where(first >= 0, self.size[first], 0)
        word = np.repeat(np.arange(len(words)), size)
        return first[word] + np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size), word

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if max(len(self.seen), self.n_known) > CACHE:
            self.seen, self.n_known = {}, 0
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.model.langs:
            return lang, score
        split = [(t or "").lower().split() for t in texts]
        rows, word = self.rows([w for ws in split for w in ws])
        doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])[word]
        counts = np.bincount(doc, minlength=len(texts))
        full = np.flatnonzero(counts)
        if len(full):
            sums = document_marginals(self.known[rows], counts[full], self.model)
            best = sums.argmax(axis=1)
            share = sums[np.arange(len(full)), best] / sums.sum(axis=1)
            for d, j, s in zip(full, best, share, strict=True):
                lang[d], score[d] = self.model.langs[j], float(min(1.0, s))
        return lang, score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs."""
    held = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(opened(held))
        for b in batches:
            for part in _slices(b):
                lang, score = tagger.label(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _slices(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text."""
    size = np.array([x.as_buffer().size if x.is_valid else 0 for x in b.column(2)])
    for lo, hi in kernels._runs(size, most):
        yield b.slice(lo, hi - lo)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is unknown or unsure; the decision is made in the same pass."""
    held, names = shared(docs.sparkSession, model), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(opened(held))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lang, score = tagger.label(part.column(at).to_pylist())
                yield part.filter(pa.array([l != "und" and s >= least for l, s in zip(lang, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
