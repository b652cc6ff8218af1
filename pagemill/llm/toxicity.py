"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first 4 to 7 bytes (so that forms of one stem
share weights). Filters of several widths slide over the whole text, the maximum over all places is kept, and a logistic
layer gives the score. Gradients go back through the places of the maxima only. For scoring, what each filter place
makes of a word is computed once per word and remembered, so a text costs one table row a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import labelled_sample, map_batches
from pagemill.llm.decontam import words_of

BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 15, 16, (1, 2, 3), 8, (4, 5, 6, 7)
#: Bound of the labelled sample, in documents (twice that may be read).
SAMPLE_DOCS = 6_000
#: One in so many labelled rows is kept apart to find the thresholds.
CALIBRATED = 5
EPOCHS, BATCH, RATE = 5, 32, 0.01
THRESHOLD = 0.3
#: Words remembered by a process; beyond it they are forgotten.
REMEMBERED = 200_000

_COLS = sum(WIDTHS) * FILTERS


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself, and its stems where they are shorter than the word."""
    out = [zlib.crc32(word) % BUCKETS]
    for n in STEMS:
        out.append(zlib.crc32(b"%d:" % n + word[:n]) % BUCKETS if len(word) > n else BUCKETS)
    return out


@dataclass
class Net:
    """Embeddings (the last row is all zero), filters side by side by width and place, their biases, the output layer."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> "Net":
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        emb[-1] = 0
        return cls(emb, rng.normal(0, 0.3, (DIM, _COLS)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, len(WIDTHS) * FILTERS), np.full(1, -1.0))

    def rows(self, feats: np.ndarray) -> np.ndarray:
        # not by matrix product, whose last digits depend on how many words are asked for at once
        return np.einsum("nd,dc->nc", self.emb[feats].sum(1), self.conv)

    def pool(self, table: np.ndarray, ids: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of all filters over a text given as rows of ``table``, and their places; short texts are padded."""
        p = table[ids] if len(ids) >= max(WIDTHS) else np.concatenate((table[ids], np.zeros((max(WIDTHS) - len(ids), _COLS), table.dtype)))
        p = np.ascontiguousarray(p.T)
        best, place, at = [], [], 0
        for w in WIDTHS:
            n = p.shape[1] - w + 1
            z = p[at : at + FILTERS, :n]
            for o in range(1, w):
                z = z + p[at + o * FILTERS : at + (o + 1) * FILTERS, o : o + n]
            if places:
                k = z.argmax(1)
                place.append(k)
                best.append(z[np.arange(FILTERS), k])
            else:
                best.append(z.max(1))
            at += w * FILTERS
        return np.concatenate(best), np.concatenate(place) if places else None

    def score(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(pooled + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip((h * self.out).sum(-1) + self.out_bias, -40, 40)))


def train(texts: list[str], y: list[int], epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam on the cross entropy; without labels of both kinds the score is the share of label 1."""
    net = Net.fresh(seed)
    share = (sum(y) + 0.5) / (len(y) + 1)
    if not 0 < sum(y) < len(y):
        net.out[:] = 0
        net.out_bias[:] = np.log(share / (1 - share))
        return net
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int64) for t in texts]
    feats = np.array([features(w) for w in vocab], np.int64).reshape(-1, 1 + len(STEMS))
    target, rng = np.array(y, np.float64), np.random.default_rng(seed)
    params = [net.emb, net.conv, net.bias, net.out, net.out_bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    spans = [(i, w, sum(WIDTHS[:i]) * FILTERS) for i, w in enumerate(WIDTHS)]
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            used, where = np.unique(np.concatenate([docs[d] for d in batch] or [np.empty(0, np.int64)]), return_inverse=True)
            x = net.emb[feats[used]].sum(1, dtype=np.float32)
            table = x @ net.conv
            cuts = np.cumsum([len(docs[d]) for d in batch])[:-1]
            ids = np.split(where, cuts)
            sizes = np.array([len(i) for i in ids])
            starts, padded = np.cumsum(sizes) - sizes, np.append(where, 0)
            got = [net.pool(table, i, True) for i in ids]
            pooled, place = np.array([g[0] for g in got]), np.array([g[1] for g in got])
            pre = pooled + net.bias
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -40, 40)))
            err = (p - target[batch]) / len(batch)
            gh = err[:, None] * net.out[None, :] * (pre > 0)
            gconv, gx = np.zeros_like(net.conv), np.zeros_like(x)
            for i, w, at in spans:
                for o in range(w):
                    at_ = place[:, i * FILTERS : (i + 1) * FILTERS] + o
                    inside = at_ < sizes[:, None]
                    rows = np.where(inside, padded[np.minimum(starts[:, None] + at_, len(padded) - 1)], -1)
                    g = gh[:, i * FILTERS : (i + 1) * FILTERS] * (rows >= 0)
                    c = slice(at + o * FILTERS, at + (o + 1) * FILTERS)
                    gconv[:, c] += np.einsum("bfd,bf->df", x[rows], g)
                    np.add.at(gx, rows.ravel(), (g[:, :, None] * net.conv[:, c].T[None]).reshape(-1, DIM))
            step += 1
            rate = RATE * min(1.0, step / 50) * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
            touched = np.flatnonzero(np.abs(gx).sum(1))
            index = feats[used[touched]]
            rows_, inv = np.unique(index, return_inverse=True)
            gemb = np.zeros((len(rows_), DIM))
            np.add.at(gemb, inv.reshape(index.shape), gx[touched][:, None, :])
            live = rows_ < BUCKETS
            rows_, gemb = rows_[live], gemb[live]
            for j, (prm, g) in enumerate(zip(params, (gemb, gconv + 1e-5 * net.conv, gh.sum(0), h.T @ err + 1e-5 * net.out, err.sum(keepdims=True)), strict=True)):
                k = rows_ if j == 0 else slice(None)
                m1[j][k] = 0.9 * m1[j][k] + 0.1 * g
                m2[j][k] = 0.999 * m2[j][k] + 0.001 * g * g
                prm[k] -= rate * (m1[j][k] / (1 - 0.9**step)) / (np.sqrt(m2[j][k] / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """A net with the words that this process has met."""

    def __init__(self, net: Net):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.empty((1024, _COLS), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a in range(0, len(texts), 256):
            words = [words_of(t) for t in texts[a : a + 256]]
            new = list({w for ws in words for w in ws}.difference(self.known))
            if len(self.known) + len(new) > REMEMBERED and self.known:
                self._forget()
                new = list({w for ws in words for w in ws})
            if new:
                n = len(self.known)
                while len(self.table) < n + len(new):
                    self.table = np.concatenate((self.table, np.empty_like(self.table)))
                self.table[n : n + len(new)] = self.net.rows(np.array([features(w) for w in new], np.int64))
                self.known.update(zip(new, range(n, n + len(new)), strict=True))
            get = self.known.__getitem__
            pooled = np.array([self.net.pool(self.table, np.fromiter(map(get, ws), np.int64, len(ws)))[0] for ws in words])
            out[a : a + 256] = self.net.score(pooled)
        return out


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """By language the threshold of the best F1, halfway to the next lower score; languages with under 5 of a label keep THRESHOLD."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        pick = np.array([x == lang for x in langs])
        s, t = scores[pick], y[pick]
        if min(t.sum(), len(t) - t.sum()) < 5:
            continue
        order = np.argsort(-s, kind="stable")
        tp = np.cumsum(t[order])
        f1 = 2 * tp / (np.arange(1, len(t) + 1) + t.sum())
        k = int(f1.argmax())
        low = s[order][k + 1] if k + 1 < len(t) else 0.0
        out[lang] = float((s[order][k] + low) / 2)
    return out


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> Net:
    """The net trained on labelled rows for which ``usable`` holds. Its thresholds by language are those of a net that was
    trained without every CALIBRATED-th of them, on just these.
    """
    rows = labelled_sample(docs, labels, "toxic", usable, sample_docs)
    apart = [zlib.crc32(f"calibrated {r.doc_id}".encode()) % CALIBRATED == 0 for r in rows]
    learnt, kept = ([r for r, a in zip(rows, apart, strict=True) if a == side] for side in (False, True))
    thresholds: dict[str, float] = {}
    if kept:
        other = train([r.text for r in learnt], [r.y for r in learnt])
        thresholds = calibrate(Scorer(other).scores([r.text for r in kept]), np.array([r.y for r in kept]), [r.lang for r in kept])
    net = train([r.text for r in rows], [r.y for r in rows])
    net.thresholds = thresholds
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, lang, score) of every row; null and empty texts get the score of a text without words.

    The score depends on the text alone; equal texts have equal scores wherever they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scorer.scores(b.column(2).to_pylist()), pa.float64())], names=["doc_id", "lang", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), run, "doc_id bigint, lang string, score double")


def flagged(lang: Column, value: Column, thresholds: dict[str, float]) -> Column:
    """Whether a score reaches the threshold of its row's language (THRESHOLD where none was calibrated)."""
    limit = F.lit(THRESHOLD)
    if thresholds:
        by = F.create_map(*[F.lit(x) for pair in sorted(thresholds.items()) for x in pair])
        limit = F.coalesce(F.element_at(by, lang), limit)
    return value >= limit
