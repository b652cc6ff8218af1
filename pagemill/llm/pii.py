"""Personal data: four patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans. The random field runs over the tokens that hold a digit, ``@`` or ``+`` (all others
are outside for certain, so they cut the chain without loss). Neighbouring tokens share transition potentials; tokens of
one document that are repeated or similar (same letters and digits) share agreement potentials, each occurrence with the
next, so the links grow with the tokens. Marginals come from loopy sum-product message passing over all documents of a
batch at once. The weights are fitted by pseudo-likelihood to the base labels of a bounded sample of documents; tokens
whose marginal for a kind is at least ``threshold`` and that no base span covers are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import hash_sample, learnable, map_batches

KINDS = ("email", "ip", "card", "phone")
#: Bound of the sample that weights are fitted to, in documents (twice that may be read).
SAMPLE_DOCS = 4000
THRESHOLD = 0.6
ROUNDS = 8
#: Share of the tokens whose features are withheld from the fit: the base label of a token follows from its features, so
#: only where they are missing can the fit learn what neighbours and repeats say.
WITHHELD = 0.3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\s]*[0-9@+][^\s]*")
_MARKED = re.compile(r"[0-9@+]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NOT_ALNUM = re.compile(r"[\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns: leftmost, not overlapping within a kind, failing matches dropped.

    Equal to scanning with the patterns, but in time linear in the text: the local part of an address is found from its
    ``@``, numbers with dots are taken whole and cut into fours.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((0, start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, pos = m.group().split("."), m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                found.append((1, pos, pos + size))
            pos += size + 1
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found)


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the runs without white space that hold a digit, ``@`` or ``+``, in linear time."""
    out, end = [], 0
    m = _MARKED.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append((start, end))
        m = _MARKED.search(text, end)
    return out


FEATURES = (
    "bias", "address", "at_only", "plus_first", "plus_other", "octets", "dotted_four", "card_luhn", "card_length", "phone_length", "digits_1_3", "digits_4_6", "digits_7_9", "digits_10_15",
    "digits_20", "parens", "hyphen", "letters", "letters_only_end", "quote_or_equals", "group_of_four", "before_plus", "before_parens", "after_cue",
)


def _features(text: str, start: int, end: int, before: str) -> list[float]:
    t = text[start:end]
    core = t.strip(".,;:!?\"'()[]{}<>*#$%&|")
    digits = _NOT_DIGIT.sub("", t) if len(t) < 200 else ""
    n, letters = len(digits), any(c.isalpha() for c in core[:200])
    dotted = core.count(".") == 3 and all(_DIGITS.fullmatch(x) for x in core.split("."))
    octets = dotted and all(len(x) <= 3 and int(x) <= 255 for x in core.split(".")) if len(core) < 32 else False
    at = "@" in core
    address = at and "." in core.rpartition("@")[2]
    only = not letters and not at
    return [
        1, address, at and not address, t.startswith("+") and n > 0, "+" in t[1:], octets, dotted and not octets, only and 16 <= n <= 19 and luhn(digits), only and 16 <= n <= 19, only and 8 <= n <= 15 and t.startswith("+"), only and 1 <= n <= 3, only and 4 <= n <= 6, only and 7 <= n <= 9, only and 10 <= n <= 15,
        n >= 20, "(" in t or ")" in t, only and "-" in core, letters and not at, letters and not at and core[:1].isalpha(), '"' in t or "=" in t, only and n == 4 and len(core) == 4, before.startswith("+"), before.startswith("("), before[-1:] in ":=",
    ]


@dataclass
class Graph:
    """Tokens of many documents: features, document, place, chain links and skip links (pairs of token numbers)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph_of(texts: list[str]) -> Graph:
    doc, start, end, x, chain, skip = [], [], [], [], [], []
    for d, text in enumerate(texts):
        last: dict[str, int] = {}
        prev_end, before = -2, ""
        for s, e in tokens_of(text):
            i = len(doc)
            adjacent = prev_end >= 0 and s - prev_end == 1 and text[prev_end] == " "
            if adjacent:
                chain.append((i - 1, i))
            else:
                before = text[max(0, s - 12) : s].strip().rpartition(" ")[2]
            key = _NOT_ALNUM.sub("", text[s:e]).lower()
            if len(key) >= 3:
                if key in last:
                    skip.append((last[key], i))
                last[key] = i
            doc.append(d)
            start.append(s)
            end.append(e)
            x.append(_features(text, s, e, before))
            prev_end, before = e, text[s : min(e, s + 40)]
    pairs = lambda v: np.array(v, np.int64).reshape(-1, 2)
    return Graph(np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(x, np.float64).reshape(-1, len(FEATURES)), pairs(chain), pairs(skip))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


@dataclass
class Field:
    """Weights by feature and label (0: outside, then KINDS), transitions, and the agreement of skip links."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product, all messages at once in each round, damped by a half."""
        u = g.x @ self.unary
        pairs = np.concatenate((g.chain, g.skip))
        if not len(pairs):
            return _softmax(u)
        a = np.concatenate((pairs[:, 0], pairs[:, 1]))
        b = np.concatenate((pairs[:, 1], pairs[:, 0]))
        n, back = len(pairs), np.r_[len(pairs) : 2 * len(pairs), 0 : len(pairs)]
        kind = np.arange(2 * n) % n < len(g.chain)
        forward = np.where(kind[:n, None, None], self.chain, self.skip)
        pot = np.exp(np.concatenate((forward, forward.transpose(0, 2, 1))))
        m = np.zeros((2 * n, u.shape[1]))
        for _ in range(rounds):
            belief = u.copy()
            np.add.at(belief, b, m)
            z = belief[a] - m[back]
            z = np.log(np.einsum("ei,eij->ej", np.exp(z - z.max(1, keepdims=True)), pot))
            m = 0.5 * m + 0.5 * (z - z.mean(1, keepdims=True))
        belief = u.copy()
        np.add.at(belief, b, m)
        return _softmax(belief)


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood fit to the base labels of ``texts``; without tokens all weights are zero but for outside."""
    k = len(KINDS) + 1
    field = Field(np.zeros((len(FEATURES), k)), np.zeros((k, k)), np.zeros((k, k)))
    field.unary[0, 0] = 2.0
    g = graph_of(texts)
    if not len(g.doc):
        return field
    y = _labels(texts, g)
    one, x = np.eye(k)[y], g.x.copy()
    x[np.random.default_rng(1).random(len(x)) < WITHHELD, 1:] = 0
    state = [np.zeros_like(w) for w in (field.unary, field.chain, field.skip)]
    for _ in range(steps):
        z = x @ field.unary
        np.add.at(z, g.chain[:, 1], field.chain[y[g.chain[:, 0]]])
        np.add.at(z, g.chain[:, 0], field.chain[:, y[g.chain[:, 1]]].T)
        np.add.at(z, g.skip[:, 1], field.skip[y[g.skip[:, 0]]])
        np.add.at(z, g.skip[:, 0], field.skip[:, y[g.skip[:, 1]]].T)
        r = one - _softmax(z)
        grads = [x.T @ r]
        for links in (g.chain, g.skip):
            w = np.zeros((k, k))
            np.add.at(w, y[links[:, 0]], r[links[:, 1]])
            np.add.at(w.T, y[links[:, 1]], r[links[:, 0]])
            grads.append(w)
        for i, (w, grad) in enumerate(zip((field.unary, field.chain, field.skip), grads, strict=True)):
            grad = grad / len(y) - decay * w
            state[i] += grad**2
            w += rate * grad / (np.sqrt(state[i]) + 1e-8)
    field.skip = np.maximum(field.skip, 0) * np.eye(k)  # links only ever ask for agreement
    return field


def _labels(texts: list[str], g: Graph) -> np.ndarray:
    """Of each token: the kind of the first base span that overlaps it, or outside."""
    y = np.zeros(len(g.doc), np.int64)
    first = np.searchsorted(g.doc, np.arange(len(texts) + 1))
    for d, text in enumerate(texts):
        if first[d] < first[d + 1]:
            own = slice(first[d], first[d + 1])
            for kind, s, e in reversed(base_spans(text)):
                y[own][(g.start[own] < e) & (g.end[own] > s)] = kind + 1
    return y


_EDGES = " .,;:!?\"'[]{}<>*#$%&|=\\/"


def find(texts: list[str], field: Field, threshold: float = THRESHOLD) -> list[list[tuple[int, int, int, bool]]]:
    """Of each text: (kind, start, end, base), by kind and start; spans that are not base touch no base span."""
    out = [[(*s, True) for s in base_spans(t)] for t in texts]
    g = graph_of(texts)
    if not len(g.doc):
        return out
    p = field.marginals(g)
    best = p[:, 1:].argmax(1)
    taken = _labels(texts, g) > 0
    pick = np.flatnonzero((p[np.arange(len(p)), best + 1] >= threshold) & ~taken)
    linked = set(g.chain[:, 1].tolist())
    runs: list[list[int]] = []
    for i in pick.tolist():
        if runs and runs[-1][-1] == i - 1 and i in linked and best[i] == best[i - 1]:
            runs[-1].append(i)
        else:
            runs.append([i])
    for run in runs:
        d, s, e = int(g.doc[run[0]]), int(g.start[run[0]]), int(g.end[run[-1]])
        text = texts[d]
        while s < e and text[s] in _EDGES:
            s += 1
        while e > s and text[e - 1] in _EDGES:
            e -= 1
        if s < e:
            out[d].append((int(best[run[0]]), s, e, False))
    return [sorted(v) for v in out]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def fit_on(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field fitted to a bounded sample of ``docs``, of texts of LEARNT_CHARS at most; an empty table gives one that adds nothing."""
    rows = hash_sample(docs.select("doc_id", "text").filter(learnable(F.col("text"))), sample_docs).collect()
    return fit([r.text for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))])


def detect(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Null and empty texts have no spans. Offsets are code points of the whole text. Only doc_id and text are read, so
    columns of clashing names do no harm; repeated rows give repeated rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find([t or "" for t in b.column(1).to_pylist()], held.value, threshold)
            base = [[s[:3] for s in v if s[3]] for v in found]
            counts = [pa.array([sum(s[0] == k for s in v) for v in base], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(digest(v).encode()).hexdigest() for v in base], pa.string())
            spans = pa.array([digest([s[:3] for s in v]) for v in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, spans, pa.array([sum(not s[3] for s in v) for v in found], pa.int64())], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by the kind of its first one in angle brackets."""
    out, at, reach = [], 0, -1
    for s, e, k in sorted((s, e, k) for k, s, e, _ in spans):
        if s >= reach:
            out += [text[at : max(s, at)], f"<{KINDS[k].upper()}>"]
        reach = max(reach, e)
        at = reach
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data masked in ``text``; ``n_chars`` (if there) follows, null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    schema = docs.schema
    at, n_at = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = find([t or "" for t in texts], held.value, threshold)
            new = [t if t is None else masked(t, v) for t, v in zip(texts, found, strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if n_at >= 0:
                old = b.column(n_at).to_pylist()
                cols[n_at] = pa.array([o if t is None else len(t) for o, t in zip(old, new, strict=True)], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_batches(docs, run, schema)
