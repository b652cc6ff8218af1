"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint has two halves. If two fingerprints differ in at most 3 bits, one of their halves differs in at
most 1. The anchors of a half are the codewords of the perfect Hamming code of length 31 over its low 31 bits: covering
radius 1. Every half is sent to all anchors within 1 (radius) + 1 (threshold of the half) bits, that is its nearest
anchor ("home") and 15 more, so the home of one fingerprint also receives the other, and comparing the homes of each
anchor with everything there finds each link. Equal fingerprints are collapsed before, so copies cost one row.

An anchor with more than ``bucket_limit`` fingerprints is not compared: its fingerprints go through centres instead,
the exact way for dense groups. Two fingerprints within 3 bits have a centre within 1 bit of one and 2 of the other;
all fingerprints at a centre are connected as soon as one is within 1 bit, so each centre yields a star and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import connected_components, map_batches, saved

SEED = 42
BITS = 3


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned SimHash of the word shingles of ``text`` (null or without words: 0)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), SEED)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(w) - words + 1
    cut = zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    h = np.fromiter((digest(flat[i:j], SEED) for i, j in cut), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 32768):
        ones += np.unpackbits(h[at : at + 32768].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row of ``docs``; other columns are ignored, equal rows stay equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str | None, int] = {}
            out = np.empty(b.num_rows, np.uint64)
            for i, text in enumerate(b.column(1).to_pylist()):
                if (f := known.get(text)) is None:
                    f = known[text] = fingerprint(text, words)
                out[i] = f
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint")


def _syndromes(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the xor of the places (1 to 31) of the bits that are set."""
    s = np.zeros(len(half), np.uint64)
    for k in range(5):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1))
        s |= (np.bitwise_count(half & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return s


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor key, whether the anchor is its home) for all anchors that each fingerprint goes to."""
    idx, keys, homes = [], [], []
    at = np.arange(len(fp))
    one = np.uint64(1)
    for side in (0, 1):
        x = (fp >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)
        tag = np.uint64(side) << np.uint64(31)
        s = _syndromes(x)
        flip = np.where(s > 0, one << (np.maximum(s, one) - one), np.uint64(0))
        idx.append(at)
        keys.append((x ^ flip) | tag)
        homes.append(np.ones(len(fp), bool))
        for i in range(1, 32):
            j = s ^ np.uint64(i)
            pick = (s > 0) & (j > np.uint64(i))
            idx.append(at[pick])
            keys.append((x[pick] ^ np.uint64(1 << (i - 1)) ^ (one << (j[pick] - one))) | tag)
            homes.append(np.zeros(int(pick.sum()), bool))
    return np.concatenate(idx), np.concatenate(keys).astype(np.int64), np.concatenate(homes)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        i, key, home = anchors_of(fp)
        for at in range(0, len(i), 200_000):
            cut = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(fp[i[cut]].view(np.int64)), pa.array(home[cut])], names=["anchor", "fp", "home"])


def _forest(fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest fingerprint of each component among the links of homes with all others."""
    label = np.arange(len(fp))
    h = np.flatnonzero(home)
    links_a, links_b = [h[:0]], [h[:0]]
    for at in range(0, len(h), 256):
        a, b = np.nonzero(np.bitwise_count(fp[h[at : at + 256], None] ^ fp[None, :]) <= bits)
        links_a.append(h[at + a])
        links_b.append(b)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    pick = label != np.arange(len(fp))
    return fp[pick], fp[label[pick]]


def _compare(bits: int, limit: int):
    """Streams the anchors in order of their key; holds one anchor's fingerprints, ``limit`` at most, and a batch."""

    def emit(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k0, f0, h0 = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        over = None  # the anchor that went over the limit
        for b in _with_end(batches):
            if b is not None:
                k0 = np.concatenate((k0, b.column(0).to_numpy(zero_copy_only=False)))
                f0 = np.concatenate((f0, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
                h0 = np.concatenate((h0, b.column(2).to_numpy(zero_copy_only=False)))
                if not len(k0):
                    continue
                done = int(np.searchsorted(k0, k0[-1]))  # the last anchor may go on in the next batch
            else:
                done = len(k0)
            k, f, h = k0[:done], f0[:done], h0[:done]
            k0, f0, h0 = k0[done:], f0[done:], h0[done:]
            if len(k):
                first = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1))
                size = np.diff(np.concatenate((first, [len(k)])))
                if over is not None and k[0] == over:
                    yield emit(f[: size[0]], f[: size[0]], True)
                    first, size = first[1:], size[1:]
                big = size > limit
                for s, n in zip(first[big].tolist(), size[big].tolist(), strict=True):
                    yield emit(f[s : s + n], f[s : s + n], True)
                mid = (size > 48) & ~big
                for s, n in zip(first[mid].tolist(), size[mid].tolist(), strict=True):
                    yield emit(*_forest(f[s : s + n], h[s : s + n], bits), False)
                small = np.repeat((size > 1) & (size <= 48), size)
                last = np.repeat(first + size, size)
                i = np.flatnonzero(small) + (first[0] if len(first) else 0)
                last = last[small]
                for step in range(1, 48):
                    keep = i + step < last
                    i, last = i[keep], last[keep]
                    if not len(i):
                        break
                    j = i + step
                    near = (h[i] | h[j]) & (np.bitwise_count(f[i] ^ f[j]) <= bits) & (f[i] != f[j])
                    if near.any():
                        yield emit(f[i[near]], f[j[near]], False)
            over = None if not len(k0) or k0[0] != over else over
            if len(k0) > limit:  # one anchor only: pass its fingerprints on and hold none of them
                over = k0[0]
                yield emit(f0, f0, True)
                k0, f0, h0 = k0[:0], f0[:0], h0[:0]

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _to_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [np.uint64(1 << i) for i in range(64)]
    near = np.array([0, *one], np.uint64)
    far = np.array([a ^ b for a, b in combinations(one, 2)], np.uint64)
    flips = np.concatenate((near, far))
    within = np.arange(len(flips)) < len(near)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 64):
            part = fp[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.tile(within, len(part)))],
                names=["centre", "fp", "near"],
            )


def links(distinct: DataFrame, bucket_limit: int = 4096) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as all links of at most 3 bits do."""
    at = map_batches(distinct.select("fp"), _to_anchors, "anchor bigint, fp bigint, home boolean")
    found = saved(map_batches(at.repartition("anchor").sortWithinPartitions("anchor"), _compare(BITS, bucket_limit), "a bigint, b bigint, hot boolean"))
    hot = map_batches(found.filter("hot").select(F.col("a").alias("fp")).distinct(), _to_centres, "centre bigint, fp bigint, near boolean")
    star = hot.groupBy("centre").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b")).filter("b is not null")
    return found.filter("not hot").select("a", "b").unionByName(hot.join(star, "centre").filter("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def components(docs: DataFrame, words: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most 3 differing bits reach.

    Null or empty texts have fingerprint 0 and are linked like any other. Rows with a null doc_id keep their
    fingerprint; they get the smallest doc_id of their component, null if it has none. Repeated rows give repeated
    rows; an empty table gives no rows. Other columns of ``docs`` are not touched.
    """
    marked = saved(fingerprints(docs, words))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(links(distinct, bucket_limit))
    least = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_root = least.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = least.join(of_root, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
