"""Benchmark decontamination with a positional inverted index that is distributed by documents.

The index has a row for each segment of some hundred documents: its documents, its terms in byte order and, for each
term, the delta-coded positions of all its occurrences. Positions run through the segment, with a gap between documents
that no phrase crosses. A search takes the posting lists of a phrase's terms, starts at the rarest one of the segment
and intersects the others, each moved by its term's offset; what is left are exact phrase matches. Proximity matches
need only the rarest terms, by their counts in all segments, and let each stray from its place; all terms of a match are in
one document. Phrases that ask for the same rarest terms in the same places are sought once.

Segments are independent: building and searching move no postings between tasks, and a hot term or document is spread
over all segments that hold it. Phrases are broadcast in blocks of bounded size; the hits of all blocks are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, scratch

WINDOW = 13
#: Documents of a segment end when it has so many words; a longer document is a segment of its own.
SEGMENT_WORDS, SEGMENT_DOCS = 150_000, 20_000
#: Proximity: how many of the rarest terms must be near, and how far each may be from its place.
RARE_TERMS, SLOP = 3, 3
#: Free places between documents: no exact match has one, and the terms of a proximity match are sought within a document.
GAP = 1
#: Words of the benchmark that are searched for, and broadcast, at once.
BLOCK_WORDS = 1_000_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c in range(0x30, 0x3A) or c in range(0x61, 0x7B) or c >= 0x80 else 0x20 for c in range(256))

INDEX_SCHEMA = "doc_ids array<bigint>, n_words array<int>, terms array<binary>, counts array<int>, postings binary"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters, in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words one after the other; as :func:`words_of`, all texts at once."""
    n, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.py_buffer(np.frombuffer(_TO_WORDS, np.uint8)[data])
    cut = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), plain]))
    words, parts = cut.flatten(), np.diff(cut.offsets.to_numpy())
    full = pc.greater(pc.binary_length(words), 0)
    sizes = np.bincount(np.repeat(np.arange(n), parts)[full.to_numpy(zero_copy_only=False)], minlength=n)
    return sizes.astype(np.int64), words.filter(full)


def _row(ids: list[pa.Array], sizes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """The segment of documents of ``sizes`` words."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.uint16 if len(order) < 1 << 16 else np.int32)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    at = np.arange(len(code)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
    by = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=len(order)).astype(np.int32)
    placed, heads = at[by], np.cumsum(counts)[:-1]
    delta = np.diff(placed, prepend=0)
    delta[heads] = placed[heads]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    terms = coded.dictionary.take(pa.array(order)).cast(pa.binary())
    cols = [one(pa.concat_arrays(ids).cast(pa.int64())), one(pa.array(sizes, pa.int32())), one(terms), one(pa.array(counts)), pa.array([_pack(delta)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_ids", "n_words", "terms", "counts", "postings"])


def _pack(v: np.ndarray) -> bytes:
    """Each value's length in bytes (0 to 4, for 1, 2, 3, 4 and 8 bytes) in one stream, its low bytes in another."""
    v = v.astype("<i8")
    kind = np.searchsorted([1 << 8, 1 << 16, 1 << 24, 1 << 32], v, side="right").astype(np.uint8)
    wide = np.array([1, 2, 3, 4, 8])[kind]
    keep = np.arange(8)[None, :] < wide[:, None]
    return np.uint64(len(v)).tobytes() + kind.tobytes() + v.view(np.uint8).reshape(-1, 8)[keep].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    kind = np.frombuffer(raw, np.uint8, n, 8)
    wide = np.array([1, 2, 3, 4, 8])[kind]
    out = np.zeros((n, 8), np.uint8)
    out[np.arange(8)[None, :] < wide[:, None]] = np.frombuffer(raw, np.uint8, offset=8 + n)
    return out.view("<i8").ravel()


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The segments of ``docs`` (doc_id, text); every row is in one of them, also rows with null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, pa.Array]] = []
        n_docs = n_words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_docs, n_words
            if n_docs:
                yield _row([i for i, _, _ in held], np.concatenate([s for _, s, _ in held]), pa.concat_arrays([w for _, _, w in held]))
            held.clear()
            n_docs = n_words = 0

        for b in batches:
            sizes, words = _split(b.column(1))
            ends, first = np.cumsum(sizes), 0
            for i, n in enumerate(sizes.tolist()):
                if n_docs and (n_words + n > segment_words or n_docs >= SEGMENT_DOCS):
                    if i > first:
                        held.append(_slice(b.column(0), sizes, words, ends, first, i))
                    yield from flush()
                    first = i
                n_docs, n_words = n_docs + 1, n_words + n
            held.append(_slice(b.column(0), sizes, words, ends, first, b.num_rows))
        yield from flush()

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, INDEX_SCHEMA)


def _slice(ids: pa.Array, sizes: np.ndarray, words: pa.Array, ends: np.ndarray, first: int, last: int) -> tuple[pa.Array, np.ndarray, pa.Array]:
    start = int(ends[first] - sizes[first]) if first < last else 0
    return ids[first:last], sizes[first:last], words[start : int(ends[last - 1])] if first < last else words[:0]


class Phrases:
    """Phrases to search: all windows of ``window`` words of each item; an item of fewer words, but not none, is one."""

    def __init__(self, items: list[tuple[object, str | list[bytes] | None]], window: int = WINDOW):
        vocab: dict[bytes, int] = {}
        self.items: list[object] = []
        lists: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            codes = [vocab.setdefault(w, len(vocab)) for w in (text if isinstance(text, list) else words_of(text))]
            if not codes:
                continue
            if len(codes) > window:
                cuts = [tuple(codes[i : i + window]) for i in range(len(codes) - window + 1)]
            else:
                cuts = [tuple(codes)]
            self.items.append(item_id)
            for cut in cuts:
                lists.setdefault(cut, set()).add(len(self.items) - 1)
        self.vocab = sorted(vocab)
        rank = {vocab[w]: i for i, w in enumerate(self.vocab)}
        by_size: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for cut in lists:
            by_size[len(cut)].append(cut)
        #: by length: the phrases as ranks in vocab, and the items of each
        self.groups = [(n, np.array([[rank[c] for c in cut] for cut in cuts], np.int64), [sorted(lists[cut]) for cut in cuts]) for n, cuts in sorted(by_size.items())]


class _Postings:
    """One segment with the posting lists of the searched terms."""

    def __init__(self, row: dict[str, pa.Array], vocab: pa.Array, longest: int):
        self.sizes = row["n_words"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes + GAP)))
        counts = row["counts"].to_numpy(zero_copy_only=False).astype(np.int64)
        local = pc.fill_null(pc.index_in(vocab, value_set=row["terms"]), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(local >= 0)
        self.freq = np.zeros(len(vocab), np.int64)
        self.freq[known] = counts[local[known]]
        self.lists: dict[int, np.ndarray] = {}
        if len(known):
            delta, ends = _unpack(row["postings"].as_py()), np.cumsum(counts)
            self.lists = {r: np.cumsum(delta[ends[t] - counts[t] : ends[t]]) for r, t in zip(known.tolist(), local[known].tolist(), strict=True)}
        # which searched term is at a place: the bitmaps that the moved posting lists are intersected with
        self.place = np.full(int(self.base[-1]) + longest + 1, -1, np.int32)
        for r, p in self.lists.items():
            self.place[p] = r

    def exact(self, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number, starts) of the phrases, rows of ``terms``, that occur."""
        alive = np.flatnonzero((self.freq[terms] > 0).all(1))
        ranked = np.argsort(self.freq[terms[alive]], axis=1, kind="stable")
        for k, order in zip(alive.tolist(), ranked, strict=True):
            phrase = terms[k]
            start = self.lists[int(phrase[order[0]])] - order[0]
            start = start[start >= 0]
            for j in order[1:]:
                if not len(start):
                    break
                start = start[self.place[start + j] == phrase[j]]
            if len(start):
                yield k, start

    def near(self, asked: "Near", slop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number, places of the rarest term) of what is ``asked`` and found: all terms in one document, about in place."""
        for k in np.flatnonzero((self.freq[asked.terms] > 0).all(1)).tolist():
            at = self.lists[int(asked.terms[k, 0])]
            doc = self.doc_of(at)
            for t, moved in zip(asked.terms[k, 1:].tolist(), asked.moved[k, 1:].tolist(), strict=True):
                p = self.lists[t]
                lo = np.searchsorted(p, np.maximum(at + moved - slop, self.base[doc]))
                hi = np.searchsorted(p, np.minimum(at + moved + slop, self.base[doc] + self.sizes[doc] - 1), side="right")
                at, doc = at[lo < hi], doc[lo < hi]
                if not len(at):
                    break
            if len(at):
                yield k, at

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1


class Near:
    """What proximity asks of a group of phrases: their rarest terms, the first one's place and how far the others are moved
    from it, each different one once, with the phrases that ask it.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, rare: int):
        few = np.argsort(counts[terms], axis=1, kind="stable")[:, : rare if terms.shape[1] >= rare else 0]
        asked = np.concatenate((np.take_along_axis(terms, few, 1), few - few[:, :1]), 1) if few.shape[1] else np.empty((0, 2), np.int64)
        rows, self.of = np.unique(asked, axis=0, return_inverse=True)
        self.terms, self.moved = rows[:, : rows.shape[1] // 2], rows[:, rows.shape[1] // 2 :]
        self.weight = np.bincount(self.of, minlength=len(rows))


def _search(seg: _Postings, phrases: Phrases, slop: int, asked: list[Near]) -> tuple[np.ndarray, list[set[int]], np.ndarray]:
    """Of one segment: whether each place is hit; by document, the items that occur and the number of proximity matches."""
    n = len(seg.sizes)
    items, n_near, hit = [set() for _ in range(n)], np.zeros(n, np.int64), np.zeros(len(seg.place), bool)
    for (size, terms, owners), near in zip(phrases.groups, asked, strict=True):
        for k, at in seg.near(near, slop):
            np.add.at(n_near, seg.doc_of(at), near.weight[k])
        for k, start in seg.exact(terms):
            hit[(start[:, None] + np.arange(size)[None, :]).ravel()] = True
            for d in np.unique(seg.doc_of(start)).tolist():
                items[d].update(owners[k])
    return hit, items, n_near


def _counts(index: DataFrame, vocab: list[bytes]) -> np.ndarray:
    """How often each of ``vocab`` occurs in all segments; every task sends one row a term that it saw."""
    held = index.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.binary())
        total = np.zeros(len(known), np.int64)
        for b in batches:
            at = pc.index_in(b.column(0).flatten(), value_set=known)
            seen = at.is_valid()
            np.add.at(total, at.filter(seen).to_numpy(zero_copy_only=False), b.column(1).flatten().filter(seen).to_numpy(zero_copy_only=False))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "c"])

    out = np.zeros(len(vocab), np.int64)
    for term, c in map_batches(index.select("terms", "counts"), run, "term bigint, c bigint").groupBy("term").agg(F.sum("c")).collect():
        out[term] = c
    return out


def _asked(index: DataFrame, phrases: Phrases, rare: int) -> list[Near]:
    counts = _counts(index, phrases.vocab) if rare and phrases.vocab else np.zeros(len(phrases.vocab), np.int64)
    return [Near(terms, counts, rare) for _, terms, _ in phrases.groups]


def _segments(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[tuple[dict[str, pa.Array], _Postings]]:
    known, longest = pa.array(phrases.vocab, pa.binary()), max((n for n, _, _ in phrases.groups), default=0)
    for b in batches:
        for i in range(b.num_rows):
            row = {name: b.column(name)[i].values if name != "postings" else b.column(name)[i] for name in b.schema.names}
            yield row, _Postings(row, known, longest)


_COLUMNS = ("doc_ids", "n_words", "terms", "counts", "postings")


def search(index: DataFrame, phrases: Phrases, slop: int = SLOP, rare: int = RARE_TERMS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_near) of every indexed row.

    n_hit: words inside exact occurrences; items: sorted ids (as strings) of items that occur; n_near: proximity
    matches, where the ``rare`` rarest terms of a phrase, of all that is indexed, are within ``slop`` words of their
    places.
    """
    held = index.sparkSession.sparkContext.broadcast((phrases, _asked(index, phrases, rare)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = held.value
        for row, seg in _segments(batches, known):
            hit, items, n_near = _search(seg, known, slop, asked)
            n_hit = np.add.reduceat(hit.astype(np.int64), seg.base[:-1]) if len(seg.sizes) else n_near
            named = [sorted({str(known.items[i]) for i in found}) for found in items]
            yield pa.RecordBatch.from_arrays([row["doc_ids"], row["n_words"].cast(pa.int64()), pa.array(n_hit), pa.array(named, pa.list_(pa.string())), pa.array(n_near)], names=["doc_id", "n_words", "n_hit", "items", "n_near"])

    return map_batches(index.select(*_COLUMNS), run, "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, n_near bigint")


def matches(index: DataFrame, phrases: Phrases, slop: int = SLOP, rare: int = RARE_TERMS) -> DataFrame:
    """(doc_id, kind, item_id, word, n_words) of all matches: of an exact one its first word and length, of one by proximity
    the place of its rarest term and 1. An item has a row for each of its phrases that is found there.
    """
    held = index.sparkSession.sparkContext.broadcast((phrases, _asked(index, phrases, rare)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = held.value
        for row, seg in _segments(batches, known):
            ids = row["doc_ids"].to_pylist()
            for (size, terms, owners), near in zip(known.groups, asked, strict=True):
                found = [("exact", at, [known.items[i] for i in owners[k]], size) for k, at in seg.exact(terms)]
                for k, at in seg.near(near, slop):
                    found += [("near", at, [known.items[i] for i in owners[p]], 1) for p in np.flatnonzero(near.of == k).tolist()]
                rows = []
                for kind, at, named, n in found:
                    docs = seg.doc_of(at)
                    rows += [(ids[d], kind, str(item), w, n) for d, w in zip(docs.tolist(), (at - seg.base[docs]).tolist(), strict=True) for item in named]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "kind", "item_id", "word", "n_words"])

    return map_batches(index.select(*_COLUMNS), run, "doc_id bigint, kind string, item_id string, word bigint, n_words int")


def _spans(index: DataFrame, phrases: Phrases, slop: int, rare: int) -> DataFrame:
    """(segment, at, spans, items, n_near) of the documents with matches; spans are starts and ends of hit words in turn."""
    held = index.sparkSession.sparkContext.broadcast((phrases, _asked(index, phrases, rare)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = held.value
        for row, seg in _segments(batches, known):
            hit, items, n_near = _search(seg, known, slop, asked)
            turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
            cut = np.searchsorted(turns, seg.base)
            some = [d for d in range(len(items)) if items[d] or n_near[d]]
            spans = [turns[cut[d] : cut[d + 1]] - seg.base[d] for d in some]
            named = [sorted({str(known.items[i]) for i in items[d]}) for d in some]
            segment = pa.array(np.full(len(some), row["segment"][0].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([segment, pa.array(some, pa.int32()), pa.array(spans, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string())), pa.array(n_near[some], pa.int64())], names=["segment", "at", "spans", "items", "n_near"])

    return map_batches(index.select(*_COLUMNS, F.array("segment").alias("segment")), run, "segment bigint, at int, spans array<bigint>, items array<string>, n_near bigint")


def _merged(index: DataFrame, spans: DataFrame) -> DataFrame:
    """What :func:`search` returns, of the hits of several blocks: hit words are those of any block, ``n_near`` is the sum."""
    found = spans.groupBy("segment", "at").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.shiftright(F.size("spans"), 1) - 1), lambda i: F.struct(F.col("spans")[2 * i].alias("s"), F.col("spans")[2 * i + 1].alias("e"))))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(pairs, none, step)["n"]).otherwise(0)
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d")).select("segment", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("bigint").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = docs.join(found.select("segment", "at", n_hit.alias("n_hit"), "items", "n_near"), ["segment", "at"], "left")
    return joined.select("doc_id", "n_words", zero("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), zero("n_near"))


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The phrases of all ``benchmark`` texts in blocks of about ``block_words`` words; one block, if there are none.

    The driver holds a partition of the benchmark and a block. A longer text is cut into stretches that share a window.
    """
    items: list[tuple[object, list[bytes]]] = []
    size, some = 0, False
    for r in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(r.text)
        for at in range(0, max(1, len(words) - window + 1), block_words):
            part = words[at : at + block_words + window - 1]
            items.append((r.item_id, part))
            size += len(part)
            if size >= block_words:
                yield Phrases(items, window)
                items, size, some = [], 0, True
    if items or not some:
        yield Phrases(items, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_near, contaminated) of every row of ``docs`` against all ``benchmark`` texts.

    Null and empty texts have no words: a document has no hits, an item no window. Repeated items count once each by
    their id; repeated documents give repeated rows; an empty benchmark leaves all documents clean. A benchmark of any size
    is searched for, in blocks. A document is contaminated if hits are at least a twentieth of its words.
    """
    spark = docs.sparkSession
    path = scratch(spark, "positional-index")
    build_index(docs).withColumn("segment", F.monotonically_increasing_id()).write.parquet(path)
    index, blocks = spark.read.parquet(path), phrase_blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = search(index, first)
    else:
        hits = scratch(spark, "benchmark-hits")
        for block in chain((first, second), blocks):
            _spans(index, block, SLOP, RARE_TERMS).write.mode("append").parquet(hits)
        found = _merged(index, spark.read.parquet(hits))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def items_digest(items) -> "F.Column":
    return F.sha2(F.array_join(items, ","), 256)

