"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces and scores of a model file.

The segmentation of a text is the one with the largest sum of piece scores. For a model of type BPE, such as the default
one, that is not the encoding of the library, which merges by rank (figures in the README). The search keeps a window of the last
``longest piece`` characters. Once all surviving back-pointer paths of the window pass through one boundary, nothing to
come can change what lies before it: its ids are committed and the window moves up. Where no piece of the vocabulary
spans a boundary (before a word mark that follows something else; around characters that no longer piece holds) all
paths meet for certain, so stretches between such boundaries that have not been met before are streamed one after the
other through one search, and the ids of each are remembered, up to a bound.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches

MARK = "▁"
UNK_PENALTY = 10.0
#: Stretches remembered by a process; beyond it they are forgotten and the memory starts anew.
REMEMBERED = 600_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores, byte pieces and the bounds that follow from them."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        if n > 65_536:
            raise ValueError("ids beyond 65535 are not supported")
        self.byte_id = [-1] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        self.text_of: list[bytes] = [b""] * n
        self.unk = sp.unk_id()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.text_of[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = (i, sp.get_score(i))
                self.text_of[i] = piece.encode()
        self.longest = max(map(len, self.pieces))
        self.unk_score = min(s for _, s in self.pieces.values()) - UNK_PENALTY
        self.cut_at_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.cut_at_newlines = not any("\n" in p for p in self.pieces if len(p) > 1)
        #: a character that no longer piece holds, so that all paths meet before and after it
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        self.divider = next(c for c in map(chr, range(0x110000)) if c not in inside)
        #: the pieces by their characters: what follows (none at the end of a branch), id (-1: no piece ends here) and score
        self.tree: dict[str, list] = {}
        for piece, found in self.pieces.items():
            kids = self.tree
            for c in piece[:-1]:
                node = kids.setdefault(c, [None, -1, 0.0])
                node[0] = kids = {} if node[0] is None else node[0]
            kids.setdefault(piece[-1], [None, -1, 0.0])[1:] = found

    def unknown(self, char: str) -> list[int]:
        ids = [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unk] if min(ids) < 0 else ids


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def stream(chunks: Iterable[str], v: Vocabulary) -> Iterator[list[int]]:
    """Commits lists of ids while ``chunks`` of marked text arrive; holds no more than a window of them at most times.

    Ties: the longer last piece wins, as in the library. Characters in no piece become their UTF-8 byte pieces.
    """
    return (ids for ids, _ in search(chunks, v))


def search(chunks: Iterable[str], v: Vocabulary) -> Iterator[tuple[list[int], list[int]]]:
    """The ids of :func:`stream` and, for each, where its piece ends in all that has been sent."""
    text, gone = "", 0  # from the last committed boundary on, and what came before it
    score, back, piece = [0.0], [0], [-1]  # by end: best score, start of its last piece, id (-1: unknown)
    todo = 0  # the next start whose pieces are laid out
    tree, unk, most, none = v.tree, v.unk_score, v.longest, -np.inf

    def trace(end: int) -> tuple[list[int], list[int]]:
        ids, ends = [], []
        while end:
            own = [piece[end]] if piece[end] >= 0 else v.unknown(text[back[end] : end])[::-1]
            ids += own
            ends += [gone + end] * len(own)
            end = back[end]
        return ids[::-1], ends[::-1]

    def lay(stop: int) -> None:
        size = len(text)
        more = size + 1 - len(score)
        score.extend([none] * more)
        back.extend([0] * more)
        piece.extend([-1] * more)
        for start in range(todo, stop):
            here, at, node = score[start], start + 1, tree.get(text[start])
            if (node is None or node[1] < 0) and here + unk > score[at]:
                score[at], back[at], piece[at] = here + unk, start, -1
            while node is not None:
                kids, own, more = node
                if own >= 0 and here + more > score[at]:
                    score[at], back[at], piece[at] = here + more, start, own
                if kids is None or at == size:
                    break
                node = kids.get(text[at])
                at += 1

    def converged() -> int:
        """The last boundary on all paths that reach the ends still open: todo and those laid out beyond it."""
        ends = {e for e in range(todo, len(score)) if score[e] > none}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(back[far])
        return ends.pop()

    for chunk in chunks:
        for at in range(0, len(chunk), 4 * most):
            text += chunk[at : at + 4 * most]
            if len(text) - most + 1 > todo:
                lay(len(text) - most + 1)
                todo = len(text) - most + 1
            if todo >= 2 * most and (at_ := converged()) > 0:
                yield trace(at_)
                base = score[at_]
                score, back, piece = [s - base for s in score[at_:]], [max(0, b - at_) for b in back[at_:]], piece[at_:]
                text, todo, gone = text[at_:], todo - at_, gone + at_
                back[0], piece[0] = 0, -1
    lay(len(text))
    if text:
        yield trace(len(text))


class Encoder:
    """Encodes and decodes whole texts; remembers the ids of stretches between certain boundaries."""

    #: Characters up to which a stretch is remembered.
    SHORT = 48

    def __init__(self, model_file: str):
        self.v = vocabulary(model_file)
        self.known: dict[str, bytes] = {"": b""}
        self.cuts = re.compile(f"(?<=[^{MARK}])(?={MARK})" + ("|(?<=\n)|(?=\n)" if self.v.cut_at_newlines else ""))

    def _parts(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if not self.v.cut_at_marks:
            return [marked]
        if MARK + MARK in marked or "\x00" in marked:
            return self.cuts.split(marked)
        # the same cuts, without look-around
        return (marked.replace("\n", "\x00\n\x00") if self.v.cut_at_newlines else marked).replace(MARK, "\x00" + MARK).split("\x00")

    def _learn(self, new: set[str]) -> None:
        """Streams the stretches one after the other, each with a character behind it that no longer piece holds."""
        sent = list(new)
        todo = iter(sent)
        stretch, end, ids = None, 0, []  # whose ids come next, and where it ends
        chunks = ("".join([s + self.v.divider for s in sent[at : at + 256]]) for at in range(0, len(sent), 256))
        for found, ends in search(chunks, self.v):
            at = 0
            while at < len(found):
                if stretch is None:
                    stretch = next(todo)
                    end += len(stretch)
                upto = bisect_right(ends, end, at)
                ids += found[at:upto]
                at = upto
                if at < len(found):  # the divider's ids
                    self.known[stretch] = np.array(ids, "<u2").tobytes()
                    stretch, end, ids = None, end + 1, []
                    at = bisect_right(ends, end, at)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers; null and empty texts have none."""
        out: list[bytes] = []
        parts: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            parts.append(self._parts(text) if text else [])
            size += len(text or "")
            if size >= 1_000_000 or i == len(texts) - 1:
                if len(self.known) > REMEMBERED:
                    self.known = {"": b""}
                new = {p for words in parts for p in words}.difference(self.known)
                self._learn(new)
                out += [b"".join(map(self.known.__getitem__, words)) for words in parts]
                for p in new:
                    if len(p) > self.SHORT:
                        del self.known[p]
                parts, size = [], 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``: marks are spaces again, without the one that encoding put in front."""
        raw = b"".join(map(self.v.text_of.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return raw.decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(model_file)
    return _ENCODERS[model_file]


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32, decoded) of every row.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; decoded says whether decoding gives the text
    back (a text that itself holds U+2581 comes back with spaces there). Null and empty texts have no ids. Only doc_id
    and text are read; repeated rows give repeated rows.
    """
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            coded = enc.encode_all(texts)
            sizes = np.array([len(c) // 2 for c in coded], np.int64)
            wide = [np.frombuffer(c, "<u2").astype("<u4") for c in coded]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate([np.empty(0, "<u4"), *wide]).astype(np.int32)))
            crc = pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64())
            same = pa.array([enc.decode(c) == (t or "") for c, t in zip(coded, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), ids, crc, same], names=["doc_id", "n_ids", "ids", "ids_crc32", "decoded"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_ids bigint, ids array<int>, ids_crc32 bigint, decoded boolean")
