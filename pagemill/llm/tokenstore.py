"""A content-addressed store of token ids.

Texts are encoded and each document's id stream is cut where a rolling hash of the last ids says so, so equal passages
give equal chunks wherever they stand. The store is a folder of three Parquet tables:

- ``chunks``: every different chunk once, under the hash of its bytes (ids as little-endian integers of ``width`` bytes);
- ``recipes``: by ascending doc_id, in blocks: a document's chunk hashes and sizes, its place in the block, and the hash
  of all that (a Merkle leaf), with the number of ids after each chunk;
- ``manifest``: of each block its documents, ids and Merkle root;
- ``root``: documents, ids and the Merkle root over all blocks.

Reading verifies chunks against their addresses, blocks against their roots and the manifest against the root over all. The CRC of a document is put together
from the CRCs of its chunks, each moved by the bytes that follow it, which is a sum in any order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import drop_path, map_batches, saved, scratch, sized

WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
WIDTH, END_ID = 2, 0
#: Documents of a block, about.
BLOCK_DOCS = 50_000
#: Characters that are encoded together, about.
TOGETHER = 12_000_000
#: Words remembered by a process; beyond it they are forgotten.
REMEMBERED = 1_500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizer with a memory of words.

    The pre-tokenizer always splits before a single space or newline between other characters, so words between them are
    encoded on their own and remembered. It also splits between a letter or digit and the comma or full stop after it,
    so those are cut off too, unless the text has one after something else. A text with any other white space is encoded
    whole. A word of letters is one piece of the pre-tokenizer, so it goes to the tokenizer's model as it is.
    """

    #: a comma or full stop after something that is neither letter nor digit
    STOPS = re.compile(r"[.,](?<=[\W_].)")
    #: what keeps a text from being cut: white space in a row, other white space, the memory's mark, special tokens
    ODD = ("  ", "\n\n", " \n", "\n ", "\x00", "<|", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
    ODD_ASCII = tuple(c for c in ODD if c.isascii())

    #: how the pre-tokenizer cuts a printable ASCII word and the space before it
    PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")
    #: how byte-level models write the bytes from 128 on that are no printable Latin-1 characters
    BYTES = {b: 0x100 + 33 + i for i, b in enumerate([*range(0x7F, 0xA1), 0xAD])}

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 8 * WIDTH:
            raise ValueError("ids do not fit the store's width")
        self.model = self.tokenizer.model
        self.newline = self._ids(["\n"])[0][0]
        self._forget()

    def _forget(self) -> None:
        """``known`` numbers the words; the ids of word k are ``size[k]`` of ``ids`` from ``start[k]`` on."""
        self.known: dict[str, int] = {"\n": 0, "\x00": 1}
        self.pieces: dict[str, list[int]] = {}
        self.ids = np.array([self.newline], f"<u{WIDTH}")
        self.start, self.size = np.array([0, 0]), np.array([1, 0])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{WIDTH}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Words of letters are one piece of the pre-tokenizer; other ASCII words are cut as it does, and their pieces, which
        come again and again, are remembered too. All others go through the whole tokenizer, many at once, one a line: a
        newline between other characters is a token of its own.
        """
        letters, plain, others = [], [], []
        for w in new:
            if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
                letters.append(w)
            else:
                (plain if w.isascii() and w.lstrip("\x00").isprintable() else others).append(w)
        cut = [self.PIECE.findall(w[1:] if w[0] == "\x00" else " " + w) for w in plain]
        for p in {p for ps in cut for p in ps}.difference(self.pieces):
            self.pieces[p] = self._of_model(p.replace(" ", "Ġ"))
        found = [self._of_model("Ġ" + w if w.isascii() else "Ġ" + w.encode().decode("latin-1").translate(self.BYTES)) for w in letters]
        found += [list(chain.from_iterable(map(self.pieces.__getitem__, ps))) for ps in cut]
        found += self._by_line([w[1:] if w[0] == "\x00" else " " + w for w in others])
        n = len(self.known)
        self.known.update(zip(chain(letters, plain, others), range(n, n + len(new)), strict=True))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), f"<u{WIDTH}")))
        self.size = np.concatenate((self.size, np.fromiter(map(len, found), np.int32, len(found))))
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def _of_model(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _by_line(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), 4096):
            ids = self._ids(["\n".join(words[at : at + 4096])])[0]
            ends = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
            if len(ends) != len(words[at : at + 4096]):
                raise ValueError("the tokenizer does not split at newlines")
            flat, start = ids.tolist(), 0
            for end in ends:
                out.append(flat[start:end])
                start = end + 1
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        at, size, lines = [], 0, []
        for i, text in enumerate(texts):
            if text and (text[0] in " \n" or text[-1] in " \n" or any([c in text for c in (self.ODD_ASCII if text.isascii() else self.ODD)])):
                out[i] = self._ids([text])[0].tobytes()
            elif text:
                at.append(i)
                line = "\x00" + text.replace("\n", " \n \x00")
                if not self.STOPS.search(text):
                    line = line.replace(", ", " \x00, ").replace(". ", " \x00. ")
                lines.append(line)
                size += len(text)
            if lines and (size >= TOGETHER or i == len(texts) - 1):
                for j, raw in zip(at, self._lines(lines), strict=True):
                    out[j] = raw
                at, size, lines = [], 0, []
        return out

    def _lines(self, lines: list[str]) -> Iterator[bytes]:
        """The ids of each line of words between single spaces."""
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        number = [self.known.get(w, -1) for w in words]
        new = [w for w, k in zip(words, number, strict=True) if k < 0]
        if new:
            self._learn(new)
            number = map(self.known.__getitem__, words)
        word = np.fromiter(number, np.int32, len(words))[coded.indices.to_numpy()]
        size = self.size[word]
        ends = np.cumsum(size, dtype=np.int64)
        place = np.repeat((self.start[word] - (ends - size)).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.ids[place]
        raw, stops = ids.tobytes(), np.concatenate(([0], ends))[split.offsets.to_numpy()].tolist()
        for s, e in zip(stops[:-1], stops[1:], strict=True):
            yield raw[WIDTH * s : WIDTH * e]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _gear(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each id, by the splitmix64 rule."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: where the rolling hash over WINDOW ids falls below 1 in MEAN, within LEAST and MOST."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h, span = _gear(ids), 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint64(span) if span < n else 0
        span *= 2
    found, last = [], 0
    for c in (np.flatnonzero(h < np.uint64((1 << 64) // MEAN)) + 1).tolist():
        while c - last > MOST:
            last += MOST
            found.append(last)
        if c - last >= LEAST and c < n:
            found.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        found.append(last)
    return [*found, n] if last < n else found


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Merkle:
    """The root over leaves that arrive one by one; keeps one hash a level. No leaves: the hash of nothing."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, held in enumerate(self.levels):
            if held is None:
                self.levels[i] = leaf
                return
            leaf = address(held + leaf)
            self.levels[i] = None
        self.levels.append(leaf)

    def root(self) -> bytes:
        out = None
        for held in self.levels:
            if held is not None:
                out = held if out is None else address(held + out)
        return out if out is not None else address(b"")


def leaf_of(doc_id: int | None, start: int, hashes: list[bytes], sizes: list[int]) -> bytes:
    return address(repr((doc_id, start, sizes)).encode() + b"".join(hashes))


# CRC-32: multiplying by x^(8 * 2^k) modulo the polynomial, as the images of the 32 single bits
def _shifters(count: int = 40) -> np.ndarray:
    def times(m: np.ndarray, v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= int(m[i])
        return out

    one = np.array([0xEDB88320, *[1 << i for i in range(31)]], np.uint64)
    op = one
    for _ in range(3):
        op = np.array([times(op, int(v)) for v in op], np.uint64)
    out = []
    for _ in range(count):
        out.append(op)
        op = np.array([times(op, int(v)) for v in op], np.uint64)
    return np.array(out)


_SHIFTERS = _shifters()


def crc_moved(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The part of a chunk's CRC in the CRC of a stream in which ``following`` bytes come after it."""
    crc = crc.astype(np.uint64)
    for k in range(int(following.max()).bit_length() if len(following) else 0):
        on = np.flatnonzero(following >> k & 1)
        v, out = crc[on], np.zeros(len(on), np.uint64)
        for i in range(32):
            out ^= np.where(v >> np.uint64(i) & np.uint64(1), _SHIFTERS[k, i], np.uint64(0))
        crc[on] = out
    return crc


@dataclass
class Store:
    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def blocks(self, spark: SparkSession) -> list:
        """The rows of the manifest, one for each block, in order."""
        return self.table(spark, "manifest").orderBy("block").collect()


def _stage(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        met: set[bytes] = set()  # chunks that this task has passed on already
        for b in _larger(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            hashes, sizes, bodies, n = [], [], [], []
            for raw in enc.encode_all(texts):
                raw += END_ID.to_bytes(WIDTH, "little")
                ends = cuts(np.frombuffer(raw, f"<u{WIDTH}"))
                parts = [raw[WIDTH * s : WIDTH * e] for s, e in zip([0, *ends], ends)]
                own = [address(p) for p in parts]
                hashes.append(own)
                sizes.append([len(p) // WIDTH for p in parts])
                n.append(ends[-1])
                new = {}
                for h, p in zip(own, parts, strict=True):
                    if h not in met:
                        met.add(h)
                        new[h] = p
                bodies.append([{"hash": h, "ids": p} for h, p in new.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(bodies, pa.list_(pa.struct([("hash", pa.binary()), ("ids", pa.binary())])))],
                names=["doc_id", "n_tokens", "hashes", "sizes", "bodies"],
            )

    return run


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about TOGETHER bytes at least, so that a word is looked up once for many texts."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one block in order, then a row (at -1) with the block's documents, ids and Merkle root."""
    from pyspark import TaskContext

    block, at, start, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
    names = ["block", "at", "doc_id", "start", "n_tokens", "hashes", "sizes", "after", "leaf"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        rows = []
        for doc_id, n, hashes, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            leaf = leaf_of(doc_id, start, hashes, sizes)
            tree.add(leaf)
            rows.append((block, at, doc_id, start, n, hashes, sizes, n - np.cumsum(sizes, dtype=np.int64), leaf))
            at, start = at + 1, start + n
        if rows:
            yield batch(rows)
    if at:
        yield batch([(block, -1, None, at, start, [], [], [], tree.root())])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, blocks: int | None = None) -> Store:
    """Encode ``docs`` (doc_id, text) into a new store at ``path``; null texts are empty, every document ends with END_ID.

    Repeated rows are documents of their own, in order of id and then content; null ids come first. An empty table gives
    an empty store. The encoded rows are written once and dropped when chunks and recipes are made from them.
    """
    spark = docs.sparkSession
    staged_path = f"{path}/staged"
    schema = "doc_id bigint, n_tokens bigint, hashes array<binary>, sizes array<int>, bodies array<struct<hash: binary, ids: binary>>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    map_batches(rows, _stage(tokenizer or default_tokenizer()), schema).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    staged.select(F.inline("bodies")).dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    n = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-staged.count() // BLOCK_DOCS))
    ordered = staged.select("doc_id", "n_tokens", "hashes", "sizes").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("hashes").cast("array<string>"))
    schema = "block bigint, at bigint, doc_id bigint, start bigint, n_tokens bigint, hashes array<binary>, sizes array<int>, after array<bigint>, leaf binary"
    map_batches(ordered, _blocks, schema).write.parquet(f"{path}/recipes")
    rows = spark.read.parquet(f"{path}/recipes").filter("at = -1")
    rows.select("block", F.col("start").alias("n_docs"), "n_tokens", F.col("leaf").alias("root")).coalesce(1).write.parquet(f"{path}/manifest")
    store = Store(path)
    spark.createDataFrame([_over_all(store.blocks(spark))], "n_docs bigint, n_tokens bigint, root binary").coalesce(1).write.parquet(f"{path}/root")
    drop_path(spark, staged_path)
    return store


def _over_all(blocks: list) -> tuple[int, int, bytes]:
    tree = Merkle()
    for b in blocks:
        tree.add(address(repr((b.block, b.n_docs, b.n_tokens)).encode() + bytes(b.root)))
    return sum(b.n_docs for b in blocks), sum(b.n_tokens for b in blocks), tree.root()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, bodies = b.column(0).to_pylist(), b.column(1).to_pylist()
        for h, body in zip(hashes, bodies, strict=True):
            if address(body) != h:
                raise ValueError(f"chunk {h.hex()} does not have the content of its address")
        wide = [np.frombuffer(x, f"<u{WIDTH}").astype("<u4").tobytes() for x in bodies]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in wide], pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64())], names=["hash", "n", "crc"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = crc_moved(b.column(4).to_numpy(zero_copy_only=False), 4 * b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(crc.astype(np.int64))], names=["block", "at", "n", "crc"])


def check_blocks(store: Store, spark: SparkSession) -> DataFrame:
    """(block, sound) of the manifest: whether the recipes of the block, in order, give its root and counts."""

    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, docs, ids, good, root = Merkle(), 0, 0, True, None
        for b in tables:
            for r in b.to_pylist():
                if r["at"] < 0:
                    root = (r["leaf"], r["start"], r["n_tokens"])
                    continue
                good &= leaf_of(r["doc_id"], r["start"], r["hashes"], r["sizes"]) == r["leaf"] and r["at"] == docs and r["start"] == ids and sum(r["sizes"]) == r["n_tokens"]
                good &= r["after"] == (r["n_tokens"] - np.cumsum(r["sizes"], dtype=np.int64)).tolist()
                tree.add(r["leaf"])
                docs, ids = docs + 1, ids + r["n_tokens"]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([good and root == (tree.root(), docs, ids)], pa.bool_())], names=["block", "sound"])

    rows = store.table(spark, "recipes")
    return map_batches(rows.repartition("block").sortWithinPartitions("block", "at"), _by_block(run), "block bigint, sound boolean")


def _by_block(run):
    """Streams rows that are in order of block through ``run``, one block at a time."""

    def all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            blocks = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if now is not None and blocks[s] != now:
                    yield from run((pa.scalar(int(now)),), iter(held))
                    held = []
                now = blocks[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from run((pa.scalar(int(now)),), iter(held))

    return all_blocks


def documents(store: Store, spark: SparkSession) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the store.

    start counts the ids of all documents before; n_tokens and ids_crc32 (ids as little-endian unsigned 32-bit integers)
    come from the chunks. A chunk that is missing or wrong, or a block that does not give its Merkle root, raises.
    """
    manifest, root = store.blocks(spark), store.table(spark, "root").first()
    if (root.n_docs, root.n_tokens, bytes(root.root)) != _over_all(manifest):
        raise ValueError("the manifest does not match the root over all blocks")
    bad = check_blocks(store, spark).filter("not sound").count()
    if bad:
        raise ValueError(f"{bad} blocks do not match their manifest")
    offsets, total = [], 0
    for m in manifest:
        offsets.append((m.block, total))
        total += m.n_tokens
    recipes = store.table(spark, "recipes").filter("at >= 0")
    facts = saved(map_batches(store.table(spark, "chunks").select("hash", "ids"), _verified, "hash binary, n bigint, crc bigint"))
    refs = recipes.select("block", "at", F.posexplode("hashes").alias("pos", "hash"), "after").select("block", "at", "hash", F.get("after", F.col("pos")).alias("after"))
    parts = refs.join(facts, "hash", "left").select("block", "at", "after", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("bigint")).alias("n"), "crc")
    whole = map_batches(parts, _moved, "block bigint, at bigint, n bigint, crc bigint").groupBy("block", "at").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    found = recipes.select("block", "at", "doc_id", F.col("start").alias("in_block")).join(whole, ["block", "at"])
    bases = sized(spark.createDataFrame(offsets, "block bigint, base bigint"))
    return found.join(bases, "block").select("doc_id", (F.col("in_block") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(store: Store, spark: SparkSession) -> DataFrame:
    """(doc_id, ids array<int>) of every document, put together from its chunks."""
    refs = store.table(spark, "recipes").filter("at >= 0").select("block", "at", "doc_id", F.posexplode("hashes").alias("pos", "hash"))
    parts = refs.join(store.table(spark, "chunks"), "hash").groupBy("block", "at", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(b"".join(p["ids"] for p in ps), f"<u{WIDTH}").astype(np.int32) for ps in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(parts.select("doc_id", "parts"), run, "doc_id bigint, ids array<int>")


def store_documents(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read it back; see :func:`documents`."""
    spark = docs.sparkSession
    return documents(write(docs, scratch(spark, "token-store")), spark)
