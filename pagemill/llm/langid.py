"""Language ID by compression: the language whose zstandard raw-content dictionary encodes a text smallest.

For each learnt language a dictionary of raw text is put together from training documents; a whole text is compressed
with each of them, in lower case and in short blocks, so that what was seen of the text itself stays small against the
dictionary. The fewest bytes in all win. A text is rejected when the runner-up needs less than ``margin`` more bytes
(relative), or when it has no letter.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Bound of the sample that dictionaries are made of: documents for each language (twice that may be read), and bytes.
SAMPLE_DOCS = 250
DICT_BYTES = 224 * 1024
#: Relative excess of the runner-up under which a text is rejected.
MARGIN = 0.002
LEVEL = 5
#: Languages that are learnt, those of the most documents: what is broadcast has at most so many dictionaries.
MOST_LANGS = 200
#: Bytes that are compressed at once.
BLOCK = 1024


def fit(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from rows where ``usable`` holds, ``lang`` is not null and the text has a letter.

    The sample is bounded: rows whose id hashes below a threshold made from the exact row count of each language, about
    ``sample_docs`` each and at most twice that in hash order; their whole texts are joined until ``dict_bytes`` are
    reached. Ties and copies: equal texts are used once. Without usable rows the result is empty.
    """
    rows = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    counts = {r.lang: r.n for r in most.collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.5 * sample_docs / n))])
    rows = rows.withColumn("place", place).filter(F.col("place") <= F.try_element_at(share, F.col("lang")))
    texts: dict[str, list[tuple[float, str]]] = defaultdict(list)
    few = rows.select("lang", "place", F.substring("text", 1, dict_bytes).alias("text"))  # no dictionary uses more of one
    for r in few.limit(2 * sample_docs * len(counts)).collect():
        texts[r.lang].append((r.place, r.text))
    out = {}
    for lang, found in texts.items():
        raw = bytearray()
        for text in dict.fromkeys(t for _, t in sorted(found)):
            if LETTER.search(text) and len(raw) < dict_bytes:
                raw += text.lower().encode("utf-8", "surrogatepass") + b"\n"
        if len(raw) >= 8:
            out[lang] = bytes(raw[-dict_bytes:])
    return out


class Scorer:
    """Compressors of one process, by language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.packers = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the share of the best language in exp(-bits / 16); ties: the first by name."""
        if not self.langs or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(map(len, map(p.compress, blocks))) for p in self.packers]
        best = min(sizes)
        score = 1.0 / sum(math.exp(max(-700.0, (best - s) / 2)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != sizes.index(best)), default=2 * best)
        return self.langs[sizes.index(best)], score, second - best < margin * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row.

    Null texts and texts without a letter: ``und``, score 0, rejected. Whole texts are encoded, however long. Columns
    other than doc_id and text play no part; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(dictionaries)  # at most DICT_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            got = [scorer.predict(text, margin) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([not scorer.predict(text, margin)[2] for text in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
