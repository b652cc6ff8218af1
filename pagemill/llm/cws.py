"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a set of weighted terms: its words (runs without white space) and how often each occurs. For every sample k and
term, three numbers follow from hashes of the term alone: r and c, Gamma(2, 1), and b, uniform. With S the weight,
t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r (Ioffe, 2010); the term of least a, with its t, is sample k. Two
texts share a sample with the probability of their generalised Jaccard similarity, sum of least over sum of largest
weights. A sample is kept as 64 bits: 40 of a, so that a minimum finds it, and 24 of a hash of term and t.

A text is cut at the words both versions of it share; runs of equal words come from a sorted array, so no row of a word is
shuffled. Only whole rows are, once, to put documents beside their successors. A word that both versions have equally often
is one row.

Few terms are the least of a sample, and a bound on a tells most others without a logarithm: c = -ln x >= 1 - x. The least a
of n words is exponentially distributed with rate n, so a term with a bound above SURE / n is as good as never the least; it
leaves before the aggregation. Every sample is then held to that limit: below it, the least of what is left is the least of
all. Should a sample of any text not be below, all are worked out again without limits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import saved, sized

SAMPLES = 64
#: The chance that a text has a sample that its limit leaves open is below 128 e^-SURE, 1e-10.
SURE = 28.0
#: Documents of a block, and the most blocks; blocks beyond that are larger, and their sort spills.
BLOCK_ROWS, MOST_BLOCKS = 1024, 16_384
#: Marks that say which part a word is of; in texts they count as spaces.
HEAD, TAIL, GIFT = "\x01", "\x02", "\x03"
_LOW = 1 << 24


def order_blocks(docs: DataFrame, blocks: int) -> list[int]:
    """Ascending doc_ids, ``blocks`` - 1 at most, that cut the ids into parts of about equal size."""
    n = max(blocks, 2)
    got = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted(set(got or []))


def _block(doc_id: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are not above the id, by binary search; null ids are in the first block."""
    size = 1
    while size < len(bounds) + 1:
        size *= 2
    held = F.lit([*bounds, *[2**63 - 1] * (size - len(bounds))]).cast("array<bigint>")
    steps = F.lit([size >> i for i in range(1, size.bit_length())]).cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((F.get(held, at + s - 1) <= doc_id), at + s).otherwise(at))
    return F.coalesce(found, F.lit(0)) if size > 1 else F.lit(0)


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, row, doc_id, text, next_text): each row beside the next by doc_id, the last beside the first.

    Ids are cut into blocks of near-equal size at ids that occur. The first rows of a block are also sent to the block
    before it, and the first of all to the last, so every successor is found within a block. Null ids come first; rows of
    equal id are ordered by their texts.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = order_blocks(docs, blocks)
    low = docs.agg(F.min("doc_id"), F.count("*") > F.count("doc_id")).first()
    block = _block(F.col("doc_id"), bounds)
    first = F.col("doc_id").isNull() if low[1] else F.col("doc_id") == F.lit(low[0])
    starts = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    at = F.array(F.struct(block.alias("block"), F.lit(0).alias("extra")))
    at = F.when(starts, F.array_append(at, F.struct((block - 1).alias("block"), F.lit(1).alias("extra")))).otherwise(at)
    at = F.when(first, F.array_append(at, F.struct(F.lit(len(bounds)).alias("block"), F.lit(2).alias("extra")))).otherwise(at)
    rows = docs.select("doc_id", "text", F.inline(at))
    by = Window.partitionBy("block").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return (
        rows.select("block", "extra", "doc_id", "text", F.lead("text").over(by).alias("next_text"), F.row_number().over(by).alias("row"))
        .filter("extra = 0")
        .select("block", "row", "doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))
    )


def edited(text: Column, next_text: Column) -> tuple[Column, Column, Column]:
    """Head, tail and gift: the text is head + tail, its edited form head + gift."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.substring(text, F.lit(1), n - cut), F.substring(text, n - cut + 1, cut), F.substring(next_text, F.lit(1), cut)


def runs(head: Column, tail: Column, gift: Column) -> Column:
    """Runs of equal words of all parts, each word followed by the mark of its part.

    The head's last word may go on in tail and gift, so it belongs to them.
    """
    clean = lambda c: F.translate(c, HEAD + TAIL + GIFT, "   ")
    whole = F.regexp_extract(head, r"^(?s:.*\s)", 0)
    rest = F.substring(head, F.length(whole) + 1, F.length(head))

    def part(c: Column, mark: str) -> Column:
        words = F.trim(F.regexp_replace(clean(c), r"\s+", " "))
        return F.when(words != "", F.concat(F.replace(words, F.lit(" "), F.lit(f"{mark} ")), F.lit(mark)))

    words = F.concat_ws(" ", part(whole, HEAD), part(F.concat(rest, tail), TAIL), part(F.concat(rest, gift), GIFT))
    line = F.array_join(F.sort_array(F.split(words, " ")), " ")
    return F.regexp_extract_all(line, F.lit(rf"([^{HEAD}{TAIL}{GIFT} ]+)[{HEAD}{TAIL}{GIFT}](?: \1[{HEAD}{TAIL}{GIFT}])*+"), F.lit(0))


def _uniform(bits: Column, shift: int) -> Column:
    """21 bits of a hash as a number above 0 and below 1."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / float(1 << 21)


#: A document's facts as numbers: the hash of its edited text in four parts, its id, its size and the limit of its samples
#: in their units, null for none. They travel in place of samples, fact i as number i - FACTS.
_OWN, _OTHER = ("sha0", "sha1", "sha2", "sha3"), ("doc_id", "n_chars", "certain")
FACTS = len(_OWN)


def samples_of(rows: DataFrame) -> DataFrame:
    """``rows`` (block, row, term, in_own, in_other, ln_s, below, k, facts) with sample k as 64 bits: in own of terms of the
    text, in other of terms of the edited text. Rows of which a is certain to be ``below`` / S or more are left out.

    r = -ln u1 - ln u2 is Gamma(2, 1), and b = ln u2 / (ln u1 + ln u2) is uniform and independent of it. With these
    ln S / r + b = (ln S - ln u2) / r and a = c u1 (u1 u2)^t, and t = 0 at weight 1: most terms need c and u1 only. As
    (u1 u2)^t >= u2 / S and c = -ln x >= 1 - x, a is at least (1 - x) u1 u2 / S, and (1 - x) u1 at weight 1.
    """
    # the partition's number makes no difference, but the optimiser does not write the hash out again in the filter then
    once = F.spark_partition_id().bitwiseAND(F.lit(0)).cast("bigint")
    h, heavy, is_fact = F.col("h"), F.col("ln_s") > 0, F.col("k") < 0
    u1, u2, x = _uniform(h, 0), _uniform(F.xxhash64("term", "k", F.lit(1)), 0), _uniform(h, 21) * _uniform(h, 42)
    bound = (F.lit(1.0) - x) * u1
    some = rows.withColumn("h", F.xxhash64("term", "k").bitwiseXOR(once)).filter(is_fact | (F.when(heavy, bound * u2).otherwise(bound) < F.col("below")))
    t = F.when(heavy, F.floor((F.col("ln_s") - F.ln(u2)) / -F.ln(u1 * u2))).otherwise(F.lit(0).cast("bigint"))
    with_t = some.withColumn("t", t)
    a = -F.ln(x) * u1 * F.when(F.col("t") > 0, F.pow(u1 * u2, F.col("t").cast("double"))).otherwise(F.lit(1.0))
    high = (F.least(a, F.lit(63.0)) * float(1 << 34)).cast("bigint")
    got = with_t.withColumn("s", F.shiftleft(high, 24).bitwiseOR(F.col("term").bitwiseXOR(F.col("t")).bitwiseAND(F.lit(_LOW - 1))))

    def of(version: str, facts: tuple[str, ...]) -> Column:
        out = F.when(F.col(f"in_{version}") & ~is_fact, F.col("s"))
        for i, c in enumerate(facts):
            out = out.when(F.col("k") == i - FACTS, F.col(c))
        return out.alias(version)

    return got.select("block", "row", "k", of("own", _OWN), of("other", _OTHER))


def blocks_of(docs: DataFrame) -> int:
    """How many blocks the documents are dealt to: by their number, and enough for all tasks of a shuffle."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * tasks, min(MOST_BLOCKS, -(-docs.count() // BLOCK_ROWS)))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, blocks: int | None = None) -> DataFrame:
    """(block, row, doc_id, n_chars, edited_sha256, own, other): signatures of each text and of its edited form.

    A signature is an array of ``samples`` numbers, null for texts without words. All rows are kept: null texts count as
    empty, repeated rows have equal signatures, whole texts are used, and columns of other names play no part.
    """
    return _exact(lambda sure: _drawn(docs, samples, blocks, sure))


def _exact(build: Callable[[float | None], DataFrame]) -> DataFrame:
    """What ``build`` gives, saved: with limits, or without them if a sample of any text is not below its limit."""
    got = saved(build(SURE))
    return (got if got.filter("not settled").isEmpty() else saved(build(None))).drop("settled")


def _drawn(docs: DataFrame, samples: int, blocks: int | None, sure: float | None) -> DataFrame:
    """The rows of :func:`fingerprints`, and whether they are ``settled``; all are without ``sure``.

    Rows are (text, term, some samples) only between an explode and the hash aggregation that keeps the least of each sample;
    both are in the stage that read the block, so none of them is shuffled. The first row of a text also brings the text's
    own facts, as one more group of numbers, so that nothing has to be joined.
    """
    beside = with_next(docs, blocks or blocks_of(docs))
    head, tail, gift = edited(F.col("text"), F.col("next_text"))
    # the runs are a column of their own, in which parts that are used twice are worked out once
    whole = beside.select("block", "row", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.concat(head, gift), 256).alias("sha"), runs(head, tail, gift).alias("runs"))
    quarter = lambda i: F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("bigint")
    # words of the head, which both versions have; a text without any has no limit
    shared_words = F.aggregate("runs", F.lit(0), lambda n, r: n + F.length(r) - F.length(F.translate(r, HEAD, "")))
    below = F.when(shared_words > 0, F.lit(sure) / shared_words) if sure else F.lit(None).cast("double")
    numbered = whole.select("block", "row", "doc_id", "n_chars", *[quarter(i).alias(c) for i, c in enumerate(_OWN)], below.alias("below"), "runs")
    numbered = numbered.withColumn("certain", F.floor(F.col("below") * float(1 << 34)).cast("bigint"))
    terms = numbered.select("block", "row", *_OWN, *_OTHER, "below", F.posexplode_outer("runs").alias("pos", "run"))
    # a run is the word with HEAD so many times, then with TAIL, then with GIFT: the places of the first of each say how often
    place = lambda mark: F.instr("run", mark)
    first = F.when(place(HEAD) > 0, place(HEAD)).when(place(TAIL) > 0, place(TAIL)).otherwise(place(GIFT)) - 1
    placed = terms.select("*", place(TAIL).alias("b"), place(GIFT).alias("c"), first.alias("size"))
    before = lambda at: F.floor((at - 1 - F.col("size")) / (F.col("size") + 2))
    every = F.floor((F.length("run") + 1) / (F.col("size") + 2))
    shared = placed.select(
        "block", "row", *_OWN, *_OTHER, "below", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.xxhash64(F.substring("run", F.lit(1), F.col("size"))).alias("term"),
        F.when(F.col("b") > 0, before(F.col("b"))).when(F.col("c") > 0, before(F.col("c"))).otherwise(every).alias("h"), F.when(F.col("c") > 0, before(F.col("c"))).otherwise(every).alias("n_own"), every.alias("n"),
    )
    counted = shared.select("*", (F.col("h") + F.col("n") - F.col("n_own")).alias("n_other")).drop("h")
    # a row for each different weight: of both versions, of the text alone, of the edited text alone
    weight = lambda n, own, other: F.struct(n.alias("w"), F.lit(own).alias("in_own"), F.lit(other).alias("in_other"))
    own, other = F.col("n_own"), F.col("n_other")
    each = F.when(F.col("n").isNull(), F.array(weight(F.lit(0).cast("bigint"), False, False))).when(own == other, F.array(weight(own, True, True)))
    each = each.when(other == 0, F.array(weight(own, True, False))).when(own == 0, F.array(weight(other, False, True))).otherwise(F.array(weight(own, True, False), weight(other, False, True)))
    numbers = F.sequence(F.when(F.col("first"), F.lit(-FACTS)).otherwise(F.lit(0)), F.lit(samples - 1))
    s = F.greatest("w", F.lit(1)).cast("double")
    slack = F.coalesce(F.col("below") * s * (1 + 1e-9), F.lit(math.inf))
    weighed = counted.select("*", F.inline(each)).select("block", "row", "term", "in_own", "in_other", *_OWN, *_OTHER, F.ln(s).alias("ln_s"), slack.alias("below"), F.explode(numbers).alias("k"))
    least = samples_of(weighed).groupBy("block", "row", "k").agg(F.min("own").alias("own"), F.min("other").alias("other"))
    packed = least.groupBy("block", "row").agg(F.array_sort(F.collect_list(F.struct("k", "own", "other"))).alias("s"))
    drawn = lambda v: F.slice(F.col(f"s.{v}"), FACTS + 1, samples)
    sha = F.concat(*[F.lower(F.lpad(F.hex(F.col("s")[i]["own"]), 16, "0")) for i in range(FACTS)])
    doc_id, n_chars, certain = (F.col("s")[i]["other"] for i in range(len(_OTHER)))
    under = lambda v: F.forall(drawn(v), lambda x: F.coalesce(F.shiftright(x, 24) < certain, F.lit(False)))
    settled = certain.isNull() | ((F.size("s") == samples + FACTS) & under("own") & under("other"))
    return packed.select("block", "row", doc_id.alias("doc_id"), n_chars.alias("n_chars"), sha.alias("edited_sha256"), drawn("own").alias("own"), drawn("other").alias("other"), settled.alias("settled"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; texts without words are alike among themselves and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return same.cast("double") / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("-"))), "")


def with_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    near_next compares with the next row by doc_id. Within a block that is the next row where it is; only the last rows of
    blocks look for the first rows of others.
    """
    beside = F.lead("own").over(Window.partitionBy("block").orderBy("row"))
    got = _exact(lambda sure: _drawn(docs, samples, None, sure).withColumn("next_own", beside).withColumn("near_next", likeness(F.col("own"), F.col("next_own"))).withColumn("last", F.col("next_own").isNull()).drop("next_own"))
    first = got.filter("row = 1").select("block", F.col("own").alias("next_own"))
    blocks = [r.block for r in first.select("block").orderBy("block").collect()]  # a number for each block
    after = docs.sparkSession.createDataFrame([(b, blocks[(i + 1) % len(blocks)]) for i, b in enumerate(blocks)], "block int, next_block int")
    last = got.filter("last").join(sized(after), "block").join(sized(first.withColumnRenamed("block", "next_block"), 2000), "next_block")
    rows = got.filter("not last").unionByName(last.withColumn("near_next", likeness(F.col("own"), F.col("next_own"))).select(got.columns))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), "near_next"
    )
