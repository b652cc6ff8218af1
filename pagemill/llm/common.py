"""Helpers shared by the training-data operators: table access, shared scratch space, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch. Documents are long: Spark's default, 10,000 rows, would be held several times over by each worker.
BATCH_ROWS = 1000
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; the path may be of any store that Spark reads.

    Where the session has Spark's default size of Arrow batches, it gets BATCH_ROWS.
    """
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on a single machine (tests) a temporary folder is
    made and set as the checkpoint folder; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path:
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(path)
        return path
    if held.isEmpty():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def scratch(spark: SparkSession, stem: str) -> str:
    """A path of its own in the shared folder, for a table that later steps read again."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, through Hadoop so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage: written to the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``, after which a worker gives back the memory that its task does not hold any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sized(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """``df`` (narrow rows, saved), broadcast if it has no more than ``limit`` rows; else joins deal it by key."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Characters up to which a text is learnt from, so that a sample of so many texts has a bounded size. Scores and results
#: are of all texts, whole.
LEARNT_CHARS = 50_000


def learnable(text: Column) -> Column:
    """Whether a text may be in a sample that a model is fitted to."""
    return text.isNotNull() & (F.length(text) <= LEARNT_CHARS)


def hash_sample(df: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows of ``df`` (all, if it has no more; at most twice as many), chosen by a hash of the row.

    The hash threshold comes from the exact row count, so every task sends a share of the sample and no more.
    """
    n = df.count()
    share = min(1.0, 1.2 * limit / max(n, 1))
    return df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))).limit(2 * limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> list:
    """About ``limit`` rows (doc_id, text, lang, y) of labelled documents, at most twice as many, in order of the id.

    ``usable`` says over ``doc_id`` which rows may be learnt from; rows with a null label, id or text are not used, nor texts
    longer than LEARNT_CHARS. An id with several labels has the largest, with several texts the first of them in order.
    Only the chosen ids, 2 x ``limit`` at most, are broadcast to the scan.
    """
    rows = docs.select("doc_id", "text", "lang").filter(learnable(F.col("text"))).join(F.broadcast(labelled_ids(labels, label, usable, limit)), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "y", "t.text", "t.lang")
    return sorted(one.collect(), key=lambda r: r.doc_id)


def labelled_ids(labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """(doc_id, y) of a sample of the labelled ids for which ``usable`` holds, each once."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable)
    return hash_sample(known.groupBy("doc_id").agg(F.max("y").alias("y")), limit)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node reachable.

    In each round every node is linked to its smallest neighbour, if that is smaller: a forest, however many edges there
    are. Pointer jumping finds the roots of its trees, the edges between trees are those of the next round, each of which
    leaves only nodes that had no smaller neighbour. What a round needs is saved, joins may be split by adaptive execution,
    and nothing but whether there is more to do reaches the driver. ``rounds`` guards against an endless loop: it raises, it
    does not return a part.
    """
    links = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    found = None
    for _ in range(rounds):
        trees = _roots_of(links.groupBy("v").agg(F.min("u").alias("u")), rounds)
        if found is None:
            alone = links.select(F.col("u").alias("v")).distinct().join(trees.select("v"), "v", "left_anti").select("v", F.col("v").alias("u"))
            found = trees.unionByName(alone)
        else:
            found = found.join(trees.select(F.col("v").alias("u"), F.col("u").alias("top")), "u", "left").select("v", F.coalesce("top", "u").alias("u"))
        found = saved(found)
        root = lambda c: trees.select(F.col("v").alias(c), F.col("u").alias(f"{c}_root"))  # noqa: B023, E731
        between = links.join(root("v"), "v", "left").select(F.coalesce("v_root", "v").alias("v"), "u").join(root("u"), "u", "left").select("v", F.coalesce("u_root", "u").alias("u"))
        links = saved(between.filter("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
        if links.isEmpty():
            return found.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError(f"connected components did not settle in {rounds} rounds")


def _roots_of(parents: DataFrame, rounds: int) -> DataFrame:
    """(v, u) with u the root of v's tree, of trees given by one parent u for each v that has one; each round halves the depth."""
    now = saved(parents)
    for _ in range(rounds):
        above = now.select(F.col("v").alias("u"), F.col("u").alias("top"))
        now = saved(now.select("v", "u").join(above, "u", "left").select("v", F.coalesce("top", "u").alias("u"), F.col("top").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("v", "u")
    raise RuntimeError(f"trees are deeper than 2 to the power of {rounds}")
