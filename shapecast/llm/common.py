"""Helpers shared by the corpus operators: text columns, shared folders, bounded broadcasts, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters, digits and everything outside ASCII, after lower-casing.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words that are runs without ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
#: Rows up to which a table whose size was counted is broadcast.
BROADCAST_ROWS = 1_000_000
#: Edges up to which components are found on the driver (4 MB).
LOCAL_EDGES = 250_000
#: Bytes that are sent to Python at once.
BATCH_BYTES = 2 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. Pure ASCII text takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_alnum(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null gives no words."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), NOT_ALNUM), ""), F.array().cast("array<string>"))


def words_white(text: Column, lower: bool = True) -> Column:
    """Words between ASCII white space; null gives no words."""
    text = lower_ascii(text) if lower else text
    return F.coalesce(F.array_remove(F.split(text, WHITE), ""), F.array().cast("array<string>"))


def count_white(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    bare = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, WHITE))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session gets a folder made here."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "made", None):
        shared_dir.made = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, shared_dir.made, ignore_errors=True)
    return f"file://{shared_dir.made}"


def written(df: DataFrame, what: str, batch: int = BATCH_BYTES) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors. batch: see batches_of."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with batches_of(df.sparkSession, batch):
        df.write.option("compression", "zstd").parquet(path)  # Snappy's buffers are outside the heap and stay until it is collected
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "written_to", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, rather than when the driver next collects its garbage."""
    spark.range(1).collect()  # the last step is no longer what the session holds on to
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if its counted rows are few; a shuffle join otherwise."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int):
    """While it is open, jobs that start send at most so many bytes to Python at once, but for a single larger row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables that an operator writes in the shared folder for itself."""

    def __init__(self):
        self.made = []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.made.append(written(df, what))
        return self.made[-1]

    def result(self, df: DataFrame, what: str) -> DataFrame:
        """df, written; all tables before it are deleted."""
        out = written(df, what)
        self.clear()
        return out

    def clear(self) -> None:
        while self.made:
            forget(self.made.pop())


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, sorted, and of each the smallest node reachable."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while not np.array_equal(p := root[x], q := root[y]):
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), which are longs, as a written table: the smallest node reachable.

    Up to LOCAL_EDGES counted edges, the driver does it, as each round below costs several shuffles. Beyond that, alternating large-star and small-star. Both turn the edges of a node into a star around its smallest neighbour,
    so an edge set never grows, and the rounds grow with the logarithm of the number of nodes. The neighbours of one
    node are never gathered: the smallest comes from a partial aggregation and a join back.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        joined = both.join(least, "a")
        if large:  # each strictly larger neighbour hangs on the smallest
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # the node itself and its smaller neighbours do
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    if before[0] <= LOCAL_EDGES:
        few = now.toArrow()
        of = smallest_reachable(few["a"].to_numpy(), few["b"].to_numpy())
        out = written(edges.sparkSession.createDataFrame(pa.table(dict(zip(("node", "component"), of, strict=True)))), "components")
        forget(now)
        return out
    for _ in range(most_rounds if before[0] else 0):
        put = Scratch()
        put.made.append(now)
        now = put.result(star(put(star(now, True), "large"), False), "smallstar")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("the components did not settle")
    out = written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    forget(now)
    return out
