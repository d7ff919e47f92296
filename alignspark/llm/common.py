"""Shared pieces: the shared folder, written tables, bounded Arrow batches, joins of a checked size, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters and bytes that the operators' contracts call white space.
SPACE = " \t\n\x0b\x0c\r"
#: Most rows of a side that is broadcast (a few numbers each), and of hot keys that are salted; counted first.
BROADCAST_ROWS = 100_000


#: Spark's setting by which an execution's shuffle files go when it ends, and not when the driver happens to collect garbage.
#: Lost parts of held tables are worked out again from their lineage, map stages included.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders of this process, by the shared folder they are in; deleted when the process ends.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """An own folder where driver and executors both see it: in spark.checkpoint.dir, or beside the warehouse where that is unset."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    if at not in _folders:
        own = _folders[at] = f"{at.rstrip('/')}/alignspark-{uuid.uuid4().hex}"
        atexit.register(_deleted, context._gateway.jvm, own)
    return _folders[at]


def _deleted(jvm, at: str) -> None:
    """Delete a folder through Hadoop; nothing to do where the JVM is gone (the cluster's clean-up has it then)."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):
        pass


def stored(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Write df under the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with setting(spark, CLEAN, "true"):
        writer.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._stored_at = at
    return back


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_text(spark: SparkSession, at: str, text: str) -> None:
    """A small file, put in place at once: it's written beside and renamed."""
    jvm = spark._jvm
    path, new = jvm.org.apache.hadoop.fs.Path(at), jvm.org.apache.hadoop.fs.Path(f"{at}.{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(path, False)
    if not fs.rename(new, path):
        raise OSError(f"{new} can't be renamed to {path}")


def read_text(spark: SparkSession, at: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for plans that run within; then what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """df, worked out now and held on the executors' disks (not in their heaps) until dropped() lets it go.

    For what is read more than once: unlike a written table it keeps its lineage, from which lost parts are worked out again,
    and costs no files in the shared folder.  Not for loops: plans would grow with each turn.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    with setting(df.sparkSession, CLEAN, "true"):
        df._rows = df.count()
    return df


def dropped(*tables: DataFrame) -> None:
    """Let go of tables that stored() wrote or kept() holds and that nothing reads any more."""
    for df in tables:
        if at := getattr(df, "_stored_at", None):
            delete(df.sparkSession, at)
        else:
            df.unpersist()


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text stays near most_bytes (a single longer row is a slice of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= most_bytes:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, length in enumerate(lengths):
            if i > begin and held + length > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += length
        yield batch.slice(begin)


def lean(run: Callable) -> Callable:
    """run for mapInArrow, with the worker's free memory given back to the system at the end of a task.

    Workers live on from stage to stage; without this each keeps the most that any task took.
    """

    @wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return wrapped


def rows_of(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with lean workers and Arrow batches bounded by bytes before they leave the JVM."""
    conf, most = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(most) in ("64MB", "67108864b"):  # the default: a caller's own setting stays
        conf.set(most, "8m")
    return df.mapInArrow(lean(run), schema)


def looked_up(big: DataFrame, small: DataFrame, key: str, salt_by: Column, how: str = "inner", rows: int | None = None, salts: int = 32) -> DataFrame:
    """Join on key where big may hold a third of its rows under one key; small has one row a key, so nothing multiplies.

    A small of at most BROADCAST_ROWS rows (counted, unless rows says) is broadcast.  Else big's hot keys (those of more
    than a share of its rows, few by that share) are salted by salt_by and only their rows of small repeated; all other
    rows meet by key alone.
    """
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(f"{key} IS NOT NULL")
    total = big.count()
    hot = [r[0] for r in counts.where(F.col("_n") > max(total // 2000, 10_000)).select(key).collect()]  # 2000 at most
    if not hot:
        return big.join(small.hint("merge"), key, how)
    spread = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(salt_by), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left, right = big.withColumn("_salt", spread), small.withColumn("_salt", F.explode(every))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) for each end of an edge; component is the least id.

    Every round maps each node to the least label next to it, follows those pointers to their roots and contracts the
    edges, all in Spark; a round's tables are written to the shared folder.  Null ends and self-loops are ignored.
    Rounds fall as the logarithm of the nodes; nothing is gathered at the driver but counts.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = stored(ends, "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.min("b").alias("r")).select("a", F.least("a", "r").alias("r")), "pointers")
        nodes = to.count()
        while True:  # pointer jumping, three jumps at a time
            step, next_ = to.select("a", "r"), to.select(F.col("a").alias("k"), F.col("r").alias("n"))
            for _ in range(3):
                step = looked_up(step.withColumnRenamed("r", "k"), next_, "k", F.col("a"), rows=nodes).select("a", F.col("k").alias("before"), F.col("n").alias("r"))
            jumped = stored(step.select("a", "r", (F.col("r") != F.col("before")).alias("moved")), "jumped")
            dropped(to)
            to = jumped
            if to.where("moved").isEmpty():
                break
        roots = to.select("a", "r")
        if labels is None:
            new = roots.select(F.col("a").alias("id"), F.col("r").alias("component"))
        else:
            new = looked_up(labels.withColumnRenamed("component", "a"), roots, "a", F.col("id"), "left", nodes).select("id", F.coalesce("r", "a").alias("component"))
        old, labels = labels, stored(new, "labels")
        if old is not None:
            dropped(old)
        one = looked_up(left, roots, "a", F.col("b"), rows=nodes).select(F.col("r").alias("x"), F.col("b").alias("a"))
        two = looked_up(one, roots, "a", F.col("x"), rows=nodes).select("x", F.col("r").alias("y"))
        after = stored(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(left, to)
        left = after
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def small_enough(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most most_rows (counted), else for a merge join (whose skew Spark splits at run time)."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint("merge")


def least_count(counts: DataFrame, column: str, most: int) -> int:
    """The least value of column (a count, at least 1) such that at most `most` rows have that much or more.

    Rows are counted by their bit length (64 groups), then within the one group that the bound cuts by 1024 strips.
    """
    groups = {r["b"]: r["k"] for r in counts.groupBy(F.length(F.bin(column)).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}
    room, above = most, 64
    while above > 0 and groups.get(above, 0) <= room:
        room -= groups.get(above, 0)
        above -= 1
    least = 1 << above
    if above and room:
        low = 1 << (above - 1)
        step = max(1, (least - low) // 1024)
        within = counts.where(F.col(column).between(low, least - 1)).groupBy(F.floor((F.col(column) - low) / step).alias("b"))
        strips = {r["b"]: r["k"] for r in within.agg(F.count(F.lit(1)).alias("k")).collect()}
        strip = (least - 1 - low) // step
        while strip >= 0 and strips.get(strip, 0) <= room:
            room -= strips.get(strip, 0)
            least = low + strip * step
            strip -= 1
    return least
