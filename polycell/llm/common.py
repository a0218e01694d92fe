"""What the operators of this folder share: tables, scratch space, sketches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .textkernel import trim

#: Rows and bytes of texts that go to a Python worker at once, where the session doesn't say otherwise.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def set_unless_set(spark: SparkSession, name: str, value: str) -> None:
    """A setting that the session doesn't have yet; those that somebody made stay, also where they equal Spark's own default."""
    if name not in spark.conf.getAll:
        spark.conf.set(name, value)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker holds of texts of any length."""
    set_unless_set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    set_unless_set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session names it.

    Only where it is unset and the session runs on one machine, as in tests, a
    temporary folder is set; a cluster without it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="polycell-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


#: Folders of scratch tables that were made within temporary(), innermost last.
_OPEN: list[list[str]] = []


class Scratch:
    """Tables written in the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/polycell-{uuid.uuid4().hex}"
        self.shared: list = []
        if _OPEN:
            _OPEN[-1].append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that save() returned and that nothing reads any more."""
        for df in tables:
            delete(self.spark, df._scratch_path)

    def share(self, value):
        """A broadcast of a value of bounded size, until release()."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def release(self) -> None:
        """Destroys what share() returned: tables that were made with it are written."""
        while self.shared:
            self.shared.pop().destroy()


def tidy(spark: SparkSession) -> None:
    """Gives back what driver and executors have freed, at the end of an operator's many jobs.

    Heaps that have grown to their limit are collected, so that they shrink beside
    the Python workers; of the driver also the C library's free memory.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)
    except Py4JError:  # only some JVMs can
        pass
    trim()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession):
    """Deletes, at its end, the scratch tables of operators that were called within; what they returned must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for root in _OPEN.pop():
            delete(spark, root)


def bounded_sample(docs: DataFrame, marks: DataFrame, value_col: str, values: list, rows_each: int, max_chars: int) -> dict:
    """Texts of at most ``rows_each`` documents for each value of a label, those with the smallest hashes of their ids.

    docs: (doc_id, text); marks: (doc_id, value_col), a row per document. Texts of
    more than max_chars characters, empty and null ones, and documents or marks
    without an id aren't in it. Which rows
    they are is settled on keys; only the texts of those, a number that the
    parameters bound, go to the driver.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text")
    small = docs.filter(f"length(text) between 1 and {max_chars}").select("doc_id", key.alias("k"))
    small = Scratch(spark).save(small.join(marks, "doc_id").select(F.xxhash64("doc_id").alias("h"), "k", value_col), "sample")
    picked = {}
    for v in values:
        for r in small.filter(F.col(value_col) == v).select("h", "k").distinct().orderBy("h", "k").limit(rows_each).collect():
            picked[r["k"]] = v
    if not picked:
        return {v: [] for v in values}
    keys = F.broadcast(spark.createDataFrame([(k,) for k in picked], "k long"))  # values * rows_each rows at most
    texts = {r["k"]: r["text"] for r in docs.select(key.alias("k"), "text").join(keys, "k").dropDuplicates(["k"]).collect()}  # once, also of repeated rows
    out: dict = {v: [] for v in values}
    for k, v in picked.items():
        out[v].append(texts[k])
    return out


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components as doubles, offsets, which rows are neither null nor empty and have finite components only) of a list column."""
    valid = np.asarray(column.is_valid())
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, offsets, valid & (sizes > 0) & (wrong[offsets[1:]] == wrong[offsets[:-1]])


def binary_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows are runs of ``sizes`` bytes of an array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Rows of a binary column, which are of one length and not null, as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def width(spark: SparkSession) -> int:
    """Number of partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter with one hash of a long column, as words of 64 bits: 16 bits a row, from 2**23 to 2**28 bits.

    So it may be broadcast; beyond 2**24 rows it is only less selective.
    """
    bits = 1 << min(28, max(23, (16 * df.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    rows = (
        df.select(at.alias("b"))
        .groupBy((F.col("b") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out


def in_bitmap(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which xxhash64 values (as int64) the filter of bitmap() holds."""
    b = np.mod(hashes, len(words) * 64)
    return (words[b >> 6] >> (b & 63)) & 1 == 1


def held_by(column, words: np.ndarray, spark: SparkSession):
    """Column: whether a filter of bitmap() holds a long column; only that column goes to Python. A null is a value like others, as it hashes to one."""
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(h.to_numpy(zero_copy_only=False), shared.value))

    return test(F.xxhash64(column))


def summed_sketch(df: DataFrame, fn, length: int, finish=None, kind: str = "<u8") -> np.ndarray:
    """Sum over all partitions of the uint64 arrays of fixed ``length`` that fn(batches) returns.

    The arrays travel in pieces: tasks are summed in groups first and then over
    the groups, so no task holds more than a group's pieces. finish: what the sums
    are turned to, as numbers of a smaller kind, before they go to the driver.
    """
    piece = min(length, 1 << 14)

    def per_task(batches):
        from pyspark import TaskContext

        out = fn(batches)
        group = TaskContext.get().partitionId() % 32
        for k in range(0, length, piece):
            part = out[k : k + piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // piece], pa.int32()), pa.array([group], pa.int32()), pa.array([part.astype("<u8").tobytes()], pa.binary())], ["k", "g", "v"])

    def add(end):
        def runs(batches):
            # Rows come in the order of their keys; plain streams, as grouped ones would load more into each worker.
            now, total = None, np.zeros(piece, np.uint64)
            for b in batches:
                for *key, v in zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 1)), b.column("v"), strict=True):
                    if key != now:
                        if now is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(now[:1], pa.int32()), pa.array([end(total).tobytes()], pa.binary())], ["k", "v"])
                        now, total = key, np.zeros(piece, np.uint64)
                    got = np.frombuffer(v.as_buffer(), "<u8")
                    total[: len(got)] += got
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array(now[:1], pa.int32()), pa.array([end(total).tobytes()], pa.binary())], ["k", "v"])

        return runs

    parts = df.mapInArrow(per_task, "k int, g int, v binary")
    parts = parts.repartition("k", "g").sortWithinPartitions("k", "g").mapInArrow(add(lambda t: t.astype("<u8")), "k int, v binary")
    parts = parts.repartition("k").sortWithinPartitions("k").mapInArrow(add(lambda t: (finish(t) if finish else t).astype(kind)), "k int, v binary")
    out = np.zeros(length, kind)
    for row in parts.toLocalIterator():  # length / piece rows
        got = np.frombuffer(row["v"], kind)
        out[row["k"] * piece : (row["k"] + 1) * piece] = got[: length - row["k"] * piece]
    return out


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a long, b long); component: its smallest node.

    Alternating large-star and small-star passes (Kiveris et al., 2014) until no
    edge changes, which the number and the hashes of the edges tell that each pass
    observes as it writes them: a pass is one job. Each pass takes minima with
    map-side combining, so a node with very many edges is no hot group, and joins
    them back, where AQE splits skew. Null ends and loops are left out.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = scratch.save(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")), "edges")
        return out, (seen.get["n"], seen.get["h"])

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    now, state = written(now)
    for _ in range(rounds if state[0] else 0):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before = state
        after, state = written(small)
        scratch.drop(now)
        now = after
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
