"""Helpers on DataFrames that several operators use."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JVMView
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(column: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + column.replace("`", "``") + "`"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows: a batch then stays small beside very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1_000 or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, "1000")


#: Share of the driver's heap limit from which it is collected, and seconds between two collections.
HEAP_SHARE, COLLECT_S = 0.4, 10.0
#: Per cent of the heap that may stay free after a collection; the JVM's own 40 and 70 keep over three times what is alive.
FREE = {"MinHeapFreeRatio": "20", "MaxHeapFreeRatio": "40"}
_collected = -COLLECT_S


def _release(jvm: JVMView) -> None:
    """Lets the JVM keep less of its heap free, and has the C library give back what the JVM freed outside of it.

    Compilers, sockets and threads of many small steps leave freed pieces in the library's pools, which it keeps. JVMs
    without these commands stay as they are.
    """
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName
    try:
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        for option, percent in FREE.items():
            options.setVMOption(option, percent)
        server.invoke(name("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)
    except Py4JError:
        pass


def collect_garbage(spark: SparkSession) -> None:
    """Collects the driver's garbage if its heap has grown past ``HEAP_SHARE`` of its limit, and returns free memory.

    Spark keeps the map statuses, broadcasts and files of frames that are out of use until the JVM happens to collect, and
    the JVM rather takes more memory: over many steps the heap grows to its limit, however little of it is alive.
    """
    global _collected
    if time.monotonic() - _collected < COLLECT_S:
        return
    _collected = time.monotonic()
    _release(spark._jvm)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        gc.collect()  # frames that Python still holds in cycles
        spark._jvm.java.lang.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder all executors share (spark.checkpoint.dir), with no lineage.

    Meanwhile the driver's garbage is collected too, as one long step of many tasks fills the heap as well as many short ones.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))  # only where the cluster names none, as in tests
    over = threading.Event()

    def meanwhile() -> None:
        while not over.wait(COLLECT_S):
            collect_garbage(spark)

    beside = threading.Thread(target=meanwhile, daemon=True)
    beside.start()
    try:
        out = df.checkpoint()
    finally:
        over.set()
        beside.join()
    collect_garbage(spark)
    return out


#: Edges, both ways, up to which components are found by one task: 2**21 rows of two names, some 100 MB of 16-byte ones.
ONE_TASK = 1 << 21


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, label) of every node of all edges (x, y): the smallest node of its component."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    both = pa.chunked_array([*t.column("x").chunks, *t.column("y").chunks]).combine_chunks()
    names = pc.unique(both)
    names = names.take(pc.array_sort_indices(names))  # so that the smallest number is the smallest node
    x, y = (pc.index_in(t.column(c).combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, before[x], least)  # the roots of both ends, so that whole trees are hung up at once
        np.minimum.at(label, before[y], least)
        while (label != (far := label[label])).any():
            label = far
    for i in range(0, len(names), 10_000):
        yield pa.RecordBatch.from_arrays([names[i : i + 10_000], names.take(pa.array(label[i : i + 10_000]))], names=["x", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node of it.

    At most ONE_TASK edges, counted, are united by one task: every round of the others is six shuffles, whose tasks and map
    statuses the driver has to hold however few the edges are. Rounds take the smallest label among a node's neighbours
    and then jump along labels, so they follow the logarithm of the longest path. Labels never leave the executors; one
    count a round reaches the driver. Null ends and self-loops are ignored. An empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    e = saved(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    if e.count() <= ONE_TASK:
        kind = e.schema["x"].dataType.simpleString()
        united = e.where("x < y").coalesce(1).mapInArrow(_united, f"x {kind}, label {kind}")
        return saved(united.select(F.col("x").alias("node"), F.col("label").alias("component")))
    # labels are written before they are joined, so that it is a plain join of two shuffles, split where a hub makes it hot
    labels = saved(e.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumn("changed", F.lit(True)))
    while True:
        near = e.join(labels.select(F.col("x").alias("y"), F.col("label").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        step = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("x").alias("mid"), F.col("label").alias("far"))
        labels = saved(step.join(jump, "mid", "left").select("x", F.coalesce(F.least("mid", "far"), "mid").alias("label"), "old").withColumn("changed", F.col("label") != F.col("old")).drop("old"))
        if labels.where("changed").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
