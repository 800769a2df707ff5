"""Plumbing shared by the training-data operators: shipping code, scratch tables, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def trim() -> None:
    """Memory that is free in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task of a worker that lives on: what its largest batch took isn't held until the
    worker's next tasks, of any stage, have come and gone."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that workers import it
    whatever their working folder is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tremolo-code-")
    target = os.path.join(folder, "tremolo_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(os.path.join(root, "tremolo")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir of the session; a temporary one is
    made only where the setting is absent, as in tests."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tremolo-shared-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive the loss of executors.

    ``keep(df, name)`` writes and rereads; ``drop(name)`` deletes a table that nothing reads
    any more. What a returned lazy DataFrame still reads goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/tremolo-{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.base}/{name}")

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.base)
        except Exception:  # noqa: BLE001 - the JVM may be gone when Python ends
            pass


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star.

    Returns (node, root), root being the smallest node of the component, for every node that
    has an edge to another one. Nulls and loops are ignored. Each round is two shuffles of at
    most the edges; rounds grow with the logarithm of the nodes. A node with very many edges
    is safe: minima are combined before the shuffle, and the join that follows reads two
    written tables, so its hot key can be split.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = scratch.keep(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    if not now.take(1):
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    k = 0
    before = None
    while True:
        # Large star: every neighbour above a node is linked to the node's smallest neighbour.
        pairs = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = scratch.keep(least, f"{tag}-m{k}")
        large = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, f"{tag}-l{k}")
        # Small star: a node and its lower neighbours are linked to the lowest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        low = scratch.keep(low, f"{tag}-s{k}")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = scratch.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{tag}-{k + 1}")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        for name in (f"{tag}-{k}", f"{tag}-m{k}", f"{tag}-l{k}", f"{tag}-s{k}"):
            scratch.drop(name)
        now, k = after, k + 1
        if before == (state["n"], state["h"]) and state["n"] == state["d"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (state["n"], state["h"])


