"""SimHash near-duplicates through a Gray-order hierarchical index.

Defined results of odd inputs: a null text counts as empty; an empty text (or one of white
space) has the fingerprint zero and links like any other; equal texts are one fingerprint and
one component; rows with a null id get a fingerprint and no part in the choice of the smallest
id; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, ship, trimmed
from .gray_index import local_components

SEED = 42


def fingerprint(text: str | None, shingle: int = 4, block: int = 1 << 15) -> int:
    """The SimHash of a whole text: a bit is set if it is set in over half of the XXH64 of all
    word shingles, repeats included. Counts are kept for ``block`` shingles at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - (length + 1)
    n = len(words) - shingle + 1
    stop = (start + length)[shingle - 1 :].tolist()
    start = start[:n].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = [digest(line[a:b], SEED) for a, b in zip(start[at : at + block], stop[at : at + block], strict=True)]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_prints), f"doc_id {kind}, fp bigint")


def _blocks(n: int) -> list[int]:
    """64 bits in n blocks as equal as can be, as masks."""
    cut = [64 * k // n for k in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_components(spark: SparkSession, prints: DataFrame, scratch: Scratch, radius: int = 4, group_goal: int = 512) -> DataFrame:
    """(node, root) of distinct fingerprints ``prints(fp)`` linked at ``radius`` or fewer bits.

    With 64 bits in k blocks, two such fingerprints agree on at least k - radius blocks, so each
    choice of k - radius blocks gives an upper node of the index: the fingerprints that share
    these masked bits. k is the least for which an even spread puts at most ``group_goal``
    fingerprints below such a node; every choice finds every link. A node that is far larger
    than a task's share is cut into chunks, and each pair of chunks is searched by a task of
    its own. Within a task all its nodes are indexed by Gray rank and searched together.
    """
    n = prints.count()
    k = radius + 1
    while k < radius + 5 and n / 2.0 ** (64.0 * (k - radius) / k) > group_goal:
        k += 1
    masks = [sum(m) for m in combinations(_blocks(k), k - radius)]
    rows = n * len(masks)
    cap = min(max(4096, rows // 512), 4_000_000)
    many = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("v")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", many.alias("k")).select("fp", "k.t", "k.v")
    large = keyed.groupBy("t", "v").agg(F.count("*").alias("c")).where(F.col("c") > cap)
    large = scratch.keep(large, "large-nodes")
    if large.take(1):
        chunks = F.ceil(F.col("c") / F.lit(cap)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        # Chunk i goes to the pairs (i, j): with every other chunk, so every two of its rows meet too.
        pair = F.explode(F.when(F.col("s") > 1, F.transform(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda j: j != F.col("own")), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))))
        keyed = keyed.join(large.withColumn("s", chunks).drop("c"), ["t", "v"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
        keyed = keyed.withColumn("own", own).withColumn("p", pair).select("fp", F.xxhash64("t", "v", "p.i", "p.j").alias("g"))
    else:
        keyed = keyed.select("fp", F.xxhash64("t", "v").alias("g"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, groups = [], []
        for b in batches:
            fps.append(b.column(0).to_numpy())
            groups.append(b.column(1).to_numpy())
        if not fps:
            return
        fp, g = np.concatenate(fps).view(np.uint64), np.concatenate(groups)
        node, root = local_components(fp, g, radius)
        for at in range(0, len(node), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(node[part].view(np.int64)), pa.array(root[part].view(np.int64))], names=["a", "b"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2_000_000)
    edges = keyed.repartition(parts, "g").select("fp", "g").mapInArrow(trimmed(search), "a bigint, b bigint")
    return components(spark, edges, scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id reachable over links of ``radius`` or fewer differing bits), n_prints (distinct
    fingerprints of the component)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simhash")
    fp = scratch.keep(fingerprints(docs, id_col, text_col), "prints")
    distinct = scratch.keep(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = link_components(spark, distinct.select("fp"), scratch, radius)
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_prints")), "least")
    member = scratch.keep(rooted.join(least, "root").select("fp", "component_id", "n_prints"), "member")
    return fp.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_prints")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs.select("doc_id", "text"))
