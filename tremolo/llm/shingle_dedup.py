"""SimHash near-duplicates, made whole: no pair of the given Jaccard similarity of whole texts'
word shingles is left.

Texts of one set of shingles are one node. The Gray-order index links nodes whose SimHash
fingerprints over these shingles differ in ``radius`` bits or fewer. Where links ``stand``, such a
link counts as it is, as in op5, also where the similarity is below the given one; else it is
verified on the whole sets. At a similarity of 0.8 fingerprints differ
in some 10 bits, beyond what an index can search at scale, so the links that SimHash can't give are
added: shingles stand in one order for all nodes, common ones last; two nodes of similarity ``t`` share one of their first ``n - ceil(t n) + 1`` shingles, so
the nodes that share one of these are the candidates, and every candidate pair is verified on
the whole sets. First each node meets a few heads of its shingles; then, of pairs not yet in
one component, all. No candidate is dropped, so the components are those of all pairs and of the
links that stand.

Defined results of odd inputs: a null text counts as empty; empty texts are one node; a text
shorter than a shingle is one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, ship, trimmed
from .simhash import link_components

SEED = 42
HEADS, SAMPLE = 8, 8
BROADCAST = 1_000_000  # as many node keys at most
PART = 1 << 18  # shingles of a part of a batch, but where one text has more


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted; words as SimHash takes them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    found = [digest(b" ".join(words[k : k + width]), SEED) for k in range(max(1, len(words) - width + 1))]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def majority(h: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is set if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = [shingles(t, width) for t in b.column(1)[at : at + 512].to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                prints = pa.array([majority(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 512], pa.array(node), prints, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["doc_id", "node", "fp", "h"])

    return run


def _parts(b: pa.RecordBatch, column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """``b`` in parts of ``most`` values of a list column at most, but where one row has more."""
    ends = b.column(column).offsets.to_numpy()
    at = 0
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield b.slice(at, stop - at)
        at = stop


def _prefixes(hot, slots: int, tenths: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, count = hot.value
        for b in (part for whole in batches for part in _parts(whole, 1)):
            lists = b.column(1)
            x, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(b.num_rows), n)
            common = np.zeros(len(x), np.int64)
            if len(slot) and len(x):
                at = np.minimum(np.searchsorted(slot, x & (slots - 1)), len(slot) - 1)
                common = np.where(slot[at] == (x & (slots - 1)), count[at], 0)
            order = np.lexsort((x, common, owner))
            size = n + (-n * tenths // 10) + 1
            place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            p = x[order][place < np.repeat(size, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(p))], names=["node", "n", "p"])

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, tenths: int = 8, radius: int = 4, stand: bool = False) -> DataFrame:
    """One row per document: doc_id and component_id (the smallest doc_id reachable over pairs of
    texts whose shingles of ``width`` words have a Jaccard similarity of ``tenths`` / 10 or more or, if
    links ``stand``, fingerprints of ``radius`` or fewer differing bits)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "shingles")
    kind = dict(docs.dtypes)[id_col]
    sets = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_sets(width)), f"doc_id {kind}, node bigint, fp bigint, h array<bigint>")
    sets = scratch.keep(sets, "sets")
    ids = scratch.keep(sets.select("doc_id", "node"), "ids")
    full = sets.where(F.size("h") > 0).select("node", "h")

    # Shingles of crowded slots come last, as a sample of the nodes tells. Any order gives the
    # same components; this one keeps candidates few.
    total = full.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    slots = 1 << min(26, max(16, (total // 8).bit_length()))
    sample = full.where(F.pmod("node", F.lit(SAMPLE)) == 0)
    counts = sample.select(F.explode("h").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(slots - 1).cast("bigint")).alias("slot")).count()
    crowded = counts.where(F.col("count") > (64 + 2 * total // slots) // SAMPLE).orderBy("slot").toPandas()
    hot = spark.sparkContext.broadcast((crowded["slot"].to_numpy(np.int64), crowded["count"].to_numpy(np.int64)))
    nodes = full.mapInArrow(trimmed(_prefixes(hot, slots, tenths)), "node bigint, n bigint, p array<bigint>").groupBy("node").agg(F.first("n").alias("n"), F.first("p").alias("p"))
    nodes = scratch.keep(nodes, "nodes")

    held = nodes.select(F.explode("p").alias("x"), "node", "n")
    order = F.xxhash64(F.pmod("x", F.lit(HEADS)), "node")
    heads = held.groupBy("x").agg(F.min(order).alias("o"), F.max(order).alias("last")).where("o < last").select("x", "o")
    heads = scratch.keep(heads, "heads")
    shared = scratch.keep(held.join(heads.hint("merge"), "x").select("x", "node", "n", (order == F.col("o")).alias("leads")), "shared")

    def near(n: str, m: str):  # noqa: ANN202
        return (F.col(n) * 10 >= F.col(m) * tenths) & (F.col(m) * 10 >= F.col(n) * tenths)

    def joined(pairs: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(c + side) for c in cols]).hint("merge"), side)
        return pairs

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
        # Beyond the prefix that ends first, its node has n - size(p) shingles left to share.
        most = F.size(F.array_intersect("pa", "pb")) + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
        pairs = scratch.keep(joined(pairs, nodes, ["n", "p"]).where(most * (10 + tenths) >= (F.col("na") + F.col("nb")) * tenths).select("a", "b"), f"{name}-likely")
        met = scratch.keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), f"{name}-met")
        asked = full.join(F.broadcast(met) if met.count() <= BROADCAST else met.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("h").alias("h"))
        asked = scratch.keep(asked, f"{name}-asked")
        both = F.size(F.array_intersect("ha", "hb"))
        enough = both * (10 + tenths) >= (F.size("ha") + F.size("hb")) * tenths
        out = scratch.keep(joined(pairs, asked, ["h"]).where(enough).select("a", "b"), f"{name}-edges")
        for part in ("pairs", "likely", "met", "asked"):
            scratch.drop(f"{name}-{part}")
        return out

    scratch.drop("heads")

    # Links of the SimHash index: each node with the least node of its fingerprint's component.
    prints = scratch.keep(sets.where(F.size("h") > 0).groupBy("node").agg(F.first("fp").alias("fp")), "prints")
    linked = scratch.keep(link_components(spark, prints.select("fp").distinct(), scratch, radius).select(F.col("node").alias("l_fp"), "root"), "linked")
    grouped = scratch.keep(prints.join(linked, F.col("fp") == F.col("l_fp"), "left").select("node", F.coalesce("root", "fp").alias("root")), "grouped")
    first = scratch.keep(grouped.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("root", "a"), "firsts")
    close = scratch.keep(grouped.join(first, "root").where("node <> a").select("a", F.col("node").alias("b")), "close")
    for part in ("prints", "linked", "grouped", "firsts"):
        scratch.drop(part)

    lead = shared.where("leads").select("x", F.col("node").alias("a"), F.col("n").alias("m"))
    follow = shared.where("NOT leads").select("x", "node", "n")
    met = follow.hint("merge").join(lead, "x").where(near("n", "m")).select("a", F.col("node").alias("b"))
    edges = verified(met, "head").unionByName(close) if stand else verified(met.unionByName(close), "head")
    found = scratch.keep(components(spark, edges, scratch, "heads"), "head-roots")
    rest = follow.join(found, "node", "left").select("x", "node", "n", F.coalesce("root", "node").alias("root"))
    rest = scratch.keep(rest, "rest")
    scratch.drop("shared")
    other = rest.select("x", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("s"))
    apart = rest.hint("merge").join(other, "x").where((F.col("root") < F.col("s")) & near("n", "m"))
    more = verified(apart.select(F.col("node").alias("a"), "b"), "rest")
    scratch.drop("rest")
    if more.take(1):
        found = components(spark, edges.unionByName(more), scratch, "all")
    scratch.drop("sets")
    first = ids.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rooted = first.join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    member = scratch.keep(rooted.join(least, "root").select("node", "component_id"), "member")
    return ids.join(member, "node").select("doc_id", "component_id")
