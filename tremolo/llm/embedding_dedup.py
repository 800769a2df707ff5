"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors of a label are one class; classes meet in overlapping shards. A tree of centroids
cuts each label into cells of about ``cell_goal`` classes: level by level, every cell of over
``shard_cap`` classes gets up to ``FAN`` centroids, fitted on the executors to a bounded sample of
that cell. A class goes to its nearest child and, from its main cell of each level, to the next
nearest ones, ``overlap`` in all. Centroids that would link with each other are merged, so that a
dense group isn't cut apart; a cell that this leaves with one centroid is dealt into chunks, and
each pair of chunks is a shard. So a shard has about ``shard_cap`` classes, however large the
table is, and no pair of a cell is lost.

In each shard a graph is built by robust pruning; the adjacency lists of a class are united over
all its shards; then every class is searched for in each of its shards over the united lists, from
the medoid, expanding all that is in range. Every link is verified by its cosine in double
precision, and counted in one shard only.

Recall is audited in every run against brute force over all vectors, for ``audit_queries`` classes
(of those with a vec_id divisible by 100, or of all where there is none; of more, those with the least hash), and
returned in the column ``audited_recall``. Below ``least_recall`` the overlap doubles and the
search runs again; beyond an overlap of ``MOST_OVERLAP`` cells aren't cut at all: all pairs meet.

Only vectors of the same label (and length) are compared. Defined results of odd inputs: a null
label, and a vector that is null, empty, zero or holds null or non-finite components, links with
nothing (n_links 0, component_id its own id); rows with equal vectors link with each other; a
null vec_id is returned with its links; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, ship
from .flat_graph import Graph, build, dots, medoid, range_search

FAN, MOST_LEVELS, MOST_OVERLAP = 64, 12, 32
SALT = 20_000  # classes of a cell that are routed in one go


def _unit(rows: pa.Array) -> np.ndarray:
    """Rows of one length as doubles of norm one."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """(node, grp, embedding, copies, first_id, asked) of vectors that may link; grp stands for
    label and length, asked says that a copy's vec_id is divisible by 100."""
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = v if dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>") else v.cast("array<double>")
    group = F.concat(F.col("label").cast("string"), F.lit(":"), F.size(v))
    asked = F.coalesce(F.expr("try_cast(vec_id AS bigint)") % 100 == 0, F.lit(False))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", group.alias("grp"), _key().alias("node"), kept.alias("embedding"), asked.alias("asked")).groupBy("node").agg(
        F.first("grp").alias("grp"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.max("asked").alias("asked"))


def _key():  # noqa: ANN202
    """128 bits that stand for label and vector (zeros of either sign are one)."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    return F.concat(F.hex(F.xxhash64("label", v)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), v, "label")))


def centroids(x: np.ndarray, k: int, threshold: float, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit centroids of the rows of ``x``, no two of which would link."""
    k = min(k, len(x))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    many = np.bincount((x @ c.T).argmax(1), minlength=k)
    kept: list[int] = []
    for j in np.argsort(-many, kind="stable").tolist():
        if not kept or (c[kept] @ c[j]).max() < threshold:
            kept.append(j)
    return c[kept]


def _fitter(goal: int, threshold: float):  # noqa: ANN202
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        k = min(FAN, -(-table.column("c")[0].as_py() // goal))
        found = centroids(_unit(table.column("embedding").combine_chunks()), k, threshold)
        return pa.table({"cell": table.column("cell")[:1], "c": table.column("c")[:1], "centres": pa.array([found.ravel().tolist() if len(found) > 1 else None], pa.list_(pa.float64()))})

    return fit


def _router(overlap: int):  # noqa: ANN202
    """Rows (cell, main, node, embedding, centres) come by cell: first its centroids, without a
    node, then its classes. Gives the children that each class goes to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.zeros(0)
        for b in batches:
            cell, head = b.column(0).to_numpy(), b.column(2).is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | head[1:] | head[:-1]]) if len(cell) else np.zeros(0, np.int64)
            rows, child, main = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
                if head[a]:
                    centres = b.column(4).slice(a, 1).flatten().to_numpy()
                    continue
                x = _unit(b.column(3).slice(a, z - a))
                s = x @ centres.reshape(-1, x.shape[1]).T
                m = min(overlap, s.shape[1])
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
                first = b.column(1).slice(a, z - a).to_numpy(zero_copy_only=False)
                take = np.ones(near.shape, bool)
                take[~first, 1:] = False  # beside the main cell a class keeps one child
                r, c = np.nonzero(take)
                rows.append(a + r)
                child.append(near[r, c])
                main.append(first[r] & (c == 0))
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(at)), pa.array(cell[at]), pa.array(np.concatenate(child).astype(np.int32)), pa.array(np.concatenate(main))], names=["node", "parent", "child", "main"])

    return route


def cells(all_classes: DataFrame, overlap: int, cell_goal: int, shard_cap: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, cell): the cells of each class."""
    tag = str(overlap)
    place = all_classes.select("node", F.xxhash64("grp").alias("cell"), F.lit(True).alias("main"), F.lit(overlap > MOST_OVERLAP).alias("whole"))
    place = scratch.keep(place, f"place-{tag}-0")
    for level in range(1, MOST_LEVELS):
        sizes = place.where("NOT whole").groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > shard_cap)
        sizes = scratch.keep(sizes, f"sizes-{tag}-{level}")
        if not sizes.take(1):
            break
        large = place.where("NOT whole").join(sizes, "cell")
        goal = F.least(F.lit(FAN), F.ceil(F.col("c") / cell_goal)) * 32
        ranks = 1 << 40
        chosen = large.where(F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(ranks)) < goal / F.col("c") * ranks)
        fitted = chosen.join(all_classes.select("node", "embedding"), "node").groupBy("cell").applyInArrow(_fitter(cell_goal, threshold), "cell bigint, c bigint, centres array<double>")
        fitted = scratch.keep(fitted, f"centres-{tag}-{level}")
        cut = fitted.where("centres IS NOT NULL")
        # Each group of at most about SALT classes of a cell is read behind the cell's centroids.
        salts = F.ceil(F.col("c") / SALT).cast("int")
        kind = dict(all_classes.dtypes)["embedding"]
        rows = place.where("NOT whole").join(cut.select("cell", "c"), "cell").join(all_classes.select("node", "embedding"), "node").select("cell", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "main", "node", "embedding", F.lit(None).cast("array<double>").alias("centres"))
        heads = cut.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("main"), F.lit(None).cast("string").alias("node"), F.lit(None).cast(kind).alias("embedding"), "centres")
        dealt = heads.unionByName(rows).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("node").asc_nulls_first())
        children = dealt.select("cell", "main", "node", "embedding", "centres").mapInArrow(_router(overlap), "node string, parent bigint, child int, main boolean")
        children = children.select("node", F.xxhash64("parent", "child").alias("cell"), "main", F.lit(False).alias("whole"))
        seen = fitted.select(F.col("cell").alias("f_cell"), F.col("centres").isNull().alias("dense"))
        rest = place.join(seen, F.col("cell") == F.col("f_cell"), "left").where("coalesce(whole OR dense, true)").select("node", "cell", "main", F.coalesce(F.col("whole") | F.col("dense"), F.lit(False)).alias("whole"))
        place = scratch.keep(children.unionByName(rest), f"place-{tag}-{level}")
        scratch.drop(f"place-{tag}-{level - 1}")
    return place.select("node", "cell")


def _build(table: pa.Table) -> pa.Table:
    graph = build(_unit(table.column("embedding").combine_chunks()).astype(np.float32))
    names = table.column("short").to_numpy()
    return pa.table({"short": names, "near": pa.ListArray.from_arrays(pa.array(np.r_[graph.start, len(graph.near)].astype(np.int32)), pa.array(names[graph.near]))})


def _search(threshold: float, beam: int):  # noqa: ANN202
    def work(table: pa.Table) -> pa.Table:
        n = len(table)
        unit = _unit(table.column("embedding").combine_chunks())
        names, short = table.column("node"), table.column("short").to_numpy()
        # United lists of those classes that this shard has.
        lists = table.column("near").combine_chunks()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat = lists.flatten().to_numpy()
        by = np.argsort(short, kind="stable")
        at = by[np.minimum(np.searchsorted(short[by], flat), n - 1)]
        fine = short[at] == flat
        graph = Graph.of(np.repeat(np.arange(n), size)[fine], at[fine], n)
        own = table.column("cells").combine_chunks()
        width = pc.list_value_length(own).to_numpy()
        most = int(width.max())
        cell_of = np.full((n, most), -1, np.int64)  # positions of sorted cells; -1: none
        every, flat_cells = np.unique(own.flatten().to_numpy(), return_inverse=True)
        r = np.repeat(np.arange(n), width)
        cell_of[r, np.arange(len(r)) - np.repeat(np.cumsum(width) - width, width)] = flat_cells
        cell, low, high = (table.column(c)[0].as_py() for c in ("cell", "low", "high"))
        here = int(np.searchsorted(every, cell))
        chunk, copies = table.column("chunk").to_numpy(), table.column("copies").to_numpy()
        # Two classes of the same chunk meet in every pair of it: the first is (0, 1) or (0, chunk).
        leads = np.array([low == high or (low, high) == ((0, 1) if c == 0 else (0, c)) for c in chunk.tolist()])
        links, root = np.zeros(n, np.int64), np.arange(n)
        rough = unit.astype(np.float32)
        for q, v in range_search(rough, graph, np.arange(n), medoid(rough), threshold - 1e-5, beam):
            exact = dots(unit, q, unit, v) >= threshold
            q, v = q[exact], v[exact]
            # A pair that meets in several shards counts in the least of its common cells.
            first = np.full(len(q), len(every))
            for i in range(most):
                own_i = cell_of[q, i]
                common = ((cell_of[v] == own_i[:, None]) & (own_i >= 0)[:, None]).any(1)
                first = np.where(common, np.minimum(first, own_i), first)
            counted = (first == here) & ((chunk[q] != chunk[v]) | leads[q])
            links += np.bincount(q[counted], copies[v[counted]], minlength=n).astype(np.int64)
            _unite(root, q, v)
        top = root[root]
        while (top != root).any():
            root, top = top, top[top]
        return pa.table({"node": names, "links": links, "root": names.combine_chunks().take(pa.array(root))})

    return work


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of linked rows: every root points to the least root that it meets."""
    while len(a):
        for side in (a, b):
            while (root[root[side]] != root[side]).any():
                root[side] = root[root[side]]
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, overlap: int = 2, cell_goal: int = 256, shard_cap: int = 1024, beam: int = 32, audit_queries: int = 512, least_recall: float = 0.95) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> vec_id, n_links, component_id, kept, audited_recall."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embeddings")
    all_classes = scratch.keep(classes(vectors), "classes")
    while True:
        placed = cells(all_classes, overlap, cell_goal, shard_cap, threshold, scratch)
        counts, edges = _links(all_classes, placed, overlap, shard_cap, threshold, beam, scratch)
        measured = recall(all_classes, counts, threshold, audit_queries)
        if measured >= least_recall or overlap > MOST_OVERLAP:
            break
        overlap *= 2
    roots = components(spark, edges, scratch)
    member = all_classes.select("node", "copies", "first_id").join(counts, "node", "left").join(roots, "node", "left").select("node", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    member = scratch.keep(member, "member")
    least = scratch.keep(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    member = scratch.keep(member.join(least, "root").select(F.col("node").alias("m_node"), "n_links", "component_id"), "rooted")
    rows = vectors.select("vec_id", _key().alias("node"))
    out = rows.join(member, F.col("node") == F.col("m_node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(measured).alias("audited_recall"))


def _links(all_classes: DataFrame, placed: DataFrame, overlap: int, cap: int, threshold: float, beam: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, links) and edges (a, b) of all classes."""
    sizes = placed.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > cap).select(F.col("cell").alias("s_cell"), F.ceil(F.col("c") / (cap // 2)).cast("int").alias("many"))
    sizes = scratch.keep(sizes, f"sizes-{overlap}")
    lists = placed.groupBy("node").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    rows = all_classes.select("node", "grp", "embedding", "copies", F.xxhash64("node").alias("short")).join(lists, "node").withColumn("cell", F.explode("cells"))
    rows = rows.join(sizes, F.col("cell") == F.col("s_cell"), "left").withColumn("s", F.coalesce("many", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("s")).cast("int"))
    pairs = F.when(F.col("s") > 1, F.transform(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda j: j != F.col("chunk")), lambda j: F.struct(F.least(j, F.col("chunk")).alias("low"), F.greatest(j, F.col("chunk")).alias("high")))).otherwise(F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))))
    shards = rows.withColumn("p", F.explode(pairs)).select("node", "short", "grp", "embedding", "copies", "cells", "cell", "chunk", "p.low", "p.high")
    shards = scratch.keep(shards, f"shards-{overlap}")
    key = ["grp", "cell", "low", "high"]
    built = shards.select(*key, "short", "embedding").groupBy(*key).applyInArrow(_build, "short bigint, near array<bigint>")
    # The lists of a class from its shards, united.
    graph = scratch.keep(built.groupBy("short").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"graph-{overlap}")
    met = shards.join(graph, "short", "left").groupBy(*key).applyInArrow(_search(threshold, beam), "node string, links bigint, root string")
    met = scratch.keep(met, f"met-{overlap}")
    scratch.drop(f"shards-{overlap}")
    scratch.drop(f"graph-{overlap}")
    return met.groupBy("node").agg(F.sum("links").alias("links")), met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def recall(all_classes: DataFrame, counts: DataFrame, threshold: float, queries: int) -> float:
    """Share of the links of ``queries`` classes that the counts have, against brute force over
    all classes."""
    chosen = all_classes.orderBy(F.desc("asked"), F.xxhash64("node"), "node").limit(queries).select("node", "grp", "embedding").toArrow()
    asked: dict[str, tuple[list[str], np.ndarray]] = {}
    for g in chosen.column("grp").unique().to_pylist():
        own = chosen.filter(pc.equal(chosen.column("grp"), g))
        asked[g] = (own.column("node").to_pylist(), _unit(own.column("embedding").combine_chunks()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            for g, (nodes, wanted) in asked.items():
                own = b.filter(pc.equal(b.column(1), g))
                if own.num_rows:
                    copies = own.column(3).to_numpy()
                    for node, n in zip(nodes, copies @ (_unit(own.column(2)) @ wanted.T >= threshold), strict=True):
                        total[node] = total.get(node, 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    there = all_classes.select("node", "grp", "embedding", "copies").mapInArrow(count, "node string, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    # A class meets itself in brute force; its own copies are no links between classes.
    both = there.join(all_classes.select("node", "copies"), "node").join(counts, "node", "left").select((F.col("n") - F.col("copies")).alias("n"), F.coalesce("links", F.lit(0)).alias("links"))
    got = both.agg(F.sum(F.least("n", "links")).alias("found"), F.sum("n").alias("all")).first()
    return got["found"] / got["all"] if got["all"] else 1.0


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
