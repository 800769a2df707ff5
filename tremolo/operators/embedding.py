"""Dimension reduction, exact neighbours and clustering of row vectors ``vectors(id, x array<double>)``.

What is fitted is small (a matrix of columns, or k centres) and goes through the driver; rows stay
on the executors. Rows whose vector is null or holds null or non-finite values are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, ship


def _fine(vectors: DataFrame) -> DataFrame:
    x = F.col("x").cast("array<double>")
    return vectors.select("id", x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(rows: DataFrame, column: str, work) -> np.ndarray:  # noqa: ANN001
    """Sum over all rows of the flat arrays that ``work`` makes of batches: one row from each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = work(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = rows.select(column).mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toArrow()
    return sums.column("v").to_numpy()


def principal_components(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(id, scores array<double>, explained array<double>): rows on the ``k`` main axes of the centred
    data, and each axis's share of the variance (L3). An axis points to where its largest loading is
    positive. One pass for sums and products (a square of the number of columns), one for scores."""
    ship(vectors.sparkSession)
    rows = cut(_fine(vectors))
    if not rows.take(1):
        return rows.select("id", F.col("x").alias("scores"), F.col("x").alias("explained"))
    flat = _moments(rows, "x", lambda m: np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()]))
    d = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
    n, mean = flat[0], flat[1 : d + 1] / flat[0]
    value, axis = np.linalg.eigh(flat[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    value, axis = np.maximum(value[::-1], 0), axis[:, ::-1][:, :k]
    axis = axis * np.sign(axis[np.abs(axis).argmax(0), np.arange(axis.shape[1])])
    share = (value[:k] / max(value.sum(), 1e-300)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = ((_matrix(b.column(1)) - mean) @ axis).tolist() if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.list_(pa.float64()))], names=["id", "scores"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, scores array<double>").withColumn("explained", F.array(*map(F.lit, share)))


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 15, block: int = 2048) -> DataFrame:
    """(id, place, neighbour, distance): the ``k`` nearest rows of ``vectors`` by Euclidean distance for
    each row of ``queries``, the row itself left out, ties by id (J11, exact). Every query block meets
    every block of rows, and each meeting gives ``k`` rows a query: work is queries x rows."""
    spark = vectors.sparkSession
    ship(spark)
    q, v = cut(_fine(queries)), cut(_fine(vectors))
    kind = dict(v.dtypes)["id"]
    a, b = max(1, -(-q.count() // block)), max(1, -(-v.count() // block))
    left = q.select(F.col("id").alias("id"), "x", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    right = v.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id")
        empty = pa.table({"id": left.column("id")[:0], "neighbour": ids[:0], "distance": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        x, y = _matrix(left.column("x").combine_chunks()), _matrix(right.column("x").combine_chunks())
        own, names = np.array(left.column("id").to_pylist(), object), np.array(ids.to_pylist(), object)
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
        d[own[:, None] == names[None, :]] = np.inf
        take = min(k, len(names))
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        near = np.stack([np.lexsort((rank, row))[:take] for row in d])
        r, c = np.repeat(np.arange(len(own)), take), near.ravel()
        fine = np.isfinite(d[r, c])
        r, c = r[fine], c[fine]
        exact = np.sqrt(((x[r] - y[c]) ** 2).sum(1))
        return pa.table({"id": left.column("id").combine_chunks().take(pa.array(r)), "neighbour": ids.combine_chunks().take(pa.array(c)), "distance": pa.array(exact)})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"id {kind}, neighbour {kind}, distance double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k)
    return met.groupBy("id").agg(best.alias("near")).select("id", F.posexplode("near").alias("place", "n")).select("id", (F.col("place") + 1).alias("place"), "n.neighbour", "n.distance")


def k_means(vectors: DataFrame, k: int, rounds: int = 100, seed: int = 1) -> DataFrame:
    """(id, cluster, distance): Lloyd's algorithm from ``k`` rows of least hash, until no centre moves or
    ``rounds`` are over (L4). A round is one pass that gives sums from each partition."""
    ship(vectors.sparkSession)
    rows = cut(_fine(vectors))
    first = rows.orderBy(F.xxhash64(F.lit(seed), "x"), "id").limit(k).toArrow()
    if not len(first):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    centres = _matrix(first.column("x").combine_chunks())
    for _ in range(rounds):

        def part(m: np.ndarray, c: np.ndarray = centres) -> np.ndarray:
            at = _far(m, c).argmin(1)
            one = np.eye(len(c))[at]
            return np.column_stack([one.sum(0), one.T @ m]).ravel()

        sums = _moments(rows, "x", part).reshape(len(centres), -1)
        new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
        still, centres = np.allclose(new, centres, rtol=0, atol=1e-12), new
        if still:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _far(_matrix(b.column(1)), centres) if b.num_rows else np.zeros((0, len(centres)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(1).astype(np.int32)), pa.array(np.sqrt(d.min(1)))], names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, cluster int, distance double")


def _far(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((m**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * m @ c.T, 0)
