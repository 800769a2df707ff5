"""Connectivity operators: correlograms, tiling coefficients, surrogates, covariance.

Band joins are equi-joins on time buckets as wide as the window (the other side stands in its own
bucket and its two neighbours), with the exact range as residual: no pair outside adjacent
buckets is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import correlograms as kernels
from ..functions.connectivity import hollow_gaussian_test, least_counts, link_candidates, significant_links
from .base import SqlOperator
from .cluster import ship

_BAND = """
WITH s AS (SELECT rec, unit, tick, row_number() OVER (PARTITION BY rec ORDER BY tick, unit) AS i, @IDIV(tick, $width) AS k FROM {spikes}),
o AS (SELECT rec, unit, tick, i, @SERIES(k - 1, k + 1) AS k FROM s)"""

ccg_counts = SqlOperator(
    "Cross-correlogram counts of all ordered unit pairs: lag bins of ``bin`` ticks up to ``half`` bins, half-bin ties round down; backward window closed, forward window open (K1, J2). Pairs and bins without counts are left out; ``ccg_grid`` adds them.",
    _BAND
    + """
SELECT o.rec, o.unit AS a, s.unit AS b, CAST(-floor(0.5 + (o.tick - s.tick) / ($bin * 1e0)) AS INT) AS lag_bin, count(*) AS n FROM s JOIN o ON s.rec = o.rec AND s.k = o.k AND s.i <> o.i
WHERE CASE WHEN o.i < s.i THEN s.tick - o.tick <= $bin * ($half + 0.5) ELSE o.tick - s.tick < $bin * ($half + 0.5) END GROUP BY 1, 2, 3, 4""",
    bin=60000000, half=50, width=3030000000,
)

ccg_grid = SqlOperator("Correlograms of all unit pairs on the full grid of lags, zeros included; rate divides by the spikes of a and the bin (K1 'rate').",
    "WITH u AS (SELECT rec, unit, count(*) AS spikes FROM {spikes} GROUP BY rec, unit), g AS (SELECT a.rec, a.unit AS a, b.unit AS b, a.spikes, @SERIES(-$half, $half) AS lag_bin FROM u a JOIN u b ON a.rec = b.rec) SELECT g.rec, g.a, g.b, CAST(g.lag_bin AS INT) AS lag_bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (spikes * $bin / 1e6), 9) AS rate FROM g LEFT JOIN {ccg} c ON g.rec = c.rec AND g.a = c.a AND g.b = c.b AND g.lag_bin = c.lag_bin", half=50, bin=60000000)

acg_counts = SqlOperator("Autocorrelograms: the diagonal of the correlograms (P7, P8), with the share of the fullest bin.",
    "SELECT rec, a AS unit, lag_bin, n, round(n * 1e0 / max(n) OVER (PARTITION BY rec, a), 6) AS norm FROM {ccg} WHERE a = b")

ccg_sum = SqlOperator("Sum of correlograms over the recordings of a culture (A21).",
    "SELECT a, b, lag_bin, CAST(sum(n) AS BIGINT) AS n FROM {ccg} GROUP BY a, b, lag_bin")

tiling_coefficient = SqlOperator(
    "Spike-time tiling coefficient of the unit pairs of each recording: shares of time covered within dt of a spike, shares of spikes with a partner within dt (K5, K6, J4, J5). A recording lasts to the end of the second of its last spike, or for ``stop`` ticks where that is over 0.",
    """
WITH s AS (SELECT rec, unit, tick, @IDIV(tick, $dt) AS k FROM {spikes}),
l AS (SELECT rec, CASE WHEN $stop > 0 THEN $stop ELSE ceil(max(tick) / 1e6) * 1e6 END AS stop FROM s GROUP BY rec),
g AS (SELECT rec, unit, tick, tick - lag(tick) OVER (PARTITION BY rec, unit ORDER BY tick) AS isi FROM s),
t AS (SELECT rec, unit, count(*) AS n, min(tick) AS t1, max(tick) AS tn, sum(greatest(0, 2 * CAST($dt AS BIGINT) - coalesce(isi, 2 * CAST($dt AS BIGINT)))) AS overlap FROM g GROUP BY rec, unit),
c AS (SELECT t.rec, unit, n, (2e0 * n * $dt - overlap - greatest(0, $dt - t1) - CASE WHEN n = 1 AND t1 < $dt THEN 0 ELSE greatest(0, $dt - (stop - tn)) END) / stop AS cover FROM t JOIN l ON t.rec = l.rec),
p AS (SELECT x.rec, x.unit AS a, y.unit AS b, count(DISTINCT x.tick) AS hits FROM s x JOIN (SELECT rec, unit, tick, @SERIES(k - 1, k + 1) AS k FROM s) y ON x.rec = y.rec AND x.k = y.k AND x.unit <> y.unit AND abs(x.tick - y.tick) <= $dt GROUP BY 1, 2, 3),
q AS (SELECT a.rec, a.unit AS a, b.unit AS b, a.cover AS ta, b.cover AS tb, coalesce(pa.hits, 0) * 1e0 / a.n AS pa, coalesce(pb.hits, 0) * 1e0 / b.n AS pb FROM c a JOIN c b ON a.rec = b.rec AND a.unit < b.unit LEFT JOIN p pa ON pa.rec = a.rec AND pa.a = a.unit AND pa.b = b.unit LEFT JOIN p pb ON pb.rec = a.rec AND pb.a = b.unit AND pb.b = a.unit)
SELECT rec, a, b, round(0.5 * ((pa - tb) / nullif(1 - tb * pa, 0) + (pb - ta) / nullif(1 - ta * pb, 0)), 6) AS sttc FROM q""",
    dt=1800000000, stop=0,
)

surrogate_threshold = SqlOperator("Per pair the percentile of surrogate coefficients by the Hazen rule (position n q - 1/2), and whether the coefficient is over it (A26, K7).",
    """
WITH r AS (SELECT a, b, sttc, row_number() OVER (PARTITION BY a, b ORDER BY sttc) AS k, count(*) OVER (PARTITION BY a, b) AS n FROM {surrogates}),
h AS (SELECT a, b, sum(CASE WHEN k = greatest(1, CAST(floor(n * $q + 0.5) AS INT)) THEN sttc * (1 - (n * $q + 0.5 - floor(n * $q + 0.5))) WHEN k = least(n, CAST(floor(n * $q + 0.5) AS INT) + 1) THEN sttc * (n * $q + 0.5 - floor(n * $q + 0.5)) ELSE 0 END) AS threshold FROM r GROUP BY a, b)
SELECT e.a, e.b, round(e.sttc, 6) AS sttc, round(threshold, 6) AS threshold, e.sttc > threshold AS linked FROM {observed} e JOIN h ON e.a = h.a AND e.b = h.b""", q=0.95)  # fmt: skip


def jitter(spikes: DataFrame, sd: float, surrogates: int, seed: int = 1) -> DataFrame:
    """``surrogates`` jittered copies of every train (K8): Gaussian shifts with spread ``sd`` ticks;
    a spike that would leave the train's range stays where it was. Two spikes of a copy may share
    a tick, which the tiling coefficient doesn't mind."""
    shifted = F.col("tick") + F.round(F.randn(seed) * sd).cast("long")
    out = spikes.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(surrogates)))).withColumn("shifted", shifted)
    return out.withColumn("tick", F.when(F.col("shifted") < 0, F.col("tick")).otherwise(F.col("shifted"))).drop("shifted")


def null_models(spikes: DataFrame, method: str, bins: int, seed: int = 1) -> DataFrame:
    """Null models of binned trains (K8): ``wrap`` rotates a train by a random offset, ``poisson``
    redraws the same number of spikes evenly, ``swap`` exchanges the units of random spike pairs
    in a recording. One grouped map for each train (or recording)."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["unit"].iloc[0]) & 0x7FFFFFFF])
        t = pdf["tick"].to_numpy()
        new = (t + rng.integers(0, bins)) % bins if method == "wrap" else np.sort(rng.integers(0, bins, len(t)))
        return pdf.assign(tick=np.sort(new))

    def recording(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values(["tick", "unit"]).reset_index(drop=True)
        u = pdf["unit"].to_numpy().copy()
        order = rng.permutation(len(u))
        half = len(u) // 2
        u[order[:half]], u[order[half : 2 * half]] = u[order[half : 2 * half]].copy(), u[order[:half]].copy()
        return pdf.assign(unit=u)

    schema = "rec string, unit long, tick long"
    if method == "swap":
        return spikes.select("rec", "unit", "tick").groupBy("rec").applyInPandas(recording, schema)
    return spikes.select("rec", "unit", "tick").groupBy("rec", "unit").applyInPandas(train, schema)


class Held:
    """All spikes of ``spikes(rec, unit, tick)`` in every worker, 12 bytes each."""

    def __init__(self, spikes: DataFrame):
        self.spark, self.kinds = spikes.sparkSession, dict(spikes.dtypes)
        ship(self.spark)
        table = spikes.where("rec IS NOT NULL AND tick IS NOT NULL").select("rec", "unit", F.col("tick").cast("long")).toArrow()
        rec, unit = (table.column(k).combine_chunks().dictionary_encode("encode") for k in (0, 1))
        rec, unit = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rec, unit))
        trains = kernels.Trains(rec.indices.to_numpy(), unit.indices.to_numpy(), table.column(2).to_numpy())
        self.given = self.spark.sparkContext.broadcast((trains, rec.dictionary.to_pylist(), unit.dictionary.to_pylist()))
        self.types = (rec.dictionary.type, unit.dictionary.type)


def correlograms(spikes: DataFrame | Held, form: str = "counts", bin: int = 60_000_000, half: int = 50) -> DataFrame:  # noqa: A002
    """The rows of ``ccg_counts`` (form ``counts``), of ``ccg_sum`` (``sum``) or ``ccg_grid`` (``grid``) for
    ``spikes(rec, unit, tick)``: units are dealt over tasks, which find the rows of their own as they go,
    so that no pair of spikes is shuffled. Form ``likely`` is ``counts`` without pairs that can't be linked."""
    held = spikes if isinstance(spikes, Held) else Held(spikes)
    spark, given, types, kinds = held.spark, held.given, held.types, held.kinds
    parts = 4 * spark.sparkContext.defaultParallelism
    schema = "" if form == "sum" else f"rec {kinds['rec']}, "
    schema += f"a {kinds['unit']}, b {kinds['unit']}, lag_bin int, n bigint" + (", rate double" if form == "grid" else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trains, recs, units = given.value
        recs, units = pa.array(recs, types[0]), pa.array(units, types[1])
        for k in (x for b in batches for x in b.column(0).to_pylist()):
            mine = np.arange(trains.n_units) % parts == k
            if form == "likely":
                found = kernels.likely(trains, mine, bin, half, *least_counts(half))
            else:
                found = kernels.grid(trains, mine, bin, half) if form == "grid" else kernels.counts(trains, mine, bin, half, form != "sum")
            for r, a, b, *rest in found:
                for at in range(0, len(r), 200_000):
                    cut = slice(at, at + 200_000)
                    columns = [recs.take(pa.array(r[cut])), units.take(pa.array(a[cut])), units.take(pa.array(b[cut])), *(pa.array(x[cut]) for x in rest)]
                    yield pa.RecordBatch.from_arrays(columns[1:] if form == "sum" else columns, names=names)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def ccg_links(ccg: DataFrame, half: int = 50, alpha: float = 0.001, spread: int = 5, together: bool = False, held: Held | None = None) -> DataFrame:
    """Significant connections of correlograms (K3, K4): one row (rec, a, b, sign) for each. Bins
    without counts may be left out, and so may pairs without any, which have no link: the grid
    isn't needed. Arrow kernel; only pairs that pass a necessary condition are tested in full.
    Where the rows of a pair stand ``together``, as ``correlograms`` gives them, none is shuffled;
    where the spikes behind them are ``held``, pairs that can't be linked aren't made (default bins and levels)."""
    ship(ccg.sparkSession)
    if held is not None and (alpha, spread) == (0.001, 5):
        ccg = correlograms(held, "likely", half=half)

    def tested(starts: np.ndarray, lag: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sign of each run of rows."""
        counts = np.zeros((len(starts) - 1, 2 * half + 1))
        counts[np.repeat(np.arange(len(counts)), np.diff(starts)), lag + half] = n
        sign = np.zeros(len(counts), np.int32)
        for k in np.flatnonzero(link_candidates(counts, half, alpha, spread)).tolist():
            sign[k] = significant_links(counts[k], half, alpha, spread)
        return sign

    def test(batches):  # noqa: ANN001, ANN202
        for b in batches:
            lag, n = b.column(3), b.column(4)
            sign = tested(lag.offsets.to_numpy(), lag.flatten().to_numpy(), n.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sign)], names=["rec", "a", "b", "sign"])

    def runs(batches):  # noqa: ANN001, ANN202
        """Rows that stand together; those of a batch's last pair wait for the next batch."""
        kept = None
        for b in batches:
            b = b if kept is None else pa.concat_batches([kept, b])
            a, o = b.column(1).to_numpy(), b.column(2).to_numpy()
            rec = b.column(0).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (a[1:] != a[:-1]) | (o[1:] != o[:-1])][: b.num_rows])
            if len(starts):
                kept = b.slice(int(starts[-1]))
                yield from signed(b, starts)
        if kept is not None:
            yield from signed(kept, np.array([0, kept.num_rows]))

    def signed(b: pa.RecordBatch, starts: np.ndarray):  # noqa: ANN202
        """A link needs a count right behind zero lag, or so many that one is expected there."""
        if len(starts) < 2:
            return
        lag, n = b.column(3).to_numpy()[: starts[-1]], b.column(4).to_numpy()[: starts[-1]].astype(float)
        behind = np.add.reduceat(((lag > 0) & (lag < 5)) * 1, starts[:-1]) > 0
        may = np.flatnonzero(behind | (np.add.reduceat(n, starts[:-1]) >= 0.99 * -np.log(alpha / 10)))
        size = np.diff(starts)
        rows = np.arange(size[may].sum()) + np.repeat(starts[may] - (np.cumsum(size[may]) - size[may]), size[may])
        sign = tested(np.r_[0, np.cumsum(size[may])], lag[rows], n[rows]) if len(may) else np.zeros(0, np.int32)
        at = pa.array(starts[may])
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(sign)], names=["rec", "a", "b", "sign"])

    if together:
        rows = ccg.select("rec", F.col("a").cast("long"), F.col("b").cast("long"), F.col("lag_bin").cast("int"), F.col("n").cast("long"))
        return rows.mapInArrow(runs, "rec string, a long, b long, sign int").where("sign <> 0 AND a <> b")
    arrays = ccg.where("a <> b").groupBy("rec", "a", "b").agg(F.collect_list(F.col("lag_bin").cast("int")).alias("lag"), F.collect_list(F.col("n").cast("double")).alias("n"))
    return arrays.select("rec", F.col("a").cast("long"), F.col("b").cast("long"), "lag", "n").mapInArrow(test, "rec string, a long, b long, sign int").where("sign <> 0")


def ccg_predictor(grid: DataFrame, spread: int = 5) -> DataFrame:
    """Per correlogram bin the smoothed prediction and the p-value of its count (K3)."""
    ship(grid.sparkSession)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag_bin")
        p, expected = hollow_gaussian_test(pdf["n"].to_numpy(float), spread)
        return pdf.assign(expected=expected, p=p)[["rec", "a", "b", "lag_bin", "n", "expected", "p"]]

    return grid.select("rec", "a", "b", "lag_bin", "n").groupBy("rec", "a", "b").applyInPandas(test, "rec string, a long, b long, lag_bin int, n long, expected double, p double")


def _times_pinv(cx: np.ndarray, f: np.ndarray, rcond: float) -> np.ndarray:
    """``cx @ pinv(f.T @ cx)``: with fewer rows than columns by the singular values of the small
    matrix between orthonormal bases, which are those of the product."""
    if len(cx) >= cx.shape[1]:
        return cx @ np.linalg.pinv(f.T @ cx, rcond=rcond)
    (p, r), (q, s) = np.linalg.qr(f.T), np.linalg.qr(cx.T)
    return s.T @ np.linalg.pinv(r @ s.T, rcond=rcond) @ p.T


def differential_covariance(raster: DataFrame, theta: float = 0e0) -> DataFrame:
    """Dynamical differential covariance W = cov(dx, x) B^-1 with B = cov(relu(x - theta), x) (K10)
    of ``raster(rec, unit, bin, n)``, bins without spikes being zero. One matrix for each
    recording; with more units than bins B is singular, and its inverse is the pseudo-inverse
    without singular values that are zero but for rounding."""

    def rows(rec, got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        """Rows of the result some units at a time: it is never held as a whole."""
        unit, bin, n = (pa.chunked_array([b.column(k) for b in got]).cast(kind).combine_chunks() for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64())))  # noqa: A001
        known = np.flatnonzero(pc.and_(pc.and_(unit.is_valid(), bin.is_valid()), n.is_valid()).to_numpy(zero_copy_only=False))
        if not len(known):
            return
        ends = pc.min_max(bin).as_py()
        units, j = np.unique(unit.take(pa.array(known)).to_numpy(), return_inverse=True)
        at = bin.take(pa.array(known)).to_numpy() - ends["min"]
        x, times = np.zeros((2, ends["max"] - ends["min"] + 1, len(units)))
        np.add.at(x, (at, j), n.take(pa.array(known)).to_numpy())
        np.add.at(times, (at, j), 1)
        x /= np.maximum(times, 1)
        d = np.vstack([np.zeros(x.shape[1]), (x[2:] - x[:-2]) / 2, np.zeros(x.shape[1])])
        d[[0, -1]] = d[1:-1].mean(0)
        d -= d.mean(0)
        cx = x - x.mean(0)
        f = np.maximum(x - theta, 0) - np.maximum(x - theta, 0).mean(0)
        inverse = _times_pinv(cx, f, x.shape[1] * np.finfo(float).eps)
        step = max(1, 50_000 // len(units))
        for k in range(0, len(units), step):
            w = d[:, k : k + step].T @ inverse
            columns = [pa.repeat(pa.scalar(rec, pa.string()), w.size), pa.array(np.repeat(units[k : k + step], len(units))), pa.array(np.tile(units, len(w))), pa.array(w.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["rec", "a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for b in batches:
            recs = b.column(0).to_pylist()
            ends = [0, *(k for k in range(1, len(recs)) if recs[k] != recs[k - 1]), len(recs)]
            for lo, hi in zip(ends, ends[1:], strict=False):
                if got and hi > lo and recs[lo] != now:
                    yield from rows(now, got)
                    got = []
                if hi > lo:
                    now = recs[lo]
                    got.append(b.slice(lo, hi - lo))
        if got:
            yield from rows(now, got)

    ship(raster.sparkSession)
    dealt = raster.select("rec", "unit", "bin", "n").repartition(raster.sparkSession.sparkContext.defaultParallelism, "rec")
    return dealt.sortWithinPartitions("rec").mapInArrow(run, "rec string, a long, b long, w double")
