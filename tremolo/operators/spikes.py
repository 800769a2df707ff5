"""Spike-train operators: quality control, activity features, histograms, window functions.

Inputs are long tables: ``spikes(rec, unit, tick)`` with ticks in integer microseconds, so that
all time arithmetic is exact. Windows and groups share the key (rec, unit): one shuffle each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SqlOperator

_ISI = """
  SELECT rec, unit, tick, (tick - lag(tick) OVER (PARTITION BY rec, unit ORDER BY tick)) / 1e6 AS isi FROM {spikes}"""

isi = SqlOperator("Inter-spike intervals in seconds: first differences of the sorted times of each unit (W1).",
    f"SELECT rec, unit, tick, round(isi, 6) AS isi FROM ({_ISI}) x WHERE isi IS NOT NULL")

activity_features = SqlOperator(
    "Activity features of each unit: rate, mean, variance and variation of intervals, lag-1 autocorrelation of intervals; a recording lasts to the end of the second of its last spike; zeros for units of two spikes or fewer (P3, A1, W10).",
    f"""
WITH i AS ({_ISI}),
m AS (SELECT rec, unit, tick, isi, avg(isi) OVER (PARTITION BY rec, unit) AS mean_isi, lead(isi) OVER (PARTITION BY rec, unit ORDER BY tick) AS next_isi FROM i),
f AS (SELECT rec, unit, count(*) AS n, avg(isi) AS mean_isi, var_samp(isi) AS var_isi, stddev_samp(isi) AS sd,
    sum((isi - mean_isi) * (next_isi - mean_isi)) / nullif(sum((isi - mean_isi) * (isi - mean_isi)), 0) AS pac, max(tick) AS last_tick FROM m GROUP BY rec, unit),
l AS (SELECT rec AS l_rec, ceil(max(last_tick) / 1e6) AS duration FROM f GROUP BY rec)
SELECT rec, unit, n AS n_spikes, round(n / duration, 9) AS firing_rate, round(CASE WHEN n > 2 THEN mean_isi ELSE 0 END, 4) AS mean_isi, round(CASE WHEN n > 2 THEN var_isi ELSE 0 END / 1e6, 3) AS var_isi_m,
  round(CASE WHEN n > 2 THEN sd / mean_isi ELSE 0 END, 6) AS cv_isi, round(CASE WHEN n > 2 THEN pac ELSE 0 END, 6) AS partial_autocorrelation FROM f JOIN l ON f.rec = l.l_rec""",
)

unit_activity_features = SqlOperator(
    "Activity features with quality flags: rate outside its bounds (F5), share of intervals under the refractory window too high (F6), and whether both pass (F9).",
    f"""
WITH i AS ({_ISI}),
m AS (SELECT rec, unit, tick, isi, avg(isi) OVER (PARTITION BY rec, unit) AS mean_isi, lead(isi) OVER (PARTITION BY rec, unit ORDER BY tick) AS next_isi FROM i),
f AS (SELECT rec, unit, count(*) AS n, avg(isi) AS mean_isi, stddev_samp(isi) AS sd, avg(CASE WHEN isi < $refractory THEN 1e0 WHEN isi IS NOT NULL THEN 0e0 END) AS violations,
    sum((isi - mean_isi) * (next_isi - mean_isi)) / nullif(sum((isi - mean_isi) * (isi - mean_isi)), 0) AS pac, max(tick) AS last_tick FROM m GROUP BY rec, unit),
l AS (SELECT rec AS l_rec, ceil(max(last_tick) / 1e6) AS duration FROM f GROUP BY rec)
SELECT rec, unit, n AS n_spikes, round(n / duration, 9) AS firing_rate, round(CASE WHEN n > 2 THEN mean_isi ELSE 0 END, 4) AS mean_isi, round(CASE WHEN n > 2 THEN sd / mean_isi ELSE 0 END, 6) AS cv_isi, round(CASE WHEN n > 2 THEN pac ELSE 0 END, 6) AS partial_autocorrelation,
  (n / duration < $low OR n / duration > $high) AS bad_rate, coalesce(violations > $max_violations, FALSE) AS bad_refractory,
  NOT (n / duration < $low OR n / duration > $high OR coalesce(violations > $max_violations, FALSE)) AS good FROM f JOIN l ON f.rec = l.l_rec""",
    refractory=600, low=0.000002, high=0.00001, max_violations=0.02,
)

qc_recordings = SqlOperator("Recordings with at least ``n_units`` good units stay (F9); the others go with all their units.",
    "SELECT rec, n_units, n_good FROM (SELECT rec, count(*) AS n_units, count_if(good) AS n_good FROM {flags} GROUP BY rec) x WHERE n_good >= $n_units", n_units=10)

min_unit_filter = SqlOperator("Recordings with strictly more than ``threshold`` units (F2).",
    "SELECT s.rec, count(*) AS n_spikes FROM {spikes} s SEMI JOIN (SELECT rec FROM {spikes} GROUP BY rec HAVING count(DISTINCT unit) > $threshold) k ON s.rec = k.rec GROUP BY s.rec", threshold=10)

amplitude_qc = SqlOperator("Amplitude bounds: a unit fails outside [low, high] or without a number (F4).",
    "SELECT unit, round(amplitude, 6) AS amplitude, (amplitude IS NULL OR isnan(amplitude) OR amplitude < $low OR amplitude > $high) AS bad_amplitude FROM {units}", low=0.5, high=2e0)

waveform_qc = SqlOperator(
    "Waveform quality from samples ``waveforms(unit, i, v)``: axonal if -max/min of the normalised waveform is over ``max_axon`` (F7); noise if slopes change sign over ``max_turns`` times in the window around the median trough, or the trough lies outside it (F8, W12).",
    """
WITH s AS (SELECT unit, i, v, lag(v) OVER (PARTITION BY unit ORDER BY i) AS p, lead(v) OVER (PARTITION BY unit ORDER BY i) AS q FROM {waveforms}),
t AS (SELECT unit, max(v) AS hi, min(v) AS lo, min_by(i, v) AS trough FROM {waveforms} GROUP BY unit),
c AS (SELECT CAST(floor(median(trough)) AS INT) AS mid FROM t),
n AS (SELECT s.unit, sum(CASE WHEN (v - p) * (q - v) < 0 THEN 1 ELSE 0 END) AS turns FROM s, c WHERE i BETWEEN mid - $half AND mid + $half GROUP BY s.unit)
SELECT t.unit, round(-hi / lo, 6) AS axon_ratio, CAST(turns AS BIGINT) AS turns, coalesce(-hi / lo > $max_axon, FALSE) AS axonal, (turns > $max_turns OR trough < mid - $half OR trough > mid + $half) AS noisy
FROM t JOIN n ON t.unit = n.unit, c""", half=20, max_axon=0.8, max_turns=14,
)

tonic_removal = SqlOperator(
    "Drops tonic units: rate an outlier by scaled MAD (factor 1) and above the median, variation below the mean; the rest are numbered densely (F10, J9).",
    """
WITH med AS (SELECT rec, median(firing_rate) AS m, avg(cv_isi) AS mean_cv FROM {features} GROUP BY rec),
dev AS (SELECT f.rec, f.unit, f.firing_rate, f.cv_isi, m, mean_cv, abs(f.firing_rate - m) AS d FROM {features} f JOIN med ON f.rec = med.rec),
mad AS (SELECT rec, 1.4826 * median(d) AS s FROM dev GROUP BY rec),
tonic AS (SELECT dev.rec, unit FROM dev JOIN mad ON dev.rec = mad.rec WHERE d > s AND firing_rate > m AND cv_isi < mean_cv)
SELECT k.rec, k.unit, CAST(dense_rank() OVER (PARTITION BY k.rec ORDER BY k.unit) AS INT) AS new_unit, n_spikes
FROM {features} k ANTI JOIN tonic ON k.rec = tonic.rec AND k.unit = tonic.unit""",
)

rebuilt_spikes = SqlOperator("Spike stream after quality control: bad units dropped, units numbered 1..n, sorted by time (P10, O1, J8).",
    "SELECT s.rec, s.tick, CAST(dense_rank() OVER (PARTITION BY s.rec ORDER BY s.unit) AS INT) AS unit FROM {spikes} s SEMI JOIN (SELECT rec, unit FROM {flags} WHERE good) g ON s.rec = g.rec AND s.unit = g.unit")

robust_unit_means = SqlOperator(
    "Outlier-robust means per recording: a unit goes if any feature is further than ``factor`` scaled MADs from the median; a single unit passes (A6).",
    """
WITH med AS (SELECT rec, count(*) AS n, median(firing_rate) AS a, median(mean_isi) AS b, median(cv_isi) AS c FROM {features} GROUP BY rec),
dev AS (SELECT f.rec, f.firing_rate, f.mean_isi, f.cv_isi, n, abs(f.firing_rate - a) AS da, abs(f.mean_isi - b) AS db, abs(f.cv_isi - c) AS dc FROM {features} f JOIN med ON f.rec = med.rec),
mad AS (SELECT rec, $factor * 1.4826 * median(da) AS sa, $factor * 1.4826 * median(db) AS sb, $factor * 1.4826 * median(dc) AS sc FROM dev GROUP BY rec)
SELECT dev.rec, count(*) AS n_used, round(avg(firing_rate), 12) AS firing_rate, round(avg(mean_isi), 7) AS mean_isi, round(avg(cv_isi), 9) AS cv_isi
FROM dev JOIN mad ON dev.rec = mad.rec WHERE n = 1 OR NOT (da > sa OR db > sb OR dc > sc) GROUP BY dev.rec""", factor=5,
)

cluster_unit_means = SqlOperator(
    "Robust means per recording and cluster, one row for each of ``clusters`` clusters; an empty cluster has zeros (A7, P9).",
    """
WITH f AS (SELECT rec, unit, firing_rate, cv_isi, unit % $present AS cluster FROM {features}),
med AS (SELECT rec, cluster, count(*) AS n, median(firing_rate) AS a, median(cv_isi) AS b FROM f GROUP BY rec, cluster),
dev AS (SELECT f.rec, f.cluster, firing_rate, cv_isi, n, abs(firing_rate - a) AS da, abs(cv_isi - b) AS db FROM f JOIN med ON f.rec = med.rec AND f.cluster = med.cluster),
mad AS (SELECT rec, cluster, 5 * 1.4826 * median(da) AS sa, 5 * 1.4826 * median(db) AS sb FROM dev GROUP BY rec, cluster),
r AS (SELECT dev.rec, dev.cluster, avg(firing_rate) AS firing_rate, avg(cv_isi) AS cv_isi FROM dev JOIN mad ON dev.rec = mad.rec AND dev.cluster = mad.cluster WHERE n = 1 OR NOT (da > sa OR db > sb) GROUP BY dev.rec, dev.cluster),
spine AS (SELECT rec, @SERIES(0, $clusters - 1) AS cluster FROM (SELECT DISTINCT rec FROM f) x)
SELECT spine.rec, CAST(spine.cluster AS BIGINT) AS cluster, round(coalesce(firing_rate, 0), 12) AS firing_rate, round(coalesce(cv_isi, 0), 9) AS cv_isi FROM spine LEFT JOIN r ON spine.rec = r.rec AND spine.cluster = r.cluster""",
    clusters=5, present=4,
)

binned_activity = SqlOperator(
    "Spike counts in bins of fixed width over [0, duration], empty bins included, the last closed on the right (A2).",
    """
WITH b AS (SELECT rec, least(@IDIV(tick, $width), $bins - 1) AS bin, count(*) AS n FROM {spikes} WHERE tick BETWEEN 0 AND CAST($width AS BIGINT) * $bins GROUP BY 1, 2),
spine AS (SELECT rec, @SERIES(CAST(0 AS BIGINT), CAST($bins - 1 AS BIGINT)) AS bin FROM (SELECT DISTINCT rec FROM {spikes}) x)
SELECT spine.rec, spine.bin, coalesce(n, 0) AS n FROM spine LEFT JOIN b ON spine.rec = b.rec AND spine.bin = b.bin""", width=21600000000, bins=120,
)

range_histogram = SqlOperator(
    "Histogram of n equal bins over the range of the data, per group (A3).",
    """
WITH r AS (SELECT g, min(x) AS lo, max(x) AS hi FROM {values} GROUP BY g)
SELECT v.g, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * $bins), $bins - 1) END AS INT) AS bin, count(*) AS n FROM {values} v JOIN r ON v.g = r.g GROUP BY 1, 2""", bins=10,
)

log_isi_histogram = SqlOperator("Histogram of log10 intervals in steps of ``step`` decades (A4).",
    f"SELECT rec, CAST(floor(log10(isi) / $step) AS INT) AS bin, count(*) AS n FROM ({_ISI}) i WHERE isi > 0 GROUP BY 1, 2", step=0.025)

density_map = SqlOperator(
    "Two-dimensional histogram of points(cluster, x, y) on an n by n grid over the range of all points (A5, V1).",
    """
WITH r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {points})
SELECT cluster, CAST(least(floor((x - x0) / (x1 - x0) * $n), $n - 1) AS INT) AS bx, CAST(least(floor((y - y0) / (y1 - y0) * $n), $n - 1) AS INT) AS by_, count(*) AS n FROM {points}, r GROUP BY 1, 2, 3""", n=20,
)

cluster_shifts = SqlOperator(
    "Difference of min-max scaled density maps for each pair of clusters (A20).",
    """
WITH s AS (SELECT cluster, min(n) AS lo, max(n) AS hi FROM {density} GROUP BY cluster),
d AS (SELECT x.cluster, bx, by_, CASE WHEN hi > lo THEN (n - lo) * 1e0 / (hi - lo) ELSE 0 END AS z FROM {density} x JOIN s ON x.cluster = s.cluster),
cells AS (SELECT DISTINCT bx, by_ FROM d), names AS (SELECT DISTINCT cluster FROM d),
full_ AS (SELECT names.cluster, cells.bx, cells.by_, coalesce(z, 0) AS z FROM names CROSS JOIN cells LEFT JOIN d ON d.cluster = names.cluster AND d.bx = cells.bx AND d.by_ = cells.by_)
SELECT a.cluster AS c1, b.cluster AS c2, round(sum(abs(a.z - b.z)), 6) AS shift, round(max(a.z - b.z), 6) AS top FROM full_ a JOIN full_ b ON a.bx = b.bx AND a.by_ = b.by_ AND a.cluster < b.cluster GROUP BY 1, 2""",
)

raster = SqlOperator("Raster per recording and unit: distinct sorted bins of the spikes (K9, D16).",
    "SELECT rec, unit, count(*) AS n_bins, min(bin) AS first_bin, max(bin) AS last_bin, sum(bin) AS bin_sum FROM (SELECT DISTINCT rec, unit, CAST(round(tick / $width) AS BIGINT) AS bin FROM {spikes}) x GROUP BY rec, unit", width=1e6)

time_split = SqlOperator(
    "Cuts recordings into windows (start, end), both ends open, times counted from the window's start (S13, F11, T3).",
    "SELECT w.win, s.rec, s.unit, s.tick - w.t0 AS tick FROM {spikes} s JOIN {windows} w ON s.tick > w.t0 AND s.tick < w.t1",
)

cumulative_activity = SqlOperator("Cumulative counts of binned activity from both ends (W7).",
    "SELECT rec, bin, CAST(sum(n) OVER (PARTITION BY rec ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS forward, CAST(sum(n) OVER (PARTITION BY rec ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS backward FROM {binned}")

central_difference = SqlOperator("Central difference of binned activity; at the ends the mean of the series (W11).",
    "SELECT rec, bin, round(coalesce((lead(n) OVER w - lag(n) OVER w) / 2e0, avg(n) OVER (PARTITION BY rec)), 6) AS d FROM {binned} WINDOW w AS (PARTITION BY rec ORDER BY bin)")

gaussian3 = SqlOperator("Gaussian smoothing over three bins with weights of one sixth of the window as spread; weights renormalise at the ends (W8, B12).",
    "SELECT rec, bin, round((n + exp(-2e0) * (coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0))) / (1 + exp(-2e0) * (CASE WHEN lag(n) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(n) OVER w IS NULL THEN 0 ELSE 1 END)), 6) AS s FROM {binned} WINDOW w AS (PARTITION BY rec ORDER BY bin)")

local_peaks = SqlOperator("Local maxima of binned activity, the ``k`` highest of each recording (W9, W13, W14, O3).",
    "SELECT rec, bin, n FROM (SELECT rec, bin, n, row_number() OVER (PARTITION BY rec ORDER BY n DESC, bin) AS r FROM (SELECT rec, bin, n, lag(n) OVER (PARTITION BY rec ORDER BY bin) AS p, lead(n) OVER (PARTITION BY rec ORDER BY bin) AS q FROM {binned}) x WHERE n > p AND n >= q) y WHERE r <= $k", k=3)

network_order = SqlOperator("Raster rows ordered by cluster, then unit (A28).",
    "SELECT rec, unit, unit % $clusters AS cluster, CAST(row_number() OVER (PARTITION BY rec ORDER BY unit % $clusters, unit) AS INT) AS raster_row FROM (SELECT DISTINCT rec, unit FROM {spikes}) x", clusters=4)

peak_waveform = SqlOperator(
    "Peak waveform from templates(unit, electrode, i, v): the global minimum over samples and electrodes gives amplitude (times ``lsb``), reference electrode and normalised waveform (P1); samples that are zero everywhere are left out (F16).",
    """
WITH live AS (SELECT i FROM {templates} GROUP BY i HAVING max(abs(v)) <> 0),
t AS (SELECT x.unit, x.electrode, x.i, x.v FROM {templates} x SEMI JOIN live ON x.i = live.i),
m AS (SELECT unit, min(v) AS lo, min_by(electrode, (v, electrode, i)) AS electrode FROM t GROUP BY unit)
SELECT m.unit, m.electrode, round(abs(lo) * $lsb, 6) AS amplitude, count(*) AS samples, round(sum(t.v) / max(abs(t.v)), 6) AS norm_sum FROM m JOIN t ON m.unit = t.unit AND m.electrode = t.electrode GROUP BY m.unit, m.electrode, lo""",
    lsb=6.2,
)

close_units = SqlOperator("Units at a distance strictly between ``near`` and ``far``, without the unit itself (F14, X11).",
    "SELECT a.unit, b.unit AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM {places} a JOIN {places} b ON a.unit <> b.unit WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > $near AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < $far", near=0e0, far=0.4)


def units_between(places: DataFrame, near: float = 0e0, far: float = 0.4) -> DataFrame:
    """The rows of ``close_units``, each unit's found in a worker that holds all ``places(unit, x, y)``,
    24 bytes each: pairs are neither shuffled nor written before they are returned."""
    spark = places.sparkSession
    kind = dict(places.dtypes)["unit"]
    table = places.where("unit IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").toArrow()
    given = spark.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in ("unit", "x", "y")))
    parts = 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, x, y = given.value
        step = max(1, (1 << 18) // max(1, len(unit)))
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            own = np.arange(k, len(unit), parts)
            for at in range(0, len(own), step):
                a = own[at : at + step, None]
                dx, dy = x[a] - x, y[a] - y
                d = np.sqrt(dx * dx + dy * dy)
                i, j = np.nonzero((d > near) & (d < far) & (unit[a] != unit))
                yield pa.RecordBatch.from_arrays([pa.array(unit[a[i, 0]]), pa.array(unit[j]), pa.array(d[i, j])], names=["unit", "other", "distance"])

    found = spark.range(0, parts, 1, parts).mapInArrow(run, f"unit {kind}, other {kind}, distance double")
    return found.withColumn("distance", F.round("distance", 6))


series_autocorrelation = SqlOperator("Autocorrelation of binned activity up to ``lags`` (L20).",
    "WITH z AS (SELECT rec, bin, n - avg(n) OVER (PARTITION BY rec) AS v FROM {binned}), v AS (SELECT rec, sum(v * v) AS s FROM z GROUP BY rec) SELECT a.rec, CAST(b.bin - a.bin AS INT) AS lag_, round(sum(a.v * b.v) / max(v.s), 6) AS ac FROM z a JOIN z b ON a.rec = b.rec AND b.bin BETWEEN a.bin AND a.bin + $lags JOIN v ON a.rec = v.rec GROUP BY 1, 2", lags=20)

trapezoid = SqlOperator("Trapezoid integral of samples(unit, i, v) (X6), and zero crossings (X9).",
    "SELECT unit, round(sum((v + p) / 2), 6) AS area, count_if(v * p < 0) AS crossings FROM (SELECT unit, v, lag(v) OVER (PARTITION BY unit ORDER BY i) AS p FROM {waveforms}) x GROUP BY unit")
