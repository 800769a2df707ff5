"""Burst operators on the pooled spike stream of a recording: ``stream(rec, tick, unit)``.

Sessions and islands are window functions over (rec order by tick); the exact splitting automaton
needs state that windows can't express and runs as one grouped map for each recording.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.bursts import isi_n_bursts
from .base import SqlOperator
from .cluster import ship

isi_n_spans = SqlOperator(
    "Spans of N successive spikes (W2), and for each spike the least of the spans that hold it; spikes too near the ends have none (W3).",
    """
WITH s AS (SELECT rec, unit, tick, row_number() OVER w AS i, count(*) OVER (PARTITION BY rec) AS len, (lead(tick, $n - 1) OVER w) - tick AS span FROM {stream} WINDOW w AS (PARTITION BY rec ORDER BY tick, unit))
SELECT rec, unit, tick, span, CASE WHEN i BETWEEN $n AND len - ($n - 1) THEN min(span) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN $n - 1 PRECEDING AND CURRENT ROW) END AS least_span FROM s""",
    n=4,
)

gap_bursts = SqlOperator(
    "Bursts as sessions: a gap over ``gap`` starts a new one; those of fewer than ``n`` spikes are none (W4, simple case).",
    """
WITH s AS (SELECT rec, tick, unit, CASE WHEN tick - (lag(tick) OVER w) > $gap THEN 1 ELSE 0 END AS cut FROM {stream} WINDOW w AS (PARTITION BY rec ORDER BY tick, unit)),
b AS (SELECT rec, tick, sum(cut) OVER (PARTITION BY rec ORDER BY tick, unit ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY t_start) AS INT) AS burst, t_start, t_end, n FROM (SELECT rec, k, min(tick) AS t_start, max(tick) AS t_end, count(*) AS n FROM b GROUP BY rec, k) x WHERE n >= $n""",
    gap=300000000, n=4,
)

merged_bursts = SqlOperator(
    "Joins bursts whose gap is at most ``gap`` (W6); with the gap to the next merged burst (W5).",
    """
WITH s AS (SELECT rec, t_start, t_end, n, CASE WHEN t_start - max(t_end) OVER (PARTITION BY rec ORDER BY t_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > $gap THEN 1 ELSE 0 END AS cut FROM {bursts}),
k AS (SELECT rec, t_start, t_end, n, sum(cut) OVER (PARTITION BY rec ORDER BY t_start ROWS UNBOUNDED PRECEDING) AS g FROM s),
m AS (SELECT rec, g, min(t_start) AS t_start, max(t_end) AS t_end, sum(n) AS n, count(*) AS parts FROM k GROUP BY rec, g)
SELECT rec, t_start, t_end, CAST(n AS BIGINT) AS n, parts, lead(t_start) OVER (PARTITION BY rec ORDER BY t_start) - t_end AS gap_after FROM m""",
    gap=1800000000,
)

# Each spike with the last burst that begins before or with it: bursts and spikes in one order, no
# range join. A burst's beginning comes before a spike of the same time.
_IN_BURST = """
WITH e AS (SELECT rec, burst, t_start, t_end, lead(burst) OVER (PARTITION BY rec ORDER BY t_start) AS following FROM {bursts}),
m AS (SELECT rec, t_start AS tick, 0 AS kind, burst, t_start, t_end, following FROM e UNION ALL SELECT rec, tick, 1, NULL, NULL, NULL, NULL FROM {stream} WHERE tick >= 0),
o AS (SELECT rec, tick, kind, max(t_start) OVER w AS t_start, max(t_end) OVER w AS t_end, max(burst) OVER w AS burst FROM m WINDOW w AS (PARTITION BY rec ORDER BY tick, kind ROWS UNBOUNDED PRECEDING)),
x AS (SELECT o.rec, o.tick, o.burst, o.t_start, o.t_end, e.following FROM o LEFT JOIN e ON o.rec = e.rec AND o.burst = e.burst WHERE kind = 1)"""

burst_spike_counts = SqlOperator(
    "Spikes strictly inside each burst, and in the gap before it; the tail after the last burst comes as burst 0 (J3, B9). Bursts are numbered from 1 and don't overlap.",
    _IN_BURST
    + """,
g AS (SELECT rec, CASE WHEN t_start IS NULL THEN (SELECT min(burst) FROM {bursts} f WHERE f.rec = x.rec) WHEN tick > t_end THEN coalesce(following, 0) ELSE burst END AS burst, CASE WHEN tick > t_start AND tick < t_end THEN 1 ELSE 0 END AS inside, CASE WHEN t_start IS NULL OR tick > t_end THEN 1 ELSE 0 END AS gap FROM x),
c AS (SELECT rec, burst, sum(inside) AS inside, sum(gap) AS gap FROM g GROUP BY rec, burst)
SELECT b.rec, CAST(b.burst AS INT) AS burst, CAST(coalesce(inside, 0) AS BIGINT) AS inside, CAST(coalesce(gap, 0) AS BIGINT) AS gap_before FROM {bursts} b LEFT JOIN c ON b.rec = c.rec AND b.burst = c.burst
UNION ALL SELECT rec, 0, CAST(0 AS BIGINT), CAST(gap AS BIGINT) FROM c WHERE burst = 0""",
)

burst_features = SqlOperator(
    "Burst features of a recording: intervals, durations, rise and fall around the fullest bin, peak rate, rates inside and between; outliers (scaled MAD over 3) leave before medians; fewer than three bursts give zeros (B7, A22).",
    _IN_BURST
    + """,
u AS (SELECT rec, count(DISTINCT unit) AS units FROM {stream} GROUP BY rec),
y AS (SELECT rec, burst, t_start, t_end, (lead(t_start) OVER w) - t_end AS ibi, (t_end - t_start) / 1e6 AS dur FROM {bursts} WINDOW w AS (PARTITION BY rec ORDER BY t_start)),
bins AS (SELECT rec, burst, @IDIV(tick - t_start, $bin) AS b, count(*) AS n FROM x WHERE tick BETWEEN t_start AND t_end GROUP BY 1, 2, 3),
peak AS (SELECT rec, burst, max(n) AS top, min_by(b, (-n, b)) AS at_, sum(n) AS total FROM bins GROUP BY rec, burst),
f AS (SELECT y.rec, y.burst, dur, ibi / 1e6 AS ibi, at_ * $bin / 1e6 AS rise, dur - at_ * $bin / 1e6 AS fall, top * 1e0 / units * (1e6 / $bin) AS peak_rate, total / nullif(dur, 0) / units AS intra FROM y JOIN peak ON y.rec = peak.rec AND y.burst = peak.burst JOIN u ON y.rec = u.rec),
l AS (SELECT rec, 'duration' AS name, dur AS v FROM f UNION ALL SELECT rec, 'interval', ibi FROM f WHERE ibi IS NOT NULL UNION ALL SELECT rec, 'rise', rise FROM f UNION ALL SELECT rec, 'fall', fall FROM f UNION ALL SELECT rec, 'peak_rate', peak_rate FROM f UNION ALL SELECT rec, 'intra_rate', intra FROM f WHERE intra IS NOT NULL),
med AS (SELECT rec, name, median(v) AS m FROM l GROUP BY rec, name),
mad AS (SELECT l.rec, l.name, 3 * 1.4826 * median(abs(v - m)) AS s FROM l JOIN med ON l.rec = med.rec AND l.name = med.name GROUP BY l.rec, l.name),
c AS (SELECT rec, count(*) AS bursts FROM {bursts} GROUP BY rec)
SELECT l.rec, l.name, CASE WHEN max(bursts) < 3 THEN 0e0 ELSE round(median(v), 5) END AS middle, CASE WHEN max(bursts) < 3 THEN 0e0 ELSE round(coalesce(stddev_samp(v), 0), 4) END AS spread
FROM l JOIN med ON l.rec = med.rec AND l.name = med.name JOIN mad ON l.rec = mad.rec AND l.name = mad.name JOIN c ON l.rec = c.rec WHERE abs(v - m) <= s GROUP BY l.rec, l.name""",
    bin=60000000,
)

n_grid = SqlOperator("Grid of burst sizes N: from max(4, units / 30 up) to units / 2 up, at most ``most`` values (B1).",
    "WITH u AS (SELECT rec, count(DISTINCT unit) AS units FROM {stream} GROUP BY rec), g AS (SELECT rec, greatest(4, CAST(ceil(units / 30.0) AS INT)) AS lo, CAST(ceil(units / 2e0) AS INT) AS hi FROM u), s AS (SELECT rec, lo, hi, greatest(1, CAST(ceil((hi - lo + 1) / ($most * 1e0)) AS INT)) AS step, @SERIES(0, $most - 1) AS k FROM g) SELECT rec, CAST(lo + k * step AS INT) AS n FROM s WHERE lo + k * step <= hi", most=20)

dunn_threshold = SqlOperator(
    "Dunn index of the two groups of N-spike spans that a threshold makes, in closed form for one dimension: least gap between over widest group; spans of each candidate's own N (B3, X13).",
    """
WITH o AS (SELECT rec, tick, row_number() OVER (PARTITION BY rec ORDER BY tick, unit) AS i FROM {stream}), k AS (SELECT DISTINCT n FROM {candidates}),
d AS (SELECT rec, n, tick, i + n - 1 AS i FROM o CROSS JOIN k), s AS (SELECT d.rec, d.n, o.tick - d.tick AS span FROM d JOIN o ON d.rec = o.rec AND d.i = o.i),
g AS (SELECT s.rec, s.n, threshold, max(CASE WHEN span <= threshold THEN span END) AS low_max, min(CASE WHEN span <= threshold THEN span END) AS low_min, min(CASE WHEN span > threshold THEN span END) AS high_min, max(span) AS high_max FROM s JOIN {candidates} c ON s.n = c.n GROUP BY 1, 2, 3)
SELECT rec, n, threshold, round(coalesce((high_min - low_max) * 1e0 / nullif(greatest(low_max - low_min, high_max - high_min), 0), 0), 9) AS dunn FROM g""",
)

best_isi_n = SqlOperator(
    "Best (N, threshold): Dunn index 0 below ``least`` threshold; of the top three those over 90 % of the best; of these the largest N (B4).",
    """
WITH z AS (SELECT rec, n, threshold, CASE WHEN threshold < $least THEN 0 ELSE dunn END AS d FROM {dunn}),
r AS (SELECT rec, n, threshold, d, row_number() OVER (PARTITION BY rec ORDER BY d DESC, n DESC, threshold) AS k, max(d) OVER (PARTITION BY rec) AS best FROM z)
SELECT rec, n, threshold, round(d, 9) AS dunn FROM (SELECT rec, n, threshold, d, row_number() OVER (PARTITION BY rec ORDER BY n DESC, threshold) AS p FROM r WHERE k <= 3 AND d >= 0.9 * best) x WHERE p = 1""",
    least=10000,
)


def detect_bursts(stream: DataFrame, n: int, isi_n: int) -> DataFrame:
    """Exact N-spike bursts (B5): one grouped map for each recording runs the automaton."""
    ship(stream.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ticks = pdf.sort_values(["tick", "unit"])["tick"].to_numpy()
        rows = isi_n_bursts(ticks, n, isi_n)
        return pd.DataFrame([(pdf["rec"].iloc[0], k + 1, a, b, c) for k, (a, b, c) in enumerate(rows)], columns=["rec", "burst", "t_start", "t_end", "n"])

    return stream.groupBy("rec").applyInPandas(run, "rec string, burst int, t_start long, t_end long, n long")


