"""Cohort operators: metadata filters, grouping, pooling, pivots, alignment and normalisation.

``series(culture, value, feature, x)`` is long: one row for each culture, grid value and feature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SqlOperator


def metadata_filter(df: DataFrame, include: list[tuple[str, list]], exclude: list[tuple[str, list]]) -> DataFrame:
    """Keeps rows for which every inclusion holds and no exclusion does (F1); a null value matches
    nothing; no inclusion means all."""
    hit = lambda c: F.coalesce(F.col(c[0]).isin(c[1]), F.lit(False))
    keep = reduce(lambda a, b: a & b, map(hit, include), F.lit(True))
    drop = reduce(lambda a, b: a | b, map(hit, exclude), F.lit(False))
    return df.where(keep & ~drop)


def select_features(df: DataFrame, keys: list[str], prefixes: list[str]) -> DataFrame:
    """Columns by prefix beside the keys (F12, F13)."""
    return df.select(*keys, *[c for c in df.columns if c not in keys and any(c.startswith(p) for p in prefixes)])


def union_harmonised(parts: list[DataFrame]) -> DataFrame:
    """Union with missing columns as nulls (U1, U2)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_common(parts: list[DataFrame]) -> DataFrame:
    """Union over the columns that all parts have (U3)."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*common) for p in parts])


def join_features(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Feature tables side by side (J7), by keys and not by position; a row that a table lacks has
    nulls there. A feature name in two tables is an error; null keys match nothing."""
    names = [c for p in parts for c in p.columns if c not in keys]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"in more than one table: {twice}")
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def drop_constant_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drops columns without variance or with missing values (F17): one aggregate, then a
    projection."""
    names = [c for c in df.columns if c not in keys]
    row = df.agg(*[F.stddev(c).alias(f"s_{c}") for c in names], *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"n_{c}") for c in names]).first()
    return df.select(*keys, *[c for c in names if row[f"s_{c}"] and not row[f"n_{c}"]])


pooled_groups = SqlOperator(
    "Multi-key grouping with pooled values: each key is mapped to its pool, values outside all pools go, groups are numbered densely with a joined label (A9, A10, A8, N8, Z19).",
    """
WITH p AS (SELECT x.id, a.pool AS pa, b.pool AS pb FROM {rows} x JOIN {pools} a ON a.var = 'a' AND x.a = a.value JOIN {pools} b ON b.var = 'b' AND x.b = b.value)
SELECT CAST(dense_rank() OVER (ORDER BY pa, pb) AS INT) AS grp, concat(pa, ' ', pb) AS label, count(*) AS n, min(id) AS first_id FROM p GROUP BY pa, pb""",
)
one_vs_rest = SqlOperator("Pools values that contain a text against the rest (A10).", "SELECT CASE WHEN contains(a, '$member') THEN '$member' ELSE 'rest' END AS grp, count(*) AS n, round(avg(x), 4) AS mean_x FROM {rows} GROUP BY 1", member="BUILD")
culture_groups = SqlOperator("Cultures: recordings of one chip and plating date, numbered (A11, D10, J10).",
    "SELECT chip, plated, CAST(dense_rank() OVER (ORDER BY chip, plated) AS INT) AS culture, count(*) AS recordings FROM {recordings} WHERE chip IS NOT NULL AND plated IS NOT NULL GROUP BY chip, plated")
best_recordings = SqlOperator("The recording with most units of each group, ties by id (W15).",
    "SELECT grp, rec, units FROM (SELECT grp, rec, units, row_number() OVER (PARTITION BY grp ORDER BY units DESC, rec) AS r FROM {recordings}) x WHERE r = 1")
tolerance_pivot = SqlOperator(
    "Aligns recordings to a grid of values within a tolerance: a culture stays if every grid value is met by exactly one recording and none meets two; one column block for each grid value by rank (J6, A12, O2).",
    """
WITH m AS (SELECT s.culture, s.value, s.x, g.g FROM {series} s JOIN {grid} g ON abs(s.value - g.g) <= $tol),
ok AS (SELECT culture FROM m GROUP BY culture HAVING count(*) = (SELECT count(*) FROM {grid}) AND count(DISTINCT g) = (SELECT count(*) FROM {grid}) AND count(DISTINCT value) = count(*))
SELECT m.culture, round(max(CASE WHEN g = $g1 THEN x END), 4) AS x_$g1, round(max(CASE WHEN g = $g2 THEN x END), 4) AS x_$g2, round(max(CASE WHEN g = $g3 THEN x END), 4) AS x_$g3 FROM m SEMI JOIN ok ON m.culture = ok.culture GROUP BY m.culture""",
    tol=1, g1=0, g2=6, g3=12,
)
sparse_pivot = SqlOperator("Culture by grid value with holes (A13).", "SELECT culture, value, count(*) AS n, round(avg(x), 4) AS x FROM {series} GROUP BY culture, value")
batch_zscore = SqlOperator(
    "z-scores within batches fitted on training rows, then over all training rows (N1); spread 0 gives null.",
    """
WITH b AS (SELECT batch, avg(x) AS m, nullif(stddev_samp(x), 0) AS s FROM {rows} WHERE train GROUP BY batch), a AS (SELECT id, train, (x - m) / s AS z FROM {rows} r LEFT JOIN b ON r.batch = b.batch),
t AS (SELECT avg(z) AS m, nullif(stddev_samp(z), 0) AS s FROM a WHERE train)
SELECT id, round((z - m) / s, 5) AS z FROM a CROSS JOIN t""",
)
input_matrix = SqlOperator("Input matrix: missing to 0, z-score by mean and spread of the training rows, divided by their largest absolute value (N2).",
    "WITH s AS (SELECT avg(coalesce(x, 0)) AS m, stddev_samp(coalesce(x, 0)) AS s FROM {rows} WHERE train), z AS (SELECT id, train, (coalesce(x, 0) - m) / s AS z FROM {rows} CROSS JOIN s), t AS (SELECT max(CASE WHEN train THEN abs(z) END) AS top FROM z) SELECT id, round(z / top, 6) AS v FROM z CROSS JOIN t")
baseline_norm = SqlOperator("Each value divided by the culture's first one; the first goes (N3).",
    "SELECT culture, value, round(coalesce(x / nullif(first_x, 0), 0), 6) AS ratio FROM (SELECT culture, value, x, first_value(x) OVER (PARTITION BY culture ORDER BY value ROWS UNBOUNDED PRECEDING) AS first_x, row_number() OVER (PARTITION BY culture ORDER BY value) AS r FROM {series}) y WHERE r > 1")
scaled_norm = SqlOperator("Min-max scaling over time within a culture (N4, W16).",
    "SELECT culture, value, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM (SELECT culture, value, x, min(x) OVER (PARTITION BY culture) AS lo, max(x) OVER (PARTITION BY culture) AS hi FROM {series}) y")
column_scaling = SqlOperator("Min-max scaling of a column (N5).", "SELECT id, round((x - (SELECT min(x) FROM {rows})) / ((SELECT max(x) FROM {rows}) - (SELECT min(x) FROM {rows})), 6) AS v FROM {rows}")
group_trajectories = SqlOperator(
    "Mean and spread per group and grid value, outliers (scaled MAD over ``factor``) left out (A14).",
    """
WITH m AS (SELECT grp, value, median(x) AS m FROM {series} GROUP BY grp, value), d AS (SELECT s.grp, s.value, s.x, abs(s.x - m) AS d FROM {series} s JOIN m ON s.grp = m.grp AND s.value = m.value),
k AS (SELECT grp, value, $factor * 1.4826 * median(d) AS lim FROM d GROUP BY grp, value)
SELECT d.grp, d.value, count(*) AS n, round(avg(x), 6) AS mean_x, round(coalesce(stddev_samp(x), 0), 5) AS sd_x FROM d JOIN k ON d.grp = k.grp AND d.value = k.value WHERE d <= lim GROUP BY d.grp, d.value""", factor=10,
)
group_log_ratio = SqlOperator("Log ratio of group means of min-max scaled values (A15).",
    "WITH s AS (SELECT grp, value, (x - min(x) OVER (PARTITION BY value)) / nullif(max(x) OVER (PARTITION BY value) - min(x) OVER (PARTITION BY value), 0) AS v FROM {series}) SELECT value, round(ln(nullif(avg(CASE WHEN grp = '$first' THEN v END), 0) / nullif(avg(CASE WHEN grp = '$second' THEN v END), 0)), 6) AS log_ratio FROM s GROUP BY value", first="BUILDING", second="MACHINERY")
cluster_proportions = SqlOperator("Share of clusters within each metadata group (A16).", "SELECT grp, cluster, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY grp), 6) AS share FROM {rows} GROUP BY grp, cluster")
cluster_heatmap = SqlOperator("Mean z-score per cluster and feature (A17).",
    "SELECT cluster, feature, round(avg(z), 5) AS z FROM (SELECT cluster, feature, (x - avg(x) OVER (PARTITION BY feature)) / nullif(stddev_samp(x) OVER (PARTITION BY feature), 0) AS z FROM {values}) y GROUP BY cluster, feature")
cluster_quantiles = SqlOperator("Quartiles and 5-95 % limits per cluster and feature by the Hazen rule (A18).",
    "WITH r AS (SELECT cluster, feature, x, row_number() OVER (PARTITION BY cluster, feature ORDER BY x) AS k, count(*) OVER (PARTITION BY cluster, feature) AS n FROM {values}), q AS (SELECT 0.05 AS q UNION ALL SELECT 0.25 UNION ALL SELECT 0.5 UNION ALL SELECT 0.75 UNION ALL SELECT 0.95), p AS (SELECT r.cluster, r.feature, CAST(q.q AS DOUBLE) AS q, r.x, r.k, least(greatest(n * CAST(q.q AS DOUBLE) + 0.5, 1), n) AS h FROM r CROSS JOIN q), near AS (SELECT * FROM p WHERE k = floor(h) OR k = floor(h) + 1) SELECT cluster, feature, q, round(sum(CASE WHEN k = floor(h) THEN x * (1 - (h - floor(h))) WHEN k = floor(h) + 1 THEN x * (h - floor(h)) ELSE 0 END), 5) AS v FROM near GROUP BY cluster, feature, q")
cluster_waveforms = SqlOperator("Median waveform and size of each cluster (A19).", "SELECT cluster, i, count(*) AS n, round(median(v), 5) AS v FROM {waveforms} GROUP BY cluster, i")
label_frequency = SqlOperator("Rows whose label is at least as frequent as ``share`` of the mean frequency (F18).",
    "SELECT r.label, count(*) AS n FROM {rows} r SEMI JOIN (SELECT label FROM {rows} GROUP BY label HAVING count(*) >= $share * (SELECT count(*) * 1e0 / count(DISTINCT label) FROM {rows} WHERE label IS NOT NULL)) k ON r.label = k.label GROUP BY r.label", share=0.95)
removed_clusters = SqlOperator("Units of a cluster removed from every recording of a culture in which any member has them (F15, L6).",
    "SELECT u.culture, u.unit, u.cluster FROM {units} u ANTI JOIN (SELECT DISTINCT culture, unit FROM {units} WHERE cluster = $cluster) g ON u.culture = g.culture AND u.unit = g.unit", cluster=1)
lookup_join = SqlOperator("First row of a lookup whose comma list names a part of the id (J1, S8).",
    "WITH l AS (SELECT ord, info, @SPLITTED(chips, ',') AS chip FROM {lookup}) SELECT id, chip_id, info FROM (SELECT r.id, r.chip_id, l.info, row_number() OVER (PARTITION BY r.id ORDER BY l.ord) AS k FROM {recordings} r JOIN l ON contains(r.chip_id, l.chip)) x WHERE k = 1")
path_parts = SqlOperator("Metadata from the parts of a path, with a check that the wanted part is numeric (S9, X1, S7).",
    "SELECT id, split_part(path, '/', 3) AS host, split_part(path, '/', 4) AS lang, split_part(split_part(path, '/', 5), '?', 1) AS number, regexp_like(split_part(split_part(path, '/', 5), '?', 1), '^[0-9]+$$') AS numeric FROM {paths}".replace("regexp_like(split_part(split_part(path, '/', 5), '?', 1), '^[0-9]+$$')", "(length(translate(split_part(split_part(path, '/', 5), '?', 1), '0123456789', '')) = 0 AND length(split_part(split_part(path, '/', 5), '?', 1)) > 0)"))
age_days = SqlOperator("Days between plating and recording from yyMMdd text (X2).", "SELECT id, CAST(@DAYS(@YMD(recorded), @YMD(plated)) AS INT) AS days FROM {dates}")
json_metadata = SqlOperator("Numbers from JSON metadata, per group (X17).", "SELECT g, count(*) AS n, CAST(sum(@JSONINT(props, '$$.k')) AS BIGINT) AS total FROM {rows} GROUP BY g")
distinct_pairs = SqlOperator("Distinct unordered pairs (U4).", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {pairs}")
set_difference = SqlOperator("Ids in the first set that the second lacks, and shared ids (U5).", "SELECT id, 'only' AS kind FROM (SELECT id FROM {left} EXCEPT SELECT id FROM {right}) x UNION ALL SELECT id, 'both' FROM (SELECT id FROM {left} INTERSECT SELECT id FROM {right}) y")
group_product = SqlOperator("All combinations of two group keys with their counts, empty ones too (U6, A27).",
    "SELECT a.a, b.b, count(r.id) AS n FROM (SELECT DISTINCT a FROM {rows}) a CROSS JOIN (SELECT DISTINCT b FROM {rows}) b LEFT JOIN {rows} r ON r.a = a.a AND r.b = b.b GROUP BY a.a, b.b")
cohort_cube = SqlOperator("Counts over all subsets of the cohort keys (grouping sets, the sweep of L15).", "SELECT a, b, count(*) AS n, round(avg(x), 3) AS mean_x FROM {rows} GROUP BY CUBE (a, b)")
