"""Evaluation metrics, splits and analysis of variance."""

from __future__ import annotations

from .base import SqlOperator

_CONF = """
WITH c AS (SELECT label FROM {pred} UNION SELECT predicted FROM {pred}), n AS (SELECT count(*) * 1e0 AS n FROM {pred}),
s AS (SELECT c.label AS k, count_if(p.label = c.label AND p.predicted = c.label) * 1e0 AS tp, count_if(p.label = c.label) * 1e0 AS pos, count_if(p.predicted = c.label) * 1e0 AS said FROM {pred} p CROSS JOIN c GROUP BY c.label),
m AS (SELECT k, tp, said - tp AS fp, pos - tp AS fn, n - pos - said + tp AS tn, pos, n - pos AS neg, n FROM s CROSS JOIN n)"""

confusion_matrix = SqlOperator("Confusion matrix over the full set of labels (A23).",
    "WITH c AS (SELECT label FROM {pred} UNION SELECT predicted FROM {pred}) SELECT a.label AS label, b.label AS predicted, count(p.label) AS n FROM c a CROSS JOIN c b LEFT JOIN {pred} p ON p.label = a.label AND p.predicted = b.label GROUP BY a.label, b.label")
class_metrics = SqlOperator("Recall, specificity, precision, false-positive rate, F1 and Matthews correlation of each class, one against the rest (L10, L11, M19).",
    _CONF + " SELECT k, round(tp / nullif(pos, 0), 6) AS recall, round(tn / nullif(neg, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(fp / nullif(neg, 0), 6) AS fpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(abs(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * pos * neg * (tn + fn)), 0), 6) AS mcc FROM m")
confusion_metrics = SqlOperator("Accuracy, error, macro averages and kappa of a prediction (L10, L12).",
    _CONF + ", r AS (SELECT sum(tp) / max(n) AS po, sum(pos * (tp + fp)) / (max(n) * max(n)) AS pe, avg(coalesce(tp / nullif(pos, 0), 0)) AS recall, avg(tn / nullif(neg, 0)) AS specificity, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision_, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1 FROM m) SELECT round(po, 6) AS accuracy, round(1 - po, 6) AS error, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(precision_, 6) AS precision_, round(f1, 6) AS f1, round(greatest((po - pe) / (1 - pe), (pe - po) / (1 - po)), 6) AS kappa FROM r")
cluster_purity = SqlOperator("Purity: the largest class of each cluster, summed over all rows (L5).", "SELECT round(sum(top) * 1e0 / sum(n), 6) AS purity FROM (SELECT predicted, max(n) AS top, sum(n) AS n FROM (SELECT predicted, label, count(*) AS n FROM {pred} GROUP BY predicted, label) x GROUP BY predicted) y")
group_accuracy = SqlOperator("Accuracy by class and assessment group (A24, L14).", "SELECT label, grp, count(*) AS n, round(avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM {pred} GROUP BY label, grp")
cv_folds = SqlOperator("Stratified k folds; rows of one recording stay together when ``rows`` is one row per recording (N6).", "SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY (id * 7919) % 10007, id) - 1) % $k AS INT) AS fold FROM {rows}", k=5)
one_way_anova = SqlOperator("One-way analysis of variance by sums of squares (L2).",
    "WITH g AS (SELECT grp, count(*) * 1e0 AS n, avg(x) AS m FROM {rows} GROUP BY grp), t AS (SELECT avg(x) AS m, count(*) * 1e0 AS n FROM {rows}), b AS (SELECT sum(g.n * (g.m - t.m) * (g.m - t.m)) AS ss, count(*) - 1e0 AS df FROM g CROSS JOIN t), w AS (SELECT sum((x - g.m) * (x - g.m)) AS ss FROM {rows} r JOIN g ON r.grp = g.grp) SELECT CAST(b.df AS INT) AS df_between, CAST(t.n - b.df - 1 AS INT) AS df_within, round((b.ss / b.df) / (w.ss / (t.n - b.df - 1)), 6) AS f FROM b CROSS JOIN w CROSS JOIN t")
regression_by_group = SqlOperator("Predicted against true by group: n, mean error, RMSE, R squared (V4).",
    "SELECT grp, count(*) AS n, round(avg(p - y), 5) AS bias, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(1 - sum((p - y) * (p - y)) / nullif(var_samp(y) * (count(*) - 1), 0), 5) AS r2 FROM {pred} GROUP BY grp")
f_measure = SqlOperator("F-measure of every pair of subsets of two labelings that overlap (M17).",
    "WITH n AS (SELECT x, y, count(*) * 1e0 AS n FROM {labels} GROUP BY x, y) SELECT x, y, round(2 * n / (sum(n) OVER (PARTITION BY x) + sum(n) OVER (PARTITION BY y)), 6) AS f FROM n")
greedy_pairs = SqlOperator("Pairs of subsets that are each other's best match (J12).",
    "SELECT x, y, f FROM (SELECT x, y, f, row_number() OVER (PARTITION BY x ORDER BY f DESC, y) AS a, row_number() OVER (PARTITION BY y ORDER BY f DESC, x) AS b FROM {scores}) z WHERE a = 1 AND b = 1")
bin_f_measure = SqlOperator("F-measure over bins: a bin counts for the smaller of its two counts (M17).",
    "SELECT round(2 * p * r / nullif(p + r, 0), 6) AS f, round(p, 6) AS precision_, round(r, 6) AS recall FROM (SELECT sum(least(a, b)) * 1e0 / sum(b) AS p, sum(least(a, b)) * 1e0 / sum(a) AS r FROM {bins}) x")
quadratic_form = SqlOperator("Quadratic-form distance of two subsets over bins with means (M16): weights 1 - d / d_max.",
    "WITH h AS (SELECT bin, mx, my, a * 1e0 / sum(a) OVER () - b * 1e0 / sum(b) OVER () AS d FROM {bins}), p AS (SELECT x.d AS dx, y.d AS dy, sqrt((x.mx - y.mx) * (x.mx - y.mx) + (x.my - y.my) * (x.my - y.my)) AS r FROM h x CROSS JOIN h y), t AS (SELECT max(r) AS top FROM p) SELECT round(sqrt(greatest(sum(dx * dy * (1 - r / top)), 0)), 6) AS distance FROM p CROSS JOIN t")
informativeness = SqlOperator(
    "Kullback-Leibler divergence of a column from the normal of its mean and spread, on a grid of ``cells`` with linear weights (M20).",
    """
WITH r AS (SELECT f, least(0, min(x)) AS lo, greatest(1, max(x)) AS hi FROM {values} GROUP BY f),
p AS (SELECT v.f, (x - lo) / (hi - lo) * ($cells - 1) AS u FROM {values} v JOIN r ON v.f = r.f),
c AS (SELECT f, k, sum(w) AS w FROM (SELECT f, CAST(floor(u) AS INT) AS k, 1 - (u - floor(u)) AS w FROM p UNION ALL SELECT f, CAST(floor(u) AS INT) + 1, u - floor(u) FROM p) x WHERE w > 0 GROUP BY f, k),
q AS (SELECT f, k, w / sum(w) OVER (PARTITION BY f) AS p FROM c), m AS (SELECT f, sum(p * k) AS mean_k, sum(p * k * k) - sum(p * k) * sum(p * k) AS var_k FROM q GROUP BY f),
g AS (SELECT q.f, p, exp(-(k - mean_k) * (k - mean_k) / (2 * var_k)) AS e FROM q JOIN m ON q.f = m.f), n AS (SELECT f, p, e / sum(e) OVER (PARTITION BY f) AS e FROM g)
SELECT f, round(sum(p * (ln(p) - ln(e))), 5) AS kld FROM n WHERE p > 0 AND e > 0 GROUP BY f""", cells=256,
)
cross_entropy = SqlOperator("Cross entropy of graph weights and an embedding, phi = 1 / (1 + a d^2b) (M12).",
    "SELECT count(*) AS edges, round(-sum(w * ln(greatest(1 / (1 + $a * pow(d, 2 * $b)), 1e-12)) + (1 - w) * ln(greatest(1 - 1 / (1 + $a * pow(d, 2 * $b)), 1e-12))), 3) AS ce FROM {edges}", a=1.577, b=0.895)
fuzzy_union = SqlOperator("Fuzzy union of directed memberships: a + b - ab, mixed with the intersection (M6).",
    "SELECT i, j, round($mix * (a + b - a * b) + (1 - $mix) * a * b, 6) AS w FROM (SELECT coalesce(x.i, y.j) AS i, coalesce(x.j, y.i) AS j, coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b FROM {weights} x FULL OUTER JOIN {weights} y ON x.i = y.j AND x.j = y.i) z WHERE i < j", mix=1e0)
supervised_weights = SqlOperator("Categorical supervision: weights fall by exp(-far) where labels differ, by exp(-unknown) where one is missing (M10), then rows are scaled by their largest (reset of local connectivity).",
    "SELECT i, j, round(v / max(v) OVER (PARTITION BY i), 6) AS w FROM (SELECT e.i, e.j, e.w * CASE WHEN e.li < 0 OR e.lj < 0 THEN exp(-1e0) WHEN e.li <> e.lj THEN exp(-1e0 * $far) ELSE 1 END AS v FROM {edges} e) x", far=5.0)
membership_weights = SqlOperator("Membership strengths exp(-max(0, d - rho) / sigma) with rho the least distance of a point; sigma given (M5).",
    "SELECT i, j, round(exp(-greatest(0, d - rho) / $sigma), 6) AS w FROM (SELECT i, j, d, min(d) OVER (PARTITION BY i) AS rho FROM {neighbours}) x", sigma=0.2)
