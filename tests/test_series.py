"""Time-series features on series with known answers."""

import numpy as np

from tremolo.functions import series
from tremolo.operators.series import NAMES, series_features


def test_known_answers():
    y = np.random.default_rng(3).normal(size=200)
    for x in (y, np.cumsum(y), np.sin(np.arange(390) * 2 * np.pi / 41)):
        n, z = len(x), x - x.mean()
        ac = [float((z[: n - k] * z[k:]).sum() / (z**2).sum()) for k in range(n)]
        assert np.allclose(series.autocorrelation(x), ac)
        assert series.first_zero(x) == next(k for k in range(n) if ac[k] <= 0)
        assert series.first_minimum(x) == next(k for k in range(1, n - 1) if ac[k] < min(ac[k - 1], ac[k + 1]))
        k = next(k for k in range(n) if ac[k] < np.exp(-1))
        assert np.isclose(series.decay_lag(x), np.interp(-np.exp(-1), [-ac[k - 1], -ac[k]], [k - 1, k]))
    assert series._longest(np.array([0, 0, 1, 0, 0, 0, 0, 1, 0, 0], bool)) == 5
    ramp = series.features(np.arange(30.0))
    assert ramp["SB_BinaryStats_diff_longstretch0"] == 1 and ramp["DN_Mean"] == 14.5
    assert np.isclose(ramp["CO_trev_1_num"], 1 / ramp["DN_Spread_Std"] ** 3)
    assert np.bincount(series.tercile_symbols(np.arange(9.0))).tolist() == [3, 3, 3]
    assert 0 < series.word_entropy(y) <= np.log(9)


def _plain_line(x, y):
    """What a line through the points leaves."""
    m, b = np.polyfit(x, y, 1)
    return [v - m * u - b for u, v in zip(x, y)]


def _plain_outliers(y):
    n, middles, shares, single, k = len(y), [], [], None, 0
    while k < int(max(y) / 0.01 + 1):
        at = [i + 1 for i in range(n) if y[i] >= k * 0.01]
        middles.append(float(np.median(at)) / (n / 2) - 1 if at else float("nan"))
        shares.append((len(at) - 1) * 100.0 / sum(v >= 0 for v in y))
        single = k if single is None and len(at) < 2 else single
        k += 1
    end = max([j for j, s in enumerate(shares) if s > 2], default=0)
    return float(np.median(middles[: min(end, k - 1 if single is None else single) + 1]))


def _plain_break(y, lag, ranges):
    lengths = sorted({int(np.floor(np.exp(np.log(5) + k * (np.log(len(y) // 2) - np.log(5)) / 49) + 0.5)) for k in range(50)})
    path = np.cumsum([y[k * lag] for k in range(len(y) // lag)])
    sizes = []
    for n in lengths:
        parts = [_plain_line(range(n), path[k : k + n]) for k in range(0, len(path) - n + 1, n)]
        each = [(max(p) - min(p)) ** 2 for p in parts] if ranges else [v * v for p in parts for v in p]
        sizes.append(np.log(np.sqrt(sum(each) / len(each))))
    x, best = np.log(lengths), None
    for k in range(6, len(x) - 5):
        loss = sum(v * v for v in _plain_line(x[:k], sizes[:k])) ** 0.5 + sum(v * v for v in _plain_line(x[k - 1 :], sizes[k - 1 :])) ** 0.5
        best = (loss, k) if best is None or loss < best[0] else best
    return best[1] / len(x)


def test_further_kernels_against_plain_loops():
    rng = np.random.default_rng(8)
    noise = rng.normal(size=300)
    for x in (noise, np.cumsum(noise), np.sin(np.arange(300) * 2 * np.pi / 25) + noise / 9, np.round(noise, 1)):
        y = (x - x.mean()) / x.std(ddof=1)
        n, found = len(y), series.features(x)
        s = list(series.tercile_symbols(y[:: series.first_zero(y)]))
        steps = [[sum(a == i and b == j for a, b in zip(s, s[1:])) / (len(s) - 1) for j in range(3)] for i in range(3)]
        assert np.isclose(found["SB_TransitionMatrix_3ac_sumdiagcov"], sum(np.var([steps[i][j] for i in range(3)], ddof=1) for j in range(3)))
        lag = min(series.first_zero(y), n // 10)
        d = [((y[i + 1] - y[i]) ** 2 + (y[i + lag + 1] - y[i + lag]) ** 2) ** 0.5 for i in range(n - lag - 1)]
        bins = int(np.ceil((max(d) - min(d)) / (3.5 * np.std(d, ddof=1) / len(d) ** (1 / 3))))
        wide, got = (max(d) - min(d)) / bins, [0] * bins
        for v in d:
            got[min(int((v - min(d)) / wide), bins - 1)] += 1
        off = [abs(c / len(d) - np.exp(-(min(d) + (k + 0.5) * wide) / np.mean(d)) / np.mean(d)) for k, c in enumerate(got)]
        assert np.isclose(found["CO_Embed2_Dist_tau_d_expfit_meandiff"], np.mean(off))
        assert np.isclose(found["DN_OutlierInclude_p_001_mdrmd"], _plain_outliers(list(y)))
        assert np.isclose(found["DN_OutlierInclude_n_001_mdrmd"], _plain_outliers(list(-y)))
        power = [abs(sum(v * np.exp(-2j * np.pi * f * k / 512) for k, v in enumerate(y))) ** 2 / n / (2 * np.pi) for f in range(257)]
        power = [p * (1 if f in (0, 256) else 2) for f, p in enumerate(power)]
        assert np.isclose(found["SP_Summaries_welch_rect_area_5_1"], sum(power[:51]) * 2 * np.pi / 512)
        half = next(f for f in range(257) if sum(power[: f + 1]) > sum(power) / 2)
        assert np.isclose(found["SP_Summaries_welch_rect_centroid"], half * 2 * np.pi / 512)
        assert np.isclose(found["SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1"], _plain_break(y, 1, True))
        assert np.isclose(found["SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1"], _plain_break(y, 2, False))


def test_period():
    t = np.arange(400)
    for length in (20, 37):
        y = np.sin(2 * np.pi * t / length) + 1e-5 * t**2
        assert series.period(y / y.std()) == length - 1
    assert series.period(np.arange(50.0) ** 3) == 0 and series.fluctuation_break(np.arange(20.0), 1, "range") == 0
    knot = np.clip(t - 199, 0, None) ** 3.0
    assert np.allclose(series.cubic_trend(knot / knot.max()), knot / knot.max())


def test_odd_series_give_nan():
    for x in ([], [1.0], [2.0] * 20, [1.0, np.nan] * 10, [1.0, 2.0, 3.0]):
        assert all(np.isnan(series.features(np.array(x))[n]) for n in series.FEATURES)


def test_operator_over_groups(spark):
    rng = np.random.default_rng(5)
    data = {k: rng.normal(size=50) for k in range(3)}
    points = spark.createDataFrame([(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)], "id long, t long, x double")
    for r in series_features(points).collect():
        assert np.allclose([r[n] for n in NAMES], [series.features(data[r["id"]])[n] for n in NAMES])
    assert series_features(points.limit(0)).count() == 0
