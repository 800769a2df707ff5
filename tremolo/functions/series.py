"""Time-series features of one univariate series, as NumPy kernels.

All but mean and spread work on the series z-scored by its sample deviation. A series with a
value that is not finite, of fewer than ten values or without spread gives NaN for these.
"""

from __future__ import annotations

import numpy as np

LEAST_LENGTH = 10


def autocorrelation(y: np.ndarray) -> np.ndarray:
    """Autocovariance about the mean by the zero-padded spectrum, as a share of that at lag 0."""
    n = len(y)
    padded = np.fft.rfft(y - y.mean(), 1 << (2 * n - 1).bit_length())
    cov = np.fft.irfft(padded * padded.conj())[:n]
    return cov / cov[0] if cov[0] > 0 else np.full(n, np.nan)


def _first(condition: np.ndarray, otherwise: int) -> int:
    return int(condition.argmax()) if condition.any() else otherwise


def histogram_mode(y: np.ndarray, bins: int) -> float:
    """Mean centre of the fullest of ``bins`` equal bins."""
    count, edges = np.histogram(y, bins)
    return float(((edges[1:] + edges[:-1]) / 2)[count == count.max()].mean())


def decay_lag(y: np.ndarray) -> float:
    """The lag where autocorrelation falls below 1/e, between lags by a line; else the length."""
    ac, goal = autocorrelation(y), np.exp(-1)
    k = _first(ac < goal, 0)
    return k - 1 + (goal - ac[k - 1]) / (ac[k] - ac[k - 1]) if k else float(len(y))


def first_zero(y: np.ndarray) -> int:
    return _first(autocorrelation(y) <= 0, len(y))


def _dip(x: np.ndarray) -> np.ndarray:
    """For every inner position whether it is below both neighbours."""
    return (x[1:-1] < x[:-2]) & (x[1:-1] < x[2:])


def first_minimum(y: np.ndarray) -> int:
    return _first(_dip(autocorrelation(y)), len(y) - 1) + 1


def histogram_information(y: np.ndarray, lag: int = 2, bins: int = 5, margin: float = 0.1) -> float:
    """Mutual information (nats) of the series and itself ``lag`` later, on equal bins."""
    edges = np.linspace(y.min() - margin, y.max() + margin, bins + 1)
    joint = np.histogram2d(y[:-lag], y[lag:], [edges, edges])[0] / (len(y) - lag)
    apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    full = joint > 0
    return float((joint[full] * np.log(joint[full] / apart[full])).sum())


def gaussian_information_minimum(y: np.ndarray, most: int = 40) -> int:
    """Position (from 0, lag 1) of the first local minimum of Gaussian mutual information over
    lags; else the greatest lag."""
    lags = min(most, -(-len(y) // 2))
    rho = np.array([np.corrcoef(y[:-k], y[k:])[0, 1] for k in range(1, lags + 1)])
    with np.errstate(divide="ignore"):
        return _first(_dip(-0.5 * np.log(1 - rho**2)), lags - 1) + 1


def _longest(broken: np.ndarray) -> int:
    """The widest step between neighbouring breaks; the start and the last position are breaks."""
    at = np.flatnonzero(broken)
    return int(np.diff(np.concatenate([[0], at, [len(broken) - 1]])).max())


def tercile_symbols(y: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.quantile(y, [1 / 3, 2 / 3], method="hazen"), y, "left")


def word_entropy(y: np.ndarray) -> float:
    """Entropy (nats) of words of two tercile symbols."""
    s = tercile_symbols(y)
    p = np.bincount(s[:-1] * 3 + s[1:], minlength=9) / (len(y) - 1)
    return float(-(p[p > 0] * np.log(p[p > 0])).sum())


def _three_back(y: np.ndarray) -> float:
    mean = (y[:-3] + y[1:-2] + y[2:-1]) / 3
    return float((y[3:] - mean).std(ddof=1))


def transition_spread(y: np.ndarray) -> float:
    """Sum of the column variances of the shares of steps between tercile symbols, on every k-th
    value, k the first zero of autocorrelation. Fewer than two values are left: NaN."""
    s = tercile_symbols(y[:: max(first_zero(y), 1)])
    if len(s) < 2:
        return float("nan")
    shares = np.bincount(s[:-1] * 3 + s[1:], minlength=9).reshape(3, 3) / (len(s) - 1)
    return float(shares.var(axis=0, ddof=1).sum())


def cubic_trend(y: np.ndarray) -> np.ndarray:
    """The least-squares cubic spline with one inner knot, at half the length less one."""
    n = len(y)
    knot = (n // 2 - 1) / (n - 1)
    t = np.linspace(0, 1, n)
    basis = np.column_stack([t**k for k in range(4)] + [np.clip(t - knot, 0, None) ** 3])
    return basis @ np.linalg.lstsq(basis, y, rcond=None)[0]


def period(y: np.ndarray, rise: float = 0.01) -> int:
    """Position (from 0, lag 1) of the first peak of the detrended series' lagged mean products,
    up to a third of the length, that is not negative and stands ``rise`` above the last trough
    before it; 0 without one."""
    z = y - cubic_trend(y)
    n, lags = len(z), np.arange(1, -(-len(z) // 3) + 1)
    power = np.abs(np.fft.rfft(z, 1 << (2 * n - 1).bit_length())) ** 2
    mean = np.fft.irfft(power)[lags] / (n - lags)
    trough = np.flatnonzero(_dip(mean)) + 1
    peak = np.flatnonzero(_dip(-mean)) + 1
    peak = peak[peak > trough[0]] if len(trough) else peak[:0]
    before = mean[trough[np.searchsorted(trough, peak) - 1]] if len(peak) else peak
    good = peak[(mean[peak] - before >= rise) & (mean[peak] >= 0)]
    return int(good[0]) if len(good) else 0


def step_lengths_misfit(y: np.ndarray) -> float:
    """Mean distance of the histogram of step lengths, in the plane of the series and itself a lag
    later (first zero of autocorrelation, a tenth of the length at most), from the exponential
    density of the same mean at bin centres. Bins are 3.5 deviations / cube root of n wide; 0 where
    the deviation is under 0.001."""
    lag = min(first_zero(y), len(y) // 10)
    step = np.diff(y)
    length = np.hypot(step[: len(step) - lag], step[lag:])
    spread = length.std(ddof=1)
    if spread < 0.001:
        return 0.0
    count, edges = np.histogram(length, int(np.ceil(np.ptp(length) / (3.5 * spread / np.cbrt(len(length))))))
    density = np.exp(-(edges[1:] + edges[:-1]) / 2 / length.mean()) / length.mean()
    return float(np.abs(count / len(length) - density).mean())


def outlier_position(y: np.ndarray, width: float = 0.01, least: float = 2.0) -> float:
    """Median over rising thresholds of the median position of the values at or above each, as a
    share of half the length, less 1. The last threshold is the last one above which over ``least``
    percent of the positive values lie (less one value), and never one past the first with a
    single value. 0 where no value reaches ``width``."""
    n, top = len(y), y.max()
    if top < width:
        return 0.0
    # A value leaves after its last threshold: positions by that number, most lasting first.
    last = np.floor(y / width).astype(np.int64)
    last += (last + 1) * width <= y
    last -= last * width > y
    thresholds = int(top / width + 1)
    over = np.bincount(np.clip(last[last >= 0], 0, thresholds - 1), minlength=thresholds)[::-1].cumsum()[::-1]
    positive = (y >= 0).sum()
    share = (over - 1) * 100.0 / positive
    end = min(int(np.flatnonzero(share > least).max(initial=0)), _first(over < 2, thresholds - 1))
    # The set of values over a threshold changes only where a value leaves.
    middle = np.empty(end + 1)
    for k in range(end + 1):
        middle[k] = middle[k - 1] if k and over[k] == over[k - 1] else np.median(np.flatnonzero(last >= k) + 1)
    return float(np.median(middle / (n / 2) - 1))


def spectrum(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angular frequencies and one-sided power density of one rectangular window, zero-padded to
    a power of two."""
    size = 1 << (len(y) - 1).bit_length()
    power = np.abs(np.fft.rfft(y - y.mean(), size)) ** 2 / len(y) / (2 * np.pi)
    power[1:-1] *= 2
    return 2 * np.pi * np.arange(len(power)) / size, power


def low_power(y: np.ndarray) -> float:
    """Power in the lowest fifth of the frequencies."""
    w, power = spectrum(y)
    return float(power[: len(power) // 5].sum() * w[1])


def spectral_median(y: np.ndarray) -> float:
    w, power = spectrum(y)
    total = power.cumsum()
    return float(w[_first(total > total[-1] / 2, 0)])


def _line_residuals(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a line through (x, each row of y) leaves."""
    x = x - x.mean()
    y = y - y.mean(axis=-1, keepdims=True)
    return y - (y @ x)[..., None] * x / (x @ x)


def fluctuation_break(y: np.ndarray, lag: int, measure: str, windows: int = 50, least: int = 6) -> float:
    """Where the log-log line of fluctuation by window length breaks best in two, as a share of the
    lengths. Windows of 5 to half the length, log-spaced, cut the cumulated series of every
    ``lag``-th value; in each a line is taken off and its ``measure`` (range or square) is pooled.
    Fewer than twice ``least`` lengths: 0."""
    grid = np.exp(np.linspace(np.log(5), np.log(len(y) // 2), windows))
    lengths = np.unique(np.floor(grid + 0.5).astype(int))
    if len(lengths) < 2 * least:
        return 0.0
    path = y[::lag][: len(y) // lag].cumsum()
    sizes = []
    for n in lengths:
        rest = _line_residuals(np.arange(float(n)), path[: len(path) // n * n].reshape(-1, n))
        if not len(rest):
            return float("nan")
        sizes.append(np.sqrt((np.ptp(rest, axis=1) ** 2 if measure == "range" else rest**2).mean()))
    with np.errstate(divide="ignore"):
        x, f = np.log(lengths), np.log(sizes)
    ends = range(least, len(x) - least + 1)
    loss = [np.linalg.norm(_line_residuals(x[:k], f[:k])) + np.linalg.norm(_line_residuals(x[k - 1 :], f[k - 1 :])) for k in ends]
    return float(ends[int(np.argmin(loss))] / len(x))


# The features by name, on the z-scored series.
FEATURES = {
    "DN_HistogramMode_5": lambda y: histogram_mode(y, 5),
    "DN_HistogramMode_10": lambda y: histogram_mode(y, 10),
    "CO_f1ecac": decay_lag,
    "CO_FirstMin_ac": first_minimum,
    "CO_HistogramAMI_even_2_5": histogram_information,
    "CO_trev_1_num": lambda y: (np.diff(y) ** 3).mean(),
    "MD_hrv_classic_pnn40": lambda y: (np.abs(np.diff(y)) * 1000 > 40).mean(),
    "SB_BinaryStats_mean_longstretch1": lambda y: _longest((y <= y.mean())[:-1]),
    "SB_BinaryStats_diff_longstretch0": lambda y: _longest(np.diff(y) >= 0),
    "SB_TransitionMatrix_3ac_sumdiagcov": transition_spread,
    "PD_PeriodicityWang_th0_01": period,
    "CO_Embed2_Dist_tau_d_expfit_meandiff": step_lengths_misfit,
    "IN_AutoMutualInfoStats_40_gaussian_fmmi": gaussian_information_minimum,
    "FC_LocalSimple_mean1_tauresrat": lambda y: first_zero(np.diff(y)) / first_zero(y),
    "FC_LocalSimple_mean3_stderr": _three_back,
    "DN_OutlierInclude_p_001_mdrmd": outlier_position,
    "DN_OutlierInclude_n_001_mdrmd": lambda y: outlier_position(-y),
    "SP_Summaries_welch_rect_area_5_1": low_power,
    "SP_Summaries_welch_rect_centroid": spectral_median,
    "SB_MotifThree_quantile_hh": word_entropy,
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": lambda y: fluctuation_break(y, 1, "range"),
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": lambda y: fluctuation_break(y, 2, "square"),
}


def features(values: np.ndarray) -> dict[str, float]:
    """All features of a series, with its mean and sample deviation."""
    x = np.asarray(values, float)
    out = {name: float("nan") for name in FEATURES}
    fine = len(x) > 1 and bool(np.isfinite(x).all())
    out["DN_Mean"] = float(x.mean()) if fine else float("nan")
    out["DN_Spread_Std"] = float(x.std(ddof=1)) if fine else float("nan")
    if fine and len(x) >= LEAST_LENGTH and out["DN_Spread_Std"] > 1e-12 * np.abs(x).max():
        z = (x - x.mean()) / x.std(ddof=1)
        out |= {name: float(f(z)) for name, f in FEATURES.items()}
    return out
