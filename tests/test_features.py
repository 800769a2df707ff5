"""Waveform and regularity features against closed forms and plain loops."""

import cmath
import math

import numpy as np
import pytest

from tremolo.functions import spectra
from tremolo.operators import features


def test_monotone_cubic():
    assert np.allclose(spectra.monotone_cubic(np.array([0.0, 1.0, 4.0]), 2), [0, 0.3125, 1, 2.1875, 4])
    y = np.array([0.0, 0.0, 1.0, 5.0, 5.0, 2.0, -1.0])
    z = spectra.monotone_cubic(y, 10)
    assert np.allclose(z[::10], y) and (np.diff(z[:41]) >= -1e-12).all() and (np.diff(z[40:]) <= 1e-12).all()
    assert np.allclose(spectra.monotone_cubic(np.arange(5.0), 4), np.arange(17) / 4)


def test_exponential_slope_and_peaks():
    x = np.array([1.0, 4.0, 9.0, 15.0, 22.0])
    assert abs(spectra.exponential_slope(x, 3.0 * np.exp(-0.2 * x)) + 0.2) < 1e-6
    assert math.isnan(spectra.exponential_slope(x[:1], x[:1]))
    assert spectra.highest_peak(np.array([9.0, 1, 3, 3, 2, 5, 0, 8])) == 5
    assert spectra.highest_peak(np.array([1.0, 2, 2, 1])) == 1 and spectra.highest_peak(np.arange(5.0)) == -1


def test_slew_of_a_ramp():
    assert abs(spectra.slew(np.linspace(-1, 3, 41), 10.0) - 1.0) < 1e-9
    assert abs(spectra.slew(np.linspace(3, -1, 41), 10.0) + 1.0) < 1e-9
    assert spectra.slew(np.array([2.0, 2.0]), 10.0) == 0.0


def test_waveform_features(spark):
    t = np.arange(40.0)
    wave = -np.exp(-(((t - 15) / 2) ** 2)) + 0.4 * np.exp(-(((t - 22) / 3) ** 2)) + 0.1 * np.exp(-(((t - 10) / 2) ** 2))
    df = spark.createDataFrame([(u, k, float(v * s)) for u, s in ((1, 1.0), (2, 0.5)) for k, v in enumerate(wave)], "unit long, i int, v double")
    found = {r["unit"]: r for r in features.waveform_features(df.repartition(3), rate=20_000.0).collect()}
    fine = spectra.monotone_cubic(wave, 10)
    a, b = int(fine.argmin()), int(fine.argmin()) + int(fine[fine.argmin() :].argmax())
    assert abs(found[1]["t2p_delay"] - (b - a) / 20.0) < 1e-9 and abs(found[1]["t2p_ratio"] - abs(fine[a] / fine[b])) < 1e-9
    assert found[1]["auc_trough"] > found[1]["auc_peak_2"] > found[1]["auc_peak_1"] > 0 and found[1]["rise"] > 0 > found[1]["decay"]
    for name in ("auc_peak_1", "auc_trough", "auc_peak_2", "rise", "decay"):
        assert abs(found[2][name] - found[1][name] / 2) < 1e-9
    for name in ("asymmetry", "t2p_delay", "t2p_ratio"):
        assert abs(found[2][name] - found[1][name]) < 1e-9
    power = {r["unit"]: (r["power"], r["bad_power"]) for r in features.power_qc(df, cutoff=0.3).collect()}
    wanted = max(abs(sum(v * cmath.exp(-2j * math.pi * k * f / 40) for k, v in enumerate(wave))) ** 2 / 40 for f in range(40))
    assert abs(power[1][0] - wanted) < 1e-9 and abs(power[2][0] - wanted / 4) < 1e-9 and power[1][1] == (wanted > 0.3)


@pytest.mark.parametrize("network", [False, True])
def test_regularity_of_a_clock(spark, network):
    rng = np.random.default_rng(4)
    ticks = np.sort(np.concatenate([np.arange(0, 60_000_000, 500_000), rng.integers(0, 59_900_000, 30)]))
    df = spark.createDataFrame([("r", 1 + k % 2 * network, int(t)) for k, t in enumerate(ticks)], "rec string, unit long, tick long")
    found = (features.network_regularity if network else features.train_regularity)(df, width=100_000).first()
    counts = np.bincount(ticks // 100_000, minlength=600)
    x = counts / counts.max()
    mags = [abs(sum(v * cmath.exp(-2j * math.pi * k * f / 600) for k, v in enumerate(x))) for f in range(1, 300)]
    assert abs(found["magnitude"] - max(mags)) < 1e-6 and abs(found["frequency"] - (1 + int(np.argmax(mags))) / 60) < 1e-12
    assert any(abs(found["frequency"] - 2 * k) < 1e-9 for k in (1, 2))  # two spikes a second
