"""Learners: folds never split a recording, and known structure is found."""

import numpy as np
import pytest

from tremolo.operators import learning


def _rows(spark, n=160, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        owner = k // 8
        label = "abc"[owner % 3]
        x = rng.normal(size=4)
        x[0] += 4 * (label == "a")
        x[1] += 4 * (label == "b")
        rows.append((k, f"rec{owner}", label, x.tolist()))
    return spark.createDataFrame([*rows, (998, None, "a", [0.0] * 4), (999, "rec1", None, [0.0] * 4)], "id long, unit_of string, label string, x array<double>")


def test_folds_keep_recordings_whole(spark):
    rows = _rows(spark).where("label IS NOT NULL AND unit_of IS NOT NULL")
    for k, many in ((4, 4), (0, 20)):
        dealt = learning.folds(rows, k).collect()
        by = {}
        for r in dealt:
            by.setdefault(r["unit_of"], set()).add(r["fold"])
        assert all(len(f) == 1 for f in by.values()) and len({f for s in by.values() for f in s}) == many
        if k:
            for fold in range(k):
                assert {r["label"] for r in dealt if r["fold"] == fold} == set("abc")


@pytest.mark.parametrize("method", learning.METHODS)
def test_classifiers_on_held_out_recordings(spark, method):
    found = learning.cross_classify(_rows(spark), method, k=3, trees=20).collect()
    assert len(found) == 160 and len({r["id"] for r in found}) == 160
    assert sum(r["label"] == r["predicted"] for r in found) / 160 > 0.85


def test_importance_finds_the_features_that_tell(spark):
    rows = _rows(spark).where("label IS NOT NULL AND unit_of IS NOT NULL")
    found = {r["feature"]: r["importance"] for r in learning.permutation_importance(rows.where("id < 96"), rows.where("id >= 96"), trees=20).collect()}
    assert set(found) == {0, 1, 2, 3} and min(found[0], found[1]) > 0.1 > max(abs(found[2]), abs(found[3]))


def test_regression_and_mixture(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, size=(150, 3))
    rows = spark.createDataFrame([(k, f"r{k // 5}", float(10 * r[0] + r[1]), r.tolist()) for k, r in enumerate(x)], "id long, unit_of string, label double, x array<double>")
    found = learning.cross_regress(rows, k=3, trees=30).collect()
    y, p = (np.array([r[c] for r in found]) for c in ("label", "predicted"))
    assert len(found) == 150 and np.corrcoef(y, p)[0, 1] > 0.9
    z = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + c for c in ([0, 0], [5, 0], [0, 5])])
    got = learning.mixture(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(z)], "id long, x array<double>"), ks=(2, 3, 4)).collect()
    assert {r["k"] for r in got} == {3}
    for part in range(3):
        assert len({r["cluster"] for r in got if part * 40 <= r["id"] < part * 40 + 40}) == 1
