"""Correlograms found in workers against the SQL operators."""

import random
import tracemalloc

import numpy as np

from tremolo.functions import correlograms as kernels
from tremolo.operators import connectivity

PARAMS = {"bin": 20, "half": 5}


def _spikes(spark, n=400):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice([4, 7, 7, 900, -2]), rng.randrange(0, 3000, 5)) for _ in range(n)]
    return spark.createDataFrame([*rows, ("alone", 5, 10), (None, 4, 20), ("x", 4, None)], "rec string, unit long, tick long")


def _same(x, y):
    return x.dtypes == y.dtypes and sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)


def test_counts_are_those_of_the_sql_and_shuffle_nothing(spark, capsys):
    df = _spikes(spark)
    found = connectivity.correlograms(df, "counts", **PARAMS)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert _same(found, connectivity.ccg_counts(spikes=df, width=110, **PARAMS))


def test_sums_over_recordings_are_those_of_the_sql(spark, capsys):
    df = _spikes(spark)
    found = connectivity.correlograms(df, "sum", **PARAMS)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert _same(found, connectivity.ccg_sum(ccg=connectivity.ccg_counts(spikes=df, width=110, **PARAMS)))


def test_links_of_rows_that_stand_together(spark):
    rng, rows = random.Random(5), []
    for k in range(300):  # unit 2 fires one or two bins after unit 1; units 3 and 4 by chance
        at = k * 1000 + rng.randrange(200)
        rows += [("x", 1, at), ("x", 2, at + 30), ("x", 3, rng.randrange(300_000)), ("x", 4, rng.randrange(300_000))]
    df = spark.createDataFrame(rows, "rec string, unit long, tick long")
    counts = connectivity.correlograms(df, bin=20, half=50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # pairs go over the ends of batches
    try:
        together = sorted(map(tuple, connectivity.ccg_links(counts, together=True).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ("x", 1, 2, 1) in together
    assert together == sorted(map(tuple, connectivity.ccg_links(counts).collect()))


def test_links_are_found_without_the_rows_of_other_pairs(spark):
    rng, rows = random.Random(6), []
    for k in range(200):  # unit 2 fires one bin after unit 1, units 3 to 89 by chance
        at = k * 1000 + rng.randrange(200)
        rows += [("x", 1, at), ("x", 2, at + 20)] + [("x", rng.randrange(3, 90), rng.randrange(200_000))]
    df = spark.createDataFrame([(r, u, t * 3_000_000) for r, u, t in rows], "rec string, unit long, tick long")
    held = connectivity.Held(df)
    counts = connectivity.correlograms(held)
    found = sorted(map(tuple, connectivity.ccg_links(counts, together=True, held=held).collect()))
    assert ("x", 1, 2, 1) in found
    assert found == sorted(map(tuple, connectivity.ccg_links(counts).collect()))
    few = connectivity.correlograms(held, "likely")
    assert 0 < few.count() < counts.where("a <> b").count() / 2  # all rows were made before


def test_grid_is_that_of_the_sql(spark, capsys):
    df = _spikes(spark)
    found = connectivity.correlograms(df, "grid", **PARAMS)
    found.explain()
    assert "Join" not in capsys.readouterr().out
    counts = connectivity.ccg_counts(spikes=df, width=110, **PARAMS)
    assert _same(found, connectivity.ccg_grid(ccg=counts, spikes=df.where("rec IS NOT NULL AND tick IS NOT NULL"), **PARAMS))


def test_covariance_with_fewer_bins_than_units_by_the_small_matrix():
    import numpy as np

    from tremolo.operators.connectivity import _times_pinv

    rng, eps = np.random.default_rng(3), np.finfo(float).eps
    for bins, units in ((12, 30), (30, 12), (20, 20)):
        x = rng.poisson(0.5, (bins, units)).astype(float)
        cx, f = x - x.mean(0), np.maximum(x - 0.5, 0) - np.maximum(x - 0.5, 0).mean(0)
        assert np.allclose(_times_pinv(cx, f, units * eps), cx @ np.linalg.pinv(f.T @ cx, rcond=units * eps))


def test_sums_stand_by_lag_and_a_large_unit_goes_in_steps():
    m = 3000
    trains = kernels.Trains(np.zeros(m, int), np.arange(m) % 2, np.arange(m))
    tracemalloc.start()
    _, a, b, lag, n = (np.concatenate(x) for x in zip(*kernels.counts(trains, np.array([True, True]), 60, 50, False), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Runs of a lag take no room in a file; by b first, its lags took three tenths of it.
    assert np.array_equal(np.lexsort((b, lag, a)), np.arange(len(a)))
    far = np.subtract.outer(np.arange(m), np.arange(m))
    for x, y, z in ((0, 0, 0), (0, 1, 3), (1, 0, -50), (1, 1, 50)):
        d = far[x::2, y::2]
        d = -np.floor(0.5 + d / 60)[(d != 0) & (abs(d) <= 60 * 50.5)]
        assert n[(a == x) & (b == y) & (lag == z)].sum() == (d == z).sum()
    assert n.sum() == m * (m - 1) and peak < 100e6  # 189 MB in one step
