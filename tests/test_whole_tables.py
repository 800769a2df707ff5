"""Queries over whole tables: no unit and no source is left out."""

import duckdb
import numpy as np
import pytest

from tremolo.functions.connectivity import link_candidates, significant_links
from tremolo.operators.connectivity import ccg_links, differential_covariance
from tremolo.plans import registry

WIDE = "/root/testdata/sf0.01"  # 150 users


def _users():
    return {r[0] for r in duckdb.sql(f"SELECT DISTINCT user_id FROM '{WIDE}/events.parquet'").fetchall()}


def test_links_of_any_unit_without_the_grid(spark):
    rng = np.random.default_rng(5)
    rows, wanted = [], set()
    for a, b in ((60, 70), (70, 60), (900, 901), (5, 6)):
        x = rng.poisson(0.3 if a != 5 else 30, 101)
        if a < b:
            x[52] = 9 if a != 5 else 0
        rows += [("r", a, b, k - 50, int(n)) for k, n in enumerate(x) if n]
        if s := significant_links(x.astype(float)):
            wanted.add((a, b, s))
    assert {(60, 70), (900, 901), (5, 6)} == {w[:2] for w in wanted}
    found = ccg_links(spark.createDataFrame(rows, "rec string, a long, b long, lag_bin int, n long")).collect()
    assert {(r["a"], r["b"], r["sign"]) for r in found} == wanted


def test_no_link_is_lost_before_the_test():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.poisson(m, (150, 101)) for m in (0.01, 0.1, 1, 10, 12)]).astype(float)
    x[::3, 52] *= 6
    x[1::3, 53] = 0
    x[2::5, 51] += 3
    sign = np.array([significant_links(r) for r in x])
    assert (sign > 0).any() and (sign < 0).any()
    assert link_candidates(x)[sign != 0].all()


def test_links_query_reads_every_unit(spark, monkeypatch):
    monkeypatch.setattr(registry.connectivity, "ccg_links", lambda counts, **_: counts)
    assert {r["a"] for r in registry.QUERIES["ccg_links"](spark, WIDE).select("a").distinct().collect()} == _users()


def test_covariance_of_every_unit(spark):
    found = registry.QUERIES["differential_covariance"](spark, WIDE)
    per = {r["rec"]: (r["a"], r["n"]) for r in found.groupBy("rec").agg({"a": "count", "b": "max"}).toDF("rec", "n", "a").collect()}
    units = dict(duckdb.sql(f"SELECT event_type, count(DISTINCT user_id) FROM '{WIDE}/events.parquet' GROUP BY 1").fetchall())
    assert {rec: n for rec, (_, n) in per.items()} == {rec: n * n for rec, n in units.items()}


@pytest.mark.parametrize("name", ["tiling_coefficient", "distance_bin", "path_statistics"])
def test_whole_table_queries_reach_every_user(spark, name):
    found = registry.QUERIES[name](spark, WIDE)
    n = len(_users())
    if name == "tiling_coefficient":
        units = [k for (k,) in duckdb.sql(f"SELECT count(DISTINCT user_id) FROM '{WIDE}/events.parquet' GROUP BY event_type").fetchall()]
        assert found.count() == sum(k * (k - 1) // 2 for k in units)
    elif name == "distance_bin":
        assert found.where("d = 0").count() == n
    else:
        assert found.count() > n // 2 and found.where("a >= 5").count() > 0


def test_covariance_is_not_made_as_one_table(spark, capsys):
    rng = np.random.default_rng(3)
    n = rng.poisson(1.0, (30, 7))
    rows = [(r, k, b, int(n[b, k])) for r in ("p", "q") for b in range(30) for k in range(7) if n[b, k] and (r == "p" or k < 5)]
    found = differential_covariance(spark.createDataFrame(rows, "rec string, unit long, bin long, n long"))
    found.explain()
    assert "InPandas" not in capsys.readouterr().out  # one table of all pairs of a recording before
    for r, units in (("p", 7), ("q", 5)):
        x = n[:, :units] * 1.0
        mine = [b for q, _, b, _ in rows if q == r]
        x = x[min(mine) : max(mine) + 1]
        d = np.vstack([(x[2:] - x[:-2])[:1] * 0, (x[2:] - x[:-2]) / 2, x[:1] * 0])
        d[[0, -1]] = d[1:-1].mean(0)
        cx = x - x.mean(0)
        want = ((d - d.mean(0)).T @ cx) @ np.linalg.inv(cx.T @ cx)
        got = {(a, b): w for q, a, b, w in found.collect() if q == r}
        assert len(got) == units * units and all(abs(w - want[k]) < 1e-9 for k, w in got.items())
