"""Close units found in workers against the SQL operator."""

import random

from tremolo.operators import spikes


def test_pairs_are_those_of_the_sql_and_are_not_joined(spark, capsys):
    rng = random.Random(2)
    rows = [(k // 2, rng.choice([0.1, 0.2, rng.random()]), rng.random()) for k in range(120)]
    places = spark.createDataFrame([*rows, (None, 0.1, 0.1), (200, None, 0.1), (201, float("nan"), 0.1)], "unit long, x double, y double")
    found, wanted = spikes.units_between(places), spikes.close_units(places=places)
    found.explain()
    assert "Join" not in capsys.readouterr().out and "Exchange" not in capsys.readouterr().out
    assert found.dtypes == wanted.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
