"""Time-series features of many series: one grouped map for each series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.series import FEATURES, features
from .cluster import ship

NAMES = (*FEATURES, "DN_Mean", "DN_Spread_Std")


def series_features(points: DataFrame) -> DataFrame:
    """``points(id, t, x)`` -> id, n and a column for each feature. Points are taken in order of
    t, then x; one series lies in one task. The kernels take much more time than their rows have bytes,
    so the tasks are dealt by a fixed number, which adaptive execution doesn't join by size."""
    spark = points.sparkSession
    ship(spark)
    kind = points.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["t", "x"])["x"].to_numpy(dtype=float)
        return pd.DataFrame([{"id": pdf["id"].iloc[0], "n": len(x), **features(x)}])

    dealt = points.select("id", "t", "x").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.groupBy("id").applyInPandas(run, f"id {kind}, n long, " + ", ".join(f"`{n}` double" for n in NAMES))
