"""Per-unit and network features that need a whole train or waveform: one array for each, gathered by
an aggregate and worked on in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectra import SHAPE, regularity, top_power, waveform_shape
from .cluster import ship


def power_qc(waveforms: DataFrame, cutoff: float = 1.3) -> DataFrame:
    """(unit, power, bad_power): the largest power of a Fourier bin of ``waveforms(unit, i, v)``, and
    whether it is over the cutoff (F3). The waveform is taken as it is given (normalised)."""
    return _waves(waveforms, "power double", lambda w: (top_power(w),)).withColumn("bad_power", F.col("power") > cutoff)


def waveform_features(waveforms: DataFrame, rate: float = 20_000.0) -> DataFrame:
    """Eight shape features of each unit's normalised waveform ``waveforms(unit, i, v)`` (P2, X5-X7)."""
    return _waves(waveforms, ", ".join(f"{name} double" for name in SHAPE), lambda w: waveform_shape(w, rate))


def _waves(waveforms: DataFrame, columns: str, work) -> DataFrame:  # noqa: ANN001
    ship(waveforms.sparkSession)
    kind = dict(waveforms.dtypes)["unit"]
    rows = waveforms.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))), lambda s: s["v"]).alias("w"))
    names = ["unit", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [work(w.values.to_numpy(zero_copy_only=False)) for w in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.float64()) for k in range(len(names) - 1))], names=names)

    return rows.mapInArrow(run, f"unit {kind}, {columns}")


def train_regularity(spikes: DataFrame, width: int, peaks: int = 20) -> DataFrame:
    """(rec, unit, frequency, magnitude, fit): regularity of each unit's activity in bins of ``width``
    ticks (P4, X4, X14). A recording lasts to the end of the second of its last spike."""
    return _regularity(spikes, ["rec", "unit"], width, peaks, False)


def network_regularity(spikes: DataFrame, width: int, peaks: int = 20) -> DataFrame:
    """(rec, frequency, magnitude, fit): the same of all spikes of a recording (P5)."""
    return _regularity(spikes, ["rec"], width, peaks, True)


def _regularity(spikes: DataFrame, key: list[str], width: int, peaks: int, network: bool) -> DataFrame:
    ship(spikes.sparkSession)
    kinds = dict(spikes.dtypes)
    length = spikes.groupBy("rec").agg((F.ceil(F.max("tick") / 1e6) * 1_000_000).cast("bigint").alias("stop"))
    # Whole bins of the recording; its very end belongs to the last one.
    bins = spikes.where("tick >= 0").join(length, "rec").withColumn("bins", F.floor(F.col("stop") / width)).where("bins > 0")
    bins = bins.where(F.col("tick") <= F.col("bins") * width).withColumn("bin", F.least(F.floor(F.col("tick") / width), F.col("bins") - 1))
    counted = bins.groupBy(*key, "bins", "bin").agg(F.count("*").alias("n"))
    rows = counted.groupBy(*key, "bins").agg(F.collect_list("bin").alias("bin"), F.collect_list("n").alias("n"))
    names = [*key, "frequency", "magnitude", "fit"]
    d = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                counts = np.zeros(b.column(d)[k].as_py())
                counts[b.column(d + 1)[k].values.to_numpy()] = b.column(d + 2)[k].values.to_numpy()
                out.append(regularity(counts, width / 1e6, peaks, network))
            yield pa.RecordBatch.from_arrays([*b.columns[:d], *(pa.array([r[k] for r in out], pa.float64()) for k in range(3))], names=names)

    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", frequency double, magnitude double, fit double"
    return rows.select(*key, "bins", "bin", "n").mapInArrow(run, schema)
