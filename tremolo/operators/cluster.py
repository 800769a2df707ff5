"""What operators with Python kernels or rounds need from the cluster: code and written rounds."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's files, once, so that workers can import kernels."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tremolo-kernels-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "tremolo_kernels.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def cut(df: DataFrame) -> DataFrame:
    """Writes a round to the checkpoint folder and drops its lineage; a temporary folder is set
    only where the session names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tremolo-rounds-"))
    return df.checkpoint()
