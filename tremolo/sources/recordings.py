"""Spike-sorted recording folders, lookup tables and graph files as sources and sinks.

A recording is a folder with ``spike_times.npy`` (ticks), ``spike_templates.npy`` (from 0),
``templates.npy`` (template x sample x electrode), ``channel_positions.npy`` (electrode x 2) and
``params.py`` (a line that begins with ``sample`` and gives the sampling rate). ``root`` may be a glob,
so one call reads any number of recordings; ``rec`` is the folder's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .npy import read_arrays

_REC = r"^(.*)/[^/]+$"


def sampling_rates(spark: SparkSession, root: str) -> DataFrame:
    """(rec, rate): from the first line of params.py that begins with ``sample``; the number stands
    behind ``=``. A file without such a line gives no row."""
    files = spark.read.format("binaryFile").load(f"{root}/params.py")
    lines = F.filter(F.split(F.decode("content", "UTF-8"), r"\r?\n"), lambda x: x.startswith("sample") & x.contains("="))
    rate = F.regexp_extract(F.get(lines, F.lit(0)), r"=\s*([0-9.eE+]+)", 1)
    return files.select(F.regexp_extract("path", _REC, 1).alias("rec"), rate.try_cast("double").alias("rate")).where("rate > 0")


def spikes(spark: SparkSession, root: str) -> DataFrame:
    """(rec, unit, tick, seconds): unit is the template's number from 1; seconds are ticks over the
    sampling rate, null where that is unknown. The two files of a recording are joined by place."""
    times = read_arrays(spark, f"{root}/spike_times.npy").select(F.regexp_extract("path", _REC, 1).alias("rec"), (F.col("i") + F.col("j")).alias("at"), F.coalesce("whole", F.col("value").cast("bigint")).alias("tick"))
    units = read_arrays(spark, f"{root}/spike_templates.npy").select(F.regexp_extract("path", _REC, 1).alias("rec"), (F.col("i") + F.col("j")).alias("at"), (F.coalesce("whole", F.col("value").cast("bigint")) + 1).alias("unit"))
    both = times.join(units, ["rec", "at"]).join(F.broadcast(sampling_rates(spark, root)), "rec", "left")  # a row for each folder
    return both.select("rec", "unit", "tick", (F.col("tick") / F.col("rate")).alias("seconds"))


def templates(spark: SparkSession, root: str) -> DataFrame:
    """(rec, unit, i, electrode, v) of the templates; samples that are 0 on all electrodes of all
    units of a recording (padding) are left out, and the others renumbered from 0."""
    values = read_arrays(spark, f"{root}/templates.npy").select(F.regexp_extract("path", _REC, 1).alias("rec"), (F.col("i") + 1).alias("unit"), F.col("j").alias("sample"), F.col("k").alias("electrode"), F.col("value").alias("v"))
    used = values.where("v <> 0").select("rec", "sample").distinct()
    place = used.select("rec", "sample", (F.row_number().over(Window.partitionBy("rec").orderBy("sample")) - 1).alias("i"))
    return values.join(place, ["rec", "sample"]).select("rec", "unit", "i", "electrode", "v")


def positions(spark: SparkSession, root: str) -> DataFrame:
    """(rec, electrode, x, y) of the electrodes."""
    values = read_arrays(spark, f"{root}/channel_positions.npy").select(F.regexp_extract("path", _REC, 1).alias("rec"), F.col("i").alias("electrode"), "j", "value")
    return values.groupBy("rec", "electrode").agg(F.max(F.when(F.col("j") == 0, F.col("value"))).alias("x"), F.max(F.when(F.col("j") == 1, F.col("value"))).alias("y"))


def path_metadata(rec: Column, parts: dict[str, int], required: tuple[str, ...] = ()) -> Column:
    """Struct of parts of a folder's path by index, negative ones from the end. A ``required`` part that
    is missing or empty raises an error."""
    pieces = F.filter(F.split(rec, "/"), lambda x: x != "")
    fields = []
    for name, at in parts.items():
        value = F.try_element_at(pieces, F.lit(at + 1 if at >= 0 else at))
        if name in required:
            value = F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.raise_error(F.concat(F.lit(f"no {name} in "), rec)))
        fields.append(value.alias(name))
    return F.struct(*fields)


def save_recordings(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes ``rows`` (with a column rec) as Parquet by recording. Recordings that are there already
    are left as they are, or replaced with ``overwrite``. Returns the recordings written."""
    spark = rows.sparkSession
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    if known and not overwrite:
        there = spark.read.parquet(path).select("rec").distinct()
        rows = rows.join(there, "rec", "left_anti")
    new = rows.select("rec").distinct()
    new = spark.createDataFrame(new.collect(), new.schema)  # a row for each folder
    rows.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy("rec").parquet(path)
    return new


def load_recordings(spark: SparkSession, path: str, min_units: int = 0, without: tuple[str, ...] = ()) -> DataFrame:
    """Saved recordings with more than ``min_units`` units, without the columns ``without``."""
    rows = spark.read.parquet(path).drop(*without)
    kept = rows.groupBy("rec").agg(F.count_distinct("unit").alias("n")).where(F.col("n") > min_units).select("rec")
    return rows.join(kept, "rec", "left_semi")


def read_matrix(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """A CSV file with a header: numeric columns as doubles, and the column ``label`` as an integer."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast("int" if c == label else "double").alias(c) for c in raw.columns])


def write_pajek(edges: DataFrame, nodes: DataFrame, path: str, arcs: bool = False) -> None:
    """A Pajek file of ``edges(src, dst, w)`` and ``nodes(id)``, as one sorted text table: vertices are
    numbered from 1 in order of id; ``arcs`` writes both directions, else each edge once. Rows are
    dealt by range and keep their order; the folder's parts make up the file."""
    n = nodes.count()
    # Numbers from ranges: counts of the ranges before, and places inside one.
    ranged = nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    counts = ranged.groupBy("part").agg(F.count("*").alias("k"), F.min("pos").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    number = ranged.join(F.broadcast(counts.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))), "part").select("id", (F.col("before") + F.col("pos") - F.col("first") + 1).alias("v"))
    a, b = number.select(F.col("id").alias("src"), F.col("v").alias("a")), number.select(F.col("id").alias("dst"), F.col("v").alias("b"))
    linked = edges.join(a, "src").join(b, "dst").where(F.lit(arcs) | (F.col("a") <= F.col("b")))
    lines = edges.sparkSession.createDataFrame([(0, 0, 0, f"*vertices {n}"), (2, 0, 0, "*arcs" if arcs else "*edges")], "s int, a bigint, b bigint, line string")
    lines = lines.unionByName(number.select(F.lit(1).alias("s"), F.col("v").alias("a"), F.lit(0).cast("bigint").alias("b"), F.concat(F.col("v").cast("string"), F.lit(' "'), F.col("id").cast("string"), F.lit('"')).alias("line")))
    lines = lines.unionByName(linked.select(F.lit(3).alias("s"), "a", "b", F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string"), F.col("w").cast("string")).alias("line")))
    lines.repartitionByRange("s", "a", "b").sortWithinPartitions("s", "a", "b").select("line").write.mode("overwrite").text(path)
