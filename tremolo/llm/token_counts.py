"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then answer, for
every context limit, how many documents and tokens lie above it and what truncation leaves.
The histogram has one row for each distinct length, so all that follows is small beside the
corpus. Suffix sums have two levels, blocks of lengths and lengths within a block, so no task
holds all lengths.

Defined results of odd inputs: null and empty texts have length 0 and are counted; repeated
rows are counted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import codec, default_path
from .common import Scratch, ship

BLOCK = 1024


def token_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row (length) for each document: the tokens of its whole text."""
    ship(docs.sparkSession)
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(c.encode(t)) // 4 for t in b.column(0).to_pylist()], pa.int64())], names=["length"])

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "length bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, docs) of ``lengths(length)``."""
    return lengths.where("length IS NOT NULL").groupBy("length").agg(F.count("*").alias("docs"))


def context_report(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: docs of that length, docs_over and tokens_over (those
    that are longer), truncated_tokens (sum of min(length, limit)), whole_share (documents that
    fit whole; the q-quantile is the least limit with whole_share >= q), and the totals."""
    spark = hist.sparkSession
    hist = Scratch(spark, "lengths").keep(hist.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block")), "histogram")
    # One row for each BLOCK lengths: at most the longest document / BLOCK rows.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_behind"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_behind"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    within = hist.withColumn("d", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("t", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    over, more = F.col("d") + F.col("docs_behind"), F.col("t") + F.col("tokens_behind")
    return within.join(blocks, "block").select(
        F.col("length").alias("context_limit"), "docs", over.alias("docs_over"), more.alias("tokens_over"), (F.col("total_tokens") - more + F.col("length") * over).alias("truncated_tokens"),
        ((F.col("total_docs") - over) / F.col("total_docs")).alias("whole_share"), "total_docs", "total_tokens",
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """(total_tokens, truncated_tokens, docs_over) for one limit, any number."""
    n = F.col("length") * F.col("docs")
    return hist.agg(F.sum(n).alias("total_tokens"), F.sum(F.least("length", F.lit(limit)) * F.col("docs")).alias("truncated_tokens"), F.sum(F.when(F.col("length") > limit, F.col("docs")).otherwise(0)).alias("docs_over"))


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that a share of all documents doesn't exceed."""
    return report.agg(*[F.min(F.when(F.col("whole_share") >= q, F.col("context_limit"))).alias(f"q{k}") for k, q in enumerate(shares)]).select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{k}").alias("length")) for k, q in enumerate(shares)])).alias("x")).select("x.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return context_report(histogram(token_lengths(docs)))
