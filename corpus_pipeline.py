"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
result is written as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``; the last returns token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm.bpe import encode_documents
from tremolo.llm.common import Scratch
from tremolo.llm.decontaminate import contamination, text_keys
from tremolo.llm.line_dedup import dedup_lines
from tremolo.llm.quality import scorer, train
from tremolo.llm.shingle_dedup import similar_components


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches between JVM and workers are bounded by bytes: of long texts or lists 10,000 rows
    (the default) take hundreds of MB on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more stay."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return docs.where(scorer(train(docs, labels))(F.col("text")) >= 0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; n_chars follows the text."""
    cut = "line_cut" + "_" * max(map(len, docs.columns))  # a name that no column has
    out = dedup_lines(docs, cut_col=cut)
    return out.withColumn("n_chars", F.when(F.col(f"{cut}.chars") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (fingerprints of five-word shingles that differ in 4 bits or
    fewer, or a Jaccard similarity of 0.8 or more, verified on whole texts) the document of the
    least id stays, once. A document is an id and a text: of texts under one id each is judged by
    itself. Rows without an id stay."""
    _small_batches(spark)
    key = F.struct("doc_id", F.xxhash64("text").alias("tk"))
    groups = Scratch(spark, "near").keep(similar_components(docs.where("doc_id IS NOT NULL").select(key.alias("key"), "text"), "key", stand=True).select(F.col("doc_id").alias("key"), F.col("component_id").alias("kept")), "groups")
    gone = groups.where("key <> kept").select("key").distinct()
    rest = _without(docs, gone, "left_anti")
    again = groups.where("key = kept").groupBy("key").count().where("count > 1").select("key")
    if not again.take(1):
        return rest
    # Rows repeated as they are: one of each stays.
    once = _without(rest, again, "left_semi").withColumn("tk" * max(map(len, docs.columns)), F.xxhash64("text"))
    return _without(rest, again, "left_anti").unionByName(once.dropDuplicates(["doc_id", once.columns[-1]]).select(*docs.columns))


def _without(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined by id and hash of the text with ``keys(key)``."""
    keys = keys.select(F.col("key.doc_id").alias("i"), F.col("key.tk").alias("h")).alias("k")
    docs = docs.alias("d")
    return docs.join(keys, (F.col("d.doc_id") == F.col("k.i")) & (F.xxhash64("d.text") == F.col("k.h")), how)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    tk, tl = text_keys(F.col("d.text"))
    found = contamination(docs, items).select("tk", "tl").distinct().alias("f")
    return docs.alias("d").join(found, (tk == F.col("f.tk")) & (tl == F.col("f.tl")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document that is left."""
    return encode_documents(docs, ids=False)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

# Boosting, alignment, components and merges are iterative: no SQL states them. The tests hold
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the folder
    that all machines share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
