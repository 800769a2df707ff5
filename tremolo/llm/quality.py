"""Quality classifier: an additive model over statistics of the text alone.

Labels come from documents whose crc32(doc_id as text) mod 4 is not 2; the others are held
out. The model is fitted on at most ``max_rows`` labelled documents, those with the least hash
of their id; everything else sees all rows. Label, language, source and id are no features.

Defined results of odd inputs: null and empty texts are scored by the features of an empty
text; a null id is never held out and never learnt from; null labels are no labels; a document
with several labels counts once for each; without labels the score is a constant.
"""

from __future__ import annotations

from collections import Counter
from math import log
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .gam import Gam, fit

FEATURES = (
    "log_words word_length distinct_words distinct_pairs repeats top_word upper title alpha digits symbols symbol_kinds symbol_tails bangs stops commas line_words top_line short_lines word_entropy"
).split()
SYMBOLS = "#%&$*|~^_=+<>@\\{}[]/"  # ASCII marks that prose has few of
_SYMBOLS, _TAILS = str.maketrans("", "", SYMBOLS), frozenset(SYMBOLS)


def features(text: str | None) -> list[float]:
    """The statistics of one whole text, each a share or a mean so that length alone says little."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    many = Counter(lines).most_common(1)
    c = text.count
    marks = len(text) - len(text.translate(_SYMBOLS))
    return [
        float(np.log1p(n)),
        len(text) / n,
        len(count) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(eq, words, words[1:])) / n,
        max(count.values()) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isdigit, words)) / n,
        marks / n,
        float(sum(x in text for x in SYMBOLS)) if marks else 0.0,
        sum(w[-1] in _TAILS for w in count) / len(count) if marks else 0.0,
        c("!") / n,
        c(".") / n,
        c(",") / n,
        n / max(1, len(lines)),
        many[0][1] / len(lines) if many else 0.0,
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        1.0 - sum(v * log(v) for v in count.values() if v > 1) / (n * log(n)) if n > 1 else 1.0,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Gam:
    """``labels(id_col, label_col)`` of documents that aren't held out, ``max_rows`` at most."""
    ship(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = known.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("label_id"), "label_id", "y").limit(max_rows)
    # max_rows bounds this side, ids and labels of 16 bytes each, and once more the rows that
    # it finds, as ids can repeat.
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_key"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("doc_key") == F.col("label_id"))
    got = rows.select("doc_key", "y", _features("text").alias("x")).orderBy(F.xxhash64("doc_key", "y", "x"), "doc_key").limit(max_rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    got = got.assign(k=[tuple(v) for v in got["x"]]).sort_values(["doc_key", "y", "k"])  # the same order in every run
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def scorer(model: Gam):  # noqa: ANN201
    """A column function: text -> score between 0 and 1."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts.tolist())))

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= threshold); input columns of
    these names are replaced."""
    model = train(docs, labels, id_col, text_col, label_col, max_rows)
    out = docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", scorer(model)(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
