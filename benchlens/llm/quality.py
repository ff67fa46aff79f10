"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent.

Hashed word and character n-gram vectors are learnt together with a softmax
output over their average per document. A word that repeats its predecessor
adds one common n-gram, as the pair is the same pattern whatever the word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.shipping import ship
from benchlens.llm.subwords import AverageScorer, Features, Vector, collect_vectors, sample
from benchlens.llm.words import slices

PER_LABEL = 2500  # labelled texts of each label value that are fitted


@dataclass
class Model:
    features: Features
    table: np.ndarray  # buckets x 2: vectors times output weights
    bias: np.ndarray


def _cut(text: str | None) -> list[str]:
    return (text or "").split()


def _extra(features: Features, words: list[str]) -> dict[int, float]:
    """Every text has the end feature, so an empty one has a vector too."""
    return {features.special("end"): 1.0, features.special("same"): float(sum(map(eq, words, words[1:])))}


def _vector(features: Features, text: str) -> Vector:
    words = _cut(text)
    return features.of_text(words, _extra(features, words))


def train(docs: Sequence[Vector], labels: list[int], prior: tuple[float, float], features: Features,
          dim: int = 16, epochs: int = 5, least_steps: int = 2000, rate: float = 2.0, seed: int = 7) -> Model:
    """Fit vectors and output to the feature vectors of documents, by stochastic gradient descent over single ones.

    Few documents are gone through more often, until there are ``least_steps``.
    """
    epochs = max(epochs, -(-least_steps // len(docs)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << features.bits, dim))
    out = np.zeros((dim, 2))
    y = np.array(labels)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - done / steps)
            done += 1
            bucket, weight = docs[i]
            mean = weight @ vectors[bucket]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = out @ p
            out -= lr * np.outer(mean, p)
            vectors[bucket] -= lr * np.outer(weight, back)
    share = np.bincount(y, minlength=2) / len(y)
    return Model(features, vectors @ out, np.log(np.array(prior) / share))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_label: int = PER_LABEL) -> Model | float:
    """Model from ``labels`` (``id_col``, ``label_col`` of 0 or 1) and the texts they name.

    Fitted are about ``per_label`` different texts of each label, whole and of
    any length, chosen by a hash of the text among those that labelled ids have;
    equal texts of one label count once. The label shares of all labelled ids set
    the bias. Labels other than 0 and 1, ids with both labels, null ids and null
    texts are left out; repeated label rows count once. Where a label value is
    missing altogether, the share of label 1 (0.5 without any) is returned
    instead of a model.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        "_id is not null and _label in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where(
        "_label = _most").drop("_most")
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(
        F.col("_text").isNotNull()).withColumn("_hash", F.xxhash64("_text"))
    # ids and hashes only are shuffled; the hashes of the sample are few, so they are broadcast
    named = texts.select("_id", "_hash").distinct().join(known, "_id").select("_label", "_hash").distinct()
    near = sample(named, "_label", F.col("_hash"), per_label).select("_label", "_hash")
    rows = texts.select("_hash", "_text").join(F.broadcast(near), "_hash").dropDuplicates(["_label", "_hash"])
    features = Features()
    keys, fitted = collect_vectors(rows.select("_label", "_hash", "_text"), features, _vector)
    own, total = keys["_label"].to_pylist(), sum(counts.values())
    if len(set(own)) < 2:
        return counts[1] / total
    return train(fitted, own, (counts[0] / total, counts[1] / total), features)


def predict(docs: DataFrame, model: Model | float, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (probability of label 1) of every row's whole text.

    Null and empty texts have only the end feature and get a score too; rows
    are kept one to one, repeated and null ids included; an empty table gives
    an empty result. ``keep`` must not hold a column named ``score``.
    """
    src = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    if isinstance(model, float):
        return src.select(*keep, F.lit(model).alias("score"))
    shared = ship(docs.sparkSession, model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        scorer = AverageScorer(own.features, own.table[:, 1:] - own.table[:, :1])
        for b in slices(batches):
            texts = [_cut(t) for t in b.column(len(keep)).to_pylist()]
            z = scorer.average(texts, [_extra(own.features, ws) for ws in texts])[:, 0] + own.bias[1] - own.bias[0]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                                             names=schema.names)

    return src.mapInArrow(run, schema)
