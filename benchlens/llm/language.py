"""Language identification by hierarchical discrimination.

The family of a text is predicted first; within the family, one linear support
vector machine for every two languages votes. All machines work on the same
hashed word and character n-gram averages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.shipping import ship
from benchlens.llm.subwords import AverageScorer, Features, Vector, collect_vectors, sample
from benchlens.llm.words import slices

PER_LANGUAGE = 1500  # texts of each language that are fitted
UNKNOWN = "und"

# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "da de en is nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "ar he mt",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


@dataclass
class Model:
    """Columns of ``table``: one machine per family against the rest, then one per two languages of a family."""

    features: Features
    table: np.ndarray
    scale: np.ndarray  # margin of each machine at which its odds rise by e
    families: list[str]
    members: dict[str, list[str]]
    duels: dict[tuple[str, str], int]

    def decide(self, average: np.ndarray) -> list[tuple[str, float]]:
        """(language, probability) of each row of averaged scores."""
        z = np.clip(average / self.scale, -30, 30)
        n = len(self.families)
        p = 1 / (1 + np.exp(-z))
        odds = np.exp(z[:, :n] - z[:, :n].max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        out = []
        for row, best in enumerate(odds.argmax(axis=1)):
            own = self.members[self.families[best]]
            votes = {a: [0, 0.0] for a in own}  # duels won, sum of their probabilities
            for a, b in combinations(own, 2):
                won = float(p[row, self.duels[a, b]])
                for lang, share in ((a, won), (b, 1 - won)):
                    votes[lang][0] += share >= 0.5
                    votes[lang][1] += share
            lang = max(own, key=lambda a: (votes[a], a))
            sure = votes[lang][1] / (len(own) - 1) if len(own) > 1 else 1.0
            out.append((lang, float(odds[row, best]) * sure))
        return out


def _machine(docs: Sequence[Vector], rows: np.ndarray, norms: np.ndarray, signs: np.ndarray, size: int, rng: np.random.Generator,
             decay: float = 1e-4, epochs: int = 8) -> np.ndarray:
    """Linear support vector machine by stochastic subgradients over ``rows`` of ``docs``, both sides weighted alike."""
    w, scale = np.zeros(size), 1.0
    cost = np.where(signs > 0, 0.5 / max((signs > 0).mean(), 1e-9), 0.5 / max((signs < 0).mean(), 1e-9))
    t = 1.0 / decay / 10
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (decay * t)
            bucket, x = docs[rows[i]]
            x = x / norms[rows[i]]
            margin = signs[i] * scale * (x @ w[bucket])
            scale *= 1 - rate * decay
            if margin < 1:
                w[bucket] += rate * cost[i] * signs[i] / scale * x
    return w * scale


def own_features() -> Features:
    return Features(bits=16, spans=(1, 2, 3, 4))


def _vector(features: Features, text: str) -> Vector:
    return features.of_text(_cut(text), _extra(features))


def train(raw: Sequence[Vector], langs: list[str], features: Features, seed: int = 5) -> Model:
    """Fit all machines to the feature vectors of texts."""
    rng = np.random.default_rng(seed)
    size = 1 << features.bits
    norms = np.array([np.sqrt(w @ w) for _, w in raw], np.float32)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family(lang), []).append(lang)
    families = sorted(members)
    own = np.array([family(x) for x in langs])
    names = np.array(langs)
    columns, scale, duels = [], [], {}

    def add(use: np.ndarray, signs: np.ndarray) -> None:
        rows = np.flatnonzero(use)
        w = _machine(raw, rows, norms, signs[rows], size, rng) if len(set(signs[rows])) > 1 else np.zeros(size)
        columns.append(w)
        margins = np.array([abs(x @ w[bucket]) for bucket, x in (raw[i] for i in rows)])  # averages, as in prediction
        scale.append(max(float(np.median(margins)) / 4, 1e-12) if len(rows) else 1.0)

    for f in families:
        add(np.ones(len(langs), bool), np.where(own == f, 1.0, -1.0))
    for f in families:
        for a, b in combinations(members[f], 2):
            duels[a, b] = len(columns)
            add((names == a) | (names == b), np.where(names == a, 1.0, -1.0))
    return Model(features, np.stack(columns, axis=1), np.array(scale), families, members, duels)


def _cut(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _extra(features: Features) -> dict[int, float]:
    return {features.special("end"): 1.0}


def fit(docs: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from the rows where ``learn_from`` is true and text and language are given.

    Fitted are about ``per_language`` texts of each language, whole and of any
    length, chosen by a hash of the text; equal texts count once. Without such
    rows there is no model (None).
    """
    rows = docs.where(learn_from).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull()).withColumn("_hash", F.xxhash64("_text"))
    # chosen among different texts, so that copies change neither a language's share nor what is fitted
    near = sample(rows.select("_lang", "_hash").distinct(), "_lang", F.col("_hash"), per_language).select("_lang", "_hash")
    got = rows.join(F.broadcast(near), ["_lang", "_hash"]).dropDuplicates(["_lang", "_hash"]).select("_lang", "_hash", "_text")
    features = own_features()
    keys, fitted = collect_vectors(got, features, _vector)
    return train(fitted, keys["_lang"].to_pylist(), features) if fitted else None


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every row's whole text.

    A null text, one without any letter, and every text where there is no
    model is ``und`` with score 0. Rows are kept one to one, repeated rows and
    null ids included; an empty table gives an empty result. ``keep`` must not
    hold the names of the two new columns.
    """
    src = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    if model is None:
        return src.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = ship(docs.sparkSession, model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        scorer = AverageScorer(own.features, own.table)
        extra = _extra(own.features)
        for b in slices(batches):
            texts = b.column(len(keep)).to_pylist()
            got = own.decide(scorer.average([_cut(t) for t in texts], [extra] * len(texts)))
            got = [g if t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t, g in zip(texts, got)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
