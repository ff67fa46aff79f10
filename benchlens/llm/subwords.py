"""Hashed word and character n-gram features, and linear scores averaged over them.

A word's features are the word itself and the character n-grams of the word
between boundary marks; each is hashed to a bucket. A document is the average
of its features' vectors. Any linear map of that average equals the average of
the mapped vectors, so scoring needs only one small row per distinct word.
"""

from __future__ import annotations

import mmap
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.words import slices

Vector = tuple[np.ndarray, np.ndarray]  # buckets, weights

_FIRST, _LAST = "\x02", "\x03"  # boundary marks
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Buckets of words; ``spans`` are the lengths of the character n-grams."""

    def __init__(self, bits: int = 17, spans: Sequence[int] = (3, 4, 5)):
        self.bits, self.spans = bits, tuple(spans)

    def special(self, name: str) -> int:
        """Bucket of a feature that is not a word."""
        return xxhash.xxh64_intdigest(_LAST + name + _FIRST) >> (64 - self.bits)

    def of_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(position of the word, bucket) of every feature of ``words``."""
        shift = np.uint64(64 - self.bits)
        n = np.array([len(w) + 2 for w in words])
        codes = np.frombuffer("".join([_FIRST + w + _LAST for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = codes.astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(words)), n)
        room = np.repeat(np.cumsum(n), n) - np.arange(codes.size)  # characters from here to the word's end
        whole = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64) >> shift
        at, buckets = [np.arange(len(words))], [whole]
        for span in self.spans:
            if codes.size < span:
                continue
            h = np.full(codes.size - span + 1, np.uint64(span))
            for k in range(span):
                h = (h ^ codes[k:codes.size - span + 1 + k]) * _PRIME
                h ^= h >> np.uint64(29)
            good = room[:h.size] >= span
            at.append(owner[:h.size][good])
            buckets.append((h[good] * _PRIME) >> shift)
        return np.concatenate(at), np.concatenate(buckets).astype(np.int64)

    def of_text(self, words: Sequence[str], extra: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights) of a text's words and extra buckets; the weights sum to 1."""
        tf = Counter(words)
        size = 1 << self.bits
        if tf:
            at, bucket = self.of_words(list(tf))
            bucket, where = np.unique(bucket, return_inverse=True)
            weight = np.bincount(where, np.fromiter(tf.values(), float, len(tf))[at])
        else:
            bucket, weight = np.zeros(0, np.int64), np.zeros(0)
        bucket = np.concatenate([bucket, np.fromiter(extra, np.int64, len(extra)) % size])
        weight = np.concatenate([weight, np.fromiter(extra.values(), float, len(extra))])
        return bucket.astype(np.int32), (weight / max(weight.sum(), 1.0)).astype(np.float32)


class AverageScorer:
    """Average over a text's features of the rows of ``table`` (buckets x scores), with a bounded word cache."""

    def __init__(self, features: Features, table: np.ndarray, max_words: int = 300_000):
        self.features, self.table, self.max_words = features, table.astype(np.float64), max_words
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.table.shape[1] + 1))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.max_words:
            self._reset()
            new = list(words)
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            owner, bucket = self.features.of_words(part)
            first = len(self.place)
            while first + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for k in range(self.table.shape[1]):
                self.rows[first:first + len(part), k] = np.bincount(owner, self.table[bucket, k], len(part))
            self.rows[first:first + len(part), -1] = np.bincount(owner, minlength=len(part))
            self.place.update(zip(part, range(first, first + len(part))))

    def average(self, texts: list[list[str]], extra: list[dict[int, float]]) -> np.ndarray:
        """texts x scores; ``extra`` holds further buckets and their weights for each text."""
        self._learn({w for ws in texts for w in ws})
        place, out = self.place, np.zeros((len(texts), self.table.shape[1]))
        for i, (ws, more) in enumerate(zip(texts, extra)):
            total = self.rows[[place[w] for w in ws]].sum(axis=0) if ws else np.zeros(self.rows.shape[1])
            for bucket, weight in more.items():
                total[:-1] += weight * self.table[bucket]
                total[-1] += weight
            out[i] = total[:-1] / max(total[-1], 1.0)
        return out


class Vectors(Sequence[Vector]):
    """Vectors in a scratch file of this process, so that its memory does not grow with their number and size.

    The file goes with the object. Each access gives views of the mapped file, which no one may write to.
    """

    def __init__(self, vectors: Iterable[Vector]):
        self._file = tempfile.TemporaryFile()
        ends = [0]
        for bucket, weight in vectors:
            self._file.write(bucket.astype(np.int32, copy=False).tobytes())
            self._file.write(weight.astype(np.float32, copy=False).tobytes())
            ends.append(ends[-1] + bucket.size)
        self._file.flush()
        self._ends = np.array(ends)
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ) if ends[-1] else b""

    def __len__(self) -> int:
        return len(self._ends) - 1

    def __getitem__(self, i: int) -> Vector:
        if not 0 <= i < len(self):
            raise IndexError(i)
        first, end = int(self._ends[i]), int(self._ends[i + 1])
        n = end - first
        return np.ndarray(n, np.int32, self._map, 8 * first), np.ndarray(n, np.float32, self._map, 8 * first + 4 * n)


def collect_vectors(rows: DataFrame, features: Features, vector: Callable[[Features, str], Vector],
                    at_once: int = 8192) -> tuple[pa.Table, Vectors]:
    """The columns of ``rows`` but ``_text``, and ``vector`` of each row's whole ``_text``, on the driver.

    For a bounded sample of rows. A text of over ``at_once`` bytes whose vector
    is smaller is sent as that vector, formed in its task: an entry for each
    bucket at most, however long the text. The driver keeps the vectors in a
    scratch file and holds one at a time.
    """
    own = [f for f in rows.schema if f.name != "_text"]
    schema = T.StructType([*own, T.StructField("_text", T.StringType()), T.StructField("_bucket", T.BinaryType()),
                           T.StructField("_weight", T.BinaryType())])

    def form(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            out: list[tuple[str | None, bytes | None, bytes | None]] = []
            for t in b.column(len(own)).to_pylist():
                size = len(t.encode())
                bucket, weight = vector(features, t) if size > at_once else (None, None)
                small = bucket is not None and bucket.nbytes + weight.nbytes < size
                out.append((None, bucket.tobytes(), weight.tobytes()) if small else (t, None, None))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()),
                                              pa.array(cols[2], pa.binary())], names=schema.names)

    got = rows.select(*[f.name for f in own], "_text").mapInArrow(form, schema).toArrow()
    got = got.sort_by([(f.name, "ascending") for f in own])
    docs = Vectors(vector(features, t) if t is not None else (np.frombuffer(b, np.int32), np.frombuffer(w, np.float32))
                   for part in slices(got.select(["_text", "_bucket", "_weight"]).to_batches(), 64)
                   for t, b, w in zip(*(c.to_pylist() for c in part.columns)))
    return got.select([f.name for f in own]), docs


def order_of(key: Column | str) -> Column:
    """Pseudo-random order of a key."""
    return F.xxhash64(F.lit("fit"), key)


def sample(rows: DataFrame, label: str, key: Column, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label value (all, if there are no more), kept with ``_order``.

    A label's share of the hash range is set by its row count, so no label's
    rows meet in one task; rows with equal keys are kept or left out together,
    so make keys distinct first. Expected is ``per_label``; the spread is its root.
    """
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # one row a label value
    limit = F.lit(2.0 ** 64) * F.lit(float(per_label)) / F.col("_n") - F.lit(2.0 ** 63)
    return rows.withColumn("_order", order_of(key)).join(F.broadcast(n), label).where(
        (F.col("_n") <= per_label) | (F.col("_order").cast("double") < limit)).drop("_n")
