"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every letter is hashed to one of a few symbols. Two words that are one edit
apart have reduced words that are equal or one edit apart, so it is enough to
make the whole one-edit neighbourhood of each reduced word (short, as there are
few symbols), join it to the reduced vocabulary and check the words themselves.
A reduced word is held as a polynomial over its symbols, which gives all its
neighbours from prefix and suffix sums without building a string.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.session import scratch_path

SYMBOLS = 8  # of the reduced alphabet
LETTERS = "a-zÀ-ÿ"  # of a word, after A-Z are lower-cased
_MOST_WORDS = 500_000  # different words that a task holds before it passes their counts on
_CELLS = 4_000_000  # neighbours made at once
_SALTS = 8

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, id_col: str, text_col: str, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n): every maximal run of letters in the whole texts, with its number of occurrences.

    Only A-Z are lower-cased. ``change`` may turn a word of a text into another
    (given the id and the word). Counts are added up in each task before they
    are shuffled.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]+")
        own: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
                                              names=schema.names)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = Counter(runs.findall((text.as_py() or b"").lower().decode("utf-8", "replace")))
                if change:
                    for w, n in found.items():
                        own[change(i, w)] += n
                else:
                    own.update(found)
                if len(own) > _MOST_WORDS:
                    yield rows()
                    own.clear()
        yield rows()

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    return src.mapInArrow(work, schema).groupBy("word").agg(F.sum("n").alias("n"))


def _symbol(point: int, symbols: int) -> int:
    return zlib.crc32(chr(point).encode("utf-8", "surrogatepass")) % symbols + 1


def _symbols(words: list[str], symbols: int, known: dict[int, int]) -> np.ndarray:
    """Symbols (1 to ``symbols``) of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, at = np.unique(points, return_inverse=True)
    table = np.array([known.setdefault(p, _symbol(p, symbols)) for p in found.tolist()], np.uint64)
    return table[at.reshape(-1)].reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, _BASE, np.uint64))
    return out


def reduced(cells: np.ndarray) -> np.ndarray:
    """The polynomial of each row of symbols."""
    return (cells * _powers(cells.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbourhoods(cells: np.ndarray, symbols: int) -> np.ndarray:
    """Polynomials of each row itself and of all rows one edit away, a column each (some columns repeat others)."""
    m, n = cells.shape
    power = _powers(n + 1)
    terms = cells * power[:n]
    before = np.zeros((m, n + 1), np.uint64)  # sums of the first k terms
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, n:]
    after = whole - before
    out = [whole, before[:, :n] + after[:, 1:] * np.uint64(_BACK)]  # the row, deletions
    for s in range(1, symbols + 1):
        letter = np.uint64(s)
        out.append(whole + (letter - cells) * power[:n])  # replacements (of a symbol by itself: the row)
        out.append(before + letter * power + after * np.uint64(_BASE))  # insertions
    return np.concatenate(out, axis=1)


def _short(keys: np.ndarray) -> np.ndarray:
    """32-bit join keys: few bytes to shuffle, and what they wrongly bring together the words themselves tell apart."""
    return ((keys * np.uint64(_BASE)) >> np.uint64(32)).astype(np.uint32)


def _by_length(batches: Iterable[pa.RecordBatch], most: Callable[[int], int]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Batches of (id, word) as words of one length with their ids, ``most(length)`` words at once."""
    for b in batches:
        ids, words = b.column(0).to_numpy(), b.column(1).to_pylist()
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for n, places in groups.items():
            step = max(1, most(n))
            for at in range(0, len(places), step):
                part = places[at:at + step]
                yield ids[part], [words[i] for i in part]


def keys_of(vocabulary: DataFrame, symbols: int, near: bool) -> DataFrame:
    """(key, id) of each word's reduced form, or with ``near`` of its whole one-edit neighbourhood."""
    schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("id", T.LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        width = lambda n: (2 * n + 1) * symbols + n + 1 if near else 1
        for ids, words in _by_length(batches, lambda n: _CELLS // (max(n, 1) + width(n))):
            cells = _symbols(words, symbols, known)
            keys = _short(neighbourhoods(cells, symbols) if near else reduced(cells)[:, None])
            keys.sort(axis=1)
            first = np.ones(keys.shape, bool)
            first[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first].view(np.int32)), pa.array(np.repeat(ids, first.sum(axis=1)))], names=schema.names)

    return vocabulary.select("id", "word").mapInArrow(work, schema)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) for all ordered pairs of words of ``vocabulary`` (id, word, n) exactly one edit apart.

    Ids and words must be unique. The keys of a word are different from each
    other, so a pair meets under one key only, and from either side: one of
    the two is checked and returned both ways round. Only ids are shuffled
    with the keys, however long the words are.
    """
    around = keys_of(vocabulary, symbols, True).withColumnRenamed("id", "a")
    own = keys_of(vocabulary, symbols, False).withColumnRenamed("id", "b")
    pairs = around.join(own, "key").where("a < b").select("a", "b")
    words = lambda i, w, n: vocabulary.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(n))
    met = pairs.join(words("a", "word", "n"), "a").join(words("b", "near", "near_n"), "b")
    way = lambda *cols: F.struct(*[F.col(c).alias(name) for c, name in zip(cols, ["word", "n", "near", "near_n"])])
    both = F.array(way("word", "n", "near", "near_n"), way("near", "near_n", "word", "n"))
    return met.where(F.levenshtein("word", "near", 1) == 1).select(F.inline(both))


def chain_ends(links: DataFrame) -> DataFrame:
    """(word, root): where following ``links`` (word, form) ends. Links must not go round in circles.

    Each round doubles the steps of every word that has not arrived; a form
    that many words share is spread over salted copies of its own row.
    """
    spark = links.sparkSession

    def written(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, "chains")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    at = written(links.select("word", F.col("form").alias("root")))
    while True:
        salted = at.withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(_SALTS)))
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"),
                          F.explode(F.array(*[F.lit(k).cast("long") for k in range(_SALTS)])).alias("_salt"))
        step = salted.join(ahead, ["root", "_salt"], "left")
        moved = written(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not moved.where("_moved").limit(1).count():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(counts: DataFrame, least_length: int = 5, least_n: int = 3, times: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """Spelling variants among the words of ``counts`` (word, n): word, form, root, n, n_near, form_n.

    Words have at least ``least_length`` code points and ``least_n``
    occurrences; ``n_near`` counts the words exactly one inserted, deleted or
    replaced code point away. ``form`` is the near word with the largest n
    (ties: the least in code-point order) if that is at least ``times`` n, else
    null; ``root`` is where following the forms ends (the word itself, if it
    has none). Words must be different; a null word or count is no word. An
    empty table gives an empty result; ``times`` must exceed 1, so that forms
    lead upwards. The vocabulary and the forms are written to the shared
    scratch folder.
    """
    if times <= 1:
        raise ValueError("times must exceed 1")
    spark = counts.sparkSession
    vocabulary, forms = scratch_path(spark, "vocabulary"), scratch_path(spark, "forms")
    kept = counts.where((F.col("n") >= least_n) & (F.char_length("word") >= least_length)).select("word", F.col("n").cast("long"))
    kept.withColumn("id", F.monotonically_increasing_id()).write.parquet(vocabulary)
    words = spark.read.parquet(vocabulary)
    best = near_words(words, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("_best"))
    found = words.select("word", "n").join(best, "word", "left")
    enough = -F.col("_best.n") >= times * F.col("n")
    found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                 F.when(enough, F.col("_best.w")).alias("form"), F.when(enough, -F.col("_best.n")).alias("form_n")).write.parquet(forms)
    rows = spark.read.parquet(forms)
    ends = chain_ends(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
